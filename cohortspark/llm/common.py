"""What the operators of this subpackage share: the query table, table reading, Arrow batches, byte hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of this subpackage."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions as the session sets them; they scale with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share; one is made only where the session names none and runs in one process."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, with their lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """The rows written as a table in the shared folder and read again, and aggregates of the written table."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    return kept, kept.agg(*[c.alias(k) for k, c in counts.items()]).first().asDict() if counts else {}


def held_out(doc_id):
    """True where crc32 of doc_id as text has remainder 0 by 5."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def text_chunks(batches: Iterator[pa.RecordBatch], column: str | int, most: int, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most `rows` rows whose texts hold about `most` bytes each; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + most, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Tables of at least `least` rows (the last may be smaller) that hold whole groups, from batches sorted by key."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        rows = pa.Table.from_batches(held)
        g = rows[key].to_numpy()
        end = int(np.searchsorted(g, g[-1]))  # the last group may go on
        if end:
            yield rows.slice(0, end)
            held, n = rows.slice(end).to_batches(), rows.num_rows - end
    if n:
        yield pa.Table.from_batches(held)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column (null: empty) and the n + 1 offsets of its rows."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


# Polynomial hashing of byte spans, modulo 2^64: an odd base has an inverse, so any span's hash comes from prefix sums.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    powers, _ = _grown(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * powers[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes [start, end)."""
    _, inverses = _grown(len(sums))
    return mix((sums[end] - sums[start]) * inverses[start])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows (A-Z in lower case, parted by ASCII white space), and the n + 1 offsets of each row's words."""
    data, offsets = flat_bytes(column)
    data = _LOWER[data]
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = _IN_WORD[data]
    before = ~word[:-1]
    before[offsets[:-1]] = True  # a row's first byte starts a word
    starts = np.flatnonzero(word[1:-1] & before[:-1])
    after = ~word[1:]
    after[offsets[1:]] = True
    ends = np.flatnonzero(word[1:-1] & after[1:]) + 1
    hashes = span_hashes(prefix_sums(data), starts, ends)
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words inside a row (one of all its words, where it has fewer), and the n + 1 offsets of each row's runs."""
    counts = np.diff(offsets)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(out_offsets[-1]) + np.repeat(offsets[:-1] - out_offsets[:-1], runs)
    size = np.repeat(np.minimum(counts, n), runs)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    full = bool((counts[counts > 0] >= n).all())
    for k in range(n):
        part = mix(padded[at + k] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        total += part if full else np.where(size > k, part, np.uint64(0))
    return mix(total), out_offsets
