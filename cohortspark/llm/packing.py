"""Bounded-space online packing of tokenised documents into sequences.

Each partition keeps a fixed number of open windows. A document's tail goes into the fullest window that can hold it; when none can,
the fullest is filled up (or, with a gap of a few tokens, closed as it is) and emitted. What stays open at a partition's
end is merged with that of neighbouring partitions.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import flat_bytes, partitions, prefix_sums, query, span_hashes, table, text_chunks

WINDOW = 4096
END = 2  #: the id after each document's own ids
OPEN = 8  #: open windows per partition
SMALL_GAP = 16  #: smaller gaps are padded rather than filled with a scrap
MERGED = 4  #: partitions whose leftovers are merged together

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Control characters, the apostrophe (contractions) and < (special tokens) go the slow way, as do all bytes of
# letters beyond U+00FF, of symbols and of signs that normalisation could change.
_PLAIN = np.ones(256, bool)
_PLAIN[[*range(0, 9), 11, 12, *range(14, 32), 39, 60, 127, *range(0xC0, 0xC3), *range(0xC4, 256)]] = False


_WORD_END = b"\x00"  # no plain text holds it
_SLICE = 1 << 20  # bytes of words compared at once


def _same(one: np.ndarray, at: np.ndarray, two: np.ndarray, at_two: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from `at` on in one buffer equal those from `at_two` on in the other, for each span."""
    out = np.ones(len(n), bool)
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - n[lo] + _SLICE, side="right")))
        m = n[lo:hi]
        inside = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        differ = one[np.repeat(at[lo:hi], m) + inside] != two[np.repeat(at_two[lo:hi], m) + inside]
        out[lo + np.repeat(np.arange(hi - lo), m)[differ]] = False
        lo = hi
    return out


class WordTokenizer:
    """Ids of texts exactly as the vocabulary file's own tokenizer gives them, with each distinct word encoded once.

    Plain texts (ASCII and U+00C0 to U+00FF) are cut into runs of letters, single digits and runs of signs; each is looked up by hash
    in a bounded cache, which keeps the word itself, and compared with it byte by byte. Texts with a word whose hash is another word's, and all
    that aren't plain, go through the tokenizers library whole.
    """

    def __init__(self, path: str, most: int = 1_000_000, most_bytes: int = 1 << 26):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {}
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        for token, i in vocab.items():
            if not token.startswith("<|"):
                core = token.removesuffix("</w>")
                self.last[i] = core != token
                ranks[bytes(back[c] for c in core) + _WORD_END * (core != token)] = i
        if any(bytes([b]) + _WORD_END not in ranks for b in range(256)):
            raise ValueError("the vocabulary needs every byte at a word's end")
        self.ranks = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.most, self.most_bytes = most, most_bytes
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1024, np.uint32), 0
        self.words, self.word_at, self.word_n = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other and each one's number, merged by byte-pair ranks with a final byte that stands for a word's end."""
        ids = np.array(self.ranks.encode_ordinary(b"".join(w + _WORD_END for w in words).decode()), np.uint32)
        return ids, np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        ids, n = self._encoded(words)
        total = len(ids)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + total + 65536, np.uint32)])
        self.ids[self.used : self.used + total] = ids
        word_n = np.fromiter(map(len, words), np.int64, len(words))
        more = {"keys": keys, "at": self.used + np.cumsum(n) - n, "n": n, "word_at": len(self.words) + np.cumsum(word_n) - word_n, "word_n": word_n}
        self.used += total
        self.words = np.concatenate([self.words, np.frombuffer(b"".join(words), np.uint8)])
        order = np.argsort(np.concatenate([self.keys, keys]))
        for name, values in more.items():
            setattr(self, name, np.concatenate([getattr(self, name), values])[order])

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        return at, (self.keys[np.minimum(at, max(0, len(self.keys) - 1))] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Each row's ids, with END after them; null counts as empty."""
        data, offsets = flat_bytes(column)
        n = len(offsets) - 1
        odd = np.flatnonzero(~_PLAIN[data] | (data == 0xC3))
        lead = odd[data[odd] == 0xC3]
        after = data[np.minimum(lead + 1, len(data) - 1)] if len(lead) else lead
        plain = np.ones(n, bool)
        not_plain = np.concatenate([odd[data[odd] != 0xC3], lead[(after == 0x97) | (after == 0xB7)]])
        plain[np.searchsorted(offsets, not_plain, side="right") - 1] = False
        data = _LOWER[data]
        up = lead[(after >= 0x80) & (after <= 0x9E)] + 1
        data[up] += 32
        kind = _CLASS[data]
        new = np.ones(len(data) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        new[offsets] = True
        starts = np.flatnonzero(new[:-1] & (kind > 0))
        starts = starts[plain[np.searchsorted(offsets, starts, side="right") - 1]]
        stop = np.flatnonzero(new)
        ends = stop[np.searchsorted(stop, starts, side="right")] if len(starts) else starts
        keys = span_hashes(prefix_sums(data), starts, ends)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        at, known = self._find(distinct)
        if not known.all():
            miss = np.flatnonzero(~known)
            whole = data.tobytes()
            if len(self.keys) + len(miss) > self.most or len(self.words) > self.most_bytes:
                self._forget()
                miss = np.arange(len(distinct))
            self._learn(distinct[miss], [whole[a:b] for a, b in zip(starts[first[miss]], ends[first[miss]], strict=True)])
            at, known = self._find(distinct)
        if len(starts):
            word, size = at[which], ends - starts
            other = self.word_n[word] != size
            alike = np.flatnonzero(~other)
            other[alike] = ~_same(data, starts[alike], self.words, self.word_at[word[alike]], size[alike])
            plain[np.searchsorted(offsets, starts[other], side="right") - 1] = False
        each = self.n[at][which] if len(starts) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(each)])
        where = np.arange(upto[-1]) + np.repeat(self.at[at][which] - upto[:-1], each) if len(starts) else np.zeros(0, np.int64)
        ids = self.ids[where]
        bounds = upto[np.searchsorted(starts, offsets)]
        end = np.array([END], np.uint32)
        out = [np.concatenate([ids[a:b], end]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in np.flatnonzero(~plain):
            out[i] = np.array([*self.whole.encode(column[int(i)].as_py() or "", add_special_tokens=False).ids, END], np.uint32)
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker."""
    return WordTokenizer(path)


class Packer:
    """Places (document, start, ids, total) pieces into windows; emit(window) gets the list of pieces of each closed one."""

    def __init__(self, emit, window: int = WINDOW, most_open: int = OPEN, small_gap: int = SMALL_GAP):
        self.emit, self.window, self.most_open, self.small_gap = emit, window, most_open, small_gap
        self.open: list[tuple[int, list]] = []  # (used, pieces)

    def add(self, doc: int, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self.emit([(doc, start, ids[: self.window], total)])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            fit = max(((used, i) for i, (used, _) in enumerate(self.open) if used + len(ids) <= self.window), default=None)
            if fit:
                used, pieces = self.open[fit[1]]
                pieces.append((doc, start, ids, total))
                self.open[fit[1]] = (used + len(ids), pieces)
                if used + len(ids) == self.window:
                    self.emit(self.open.pop(fit[1])[1])
                return
            if len(self.open) < self.most_open:
                self.open.append((len(ids), [(doc, start, ids, total)]))
                return
            _, i = max((used, i) for i, (used, _) in enumerate(self.open))
            used, pieces = self.open.pop(i)
            gap = self.window - used
            if gap >= self.small_gap:
                pieces.append((doc, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            self.emit(pieces)

    def finish(self) -> None:
        """Close all: what is open is strung together, and the last window is cut at powers of two, which need no padding."""
        flat = [p for _, pieces in sorted(self.open, key=lambda x: -x[0]) for p in pieces]
        self.open = []
        left = sum(len(p[2]) for p in flat)
        room, now = 0, []
        for doc, start, ids, total in flat:
            while len(ids):
                if not room:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                take = min(room, len(ids))
                now.append((doc, start, ids[:take], total))
                start, ids, room, left = start + take, ids[take:], room - take, left - take
                if not room:
                    self.emit(now)
                    now = []


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class _Rows:
    """Pieces of emitted windows as columns."""

    def __init__(self, first_id: int):
        self.id, self.rows = first_id, []

    def __call__(self, window: list) -> None:
        offset = 0
        for doc, start, ids, total in window:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.id, offset))
            offset += len(ids)
        self.id += 1

    def batch(self, **more) -> pa.RecordBatch:
        cols = {n: pa.array(c, pa.int64()) for n, c in zip(_NAMES, zip(*self.rows, strict=True) if self.rows else [[]] * 7, strict=True)}
        n, self.rows = len(self.rows), []
        return pa.RecordBatch.from_pydict(cols | {k: pa.array([v] * n, t) for k, (v, t) in more.items()})


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document (null text: empty) has its ids and END, each in exactly one piece. Sequences hold at most WINDOW ids; a shorter one is
    either a few ids short or as long as a power of two. Sequence ids are unique, not consecutive. A document with a null key keeps
    its tokens under a null doc_id, and rows that repeat a key are packed as often. Keys are whole numbers (another type raises an error). Empty tables give no
    rows; other columns are ignored. The packing follows the input's partitions, so a task that runs again gives the same rows.
    """
    if dict(docs.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{key} must be a whole number, not {dict(docs.dtypes)[key]}")
    n = parts or partitions(docs.sparkSession)

    def first(batches):
        part = TaskContext.get().partitionId()
        words = tokenizer(vocabulary)
        out = _Rows(part << 32)
        packer = Packer(out)
        none = {"kept": (None, pa.binary()), "home": (None, pa.int32())}
        for batch in text_chunks(batches, "t", 1 << 20):
            for doc, ids in zip(batch.column("k").to_pylist(), words.encode(batch.column("t")), strict=True):
                packer.add(doc, 0, ids, len(ids))
            yield out.batch(**none)
        # ids fit 16 bits in every vocabulary of under 65,536 entries, else 32
        left = [(doc, start, ids, total) for _, pieces in packer.open for doc, start, ids, total in pieces]
        cols = {
            "doc_id": pa.array([x[0] for x in left], pa.int64()), "start": pa.array([x[1] for x in left], pa.int64()), "length": pa.array([len(x[2]) for x in left], pa.int64()), "ids_crc32": pa.array([0] * len(left), pa.int64()),
            "doc_tokens": pa.array([x[3] for x in left], pa.int64()), "sequence_id": pa.array([part] * len(left), pa.int64()), "offset": pa.array(range(len(left)), pa.int64()),
            "kept": pa.array([x[2].astype("<u2" if int(x[2].max()) < 1 << 16 else "<u4").tobytes() for x in left], pa.binary()), "home": pa.array([part // MERGED * MERGED] * len(left), pa.int32()),
        }
        yield pa.RecordBatch.from_pydict(cols)

    def merge(batches):
        left: dict[int, list] = {}
        for batch in batches:
            final = batch.column("home").is_null()
            yield batch.filter(final).select(_NAMES)
            for r in batch.filter(pc.invert(final)).to_pylist():
                ids = np.frombuffer(r["kept"], "<u2" if len(r["kept"]) == 2 * r["length"] else "<u4")
                left.setdefault(r["home"], []).append((r["sequence_id"], r["offset"], (r["doc_id"], r["start"], ids, r["doc_tokens"])))
        for home, pieces in sorted(left.items()):
            out = _Rows((1 << 60) + (home << 24))
            packer = Packer(out)
            for _, _, p in sorted(pieces, key=lambda x: (-len(x[2][2]), x[0], x[1])):
                packer.add(*p)
            packer.finish()
            yield out.batch()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    pieces = rows.mapInArrow(first, _SCHEMA + ", kept binary, home int")
    # leftovers meet those of the neighbouring partitions; the rest is spread evenly
    target = F.pmod(F.coalesce(F.col("home"), F.hash("sequence_id", "offset")), F.lit(n)).cast("int")
    out = pieces.repartitionById(n, target).mapInArrow(merge, _SCHEMA)
    return out.withColumnRenamed("doc_id", key) if key != "doc_id" else out


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
