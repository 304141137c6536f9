"""Row windows of CSV files in file order, from counts of records per split and their running sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.sources.tables import MissingColumns, scratch, written

SPLIT = 64 << 20  #: bytes of a split
_NOTHING = "\x00\x00"  # stands for an empty field without quotes, so that a quoted one stays an empty text


def _lines(spark: SparkSession, path: str, split: int) -> DataFrame:
    """(path, block, line): a task reads the lines of its splits in their order. Splits are cut alike in every read of this session."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", split)
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """((path, block), lines) of stretches of one split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(pc.binary_join_element_wise(batch.column("path"), batch.column("block").cast(pa.string()), "\n"))
        at = 0
        for end in runs.run_ends.to_pylist():
            yield (batch.column("path")[at].as_py(), batch.column("block")[at].as_py()), batch.column("line").slice(at, end - at)
            at = end


def _count(batches):
    """One row per split: whether it holds an odd number of quotes, and how many records end in it, entered outside and inside of quotes."""
    seen: dict[tuple[str, int], list[int]] = {}
    for split, lines in _runs(batches):
        state = seen.setdefault(split, [0, 0, 0])
        quotes = pc.count_substring(lines, '"').to_pylist()
        empty = pc.equal(pc.binary_length(lines), 0).to_pylist()
        for q, e in zip(quotes, empty, strict=True):
            before = state[0]
            state[0] = (state[0] + q) % 2
            for inside in (0, 1):  # a line ends a record outside of quotes, unless it is an empty one between records
                state[1 + inside] += state[0] == inside and not (e and before == inside)
    keys = list(seen)
    yield pa.RecordBatch.from_pydict(
        {"path": pa.array([k[0] for k in keys], pa.string()), "block": pa.array([k[1] for k in keys], pa.int64()), **{n: pa.array([int(seen[k][i]) for k in keys], pa.int64()) for i, n in enumerate(("odd", "outside", "inside"))}}
    )


def _records(entered: dict[tuple[str, int], tuple[int, int, int, int]], start: int, stop: int | None):
    """(record, part, text) of the records of the window; a record that reaches over splits has a part in each. A file's header is its record -1."""
    wanted = lambda own, before: own >= 0 and before + own >= start and (stop is None or before + own < stop)

    def run(batches):
        state: dict[tuple[str, int], list] = {}
        for split, lines in _runs(batches):
            if split not in entered:
                continue
            part, inside, record, ahead = entered[split]
            now = state.setdefault(split, [inside, record, []])
            out = {"record": [], "part": [], "text": []}
            for line in lines.to_pylist():
                before = now[0]
                if not line and not before:
                    continue
                now[0] = (before + line.count('"')) % 2
                now[2].append(line)
                if not now[0]:
                    if wanted(now[1], ahead):
                        out["record"].append(ahead + now[1]), out["part"].append(part), out["text"].append("\n".join(now[2]))
                    now[1], now[2] = now[1] + 1, []
            yield pa.RecordBatch.from_pydict(out, pa.schema([("record", pa.int64()), ("part", pa.int64()), ("text", pa.string())]))
        rest = [(entered[s][3] + now[1], entered[s][0], "\n".join(now[2])) for s, now in state.items() if now[2] and wanted(now[1], entered[s][3])]
        yield pa.RecordBatch.from_pydict({n: [r[i] for r in rest] for i, n in enumerate(("record", "part", "text"))}, pa.schema([("record", pa.int64()), ("part", pa.int64()), ("text", pa.string())]))

    return run


def csv_window(spark: SparkSession, path: str, columns: list[str], start: int = 0, stop: int | None = None, split: int = SPLIT, number: str | None = None) -> DataFrame:
    """Selected columns, as strings, of the data rows number start to stop (from 0, exclusive) of CSV files with a header each, in the order of files by path and of rows inside them.

    One pass counts records per split, so that line breaks inside quotes end no record wherever a split is cut; quotes are doubled inside quotes, and empty lines between records
    don't count. A row per split comes to the driver. The second pass reads the files that the window touches, and parses no lines of splits outside it. `number` names a column for the
    row's number. Missing columns raise MissingColumns. The window is written to the shared folder, as the splits are cut in a session of its own.
    """
    if start < 0 or (stop is not None and stop < start):
        raise ValueError("0 <= start <= stop is needed")
    own = spark.newSession()
    lines = _lines(own, path, split)
    counts = sorted((r["path"], r["block"], r["odd"], r["outside"], r["inside"]) for r in lines.mapInArrow(_count, "path string, block long, odd long, outside long, inside long").collect())
    entered, ahead, record, inside, last = {}, 0, -1, 0, None
    for part, (file, block, odd, outside, within) in enumerate(counts):
        if file != last:
            ahead, record, inside, last = ahead + max(record + inside, 0), -1, 0, file  # a record that is never closed is one
        ends = within if inside else outside
        if ahead + record + ends >= start and (stop is None or ahead + max(record, 0) < stop):
            entered[file, block] = part, inside, record, ahead
        record, inside = record + ends, inside ^ odd
    touched = {file for file, _ in entered}
    header = own.read.option("header", True).csv(path).columns if counts else []
    missing = [c for c in columns if c not in header]
    if missing:
        raise MissingColumns(", ".join(missing))
    where = F.col("path").isin(sorted(touched)) & F.col("block").isin(sorted({b for _, b in entered}))
    got = lines.where(where).mapInArrow(_records(entered, start, stop), "record long, part long, text string")
    whole = got.groupBy("record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("text"))
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in header)
    row = F.from_csv("text", schema, {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "nullValue": _NOTHING})
    kept = whole.select(*([F.col("record").alias(number)] if number else []), row.alias("r")).select(*([number] if number else []), *[F.col("r")[c].alias(c) for c in columns])
    place = scratch(spark)
    return spark.read.schema(written(kept, place).schema).parquet(place)
