"""Spelling variants by permuterm rotations: words that differ by one inserted, deleted or replaced code point meet under one prefix.

Every word is closed by a terminator and turned to each of its places. A turned word without its last code point is the range of all
words that carry any other code point at that place; the whole turned word of a shorter one lies at the start of the same range. The ranges are sorted, and a range
holds one entry per letter and one shorter word at most, whatever the corpus.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import flat_bytes, partitions, query, stored, table, text_chunks

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
EDITED = 97  #: a run is changed in a document where this divides the hash of both


def _runs(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row and text of every maximal run of letters (A-Z in lower case, U+00C0 to U+00FF, which are the byte C3 and one more)."""
    data, offsets = flat_bytes(column)
    lead = data == 0xC3
    letter = _LETTER[data] | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = letter[1:] != letter[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    ok = letter[start] if len(start) else np.zeros(0, bool)
    start, end = start[ok], end[ok]
    sizes = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(sizes), pa.py_buffer(_LOWER[data[letter]])])
    return np.searchsorted(offsets, start, side="right") - 1, words.dictionary_encode()


def _counted(batches, divisor: int):
    """(form, n) of the runs of each slice of rows."""
    for batch in text_chunks(batches, "t", 4 << 20):
        row, coded = _runs(batch.column("t"))
        if not len(row):
            continue
        words = coded.dictionary.to_pylist()
        pairs, n = np.unique(row * len(words) + coded.indices.to_numpy(), return_counts=True)
        keys = [f"{k}:".encode() for k in batch.column("k").fill_null("").to_pylist()]
        starts = [crc32(k) for k in keys]
        rows, ids = pairs // len(words), pairs % len(words)
        h = np.fromiter((crc32(words[i], starts[r]) for r, i in zip(rows.tolist(), ids.tolist(), strict=True)), np.int64, len(pairs))
        changed = h % divisor == 0 if divisor else np.zeros(len(h), bool)
        total = np.bincount(ids[~changed], weights=n[~changed], minlength=len(words)).astype(np.int64)
        out, counts = [words[i] for i in np.flatnonzero(total)], total[total > 0].tolist()
        for at in np.flatnonzero(changed):
            word = words[ids[at]].decode()
            cut = int(h[at]) % len(word)
            out.append((word[:cut] + word[cut + 1 :]).encode())
            counts.append(int(n[at]))
        yield pa.RecordBatch.from_pydict({"word": pa.array(out, pa.binary()).cast(pa.string()), "n": pa.array(counts, pa.int64())})


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3, divisor: int = EDITED) -> DataFrame:
    """(word, n) of the words of at least `shortest` code points and `least` occurrences; runs whose hash with the key `divisor` divides lose a code point (0: none do)."""
    rows = docs.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    counts = rows.mapInArrow(lambda batches: _counted(batches, divisor), "word string, n long").where(F.length("word") >= shortest)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _ranked(c: Column) -> Column:
    """A word as a value that sorts by occurrences, most first, then by code points."""
    return F.struct((-c["n"]).alias("m"), c["word"].alias("word"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near: the word of most occurrences among those one edit away, near_n) of every word of (word, n).

    An entry is a prefix with the word it stands for. Two words of equal length share exactly one prefix, as only one place differs. A longer and a shorter
    word meet once as well: of equal code points in a row, only the last one counts as the surplus one. No pairs are made: an entry knows its range's size and its first two words.
    """
    turned = words.select("word", "n", F.length("word").alias("size"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    rest, front = F.expr("substring(word, i + 1)"), F.expr("substring(word, 1, i)")
    rest_of, front_of = F.concat(rest, F.lit("$")), F.expr("substring(word, 1, i - 1)")
    whole = F.struct(F.concat(rest_of, front).alias("prefix"), F.lit(True).alias("short"), F.lit(False).alias("long"))
    last, following = F.expr("substring(word, i, 1)"), F.expr("substring(word, i + 1, 1)")
    skipping = F.struct(F.concat(rest_of, front_of).alias("prefix"), F.lit(False).alias("short"), (last != following).alias("long"))
    entries = turned.select("word", "n", F.inline(F.when(F.col("i") > 0, F.array(whole, skipping)).otherwise(F.array(whole))))
    sorted_ = entries.repartitionByRange(partitions(words.sparkSession), "prefix")
    group = Window.partitionBy("prefix").orderBy("short", F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = _ranked(F.struct("n", "word"))
    scanned = sorted_.select(
        "word", "n", "short", "long", me.alias("me"), F.count_if(~F.col("short")).over(group).alias("equal"), F.count_if("long").over(group).alias("longer"), F.count_if("short").over(group).alias("shorter"),
        F.nth_value(me, 1).over(group).alias("one"), F.nth_value(me, 2).over(group).alias("two"), F.nth_value("short", 2).over(group).alias("two_short"),
        F.min(F.when(F.col("long"), me)).over(group).alias("best_long"), F.min(F.when(F.col("short"), me)).over(group).alias("best_short"),
    )
    mate = F.when(F.col("one") == F.col("me"), F.when(~F.col("two_short"), F.col("two"))).otherwise(F.col("one"))
    down = F.when(F.col("long"), F.col("best_short"))
    near = F.when(F.col("short"), F.col("best_long")).otherwise(F.least(mate, down))
    count = F.when(F.col("short"), F.col("longer")).otherwise(F.col("equal") - 1 + F.when(F.col("long"), F.col("shorter")).otherwise(0))
    met = scanned.where(F.col("equal") + F.col("shorter") > 1).select("word", "n", count.alias("c"), near.alias("near"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("c"), F.lit(None).cast("struct<m:bigint,word:string>").alias("near"))
    both = met.unionAll(alone).groupBy("word", "n").agg(F.sum("c").alias("n_near"), F.min("near").alias("b"))
    return both.select("word", "n", "n_near", F.col("b.word").alias("near"), (-F.col("b.m")).alias("near_n"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3, ratio: int = 2, divisor: int = EDITED) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents.

    A word's form is its nearest word of most occurrences (ties: the first by code points), if that has `ratio` times the word's at least. Occurrences grow from form to form, so
    following them ends; the rounds grow with the logarithm of the longest way. Null and empty texts have no words, a null key counts as an empty one; very
    long texts are read whole; repeated rows count as often as they stand. An empty table gives no rows; other columns are ignored.
    """
    words, _ = stored(vocabulary(docs, key, text, shortest, least, divisor))
    near, _ = stored(neighbours(words))
    has = F.col("near_n") >= ratio * F.col("n")
    steps, seen = stored(near.select("word", F.when(has, F.col("near")).alias("root")).where("root is not null"), left=F.count(F.lit(1)))
    while seen["left"]:
        up = steps.select(F.col("word").alias("_mid"), F.col("root").alias("_top"))
        jumped = steps.join(up, F.col("root") == F.col("_mid"), "left").select("word", F.coalesce("_top", "root").alias("root"), F.col("_top").isNotNull().alias("_moved"))
        steps, seen = stored(jumped, left=F.count_if(F.col("_moved")))
        steps = steps.select("word", "root")
    roots = steps.select(F.col("word").alias("_w"), "root")
    out = near.join(roots, F.col("word") == F.col("_w"), "left")
    return out.select("word", F.when(has, F.col("near")).alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(has, F.col("near_n")).alias("form_n"))


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
