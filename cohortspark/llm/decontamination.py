"""Benchmark decontamination by SimHash windows and multi-index Hamming search, with built-in functions only.

1. Windows of the items' sizes are laid over every whole document, at every 8th word: for an item of m words, the multiple of eight that is 7 to 14 words
   below m (104 words at most), so that wherever a passage stands, one of the document's windows holds the very words of one of the item's.
   Items under 15 words are searched by windows of their own length at every word.
2. Windows of the documents and the item's windows at all of its offsets get 112-bit SimHash fingerprints over their words. Bit counts are added seven to a long:
   by blocks of eight words first, then from block to block of a document, which never leaves its partition.
3. Fingerprints within 15 bits differ by at most one bit in at least one of eight blocks of 14 bits. The index holds each block of each item with every such
   change, so that the lookup by block guarantees every fingerprint within the radius.
4. Candidates are verified by the exact weighted Jaccard similarity of word shingles, at the place that the match implies and four words round it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import query, stored, table

WORDS = 5
PERCENT = 75
RADIUS = 15  #: bits of 112 by which fingerprints may differ
STRIDE = 8  #: words between windows
_BLOCKS, _WIDTH = 8, 14
_FIELDS, _FIELD = 7, 8  # counters to a long, and their bits: counts stay below 128
_ONES = sum(1 << (_FIELD * i) for i in range(_FIELDS))
_LONGEST = 13 * STRIDE
_NEAR = 4  # words round the implied place that are tried
_BROADCAST_ROWS = 1_000_000  #: an index of up to so many rows (of six numbers each) is sent to every task; a larger one is joined by shuffle


def _spaced(text: Column) -> Column:
    """The text with single characters of ASCII white space as spaces, all letters in lower case: a passage in capitals is still that passage."""
    return F.trim(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", F.lower(F.coalesce(text, F.lit("")))))


def _split(spaced: Column) -> Column:
    """Words of a text as _spaced() gives it. A split at a plain character is far cheaper, and few texts have runs of white space."""
    parts = F.when(F.contains(spaced, F.lit("  ")), F.split(spaced, " +")).otherwise(F.split(spaced, " "))
    return F.when(spaced != "", parts).otherwise(F.array().cast("array<string>"))


def _words(text: Column) -> Column:
    return _split(_spaced(text))


def _shingles(words: Column, n: int) -> Column:
    """Hashes of all runs of n words; of the whole, where there are fewer; none without words."""
    size = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    return F.when(size > 0, runs).otherwise(F.array().cast("array<long>"))


_NAMES = [f"c{k}" for k in range(2 * _FIELD)]  # of the longs of counters: eight for each half of a fingerprint


def _bit(x: Column, y: Column, k: int) -> Column:
    """Every eighth bit of the half's hash, from bit k % 8 on, each in a field of its own."""
    return F.shiftrightunsigned(x if k < _FIELD else y, k % _FIELD).bitwiseAND(F.lit(_ONES))


def _counts(hashes: Column, start: Column, length: Column | int) -> Column:
    """How often each bit is set among `length` pairs of hashes (x, y) from `start` on: eight longs of seven counters each, for x and for y."""
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in _NAMES])
    add = lambda s, h: F.struct(*[(s[n] + _bit(h["x"], h["y"], k)).alias(n) for k, n in enumerate(_NAMES)])
    return F.aggregate(F.slice(hashes, start + 1, length), zero, add)


def _both(one: Column, two: Column) -> Column:
    return F.struct(*[(one[n] + two[n]).alias(n) for n in _NAMES])


def _majority(counts: Column, length: Column, half: int) -> Column:
    """The half's 56 bits: those that more than half of the words have."""
    top = 1 << (_FIELD - 1)
    lift = (F.lit(top).cast("long") - F.floor(length / 2) - 1) * F.lit(_ONES)
    bit = lambda k: F.shiftleft(F.shiftrightunsigned((counts[_NAMES[half * _FIELD + k]] + lift).bitwiseAND(F.lit(_ONES * top)), _FIELD - 1), k)
    return reduce(lambda x, y: x.bitwiseOR(y), [bit(k) for k in range(_FIELD)])


def _hashed(rows: DataFrame) -> DataFrame:
    """Two hashes of each word, for the two halves of a fingerprint. One column of pairs, as what a lambda reads once could be computed again for each call."""
    return rows.withColumn("h", F.transform("w", lambda w: F.struct(F.xxhash64(w).alias("x"), F.xxhash64(F.xxhash64(w)).alias("y"))))


def fitting(size: int) -> int:
    """The length of the windows that search an item of so many words: its own below 15 words, else the longest multiple of 8 that leaves eight offsets."""
    return size if size < 2 * STRIDE - 1 else min((size - STRIDE + 1) // STRIDE * STRIDE, _LONGEST)


def _windows(docs: DataFrame, strided: list[int], short: list[int]) -> DataFrame:
    """Columns (doc, start, length, counts) of every window of the documents (doc, t: text), which come partitioned by doc: all that follows for one stays where it is."""
    parts = []
    # a row number keeps rows with one key apart
    rows = docs.select("doc", F.monotonically_increasing_id().alias("row"), _spaced(F.col("t")).alias("t"))
    rows = rows.select("doc", "row", _split(F.col("t")).alias("w"))  # apart, so that the text is made ready once
    if strided:
        # outer: else the optimizer lays a filter on the array's size below, which splits every text once more
        each = rows.select("doc", "row", F.posexplode_outer("w").alias("pos", "word"))
        each = each.select("doc", "row", F.shiftright("pos", 3).alias("block"), F.xxhash64("word").alias("h")).withColumn("g", F.xxhash64("h"))
        sums = [F.sum(_bit(F.col("h"), F.col("g"), k)).alias(n) for k, n in enumerate(_NAMES)]
        laid = each.groupBy("doc", "row", "block").agg(F.count(F.lit(1)).alias("full"), *sums).where(F.col("full") == STRIDE)
        laid = laid.select("doc", "row", "block", F.struct(*_NAMES).alias("s0"))
        after = Window.partitionBy("doc", "row").orderBy("block")
        for n in range(1, max(strided) // STRIDE):
            # a window of n + 1 blocks is one of n blocks and the block behind it
            laid = laid.withColumn("next", F.lead("s0", n).over(after))
            laid = laid.withColumn(f"s{n}", F.when(F.col("next").isNotNull(), _both(F.col(f"s{n - 1}"), F.col("next")))).drop("next")
        every = F.array(*[F.struct(F.lit(m).alias("length"), F.col(f"s{m // STRIDE - 1}").alias("counts")) for m in strided])
        parts.append(laid.select("doc", (F.col("block") * STRIDE).alias("start"), F.inline(every)).where("counts is not null"))
    hashed = _hashed(rows)
    for m in short:
        n = F.size("h") - m + 1
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(F.size("h") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        counts = F.transform(starts, lambda i: _counts(F.col("h"), i, m))  # noqa: B023
        parts.append(hashed.select("doc", F.posexplode(counts).alias("start", "counts")).select("doc", "start", F.lit(m).alias("length"), "counts"))
    return reduce(DataFrame.unionAll, parts)


def _fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The 112-bit fingerprints of windows, in two halves x and y."""
    half = lambda k: _majority(F.col("counts"), F.col("length"), k)
    return rows.select(*keys, "length", half(0).alias("x"), half(1).alias("y"))


def _block(k: int, half: Column) -> Column:
    return F.shiftrightunsigned(half, k * _WIDTH).bitwiseAND(F.lit((1 << _WIDTH) - 1))


def _slots(change: Column | int = 0) -> list[Column]:
    """The index keys of a fingerprint's eight blocks: window length, block number and the block's bits."""
    half = _BLOCKS // 2
    at = lambda k: (F.col("length").cast("long") * _BLOCKS + k) * (1 << _WIDTH)
    bits = lambda k: _block(k % half, F.col("x" if k < half else "y"))
    return [at(k) + (bits(k) if isinstance(change, int) else bits(k).bitwiseXOR(change)) for k in range(_BLOCKS)]


def hamming(seen: DataFrame, known: DataFrame, radius: int = RADIUS, send=lambda d: d) -> DataFrame:
    """All pairs of fingerprints (length, x, y) of both tables that differ by at most `radius` bits: blocks meet with all changes of up to radius // 8 (0 or 1) bits."""
    if radius >= 2 * _BLOCKS:
        raise ValueError(f"the index finds fingerprints up to {2 * _BLOCKS - 1} bits apart")
    changes = [0] + [1 << b for b in range(_WIDTH)] * (radius >= _BLOCKS)
    own = [c for c in known.columns if c not in ("length", "x", "y")]
    index = known.withColumn("c", F.explode(F.array(*[F.lit(c).cast("long") for c in changes])))
    index = index.select(*own, F.col("x").alias("kx"), F.col("y").alias("ky"), F.explode(F.array(*_slots(F.col("c")))).alias("slot"))
    probes = seen.select("*", F.explode(F.array(*_slots())).alias("slot"))
    # fingerprints are never null; coalesce keeps the optimizer from testing that below, which would compute each of them once more
    known_bits = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    differ = F.bit_count(known_bits("x").bitwiseXOR(known_bits("kx"))) + F.bit_count(known_bits("y").bitwiseXOR(known_bits("ky")))
    return probes.join(send(index), "slot").where(differ <= radius).drop("slot", "kx", "ky")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", words: int = WORDS, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """Columns (key, item, start, n_words, similarity): each document and item with a window at least percent / 100 alike, and the best one's place.

    start counts words from 0, n_words is the item's length, similarity the weighted Jaccard similarity of the word shingles of window and item
    (a shingle weighs as often as it occurs). Null, empty and white texts match nothing, on either side; items of fewer than `words` words match as one
    whole shingle. The best window is the most alike, then the first. Equal items each match, as do rows that repeat an item's key. Rows that repeat a document's key
    count as one document: its best window is that of any of them. Rows with a null key are not reported. Long texts and long items are searched whole. Empty tables give
    no rows; other columns are ignored.
    """
    one = items.select(F.col(item).alias("item"), _words(F.col(item_text)).alias("w")).where(F.size("w") > 0).withColumn("m", F.size("w"))
    one, _ = stored(one)
    sizes = sorted(r["m"] for r in one.select("m").distinct().collect())  # one number per length, whatever the items
    short = [m for m in sizes if m < 2 * STRIDE - 1]
    strided = sorted({fitting(m) for m in sizes if m not in short})
    plain = docs.select(F.col(key).alias("doc"), F.col(text).alias("t"))
    if not sizes:
        return plain.where("false").select(F.col("doc").alias(key), F.lit(None).cast(dict(items.dtypes)[item]).alias(item), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("similarity"))
    multiple = F.least(F.floor((F.col("m") - STRIDE + 1) / STRIDE) * STRIDE, F.lit(_LONGEST)).cast("int")
    hashed = _hashed(one).withColumn("length", F.when(F.col("m") < 2 * STRIDE - 1, F.col("m")).otherwise(multiple))
    hashed = hashed.select("item", "m", "length", "h", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("length"))).alias("off"))
    known = hashed.select("item", "m", "off", "length", _counts(F.col("h"), F.col("off"), F.col("length")).alias("counts"))
    known, seen = stored(_fingerprints(known, ["item", "m", "off"]), n=F.count(F.lit(1)))
    small = seen["n"] * _BLOCKS * (_WIDTH + 1) <= _BROADCAST_ROWS
    send = F.broadcast if small else (lambda d: d)
    by_doc = plain.where("doc is not null").repartition("doc")  # texts travel once, for the windows and for the comparison
    laid = _windows(by_doc, strided, short)
    near = hamming(_fingerprints(laid, ["doc", "start"]), known, radius, send)
    place = F.greatest(F.col("start") - F.col("off") - _NEAR, F.lit(0))
    asked = near.groupBy("doc").agg(F.collect_set(F.struct("item", "m", place.alias("start"))).alias("at"))
    # needs `at`, so the split stays above the join and text travels, not words
    found = by_doc.join(asked, "doc").select("doc", "at", _words(F.when(F.size("at") > 0, F.col("t"))).alias("w"))
    last = lambda x: F.greatest(F.size("w") - x["m"], F.lit(0))  # noqa: E731  of an item's windows in the document
    start = lambda x: F.least(x["start"], last(x))
    near_by = lambda x: F.struct(x["item"].alias("item"), start(x).alias("start"), F.least(last(x) - start(x), F.lit(2 * _NEAR)).alias("room"), F.slice("w", start(x) + 1, x["m"] + 2 * _NEAR).alias("w"))
    around = found.select("doc", F.explode(F.transform("at", near_by)).alias("x")).select("doc", "x.item", "x.start", "x.room", "x.w")
    around = around.join(send(one.select("item", "m", _shingles(F.col("w"), words).alias("b"))), "item").withColumn("every", _shingles(F.col("w"), words))
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    plain_ = lambda a: F.size(F.array_distinct(a)) == F.size(a)  # noqa: E731  no shingle repeats

    def shared(a: Column) -> Column:
        both = F.size(F.array_intersect(a, "b"))
        weighed = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(F.col("b"), x)))
        return F.when(plain_(a) & plain_(F.col("b")), both).otherwise(weighed)

    def alike(shift: Column) -> Column:
        a = F.when(F.col("m") >= words, F.slice("every", shift + 1, F.col("m") - words + 1)).otherwise(_shingles(F.slice("w", shift + 1, F.col("m")), words))
        # lists of one bind values to names
        pair = F.get(F.transform(F.array(a), lambda a: F.struct(shared(a).alias("i"), F.size(a).alias("n"))), F.lit(0))
        return F.get(F.transform(F.array(pair), lambda p: F.struct(p["i"].alias("i"), (p["n"] + F.size("b") - p["i"]).alias("u"), (-shift).alias("o"))), F.lit(0))

    # an item of different shingles has to find enough of them somewhere around
    possible = (F.col("m") < words) | ~plain_(F.col("b")) | (F.size(F.array_intersect("every", "b")) * 100 >= F.size("b") * percent)
    tried = F.filter(F.transform(F.sequence(F.lit(0), F.col("room")), alike), lambda r: (r["u"] > 0) & (r["i"] * 100 >= r["u"] * percent))
    tried = F.when(possible, tried)
    best = F.array_max(F.transform(tried, lambda r: F.struct((r["i"] / r["u"]).alias("s"), (r["o"] - F.col("start")).alias("o"))))
    rows = around.select("doc", "item", "m", best.alias("best")).where("best is not null")
    rows = rows.groupBy("doc", "item").agg(F.max(F.struct("best.s", "best.o", "m")).alias("x"))
    return rows.select(F.col("doc").alias(key), F.col("item").alias(item), (-F.col("x.o")).cast("long").alias("start"), F.col("x.m").cast("long").alias("n_words"), F.col("x.s").alias("similarity"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
