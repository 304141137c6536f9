"""Mixing sources to target weights by hash thresholds: no sort of documents, no sample.

Every document has a hash that depends on itself alone. Words are summed by source and leading bits of the hash; the bucket in which a
source's budget ends is refined by the next bits, until one hash is left. A document is taken where its hash is under
its source's threshold, so a larger budget takes all that a smaller one takes, and more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import partitions, query, shared_dir, stored, table

BITS = 12  #: bits of the hash that one histogram resolves
LEVELS = 5  #: histograms until all 60 bits are used
FEW = 100_000  #: up to so many sources their thresholds are broadcast; beyond, they are joined by salted keys
SALTS = 32


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hashed(key: Column, text: Column) -> Column:
    """60 bits of md5 of the key and the text."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def _numbered(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds each source's weight by its place in code-point order, null last: places count inside ranges of sources, and the ranges' sizes add up."""
    spread = sources.withColumn("_null", F.col("source").isNull()).repartitionByRange(partitions(sources.sparkSession), "_null", "source")
    path = f"{shared_dir(sources.sparkSession)}/table-{uuid.uuid4().hex}"
    spread.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    spread = sources.sparkSession.read.parquet(path)
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))  # a row for each task
    before = sizes.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_null", "source")) - 1
    numbered = spread.join(F.broadcast(before), "_part").withColumn("w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    return numbered.drop("_null", "_part", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, target) of (source, size): shares by weight of `percent` of all words; what is over `most` times a source's size goes to the others, by weight.

    The share of one unit of weight only rises from round to round, so sources once full stay full; each round is one aggregate over the sources.
    All sums are whole numbers.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per, _ = stored(_numbered(per, weights))
    big = lambda c: c.cast("decimal(30,0)")
    unit, weight, before = 0, 1, -1  # a unit of weight gets unit / (100 * weight) words
    full, size, w = F.lit(False), F.col("source_size"), F.col("w")
    while True:
        one = per.agg(F.sum(size).alias("all"), F.sum(F.when(full, size)).alias("full"), F.sum(F.when(~full, w)).alias("open"), F.count_if(full).alias("n")).first()
        if not one["open"] or one["n"] == before:
            break
        unit, weight, before = (one["all"] or 0) * percent - 100 * most * (one["full"] or 0), one["open"], one["n"]
        full = big(w) * F.lit(unit).cast("decimal(22,0)") > big(size) * F.lit(100 * most * weight).cast("decimal(22,0)")  # also true of all that were full before
    share = F.col("w") * F.lit(float(unit)) / F.lit(float(100 * weight))
    return per.select("source", "source_size", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("hash", BITS * (LEVELS - level)).cast("long")


def thresholds(rows: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """(source, whole, under): a source's documents are taken `whole` times, and once more where their hash is less than `under`.

    rows: (source, hash, size). The last hash counts where it brings the sum nearer to the target.
    """
    budgets = budgets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = budgets.select("source", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    inside, done = rows, None
    for level in range(1, LEVELS + 1):
        counts = inside.groupBy("source", _bucket(level).alias("b")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c"), F.min("hash").alias("least"))
        upto = F.sum("s").over(Window.partitionBy("source").orderBy("b"))  # 2^BITS buckets of a source at most
        found = joined(counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("s")), state, few)
        found = found.where("below + before <= rest and below + upto > rest").select("source", "whole", "rest", F.col("b").alias("prefix"), (F.col("below") + F.col("before")).alias("below"), "s", "c", "least")
        found, seen = stored(found, more=F.count_if(F.col("c") > 1))
        over = F.when(2 * (F.col("rest") - F.col("below")) > F.col("s"), F.col("least") + 1).otherwise(F.col("least"))
        ended = found.where("c = 1" if level < LEVELS else "true").select("source", "whole", over.alias("under"))
        done = ended if done is None else done.unionAll(ended)
        if level == LEVELS or not seen["more"]:
            break
        open_ = found.where("c > 1").select("source", "whole", "rest", "prefix", "below")
        inside, _ = stored(joined(inside, open_.select("source", "prefix"), few).where(_bucket(level) == F.col("prefix")).select("source", "hash", "size"))
        state = open_
    # sources without a boundary have no words
    done = done.groupBy(F.col("source").alias("_s")).agg(F.max("under").alias("under"))
    return budgets.join(done, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "whole", F.coalesce("under", F.lit(0)).cast("long").alias("under"))


def joined(rows: DataFrame, per: DataFrame, few: bool) -> DataFrame:
    """Rows with their source's values, null being a source: broadcast for at most FEW sources, else by salted keys, so that a hot source is dealt to many tasks."""
    right = per.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if few:
        return rows.join(F.broadcast(right), same).drop("_source")
    right = right.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("_u", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "source"]), F.lit(SALTS)))
    return left.join(right, same & (F.col("_u") == F.col("_t"))).drop("_source", "_t", "_u")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """The rows with size, source_size, target and taken: how many of its words the mix takes, 0, its size, or up to `most` times its size.

    Sources weigh by their place in code-point order (null is the last source); all together get `percent` of all words, and none more than `most` times its own. A
    source's words taken differ from its target by half its document at the threshold at most. Null and empty texts have size 0; very long texts are
    documents like others and are never cut. Rows that repeat key and text have one hash and are taken alike, so such a group counts as one document at the threshold.
    Rows with a null key are told apart by their text. An empty table stays empty; columns of the names size, source_size, target or taken are replaced.
    """
    made = ["size", "source_size", "target", "taken"]
    keep = [c for c in docs.columns if c not in made]
    narrow = docs.select(F.col(source).cast("string").alias("source"), hashed(F.col(key), F.col(text)).alias("hash"), words(F.col(text)).alias("size"))
    narrow, _ = stored(narrow)
    budgets, seen = stored(targets(narrow.select("source", "size"), weights, percent, most), n=F.count(F.lit(1)))
    limits, _ = stored(thresholds(narrow, budgets, seen["n"] <= FEW))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(source).cast("string").alias("source"), hashed(F.col(key), F.col(text)).alias("hash"), words(F.col(text)).alias("size"))
    out = joined(rows, limits, seen["n"] <= FEW)
    taken = F.col("size") * (F.col("whole") + F.when(F.col("hash") < F.col("under"), 1).otherwise(0))
    return out.select(*[F.col("_row")[c].alias(c) for c in keep], "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: the input's rows as often as they are taken, with their own columns (those that mix() makes are left out). Documents without words are not in it."""
    out = mix(docs, key, text, source, **how).where("taken > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).drop("_copy", "size", "source_size", "target", "taken")


_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 15)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS ws, coalesce(sum(source_size) OVER r, 0) AS filled, coalesce(sum(w) OVER r, 0) AS fw FROM w WINDOW r AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, w * (150 * total - 200 * filled) > 200 * source_size * (ws - fw) AS is_full FROM o),
l AS (SELECT max(150 * total) - 200 * coalesce(sum(source_size) FILTER (is_full), 0) AS unit, coalesce(sum(w) FILTER (NOT is_full), 1) AS weight FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN 2.0E0 * source_size ELSE w * CAST(unit AS DOUBLE) / CAST(100 * weight AS DOUBLE) END AS target FROM f, l),
c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, h, sum(size) AS s, max(target - whole * source_size) AS rest FROM c GROUP BY ALL),
u AS (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
k AS (SELECT source, h, upto <= rest OR (upto - s <= rest AND 2 * (rest - (upto - s)) > s) AS extra FROM u)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(c.size * (whole + CASE WHEN k.extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c JOIN k ON k.h = c.h AND k.source IS NOT DISTINCT FROM c.source"""


@query("op12_mixing", _SQL)
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
