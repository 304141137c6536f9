"""Order over whole columns without one-task windows: values are cut into ranges first, and only what the ranges add up to is ordered as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64
SALTS = 16


def with_range(df: DataFrame, value: str, out: str = "_range", n: int = RANGES, edges_of: DataFrame | None = None) -> DataFrame:
    """Adds the number of a value's range: ascending with the value, equal values in one range, and no range of any key with much over 1/n of all distinct rows.

    The edges are one array for all keys, from an approximate percentile (of `edges_of`, else of the rows themselves), which Spark pre-aggregates;
    what is computed from the ranges stays exact, whatever the edges.
    """
    edges = (df if edges_of is None else edges_of).agg(F.percentile_approx(value, [i / n for i in range(1, n)], 1000).alias("_edges"))
    both = df.join(F.broadcast(edges), how="cross")  # one row
    return both.withColumn(out, F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(value))), F.lit(0))).drop("_edges")


def salted(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """A join with one row per key that deals a hot key to many tasks."""
    few = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mine = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(salts)).cast("int"))
    return mine.join(few, [*keys, "_salt"], how).drop("_salt")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], out: str = "quantiles", weight: str | None = None) -> DataFrame:
    """One row per key that has a value: its exact quantiles, with linear interpolation as percentile() has it. Without keys always one row, maybe with an empty array. `weight`: how many rows a row stands for.

    Equal values are counted together, ranges of values are added up, and only the ranges that hold a wanted rank are ordered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    counts = with_range(counts, "_v")
    inside = [*keys, "_range"]
    up, whole = Window.partitionBy(*keys).orderBy("_range"), Window.partitionBy(*keys)
    sizes = counts.groupBy(*inside).agg(F.sum("_c").alias("_s"))
    sizes = sizes.select(*inside, (F.sum("_s").over(up) - F.col("_s")).alias("_before"), F.sum("_s").over(up).alias("_upto"), F.sum("_s").over(whole).alias("_n"))
    wanted = sizes.withColumn("_q", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)])))
    wanted = wanted.withColumn("_at", F.col("_q.s") * (F.col("_n") - 1))
    wanted = wanted.withColumn("_rank", F.explode(F.array(F.floor("_at"), F.ceil("_at")))).where("_rank >= _before and _rank < _upto").distinct()
    wanted = wanted.select(*inside, "_before", F.col("_q.i").alias("_i"), "_at", "_rank")
    held = counts.join(wanted.select(*inside).distinct(), inside, "left_semi")
    held = held.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*inside).orderBy("_v")))
    met = held.join(wanted, inside).where("_rank >= _before + _upto - _c and _rank < _before + _upto")
    low, high = F.min(F.struct("_rank", "_v")), F.max(F.struct("_rank", "_v"))
    one = met.groupBy(*keys, "_i", "_at").agg(low.alias("_l"), high.alias("_h"))
    between = (F.col("_h._rank") - F.col("_at")) * F.col("_l._v") + (F.col("_at") - F.col("_l._rank")) * F.col("_h._v")
    # between equal values nothing is computed: the weights' products may add up to a neighbour of the value
    one = one.select(*keys, "_i", F.when(F.col("_l._v") == F.col("_h._v"), F.col("_l._v")).otherwise(between).alias("_x"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(out))
