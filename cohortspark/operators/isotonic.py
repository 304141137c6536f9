"""Isotonic calibration by pooling adjacent violators in two levels: blocks inside ranges of scores, then a merge of blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.ranges import with_range

FEW = 100_000  #: up to so many corners the step function travels to the tasks as two arrays
_BLOCK = "low double, high double, y double, n double"


def _pooled(batches):
    """Blocks of growing averages from sorted blocks; only the blocks so far are held."""
    done: list[list[float]] = []
    for batch in batches:
        for low, high, y, n in zip(*[batch.column(c).to_pylist() for c in ("low", "high", "y", "n")], strict=True):
            done.append([low, high, y, n])
            while len(done) > 1 and done[-2][2] * done[-1][3] >= done[-1][2] * done[-2][3]:
                _, high2, y2, n2 = done.pop()
                done[-1] = [done[-1][0], high2, done[-1][2] + y2, done[-1][3] + n2]
    yield pa.RecordBatch.from_pydict({c: pa.array([b[i] for b in done], pa.float64()) for i, c in enumerate(("low", "high", "y", "n"))})


def blocks(rows: DataFrame, risk: str = "risk", label: str = "y", parts: int | None = None) -> DataFrame:
    """(low, high, y, n): the blocks of the isotonic fit, with the first and last score, positives and rows of each.

    Rows are summed by score; sorted ranges of scores are pooled each in its own task, and only their blocks meet in the last one. Blocks have different averages
    of whole numbers, so n rows of 0/1 labels leave about n^(2/3) of them at most, and far fewer in practice. Rows without a score or label are left out.
    """
    by = rows.where(F.col(risk).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(risk).cast("double").alias("low")).agg(F.sum(F.col(label)).cast("double").alias("y"), F.count(F.lit(1)).cast("double").alias("n"))
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = by.select("low", F.col("low").alias("high"), "y", "n").repartitionByRange(n, "low").sortWithinPartitions("low").mapInArrow(_pooled, _BLOCK)
    return first.repartition(1).sortWithinPartitions("low").mapInArrow(_pooled, _BLOCK)


def corners(fitted: DataFrame) -> DataFrame:
    """(x, v): the ends of every block with its average; a block of one score has one."""
    ends = F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))
    return fitted.select(F.explode(ends).alias("x"), (F.col("y") / F.col("n")).alias("v"))


def apply(rows: DataFrame, points: DataFrame, risk: str = "risk", out: str = "calibrated", few: int = FEW) -> DataFrame:
    """Adds the fitted value: linear between corners, the outer values beyond them, null for a null score or without any corner.

    Up to `few` corners go with the tasks; more meet the rows in ranges of scores, where each row takes the corner before and after it.
    """
    held = points.orderBy("x").limit(few + 1).collect()
    if not held:
        return rows.withColumn(out, F.lit(None).cast("double"))
    if len(held) <= few:
        xs, vs = np.array([p["x"] for p in held]), np.array([p["v"] for p in held])

        @F.pandas_udf("double")
        def value(s: pd.Series) -> pd.Series:
            return pd.Series(np.interp(s.to_numpy(), xs, vs))  # NaN, also of null, stays NaN

        return rows.withColumn(out, F.nanvl(value(F.col(risk).cast("double")), F.lit(None).cast("double")))
    return _by_range(rows, points, risk, out)


def _by_range(rows: DataFrame, points: DataFrame, risk: str, out: str) -> DataFrame:
    both = rows.select(F.col(risk).cast("double").alias("_x"), F.lit(None).cast("struct<x:double,v:double>").alias("_p"), F.struct("*").alias("_row"))
    both = both.unionAll(points.select(F.col("x").alias("_x"), F.struct("x", "v").alias("_p"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row")))
    both = with_range(both, "_x")
    ends = both.groupBy("_range").agg(F.max("_p").alias("_last"), F.min("_p").alias("_first"))  # a row per range
    down, up = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select("_range", F.max("_last").over(down).alias("_last"), F.min("_first").over(up).alias("_first"))
    inside = Window.partitionBy("_range").orderBy("_x")
    low = F.coalesce(F.max("_p").over(inside.rangeBetween(Window.unboundedPreceding, 0)), "_last")
    high = F.coalesce(F.min("_p").over(inside.rangeBetween(0, Window.unboundedFollowing)), "_first")
    met = both.join(F.broadcast(ends), "_range").withColumns({"_low": low, "_high": high}).where("_row is not null")
    share = F.try_divide(F.col("_x") - F.col("_low.x"), F.col("_high.x") - F.col("_low.x"))
    between = F.col("_low.v") + F.coalesce(share, F.lit(0.0)) * (F.col("_high.v") - F.col("_low.v"))
    v = F.when(F.col("_x").isNull(), None).when(F.col("_low").isNull(), F.col("_high.v")).when(F.col("_high").isNull(), F.col("_low.v")).otherwise(between)
    return met.select("_row.*", v.alias(out))
