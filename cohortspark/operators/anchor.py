"""Secondary outcomes held against predicted risks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import evaluate as E


def outcomes(df: DataFrame, rules: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Adds a nullable 0/1 column per rule name: (column, `>=` or `>`, threshold)."""
    def hit(c, op, t):
        return F.when(F.col(c).isNotNull(), ((F.col(c) >= t) if op == ">=" else (F.col(c) > t)).cast("double"))

    return df.select("*", *[hit(*r).alias(name) for name, r in rules.items()])


def cohort(df: DataFrame, names: list[str], risk: str) -> DataFrame:
    """Rows with at least one outcome, and their risk quartile among them."""
    some = df.where(F.coalesce(*[F.col(n) for n in names]).isNotNull())
    return E.with_quantile_bin(some, [], 4, risk, "quartile")


def long_form(df: DataFrame, names: list[str], risks: list[str], keep: list[str]) -> DataFrame:
    """One row per outcome that is known and risk: outcome, model, y, risk."""
    out = df.select(*keep, *risks, F.inline(F.array(*[F.struct(F.lit(n).alias("outcome"), F.col(n).cast("int").alias("y")) for n in names]))).where("y is not null")
    return out.select(*keep, "outcome", "y", F.inline(F.array(*[F.struct(F.lit(r).alias("model"), F.col(r).alias("risk")) for r in risks])))


def summary(long: DataFrame) -> DataFrame:
    return long.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"), F.avg("y").alias("prevalence"))


def associations(long: DataFrame) -> DataFrame:
    """Mean risk by class, their difference, auc and ap of each outcome and model (null for one class); all from one aggregate by score."""
    keys = ["outcome", "model"]
    by = E.by_score(long, keys)
    mean = lambda c: F.try_divide(F.sum(F.col("risk") * F.col(c)), F.sum(c))
    means = by.groupBy(*keys).agg(mean("pos").alias("mean_positive"), mean("neg").alias("mean_negative"))
    return means.withColumn("difference", F.col("mean_positive") - F.col("mean_negative")).join(E.ranking_of(by, keys), keys)


def quartiles(long: DataFrame) -> DataFrame:
    return long.groupBy("outcome", "quartile").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"), F.avg("y").alias("rate"), F.avg("risk").alias("mean_risk"))
