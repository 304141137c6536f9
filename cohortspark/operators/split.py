"""Entity-disjoint and temporal splits, and preprocessing fitted on the training part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.hashing import bucket
from cohortspark.functions.values import flag
from cohortspark.operators.ranges import exact_quantiles

SIZE = 10_000


def two_way(entity: Column, test: float, salt: str = "") -> Column:
    return F.when(bucket(entity, salt, SIZE) < int(round(test * SIZE)), "test").otherwise("train")


def three_way(entity: Column, test: float, validation: float, salt: str = "") -> Column:
    """test, then validation, then train, by thresholds on one bucket of the entity."""
    b, t = bucket(entity, salt, SIZE), int(round(test * SIZE))
    return F.when(b < t, "test").when(b < t + int(round(validation * SIZE)), "validation").otherwise("train")


def first_valid_salt(df: DataFrame, entity: str, label: str, salts: list[str], test: float, validation: float, block: int = 5) -> str | None:
    """The first salt under which every part has both classes; None without any.

    Labels are counted per entity, and a few salts are tried at once in one aggregate: the first block mostly holds one. Only counts come to the driver.
    """
    y = F.col(label)
    counted = df.groupBy(entity).agg(F.count_if(y == 0).alias("_n0"), F.count_if(y == 1).alias("_n1"))
    parts = ("train", "validation", "test")
    for at in range(0, len(salts), block):
        some = salts[at : at + block]
        marked = counted.select("_n0", "_n1", *[three_way(F.col(entity), test, validation, x).alias(f"p{i}") for i, x in enumerate(some)])
        sums = [F.sum(F.when(F.col(f"p{i}") == p, F.col(f"_n{c}"))).alias(f"{i}_{p}_{c}") for i in range(len(some)) for p in parts for c in (0, 1)]
        row = marked.agg(*sums).first()
        for i, salt in enumerate(some):
            if all(row[f"{i}_{p}_{c}"] for p in parts for c in (0, 1)):
                return salt
    return None


def summary(df: DataFrame, entity: str, label: str, split: str = "split") -> DataFrame:
    """Rows, entities, events and prevalence of each part and of train with validation."""
    parts = df.withColumn("_s", F.explode(F.when(F.col(split).isin("train", "validation"), F.array(F.col(split), F.lit("train+validation"))).otherwise(F.array(split))))
    out = parts.groupBy(F.col("_s").alias("split")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"), F.sum(label).cast("long").alias("events"))
    return out.withColumn("prevalence", F.round(F.col("events") / F.col("rows"), 9))


def overlaps(df: DataFrame, entity: str, split: str = "split") -> DataFrame:
    """Entities that each pair of parts shares; a leak is any."""
    sets = df.groupBy(entity).agg(F.array_sort(F.collect_set(split)).alias("s"))
    has = lambda a: F.array_contains("s", a)
    pairs = [("train", "validation"), ("train", "test"), ("validation", "test")]
    one = sets.agg(*[F.count_if(has(a) & has(b)).alias(f"{a}_{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(f"{a}_{b}").alias("entities"), (F.col(f"{a}_{b}") > 0).alias("leak")) for a, b in pairs])))


def share_table(df: DataFrame, entity: str, label: str, split: str = "split") -> DataFrame:
    """Counts and per cents of each part with a Total row; parts are disjoint by entity, so entities add up."""
    parts = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"), F.sum(label).cast("long").alias("events"))
    total = parts.agg(*[F.sum(c).alias(f"t_{c}") for c in ("rows", "entities", "events")])
    every = parts.rollup(split).agg(*[F.sum(c).alias(c) for c in ("rows", "entities", "events")])
    out = every.join(total, how="cross")  # beside one row
    pct = lambda c: F.round(F.col(c) * 100.0 / F.col(f"t_{c}"), 6).alias(f"pct_{c}")
    return out.select(F.coalesce(split, F.lit("Total")).alias("split"), "rows", "entities", "events", pct("rows"), pct("entities"), pct("events"))


def temporal(year: Column, first_test_year: int) -> Column:
    return F.when(year < first_test_year, "train").when(year >= first_test_year, "test")


def temporal_reason(df: DataFrame, label: str, least_events: int, split: str = "split") -> DataFrame:
    """One row: counts of both parts and why they can't be used, or `ok`."""
    n = lambda p, c: F.count_if((F.col(split) == p) & c)
    yes = F.col(label) == 1
    one = df.agg(n("train", F.lit(True)).alias("train_rows"), n("train", yes).alias("train_events"), n("test", F.lit(True)).alias("test_rows"), n("test", yes).alias("test_events"))
    flat = lambda p: (F.col(f"{p}_events") == 0) | (F.col(f"{p}_events") == F.col(f"{p}_rows"))
    reason = F.when((F.col("train_rows") == 0) | (F.col("test_rows") == 0), "empty_part").when(flat("train") | flat("test"), "one_class").when(F.least("train_events", "test_events") < least_events, "too_few_events").otherwise("ok")
    return one.withColumn("reason", reason)


def _beside(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """Every row beside one row of fitted values."""
    return df.join(F.broadcast(fitted), how="cross")


def impute_mode(df: DataFrame, train: Column, columns: list[str]) -> DataFrame:
    """Missing values become the training mode, the smallest of several."""
    fitted = df.where(train).agg(*[F.mode(F.col(c), True).alias(f"_m_{c}") for c in columns])
    return _beside(df, fitted).select(*[F.coalesce(c, f"_m_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def impute_median(df: DataFrame, train: Column, columns: list[str]) -> DataFrame:
    """Missing values become the exact training median; the medians of all columns come from one pass over (column, value)."""
    long = df.where(train).select(F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns])))
    medians = exact_quantiles(long, ["_column"], "_value", [0.5])
    fitted = medians.agg(*[F.max(F.when(F.col("_column") == c, F.get("quantiles", F.lit(0)))).alias(f"_m_{c}") for c in columns])
    return _beside(df, fitted).select(*[F.coalesce(F.col(c).cast("double"), f"_m_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def one_hot(df: DataFrame, train: Column, column: str, most: int = 1000) -> DataFrame:
    """A 0/1 column per training category; unknown and missing values get only zeros. More than `most` categories are an error."""
    cats = [r[0] for r in df.where(train & F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().limit(most + 1).collect()]
    if len(cats) > most:
        raise ValueError(f"{column} has over {most} categories")
    return df.select("*", *[flag(F.col(column).cast("string") == c).alias(f"{column}_{c}") for c in sorted(cats)])


def standardize(df: DataFrame, train: Column, columns: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation of the training part; a constant column becomes 0."""
    fitted = df.where(train).agg(*[x for c in columns for x in (F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    return _beside(df, fitted).select(*[F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - F.col(f"_a_{c}"), F.col(f"_s_{c}")), F.lit(0.0))).alias(c) if c in columns else F.col(c) for c in df.columns])


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Adds n / (2 * rows of the class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"))
    w = n.join(total, how="cross").select(F.col(label).alias("_y"), (F.col("_t") / (2 * F.col("_n"))).alias(out))
    return df.join(F.broadcast(w), df[label] == w["_y"], "left").drop("_y")  # one row per class
