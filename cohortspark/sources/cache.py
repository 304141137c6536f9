"""A keyed cache of derived records: upsert, load, filter and the split of pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, key: str, batch: str = "batch") -> DataFrame:
    """All rows of both with the last batch of each key; the caller writes the result to a new path, never over the one it reads."""
    both = existing.unionByName(new, allowMissingColumns=True)
    kept = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), F.col(batch)).alias("_x"))
    return kept.select(key, "_x.*").select(*both.columns)


def load(cache: DataFrame, text: str, error: str, stale: str) -> DataFrame:
    """One row for each lookup key (the raw text and its trimmed, lower-case form), without blank keys and with errors that start with `stale` cleared."""
    clean = cache.where(F.trim(text) != "").withColumn(error, F.when(F.col(error).startswith(stale), "").otherwise(F.col(error)))
    return clean.withColumn("lookup", F.explode(F.array_distinct(F.array(F.col(text), F.lower(F.trim(text))))))


def stable_keys(cache: DataFrame, token: str, token_key: str) -> DataFrame:
    """Rows whose stored key is the sha256 of their token."""
    return cache.where(F.col(token_key) == F.sha2(F.col(token), 256))


def upgrade(cache: DataFrame, defaults: dict[str, object], true_source: str, provider: str = "provider") -> DataFrame:
    """Rows under the current schema: missing columns and values get their defaults, parsed is 1 for the true source alone, an error that starts with `stale` is cleared."""
    cols = [F.coalesce(F.col(c), F.lit(v)).alias(c) if c in cache.columns else F.lit(v).alias(c) for c, v in defaults.items()]
    rest = [F.col(c) for c in cache.columns if c not in defaults and c != "error"]
    return cache.select(*rest, *cols, F.when(F.col("error").startswith("stale"), "").otherwise(F.coalesce("error", F.lit(""))).alias("error"), F.when(F.col(provider) == true_source, 1).otherwise(0).alias("parsed"))


def pending(dictionary: DataFrame, cache: DataFrame, recovered: DataFrame, token: str, selected: str) -> DataFrame:
    """Each token's status: recovered, cache_hit, pending_call where selected, else local_only."""
    out = dictionary.join(cache.select(token).distinct().withColumn("_hit", F.lit(True)), token, "left").join(recovered.select(token).distinct().withColumn("_back", F.lit(True)), token, "left")
    return out.select(*dictionary.columns, F.when(F.col("_back"), "recovered").when(F.col("_hit"), "cache_hit").when(F.col(selected), "pending_call").otherwise("local_only").alias("status"))
