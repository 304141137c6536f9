"""The document of a run: counts, splits, features, parameters and choices as one nested JSON object."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import split as S


def _one(df: DataFrame, name: str) -> DataFrame:
    """The rows of a small table as one array in one row, sorted by their first column."""
    return df.agg(F.array_sort(F.collect_list(F.struct("*"))).alias(name))


def run_document(cohort: DataFrame, entity: str, label: str, features: dict[str, dict[str, list[str]]], parameters: dict, performance: DataFrame | None = None, tuning: DataFrame | None = None, providers: DataFrame | None = None, source_rows: DataFrame | None = None) -> DataFrame:
    """One row with the column `document`.

    cohort has a column `split`. The document holds the source's and the cohort's rows, entities and events; rows, entities, events and prevalence of each part and of train with validation; entities that
    parts share; the number of features by arm and family; the given parameters; per model the tuned parameters (tuning: model, parameters, winner); the models with their metrics and the best of them by auc,
    ap, Brier score and name (performance: model, auc, ap, brier); rows by provider. All are aggregates of a few rows.
    """
    c = cohort.agg(F.struct(F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"), F.sum(label).cast("long").alias("events")).alias("cohort"))
    parts = [c, _one(S.summary(cohort, entity, label), "splits"), _one(S.overlaps(cohort, entity), "overlaps")]
    if source_rows is not None:
        parts.insert(0, source_rows.agg(F.struct(F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities")).alias("source")))
    if performance is not None:
        best = F.min_by("model", F.struct(-F.col("auc"), -F.col("ap"), "brier", "model"))
        parts.append(performance.agg(F.array_sort(F.collect_list(F.struct("model", "auc", "ap", "brier"))).alias("models"), best.alias("best_model")))
    if tuning is not None:
        parts.append(_one(tuning.where("winner").select("model", "parameters"), "tuned"))
    if providers is not None:
        parts.append(_one(providers.groupBy("provider").agg(F.count(F.lit(1)).alias("rows")), "providers"))
    of = lambda families: F.create_map(*[x for name, columns in families.items() for x in (F.lit(name), F.lit(len(columns)))])
    counts = F.create_map(*[x for arm, families in features.items() for x in (F.lit(arm), of(families))])
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, how="cross")  # one row by one row
    return out.select(F.to_json(F.struct(*out.columns, counts.alias("features"), F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters"))).alias("document"))
