"""Ordered observations of entities: next-state labels, index cohorts, history and trajectory features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.values import flag

YEAR = 365.25  #: days


@dataclass(frozen=True)
class VisitSpec:
    """Names of an observation table: its entity, the order inside it (the last name breaks ties) and the state."""

    entity: str = "entity"
    order: tuple[str, ...] = ("y", "m", "d", "visit_id")
    state: str = "state"
    date: str = "date"
    tie: str = "visit_id"


def by_order(spec: VisitSpec):
    """Observations of an entity in their order, nulls last."""
    return Window.partitionBy(spec.entity).orderBy(*[F.col(c).asc_nulls_last() for c in spec.order])


def by_date(spec: VisitSpec):
    return Window.partitionBy(spec.entity).orderBy(F.col(spec.date).asc_nulls_last(), F.col(spec.tie))


def with_sequence(visits: DataFrame, spec: VisitSpec, name: str = "seq") -> DataFrame:
    """Adds each observation's number inside its entity, from 1."""
    return visits.withColumn(name, F.row_number().over(by_order(spec)))


def with_next_state(visits: DataFrame, spec: VisitSpec, target) -> DataFrame:
    """Adds next_state (of the following observation, whatever its own state), has_next and label (1 where it is the target, null without one)."""
    nxt = F.lead(spec.state).over(by_order(spec))
    return visits.withColumn("next_state", nxt).withColumn("has_next", F.col("next_state").isNotNull()).withColumn("label", F.when(F.col("has_next"), flag(F.col("next_state") == F.lit(target))))


def index_cohort(visits: DataFrame, spec: VisitSpec, index, target) -> DataFrame:
    """Observations in the index state that have a next state, with their label. The window sees all observations, so the filter comes after it."""
    return with_next_state(visits, spec, target).where((F.col(spec.state) == F.lit(index)) & F.col("has_next"))


def summary(cohort: DataFrame, entity: str = "entity", label: str = "label") -> DataFrame:
    """One row: rows, entities, events, non_events, prevalence (0.0 for an empty cohort)."""
    n, events = F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0)).cast("long")
    out = cohort.agg(n.alias("rows"), F.count_distinct(entity).alias("entities"), events.alias("events"))
    return out.select("rows", "entities", "events", (F.col("rows") - F.col("events")).alias("non_events"), F.coalesce(F.try_divide(F.col("events").cast("double"), F.col("rows")), F.lit(0.0)).alias("prevalence"))


def eligibility(cohort: DataFrame, entity: str = "entity", label: str = "label", least: int = 3) -> DataFrame:
    """One row with the first reason that forbids modelling, or `ok`."""
    s = summary(cohort, entity, label)
    low = F.least("events", "non_events")
    reason = F.when(F.col("rows") == 0, "empty").when(F.col("entities") < least, "too_few_entities").when(low == 0, "one_class").when(low < least, "small_class").otherwise("ok")
    return s.select("rows", "entities", "events", "non_events", reason.alias("reason"))


def controlled_stop(cohort: DataFrame, step: str, entity: str = "entity", label: str = "label", least: int = 3) -> DataFrame:
    """One status row where the cohort is not eligible, none where it is."""
    return eligibility(cohort, entity, label, least).where("reason <> 'ok'").select(F.lit(step).alias("step"), F.lit("stopped").alias("status"), "reason", "rows", "entities", "events")


def with_history(visits: DataFrame, spec: VisitSpec) -> DataFrame:
    """Adds prior_count, has_prior, days_since_prior, days_since_first and both in years, over the rows given (a cohort: history inside the cohort)."""
    w = by_date(spec)
    first = F.first(F.col(spec.date), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = visits.select("*", (F.row_number().over(w) - 1).alias("prior_count"), F.datediff(F.col(spec.date), F.lag(spec.date).over(w)).alias("days_since_prior"), F.datediff(F.col(spec.date), first).alias("days_since_first"))
    return out.select("*", flag(F.col("prior_count") > 0).alias("has_prior"), (F.col("days_since_prior") / YEAR).alias("years_since_prior"), (F.col("days_since_first") / YEAR).alias("years_since_first"))


def trajectories(visits: DataFrame, spec: VisitSpec, numeric: list[str], binary: list[str]) -> DataFrame:
    """Adds for each numeric column its prior value, change and yearly change (null for no time between), for each binary one its prior value, starts and stops (missing counts as neither)."""
    w = by_date(spec)
    gap = F.datediff(F.col(spec.date), F.lag(spec.date).over(w)) / YEAR
    cols: list[Column] = []
    for c in numeric:
        prior = F.lag(c).over(w)
        cols += [prior.alias(f"traj_{c}_prior"), (F.col(c) - prior).alias(f"traj_{c}_delta"), F.try_divide(F.col(c) - prior, gap).alias(f"traj_{c}_per_year")]
    for c in binary:
        prior = F.lag(c).over(w)
        cols += [prior.alias(f"traj_{c}_prior"), flag((F.col(c) == 1) & (prior == 0)).alias(f"traj_{c}_new"), flag((F.col(c) == 0) & (prior == 1)).alias(f"traj_{c}_stopped")]
    return visits.select("*", *cols)
