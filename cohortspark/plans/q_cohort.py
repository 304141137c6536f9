"""Queries on visits: order, labels, cohorts, history and trajectories."""

from pyspark.sql import functions as F

from cohortspark.functions.values import to_date
from cohortspark.operators import cohort as C
from cohortspark.plans.registry import query
from cohortspark.plans.views import sql, view

SPEC = C.VisitSpec()
BY_DATE = C.VisitSpec(order=("date", "visit_id"))
_ORD = "PARTITION BY entity ORDER BY y NULLS LAST, m NULLS LAST, d NULLS LAST, visit_id"
_DATE = "CASE WHEN m = 2 AND d = 31 THEN NULL ELSE make_date(y, m, d) END"


def _dated(spark, sf):
    v = view(spark, sf, "v_cohort")
    return v.withColumn("date", to_date(F.col("y"), F.col("m"), F.col("d")))


@query(sql("v_visits", f"SELECT entity, visit_id, row_number() OVER ({_ORD}) AS seq FROM v_visits"))
def visit_order(spark, sf):
    return C.with_sequence(view(spark, sf, "v_visits"), SPEC).select("entity", "visit_id", "seq")


@query(sql("v_visits", f"SELECT visit_id, {_DATE} AS visit_date FROM v_visits"))
def assemble_visit_date(spark, sf):
    return view(spark, sf, "v_visits").select("visit_id", to_date(F.col("y"), F.col("m"), F.col("d")).alias("visit_date"))


@query(sql("v_visits", f"SELECT entity, visit_id, state, n AS next_state, n IS NOT NULL AS has_next, CASE WHEN n IS NULL THEN NULL WHEN n = 4 THEN 1 ELSE 0 END AS label FROM (SELECT *, lead(state) OVER ({_ORD}) AS n FROM v_visits)"))
def next_state_label(spark, sf):
    return C.with_next_state(view(spark, sf, "v_visits"), SPEC, 4).select("entity", "visit_id", "state", "next_state", "has_next", "label")


@query(sql("v_cohort", "SELECT entity, visit_id, price, label FROM v_cohort"))
def index_state_cohort(spark, sf):
    return C.index_cohort(view(spark, sf, "v_visits"), SPEC, 3, 4).select("entity", "visit_id", "price", "label")


_SUM = "SELECT count(*) AS rows, count(DISTINCT entity) AS entities, CAST(coalesce(sum(label), 0) AS BIGINT) AS events, count(*) - CAST(coalesce(sum(label), 0) AS BIGINT) AS non_events, coalesce(avg(label), 0.0) AS prevalence FROM "


@query(sql("", "raw AS (SELECT o_custkey AS entity, CASE WHEN n = 'F' THEN 1 ELSE 0 END AS label FROM (SELECT *, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE o_orderstatus = 'P' AND n IS NOT NULL);;" + _SUM.replace("coalesce(avg(label), 0.0)", "round(coalesce(avg(label), 0.0), 9)") + "raw"))
def cohort_summary(spark, sf):
    spec = C.VisitSpec("o_custkey", ("o_orderdate", "o_orderkey"), "o_orderstatus", "o_orderdate", "o_orderkey")
    return C.summary(C.index_cohort(view(spark, sf, "orders"), spec, "P", "F"), "o_custkey").withColumn("prevalence", F.round("prevalence", 9))


_WHY = "CASE WHEN rows = 0 THEN 'empty' WHEN entities < 3 THEN 'too_few_entities' WHEN least(events, non_events) = 0 THEN 'one_class' WHEN least(events, non_events) < 3 THEN 'small_class' ELSE 'ok' END AS reason"
_CASES = {"all": "true", "none": "false", "one": "label = 1", "two_entities": "entity < 3"}


@query(sql("v_cohort", ", ".join(f"s_{k} AS ({_SUM} v_cohort WHERE {c})" for k, c in _CASES.items()) + ";;" + " UNION ALL ".join(f"SELECT '{k}' AS subset, rows, entities, events, non_events, {_WHY} FROM s_{k}" for k in _CASES)))
def cohort_eligibility(spark, sf):
    v = view(spark, sf, "v_cohort")
    parts = [C.eligibility(v.where(c)).select(F.lit(k).alias("subset"), "*") for k, c in _CASES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(sql("v_cohort", f"s AS ({_SUM} v_cohort WHERE label = 1);; SELECT 'cohort' AS step, 'stopped' AS status, reason, rows, entities, events FROM (SELECT *, {_WHY} FROM s) WHERE reason <> 'ok'"))
def controlled_stop_report(spark, sf):
    return C.controlled_stop(view(spark, sf, "v_cohort").where("label = 1"), "cohort")


_W = "PARTITION BY entity ORDER BY date NULLS LAST, visit_id"
_HIST = f"""dated AS (SELECT *, {_DATE} AS date FROM v_cohort),
hist AS (SELECT *, row_number() OVER ({_W}) - 1 AS prior_count, date_diff('day', lag(date) OVER ({_W}), date) AS days_since_prior, date_diff('day', min(date) OVER (PARTITION BY entity), date) AS days_since_first,
  lag(price) OVER ({_W}) AS p0, lag(priority) OVER ({_W}) AS q0, lag(flag_a) OVER ({_W}) AS a0, lag(flag_b) OVER ({_W}) AS b0 FROM dated)"""


@query(sql("v_cohort", _HIST + ";; SELECT entity, visit_id, prior_count, days_since_prior, days_since_first FROM hist"))
def history_time_features(spark, sf):
    return C.with_history(_dated(spark, sf), BY_DATE).select("entity", "visit_id", "prior_count", "days_since_prior", "days_since_first")


@query(sql("v_cohort", _HIST + ";; SELECT visit_id, CASE WHEN prior_count > 0 THEN 1 ELSE 0 END AS has_prior, prior_count, days_since_prior, round(days_since_prior / 365.25E0, 9) AS years_since_prior, round(days_since_first / 365.25E0, 9) AS years_since_first FROM hist"))
def trajectory_time(spark, sf):
    h = C.with_history(_dated(spark, sf), BY_DATE)
    return h.select("visit_id", "has_prior", "prior_count", "days_since_prior", F.round("years_since_prior", 9).alias("years_since_prior"), F.round("years_since_first", 9).alias("years_since_first"))


@query(sql("v_cohort", _HIST + ";; SELECT visit_id, p0 AS traj_price_prior, round(price - p0, 6) AS traj_price_delta, round((price - p0) / nullif(days_since_prior / 365.25E0, 0), 1) AS traj_price_per_year, q0 AS traj_priority_prior, priority - q0 AS traj_priority_delta, round((priority - q0) / nullif(days_since_prior / 365.25E0, 0), 6) AS traj_priority_per_year FROM hist"))
def trajectory_numeric(spark, sf):
    t = C.trajectories(_dated(spark, sf), BY_DATE, ["price", "priority"], [])
    return t.select("visit_id", "traj_price_prior", F.round("traj_price_delta", 6).alias("traj_price_delta"), F.round("traj_price_per_year", 1).alias("traj_price_per_year"), "traj_priority_prior", "traj_priority_delta", F.round("traj_priority_per_year", 6).alias("traj_priority_per_year"))


def _trans(c, p):
    return f"{p} AS traj_{c}_prior, CASE WHEN {c} = 1 AND {p} = 0 THEN 1 ELSE 0 END AS traj_{c}_new, CASE WHEN {c} = 0 AND {p} = 1 THEN 1 ELSE 0 END AS traj_{c}_stopped"


@query(sql("v_cohort", _HIST + f";; SELECT visit_id, {_trans('flag_a', 'a0')}, {_trans('flag_b', 'b0')} FROM hist"))
def trajectory_transitions(spark, sf):
    t = C.trajectories(_dated(spark, sf), BY_DATE, [], ["flag_a", "flag_b"])
    return t.select("visit_id", *[c for c in t.columns if c.startswith("traj_")])


@query(sql("v_cohort", _HIST + ";; SELECT entity, visit_id, state, label, price, p0 AS traj_price_prior, a0 AS traj_flag_a_prior FROM hist"))
def trajectory_attach(spark, sf):
    t = C.trajectories(_dated(spark, sf), BY_DATE, ["price"], ["flag_a"])
    return t.select("entity", "visit_id", "state", "label", "price", "traj_price_prior", "traj_flag_a_prior")
