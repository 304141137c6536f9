"""Queries on splits, preprocessing, evaluation, anchors and models."""

from pyspark.sql import functions as F

from cohortspark.functions.hashing import MIXER, POISSON_STEPS
from cohortspark.operators import anchor as A
from cohortspark.operators import evaluate as E
from cohortspark.operators import models as M
from cohortspark.operators import split as S
from cohortspark.operators.document import run_document
from cohortspark.plans.q_clean import place
from cohortspark.plans.registry import query
from cohortspark.plans.views import sql, view
from cohortspark.sources.tables import written


def rounded(df, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- splits
_B = "$h(concat('s1', $s(entity))) % 10000"
_THREE = f"CASE WHEN {_B} < 2000 THEN 'test' WHEN {_B} < 3000 THEN 'validation' ELSE 'train' END"
_SP = f"sp AS (SELECT *, {_THREE} AS split FROM v_cohort)"


def three(spark, sf):
    return view(spark, sf, "v_cohort").withColumn("split", S.three_way(F.col("entity"), 0.2, 0.1, "s1"))


@query(sql("v_cohort", f"x AS (SELECT entity, visit_id, CASE WHEN {_B} < 3000 THEN 'test' ELSE 'train' END AS split FROM v_cohort);; SELECT * FROM x"))
def group_split_2way(spark, sf):
    return view(spark, sf, "v_cohort").select("entity", "visit_id", S.two_way(F.col("entity"), 0.3, "s1").alias("split"))


@query(sql("v_cohort", _SP + ";; SELECT entity, visit_id, split FROM sp"))
def group_split_3way(spark, sf):
    v = view(spark, sf, "v_cohort")
    salt = S.first_valid_salt(v, "entity", "label", [f"s{i}" for i in range(1, 101)], 0.2, 0.1)
    return v.select("entity", "visit_id", S.three_way(F.col("entity"), 0.2, 0.1, salt).alias("split"))


@query(sql("v_cohort", _SP + ", x AS (SELECT split, entity, label FROM sp UNION ALL SELECT 'train+validation', entity, label FROM sp WHERE split <> 'test');; SELECT split, count(*) AS rows, count(DISTINCT entity) AS entities, CAST(sum(label) AS BIGINT) AS events, round(avg(label), 9) AS prevalence FROM x GROUP BY split"))
def split_summary(spark, sf):
    return S.summary(three(spark, sf), "entity", "label")


@query(sql("v_cohort", "tp AS (SELECT entity, CASE WHEN y < 1999 THEN 'train' WHEN y < 2000 THEN 'validation' ELSE 'test' END AS split FROM v_cohort), e AS (SELECT entity, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c FROM tp GROUP BY 1);; SELECT 'train-validation' AS pair, count(*) FILTER (a AND b) AS entities, count(*) FILTER (a AND b) > 0 AS leak FROM e UNION ALL SELECT 'train-test', count(*) FILTER (a AND c), count(*) FILTER (a AND c) > 0 FROM e UNION ALL SELECT 'validation-test', count(*) FILTER (b AND c), count(*) FILTER (b AND c) > 0 FROM e"))
def split_overlaps(spark, sf):
    v = view(spark, sf, "v_cohort")
    return S.overlaps(v.withColumn("split", F.when(F.col("y") < 1999, "train").when(F.col("y") < 2000, "validation").otherwise("test")), "entity")


@query(sql("v_cohort", _SP + ", g AS (SELECT split, count(*) AS rows, count(DISTINCT entity) AS entities, CAST(sum(label) AS BIGINT) AS events FROM sp GROUP BY 1), u AS (SELECT * FROM g UNION ALL SELECT 'Total', CAST(sum(rows) AS BIGINT), CAST(sum(entities) AS BIGINT), CAST(sum(events) AS BIGINT) FROM g);; SELECT split, rows, entities, events, round(rows * 100.0E0 / (SELECT sum(rows) FROM g), 6) AS pct_rows, round(entities * 100.0E0 / (SELECT sum(entities) FROM g), 6) AS pct_entities, round(events * 100.0E0 / (SELECT sum(events) FROM g), 6) AS pct_events FROM u"))
def split_share_table(spark, sf):
    return S.share_table(three(spark, sf), "entity", "label")


def temporal(spark, sf):
    return view(spark, sf, "v_cohort").withColumn("split", S.temporal(F.col("y"), 1999))


@query(sql("v_cohort", "t AS (SELECT count(*) FILTER (y < 1999) AS train_rows, count(*) FILTER (y < 1999 AND label = 1) AS train_events, count(*) FILTER (y >= 1999) AS test_rows, count(*) FILTER (y >= 1999 AND label = 1) AS test_events FROM v_cohort);; SELECT *, CASE WHEN train_rows = 0 OR test_rows = 0 THEN 'empty_part' WHEN train_events IN (0, train_rows) OR test_events IN (0, test_rows) THEN 'one_class' WHEN least(train_events, test_events) < 100 THEN 'too_few_events' ELSE 'ok' END AS reason FROM t"))
def temporal_split(spark, sf):
    return S.temporal_reason(temporal(spark, sf), "label", 100)


@query(sql("v_cohort", "t AS (SELECT CASE WHEN y < 1999 THEN 'before 1999' ELSE 'from 1999' END AS period, count(*) AS visits, CAST(sum(label) AS BIGINT) AS events FROM v_cohort GROUP BY 1), u AS (SELECT * FROM t UNION ALL SELECT 'Total', CAST(sum(visits) AS BIGINT), CAST(sum(events) AS BIGINT) FROM t);; SELECT period, visits, events, round(visits * 100.0E0 / (SELECT sum(visits) FROM t), 6) AS pct_visits, round(events * 100.0E0 / (SELECT sum(events) FROM t), 6) AS pct_events FROM u"))
def temporal_split_table(spark, sf):
    t = temporal(spark, sf).withColumn("split", F.when(F.col("split") == "train", "before 1999").otherwise("from 1999"))
    return S.share_table(t, "entity", "label").select(F.col("split").alias("period"), F.col("rows").alias("visits"), "events", F.col("pct_rows").alias("pct_visits"), "pct_events")


@query(sql("v_cohort", _SP + ", m AS (SELECT min(f) AS f FROM (SELECT flag_b AS f, count(*) AS n FROM sp WHERE split = 'train' AND flag_b IS NOT NULL GROUP BY 1 QUALIFY rank() OVER (ORDER BY n DESC) = 1));; SELECT visit_id, coalesce(flag_b, (SELECT f FROM m)) AS flag_b FROM sp"))
def impute_mode(spark, sf):
    return S.impute_mode(three(spark, sf), F.col("split") == "train", ["flag_b"]).select("visit_id", "flag_b")


@query(sql("v_cohort", _SP + ";; SELECT visit_id, coalesce(CAST(CASE WHEN flag_b IS NULL THEN NULL ELSE price END AS DOUBLE), (SELECT quantile_cont(CASE WHEN flag_b IS NULL THEN NULL ELSE price END, 0.5) FROM sp WHERE split = 'train')) AS price FROM sp"))
def impute_median(spark, sf):
    t = three(spark, sf).withColumn("price", F.when(F.col("flag_b").isNotNull(), F.col("price")))
    return S.impute_median(t, F.col("split") == "train", ["price"]).select("visit_id", "price")


@query(sql("v_cohort", "SELECT visit_id, " + ", ".join(f"CASE WHEN priority = {k} THEN 1 ELSE 0 END AS priority_{k}" for k in range(1, 5)) + " FROM v_cohort"))
def one_hot(spark, sf):
    return S.one_hot(three(spark, sf), (F.col("split") == "train") & (F.col("priority") < 5), "priority").select("visit_id", *[f"priority_{k}" for k in range(1, 5)])


@query(sql("v_cohort", _SP + ";; SELECT visit_id, round((price - (SELECT avg(price) FROM sp WHERE split = 'train')) / (SELECT stddev_pop(price) FROM sp WHERE split = 'train'), 6) AS price FROM sp"))
def standardize(spark, sf):
    return rounded(S.standardize(three(spark, sf), F.col("split") == "train", ["price"]).select("visit_id", "price"), 6)


@query(sql("v_cohort", "SELECT visit_id, label, (SELECT count(*) FROM v_cohort) / (2 * (SELECT count(*) FROM v_cohort AS b WHERE b.label = a.label)) AS weight FROM v_cohort AS a"))
def balanced_weights(spark, sf):
    return S.balanced_weights(view(spark, sf, "v_cohort"), "label").select("visit_id", "label", "weight")


# ---- evaluation
_CONF = "conf AS (SELECT model, count(*) AS n, count(*) FILTER (risk >= 0.5 AND y = 1) AS tp, count(*) FILTER (risk >= 0.5 AND y = 0) AS fp, count(*) FILTER (risk < 0.5 AND y = 0) AS tn, count(*) FILTER (risk < 0.5 AND y = 1) AS fn FROM v_scored GROUP BY 1), conf2 AS (SELECT *, (tp + fn) / n AS prevalence, (tp + tn) / n AS accuracy, coalesce(tp / nullif(tp + fn, 0), 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM conf)"


def rank_sql(src, keys, tag="rk"):
    on = ", ".join(keys)
    return f"""{tag}_g AS (SELECT {on}, risk, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {src} GROUP BY ALL), {tag}_w AS (SELECT *, sum(neg) OVER (PARTITION BY {on} ORDER BY risk) - neg AS below, sum(pos) OVER (PARTITION BY {on} ORDER BY risk DESC) AS ctp, sum(pos + neg) OVER (PARTITION BY {on} ORDER BY risk DESC) AS taken FROM {tag}_g),
{tag} AS (SELECT {on}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * below + 0.5E0 * pos * neg) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auc, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (ctp / taken)) / sum(pos) END AS ap FROM {tag}_w GROUP BY ALL)"""


_R9 = lambda names: ", ".join(f"round({c}, 9) AS {c}" for c in names)
_RATES = ["prevalence", "accuracy", "sensitivity", "specificity", "precision", "balanced_accuracy", "f1"]
_BAL = "(sensitivity + specificity) / 2 AS balanced_accuracy"


@query(sql("v_scored", _CONF + f";; SELECT model, n, tp, fp, tn, fn, {_R9(_RATES)} FROM (SELECT *, {_BAL} FROM conf2)"))
def confusion_metrics(spark, sf):
    return rounded(E.confusion(view(spark, sf, "v_scored")))


@query(sql("v_scored", rank_sql("v_scored", ["model"]) + ";; SELECT model, round(auc, 9) AS auc FROM rk"))
def roc_auc(spark, sf):
    return rounded(E.ranking(view(spark, sf, "v_scored")).select("model", "auc"))


@query(sql("v_scored", rank_sql("v_scored", ["model"]) + ";; SELECT model, round(ap, 9) AS ap FROM rk"))
def average_precision(spark, sf):
    return rounded(E.ranking(view(spark, sf, "v_scored")).select("model", "ap"))


@query(sql("v_scored", "SELECT model, round(avg((risk - y) * (risk - y)), 9) AS brier FROM v_scored GROUP BY 1"))
def brier_score(spark, sf):
    return rounded(E.brier(view(spark, sf, "v_scored")))


_MET = _CONF + ", " + rank_sql("v_scored", ["model"]) + f", met AS (SELECT c.*, {_BAL}, auc, ap, brier FROM conf2 AS c JOIN rk USING (model) JOIN (SELECT model, avg((risk - y) * (risk - y)) AS brier FROM v_scored GROUP BY 1) USING (model))"
_MN = [*_RATES, "auc", "ap", "brier"]


def table(spark, sf):
    return E.metrics(view(spark, sf, "v_scored"))


@query(sql("v_scored", _MET + f";; SELECT model, n, tp, fp, tn, fn, {_R9(_MN)} FROM met"))
def metrics_table(spark, sf):
    return rounded(table(spark, sf))


REPS = 200


def boot_sql(body):
    """Weights are made once for each (rid, rep), by the same walk and mixer as in the library, and then meet the models."""
    mixed = f"(xor(x >> 16, x) * {MIXER}) % 4294967296"
    w = " + ".join(f"CASE WHEN x / 4294967296.0E0 >= {s!r}E0 THEN 1 ELSE 0 END" for s in POISSON_STEPS)
    seed = "CAST(concat('0x', substr(md5(rid), {at}, 8)) AS BIGINT)"
    return sql("v_scored", f"""sc AS MATERIALIZED (SELECT * FROM v_scored), un AS (SELECT rid, {seed.format(at=1)} AS one, {seed.format(at=9)} | 1 AS two FROM (SELECT DISTINCT rid FROM sc)), x0 AS (SELECT rid, rep, (one + rep * two) % 4294967296 AS x FROM un, range({REPS}) AS t(rep)),
x1 AS (SELECT rid, rep, {mixed} AS x FROM x0), x2 AS (SELECT rid, rep, {mixed} AS x FROM x1), x3 AS (SELECT rid, rep, xor(x >> 16, x) AS x FROM x2), wt AS MATERIALIZED (SELECT rid, rep, {w} AS w FROM x3),
g AS (SELECT model, rep, risk, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE w END) AS neg FROM wt JOIN sc USING (rid) WHERE w > 0 GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY model, rep ORDER BY risk) - neg AS below, sum(pos) OVER (PARTITION BY model, rep ORDER BY risk DESC) AS ctp, sum(pos + neg) OVER (PARTITION BY model, rep ORDER BY risk DESC) AS taken FROM g),
m AS (SELECT model, rep, sum(pos * below + 0.5E0 * pos * neg) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc, sum(pos * (ctp / taken)) / sum(pos) AS ap, sum(pos * (risk - 1) * (risk - 1) + neg * risk * risk) / sum(pos + neg) AS brier, (sum(CASE WHEN risk >= 0.5 THEN pos ELSE 0 END) / sum(pos) + sum(CASE WHEN risk >= 0.5 THEN 0 ELSE neg END) / sum(neg)) / 2 AS balanced_accuracy FROM c GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0),
l AS MATERIALIZED (UNPIVOT m ON auc, ap, brier, balanced_accuracy INTO NAME metric VALUE value);; {body}""")


_CI = "count(*) AS n_valid, round(quantile_cont(value, 0.025), 8) AS low, round(quantile_cont(value, 0.975), 8) AS high"


@query(boot_sql(f"SELECT model, metric, {_CI} FROM l GROUP BY ALL"))
def bootstrap_ci(spark, sf):
    return rounded(E.bootstrap(view(spark, sf, "v_scored"), REPS), 8)


@query(boot_sql(f"SELECT reference, enhanced, metric, {_CI} FROM (SELECT a.model AS reference, b.model AS enhanced, metric, b.value - a.value AS value FROM l AS a JOIN l AS b USING (rep, metric) WHERE (a.model, b.model) IN (('tied', 'signal'), ('constant', 'tied'))) GROUP BY ALL"))
def bootstrap_delta_ci(spark, sf):
    return rounded(E.bootstrap_delta(view(spark, sf, "v_scored"), [("tied", "signal"), ("constant", "tied")], REPS), 8)


@query(sql("v_scored", _MET + ";; SELECT p.label, p.reference, p.enhanced, " + ", ".join(f"round(b.{m} - a.{m}, 9) AS delta_{m}" for m in E.METRICS) + " FROM (VALUES ('add signal', 'tied', 'signal'), ('add ties', 'constant', 'tied')) AS p(label, reference, enhanced) JOIN met AS a ON a.model = p.reference JOIN met AS b ON b.model = p.enhanced"))
def incremental_value(spark, sf):
    return rounded(E.incremental(table(spark, sf), [("add signal", "tied", "signal"), ("add ties", "constant", "tied")]))


_EDGE = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"


@query(sql("v_scored", f"e AS (SELECT model, list_sort(list_distinct(quantile_cont(risk, {_EDGE}))) AS e FROM v_scored GROUP BY 1), b AS (SELECT s.*, CASE WHEN len(e) < 2 THEN -1 ELSE greatest(1, len(list_filter(e, lambda x: x < risk))) - 1 END AS bin FROM v_scored AS s JOIN e USING (model));; SELECT model, CAST(bin AS INT) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, round(avg(y), 9) AS observed, round(avg(risk), 9) AS mean_risk, min(risk) AS min_risk, max(risk) AS max_risk, round(avg(risk) - avg(y), 9) AS error FROM b GROUP BY ALL"))
def calibration_bins(spark, sf):
    return rounded(E.calibration(view(spark, sf, "v_scored")))


THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 11)]


@query(sql("v_scored", f"t AS (SELECT CAST(unnest({THRESHOLDS}) AS DOUBLE) AS threshold), s AS (SELECT model, threshold, count(*) FILTER (risk >= threshold AND y = 1) AS tp, count(*) FILTER (risk >= threshold AND y = 0) AS fp, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM v_scored, t GROUP BY ALL);; SELECT model, threshold, tp, fp, round(tp / (p + q) - fp / (p + q) * (threshold / (1 - threshold)), 9) AS net_benefit, round(p / (p + q) - q / (p + q) * (threshold / (1 - threshold)), 9) AS treat_all, 0.0 AS treat_none FROM s"))
def decision_curve(spark, sf):
    return rounded(E.decision_curve(view(spark, sf, "v_scored"), THRESHOLDS))


_SUB = "sg AS (SELECT model, y, risk, 'grp' AS group_name, coalesce(grp, '(missing)') AS group_value FROM v_scored UNION ALL SELECT model, y, risk, 'grp2', coalesce(grp2, '(missing)') FROM v_scored)"


@query(sql("v_scored", _SUB + ", " + rank_sql("sg", ["model", "group_name", "group_value"]) + ";; SELECT model, group_name, group_value, count(*) AS n, round(avg(y), 9) AS prevalence, round(max(auc), 9) AS auc, round(max(ap), 9) AS ap, round(avg((risk - y) * (risk - y)), 9) AS brier FROM sg JOIN rk USING (model, group_name, group_value) GROUP BY ALL HAVING count(*) >= 500"))
def subgroup_metrics(spark, sf):
    return rounded(E.subgroups(view(spark, sf, "v_scored"), ["grp", "grp2"], 500)).select("model", "group_name", "group_value", "n", "prevalence", "auc", "ap", "brier")


@query(sql("v_cohort", "SELECT visit_id, label FROM v_cohort ORDER BY md5('cap' || $s(visit_id)), visit_id LIMIT 400"))
def bounded_sample(spark, sf):
    return E.bounded_sample(view(spark, sf, "v_cohort"), "visit_id", "cap", 400).select("visit_id", "label")


_PV = "pv AS (SELECT visit_id AS rid, label AS y, risk_a, risk_b, CASE WHEN risk_a >= 0.5 THEN 1 ELSE 0 END AS high_a, CASE WHEN risk_b >= 0.5 THEN 1 ELSE 0 END AS high_b FROM v_risks)"


def wide(spark, sf):
    v = view(spark, sf, "v_risks").select(F.col("visit_id").alias("rid"), F.col("label").alias("y"), F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"risk_{m}").alias("risk")) for m in ("a", "b")])))
    return E.risk_table(v, ["a", "b"])


@query(sql("v_risks", _PV + ";; SELECT * FROM pv"))
def risk_table(spark, sf):
    return wide(spark, sf)


@query(sql("v_risks", _PV + ";; SELECT rid, y, round(risk_b - risk_a, 9) AS delta_a_b FROM pv"))
def risk_deltas(spark, sf):
    return rounded(E.risk_deltas(wide(spark, sf), [("a", "b")]))


@query(sql("v_risks", _PV + ";; SELECT rid, y, CASE WHEN high_a = 0 AND high_b = 1 THEN 1 ELSE 0 END AS up FROM pv"))
def reclassification(spark, sf):
    return wide(spark, sf).select("rid", "y", E.reclassified(None, "a", "b").alias("up"))


@query(sql("v_risks", _PV + ";; SELECT rid, y, round(risk_b - risk_a, 9) AS delta, CASE WHEN high_a = 0 AND high_b = 1 THEN 1 ELSE 0 END AS up, risk_b AS risk FROM pv ORDER BY up DESC, y DESC, delta DESC, risk DESC, rid LIMIT 100"))
def top_reclassified(spark, sf):
    return E.top_reclassified(wide(spark, sf), "a", "b", 100)


@query(sql("v_scored", _MET + ";; SELECT model, CASE model WHEN 'tied' THEN 'base' WHEN 'signal' THEN 'base plus signal' ELSE model END AS feature_set, CASE WHEN model IN ('tied', 'signal') THEN 'ranked' ELSE 'other' END AS family, round(auc, 9) AS auc, round(brier, 9) AS brier FROM met"))
def performance_table(spark, sf):
    labels = spark.createDataFrame([("tied", "base", "ranked"), ("signal", "base plus signal", "ranked")], "model string, feature_set string, family string")
    return rounded(E.performance(table(spark, sf), labels).select("model", "feature_set", "family", "auc", "brier"))


@query(sql("v_scored", _MET + ", mm AS (SELECT model, round(auc, 9) AS auc, round(ap, 9) AS ap, round(brier, 9) AS brier FROM met);; SELECT model, metric, value FROM (UNPIVOT mm ON auc, ap, brier INTO NAME metric VALUE value)"))
def metric_melt(spark, sf):
    return rounded(E.melted(table(spark, sf), ["model"], ["auc", "ap", "brier"]))


@query(sql("v_scored", _MET + ";; SELECT model, round(auc, 9) AS auc, round(ap, 9) AS ap, round(brier, 9) AS brier FROM met ORDER BY met.auc DESC, met.ap DESC, met.brier, model LIMIT 1"))
def select_final_model(spark, sf):
    return rounded(E.select_best(table(spark, sf)).select("model", "auc", "ap", "brier"))


@query(sql("v_visits v_cohort v_tokens_wide", "n AS (SELECT (SELECT count(*) FROM v_visits) AS visits, (SELECT count(*) FROM v_cohort) AS cohort, (SELECT count(*) FROM v_tokens_wide WHERE drug1 IS NOT NULL) AS with_tokens);; SELECT 'cohort' AS stage, cohort AS n, visits AS of, round(cohort * 100.0E0 / visits, 6) AS pct, cohort <= visits AS consistent FROM n UNION ALL SELECT 'with_tokens', with_tokens, visits, round(with_tokens * 100.0E0 / visits, 6), with_tokens <= visits FROM n"))
def workflow_coverage(spark, sf):
    v = view(spark, sf, "v_visits").agg(F.count(F.lit(1)).alias("visits"))
    c = view(spark, sf, "v_cohort").agg(F.count(F.lit(1)).alias("cohort"))
    t = view(spark, sf, "v_tokens_wide").agg(F.count("drug1").alias("with_tokens"))
    one = v.join(c, how="cross").join(t, how="cross")
    out = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("stage"), F.col(k).alias("n"), F.col("visits").alias("of")) for k in ("cohort", "with_tokens")])))
    return out.select("stage", "n", "of", F.round(F.col("n") * 100.0 / F.col("of"), 6).alias("pct"), (F.col("n") <= F.col("of")).alias("consistent"))


# ---- anchor outcomes
RULES = {"out1": ("o1", ">=", 3), "out2": ("o2", ">=", 5), "out3": ("o3", ">=", 2), "out4": ("o4", ">", 0), "out5": ("o5", ">", 0)}
_OUT = "oc AS (SELECT *, " + ", ".join(f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} {op} {t} THEN 1.0E0 ELSE 0.0E0 END AS {k}" for k, (c, op, t) in RULES.items()) + " FROM v_anchor)"
_AC = _OUT + ", ac0 AS (SELECT * FROM oc WHERE coalesce(out1, out2, out3, out4, out5) IS NOT NULL), ae AS (SELECT list_sort(list_distinct(quantile_cont(risk_a, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM ac0), ac AS (SELECT ac0.*, CAST(CASE WHEN len(e) < 2 THEN -1 ELSE greatest(1, len(list_filter(e, lambda x: x < risk_a))) - 1 END AS INT) AS quartile FROM ac0, ae)"
_AL = _AC + ", al0 AS (" + " UNION ALL ".join(f"SELECT quartile, '{k}' AS outcome, CAST({k} AS INT) AS y, risk_a, risk_b FROM ac WHERE {k} IS NOT NULL" for k in RULES) + "), al AS (SELECT quartile, outcome, y, 'risk_a' AS model, risk_a AS risk FROM al0 UNION ALL SELECT quartile, outcome, y, 'risk_b', risk_b FROM al0)"


def anchored(spark, sf):
    return A.cohort(A.outcomes(view(spark, sf, "v_anchor"), RULES), list(RULES), "risk_a")


def along(spark, sf):
    return A.long_form(anchored(spark, sf), list(RULES), ["risk_a", "risk_b"], ["quartile"])


@query(sql("v_anchor", _OUT + f";; SELECT visit_id, {', '.join(RULES)} FROM oc"))
def anchor_outcomes(spark, sf):
    return A.outcomes(view(spark, sf, "v_anchor"), RULES).select("visit_id", *RULES)


@query(sql("v_anchor", _AC + f";; SELECT visit_id, quartile, {', '.join(RULES)} FROM ac"))
def anchor_cohort(spark, sf):
    return anchored(spark, sf).select("visit_id", "quartile", *RULES)


@query(sql("v_anchor", _AL + ";; SELECT outcome, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 9) AS prevalence FROM al WHERE model = 'risk_a' GROUP BY 1"))
def anchor_summary(spark, sf):
    return rounded(A.summary(along(spark, sf).where("model = 'risk_a'")))


@query(sql("v_anchor", _AL + ", " + rank_sql("al", ["outcome", "model"]) + ";; SELECT outcome, model, round(avg(risk) FILTER (y = 1), 9) AS mean_positive, round(avg(risk) FILTER (y = 0), 9) AS mean_negative, round(avg(risk) FILTER (y = 1) - avg(risk) FILTER (y = 0), 9) AS difference, round(max(auc), 9) AS auc, round(max(ap), 9) AS ap FROM al JOIN rk USING (outcome, model) GROUP BY ALL"))
def anchor_associations(spark, sf):
    known = A.outcomes(view(spark, sf, "v_anchor"), RULES)
    return rounded(A.associations(A.long_form(known, list(RULES), ["risk_a", "risk_b"], [])))


@query(sql("v_anchor", _AL + ";; SELECT outcome, quartile, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 9) AS rate, round(avg(risk), 9) AS mean_risk FROM al WHERE model = 'risk_a' GROUP BY ALL"))
def anchor_quartiles(spark, sf):
    return rounded(A.quartiles(along(spark, sf).where("model = 'risk_a'")))


# ---- models
SETS = {"base": ["price", "priority"], "flags": ["price", "priority", "flag_a", "flag_b"]}


def modelled(spark, sf, parts=None):
    """The models' rows. The parts of the cohort and the prepared rows are written once each, as fits, scores and what preprocessing learns read them many times."""
    return written(_prepared(written(three(spark, sf)) if parts is None else parts))


def _prepared(parts):
    v = S.impute_mode(parts, F.col("split") == "train", ["flag_b"])
    return S.standardize(v, F.col("split") == "train", ["price"]).select("entity", "visit_id", "y", "split", "label", *SETS["flags"]).withColumn("priority", F.col("priority").cast("double"))


def _part(df, *names):
    return df.where(F.col("split").isin(*names))


_MODE = "(SELECT min(f) FROM (SELECT flag_b AS f, count(*) AS n FROM sp WHERE split = 'train' AND flag_b IS NOT NULL GROUP BY 1 QUALIFY rank() OVER (ORDER BY n DESC) = 1))"


@query(sql("v_cohort", _SP + f";; SELECT visit_id, round((price - (SELECT avg(price) FROM sp WHERE split = 'train')) / (SELECT stddev_pop(price) FROM sp WHERE split = 'train'), 6) AS price, CAST(priority AS DOUBLE) AS priority, flag_a, coalesce(flag_b, {_MODE}) AS flag_b FROM sp"))
def feature_frame(spark, sf):
    return rounded(_prepared(three(spark, sf)).select("visit_id", *SETS["flags"]), 6)


# ---- models in SQL: Newton steps in a recursive query, with the linear equations solved by elimination in lists
_FF = f"ff AS (SELECT entity, visit_id, y, split, label, (price - (SELECT avg(price) FROM sp WHERE split = 'train')) / (SELECT stddev_pop(price) FROM sp WHERE split = 'train') AS price, CAST(priority AS DOUBLE) AS priority, CAST(flag_a AS DOUBLE) AS flag_a, CAST(coalesce(flag_b, {_MODE}) AS DOUBLE) AS flag_b FROM sp)"


def balanced_sql(tag, src):
    return f"{tag} AS (SELECT *, count(*) OVER () / (2.0E0 * count(*) OVER (PARTITION BY label)) AS w FROM {src})"


def newton_sql(tag, src, features, c, label="label", steps=25):
    """A clause `tag` (beta) of the optimum on the rows of src (features, label, w)."""
    x = [*features, "1.0E0"]
    n = len(x)
    z = " + ".join(f"beta[{i + 1}] * {v}" for i, v in enumerate(x))
    pull = [f" + beta[{i + 1}] / {float(c)!r}E0" if c and i < n - 1 else "" for i in range(n)]
    cell = lambda i, j: f"sum(w * p * (1 - p) * {x[i]} * {x[j]})" + (f" + 1 / {float(c)!r}E0" if c and i == j < n - 1 else "")
    m = "[" + ", ".join("[" + ", ".join([cell(i, j) for j in range(n)] + [f"sum(w * (p - {label}) * {x[i]}){pull[i]}"]) + "]" for i in range(n)) + "]"
    text = f"SELECT it, beta, {m} AS m FROM (SELECT it, beta, w, {label}, {', '.join(features)}, 1 / (1 + exp(-({z}))) AS p FROM {tag}_r, {src} WHERE it < {steps}) GROUP BY it, beta"
    for k in range(1, n + 1):
        text = f"SELECT it, beta, list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / r[{k}]) ELSE list_transform(r, lambda v, j: v - r[{k}] * m[{k}][j] / m[{k}][{k}]) END) AS m FROM ({text})"
    zeros = ", ".join(["0.0E0"] * n)
    return f"{tag}_r AS (SELECT 0 AS it, [{zeros}] AS beta UNION ALL SELECT it + 1, list_transform(beta, lambda v, i: v - m[i][{n + 1}]) FROM ({text})), {tag} AS (SELECT beta FROM {tag}_r ORDER BY it DESC LIMIT 1)"


def risk_sql(features):
    return "1 / (1 + exp(-(" + " + ".join(f"beta[{i + 1}] * {v}" for i, v in enumerate([*features, "1.0E0"])) + ")))"


def model_sql(names, body):
    return sql(names, body).replace("WITH ", "WITH RECURSIVE ", 1)


_TRAIN = ", ".join([_SP, _FF, balanced_sql("tr", "ff WHERE split = 'train'")])
_ONE = _TRAIN + ", " + newton_sql("nb", "tr", SETS["flags"], 1.0)
_TEST = _ONE + f", sc AS (SELECT visit_id, label AS y, 'logistic' AS model, {risk_sql(SETS['flags'])} AS risk FROM ff, nb WHERE split = 'test')"
_SCM = _MET.replace("v_scored", "sc")
_METRICS_OF = f"SELECT model, n, tp, fp, tn, fn, {_R9(_MN).replace(', 9)', ', 7)')} FROM met"


def _fit(spark, sf, family):
    df = modelled(spark, sf)
    arm = M.Arm(family, family, tuple(SETS["flags"]), {"trees": 30, "stop": 0.15, "least": 30} if family == "gbt" else {})
    return M.fit(_part(df, "train"), arm), df


@query(model_sql("v_cohort", _TEST + ", " + _SCM + f";; {_METRICS_OF}"))
def fit_logistic(spark, sf):
    m, df = _fit(spark, sf, "logistic")
    return rounded(E.metrics(M.scored({"logistic": m}, _part(df, "test"), "visit_id", "label")), 7)


@query()
def fit_gbt(spark, sf):
    m, df = _fit(spark, sf, "gbt")
    return E.metrics(M.scored({"gbt": m}, _part(df, "test"), "visit_id", "label"))


@query(model_sql("v_cohort", _TEST + ";; SELECT visit_id, y AS label, round(risk, 7) AS risk FROM sc"))
def predict_positive(spark, sf):
    m, df = _fit(spark, sf, "logistic")
    return rounded(M.predict(m, _part(df, "test")).select("visit_id", "label", "risk"), 7)


@query()
def arm_matrix(spark, sf):
    df = modelled(spark, sf)
    arms = {a.name: a for a in M.arm_matrix(SETS, ["logistic", "gbt"])}
    return E.metrics(M.scored(M.fit_arms(_part(df, "train"), arms), _part(df, "validation"), "visit_id", "label"))


GRID = [0.1, 1.0, 10.0]
_TUNE = _TRAIN + "".join(", " + newton_sql(f"n{i}", "tr", SETS["flags"], c) for i, c in enumerate(GRID)) + ", sc AS (" + " UNION ALL ".join(f"SELECT label AS y, '[(''c'', {c})]' AS model, {risk_sql(SETS['flags'])} AS risk FROM ff, n{i} WHERE split = 'validation'" for i, c in enumerate(GRID)) + ")"


@query(model_sql("v_cohort", _TUNE + ", " + _SCM + ", rr AS (SELECT *, row_number() OVER (ORDER BY auc DESC, ap DESC, brier, model) AS rank FROM met);; SELECT model, round(auc, 7) AS auc, round(ap, 7) AS ap, round(brier, 7) AS brier, CAST(rank AS INT) AS rank, rank = 1 AS winner FROM rr"))
def tune_on_validation(spark, sf):
    df = modelled(spark, sf)
    return rounded(M.tune(_part(df, "train"), _part(df, "validation"), M.Arm("logistic", "logistic", tuple(SETS["flags"]), {"c": 1.0}), [{"c": c} for c in GRID], "visit_id"), 7)


@query(model_sql("v_cohort", ", ".join([_SP, _FF, balanced_sql("tr", "ff WHERE split <> 'test'"), newton_sql("nb", "tr", SETS["flags"], 1.0)]) + f";; SELECT visit_id, label, round({risk_sql(SETS['flags'])}, 7) AS risk FROM ff, nb WHERE split = 'test'"))
def refit_and_score(spark, sf):
    df = modelled(spark, sf)
    m = M.fit(_part(df, "train", "validation"), M.Arm("logistic", "logistic", tuple(SETS["flags"])))
    return rounded(M.predict(m, _part(df, "test")).select("visit_id", "label", "risk"), 7)


def _sides(spark, sf):
    v = view(spark, sf, "v_risks").withColumn("split", S.three_way(F.col("entity"), 0.4, 0.3, "s1")).select(F.col("visit_id").alias("rid"), F.col("label").alias("y"), F.col("risk_a").alias("risk"), "split")
    return _part(v, "validation").drop("split"), _part(v, "test").drop("split")


def isotonic_sql(tag, cal, test):
    """A clause `tag` (test's columns, calibrated): the isotonic fit by the min-max rule of averages over stretches of scores, linear between the ends of its blocks."""
    return f"""{tag}_s AS (SELECT *, sum(s) OVER (ORDER BY risk) AS cs, sum(c) OVER (ORDER BY risk) AS cc, row_number() OVER (ORDER BY risk) AS i FROM (SELECT risk, sum(y) AS s, count(*) AS c FROM {cal} GROUP BY 1)),
{tag}_l AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cc - a.cc + a.c) AS v FROM {tag}_s AS a JOIN {tag}_s AS b ON b.i >= a.i), {tag}_m AS (SELECT a, b AS i, min(v) OVER (PARTITION BY a ORDER BY b DESC) AS v FROM {tag}_l), {tag}_v AS (SELECT i, max(v) AS v FROM {tag}_m GROUP BY 1),
{tag}_p AS (SELECT risk AS x, v FROM {tag}_v JOIN {tag}_s USING (i)), {tag} AS (SELECT t.*, CASE WHEN p.x IS NULL THEN q.v WHEN q.x IS NULL THEN p.v WHEN p.x = q.x THEN p.v ELSE p.v + (t.risk - p.x) / (q.x - p.x) * (q.v - p.v) END AS calibrated FROM {test} AS t ASOF LEFT JOIN {tag}_p AS p ON t.risk >= p.x ASOF LEFT JOIN {tag}_p AS q ON t.risk <= q.x)"""


def sigmoid_sql(tag, cal, test):
    return f"{tag}_c AS (SELECT *, 1.0E0 AS w FROM {cal}), " + newton_sql(f"{tag}_b", f"{tag}_c", ["risk"], None, "y") + f", {tag} AS (SELECT t.*, {risk_sql(['risk'])} AS calibrated FROM {test} AS t, {tag}_b)"


_SIDE = "vr AS (SELECT visit_id AS rid, label AS y, risk_a AS risk, CASE WHEN {b} < 4000 THEN 'test' WHEN {b} < 7000 THEN 'validation' ELSE 'train' END AS split FROM v_risks), ca AS (SELECT rid, y, risk FROM vr WHERE split = 'validation'), te AS (SELECT rid, y, risk FROM vr WHERE split = 'test')".format(b=_B)


@query(model_sql("v_risks", _SIDE + ", " + isotonic_sql("iso", "ca", "te") + ";; SELECT rid, y, risk, round(calibrated, 7) AS calibrated FROM iso"))
def calibrate_isotonic(spark, sf):
    return rounded(M.calibrate_isotonic(*_sides(spark, sf)).select("rid", "y", "risk", "calibrated"), 7)


@query(model_sql("v_risks", _SIDE + ", " + sigmoid_sql("sig", "ca", "te") + ";; SELECT rid, y, risk, round(calibrated, 7) AS calibrated FROM sig"))
def calibrate_sigmoid(spark, sf):
    return rounded(M.sigmoid(*_sides(spark, sf)).select("rid", "y", "risk", "calibrated"), 7)


_CB = "$h(concat('calibration', $s(entity))) % 10000"
_INNER = f"ss AS (SELECT *, CASE WHEN {_CB} < 2000 THEN 'test' ELSE 'train' END AS side FROM ff WHERE split = 'train'), " + balanced_sql("st", "ss WHERE side = 'train'") + ", " + newton_sql("nb", "st", SETS["flags"], 1.0) + f", ia AS (SELECT visit_id AS rid, label AS y, {risk_sql(SETS['flags'])} AS risk FROM ss, nb WHERE side = 'test'), ie AS (SELECT visit_id AS rid, label AS y, {risk_sql(SETS['flags'])} AS risk FROM ff, nb WHERE split = 'test')"
_SIX = ", ".join([_SIDE, isotonic_sql("iso", "ca", "te"), sigmoid_sql("sig", "ca", "te"), _SP, _FF, _INNER, isotonic_sql("iso2", "ia", "ie"), sigmoid_sql("sig2", "ia", "ie")]) + ", sc AS (SELECT 'raw' AS model, y, risk FROM te UNION ALL SELECT 'isotonic', y, calibrated FROM iso UNION ALL SELECT 'sigmoid', y, calibrated FROM sig UNION ALL SELECT 'internal_raw', y, risk FROM ie UNION ALL SELECT 'internal_isotonic', y, calibrated FROM iso2 UNION ALL SELECT 'internal_sigmoid', y, calibrated FROM sig2)"
_SIXM = ["prevalence", "brier"]


@query(model_sql("v_cohort v_risks", _SIX + ", " + _SCM + f";; SELECT model, n, {_R9(_SIXM).replace(', 9)', ', 7)')} FROM met"))
def calibration_compare(spark, sf):
    df = modelled(spark, sf)
    arm = M.Arm("logistic", "logistic", tuple(SETS["flags"]))
    out = M.calibration_compare(*_sides(spark, sf), _part(df, "train"), arm, _part(df, "test"), "entity", "visit_id", "label")
    return rounded(E.metrics(out).select("model", "n", *_SIXM), 7)


_YEAR = _SP + ", " + _FF.replace("ff AS (", "f0 AS (", 1) + ", ff AS (SELECT * REPLACE (CASE WHEN y < 1999 THEN 'train' ELSE 'test' END AS split) FROM f0), " + balanced_sql("tr", "ff WHERE split = 'train'") + "".join(", " + newton_sql(f"n{k}", "tr", cols, 1.0) for k, cols in SETS.items())
_YEAR += ", sc AS (" + " UNION ALL ".join(f"SELECT label AS y, 'logistic_{k}' AS model, {risk_sql(cols)} AS risk FROM ff, n{k} WHERE split = 'test'" for k, cols in SETS.items()) + ")"


@query(model_sql("v_cohort", _YEAR + ", " + _SCM + f";; {_METRICS_OF}"))
def temporal_validation(spark, sf):
    df = modelled(spark, sf).withColumn("split", S.temporal(F.col("y"), 1999))
    fitted = M.fit_arms(_part(df, "train"), {a.name: a for a in M.arm_matrix(SETS, ["logistic"])})
    return rounded(E.metrics(M.scored(fitted, _part(df, "test"), "visit_id", "label")), 7)


def importance_sql(blocks, repeats, rows=2000):
    """Blocks permuted by the order of one hash against the order of another, and the drop of auc."""
    order = lambda salt: f"row_number() OVER (ORDER BY md5('{salt}' || $s(visit_id)), visit_id)"
    base = f"bs AS (SELECT * FROM ff WHERE split = 'test' ORDER BY md5('importance' || $s(visit_id)), visit_id LIMIT {rows})"
    parts = [f"SELECT '|0' AS model, label AS y, {risk_sql(SETS['flags'])} AS risk FROM bs, nb"]
    for name, cols in blocks.items():
        for r in range(repeats):
            keep = ", ".join(c for c in SETS["flags"] if c not in cols)
            left = f"(SELECT label{', ' + keep if keep else ''}, {order('keep')} AS n FROM bs)"
            right = f"(SELECT {', '.join(cols)}, {order(f'{name}{r}')} AS n FROM bs)"
            parts.append(f"SELECT '{name}|{r}', label, {risk_sql(SETS['flags'])} FROM {left} JOIN {right} USING (n), nb")
    out = "SELECT split_part(model, '|', 1) AS block, round(avg(b - auc), 7) AS importance, round(stddev_samp(b - auc), 7) AS sd, count(*) AS repeats FROM (SELECT model, auc, (SELECT auc FROM rk WHERE model = '|0') AS b FROM rk WHERE model <> '|0') GROUP BY 1"
    return model_sql("v_cohort", ", ".join([_ONE, base, "sc AS (" + " UNION ALL ".join(parts) + ")", rank_sql("sc", ["model"])]) + ";; " + out)


_SINGLE = {c: [c] for c in SETS["flags"]}
#: Feature groups by what the columns describe; only columns of the frame count.
GROUPS = {"order": ["price", "priority", "clerk"], "flags": ["flag_a", "flag_b"], "none of the frame": ["other"]}


@query(importance_sql(_SINGLE, 1))
def permutation_importance(spark, sf):
    m, df = _fit(spark, sf, "logistic")
    return rounded(M.permutation_importance(m, _part(df, "test"), _SINGLE, "visit_id", "label"), 7)


@query(importance_sql({"order": ["price", "priority"], "flags": ["flag_a", "flag_b"]}, 2))
def grouped_permutation_importance(spark, sf):
    m, df = _fit(spark, sf, "logistic")
    return rounded(M.permutation_importance(m, _part(df, "test"), M.feature_groups(GROUPS, m.features), "visit_id", "label", repeats=2), 7)


@query(model_sql("v_cohort", _TEST + ";; SELECT visit_id, round(risk, 7) AS risk FROM sc"))
def model_bundle_sink(spark, sf):
    m, df = _fit(spark, sf, "logistic")
    out = place(spark)
    M.save({"logistic": m}, spark, out, {"features": SETS["flags"]})
    return rounded(M.predict(M.load(spark, out)[0]["logistic"], _part(df, "test")).select("visit_id", "risk"), 7)


@query(model_sql("v_cohort v_visits v_dictionary v_scored", _TUNE + ", " + _SCM + ", tn AS (SELECT model AS tuned FROM met ORDER BY met.auc DESC, met.ap DESC, met.brier, model LIMIT 1), x AS (SELECT split, entity, label FROM sp UNION ALL SELECT 'train+validation', entity, label FROM sp WHERE split <> 'test'), pa AS (SELECT split, count(*) AS rows, count(DISTINCT entity) AS entities, CAST(sum(label) AS BIGINT) AS events FROM x GROUP BY 1), ov AS (SELECT count(*) FILTER (n > 1) AS shared FROM (SELECT entity, count(DISTINCT split) AS n FROM sp GROUP BY 1));; SELECT split, rows, entities, events, (SELECT count(*) FROM v_visits) AS source_rows, (SELECT count(*) FROM v_cohort) AS cohort_rows, shared, tuned, 'signal' AS best_model, (SELECT count(*) FROM v_dictionary WHERE provider = 'model') AS model_rows, 2 AS base_numeric, 200 AS bootstrap FROM pa, ov, tn"))
def run_metadata_json(spark, sf):
    """The run's document, written as JSON and read again; a row for each part of the split."""
    parts = written(three(spark, sf))
    df = modelled(spark, sf, parts)
    tuning = M.tune(_part(df, "train"), _part(df, "validation"), M.Arm("logistic", "logistic", tuple(SETS["flags"]), {"c": 1.0}), [{"c": c} for c in GRID], "visit_id")
    tuning = tuning.select(F.lit("logistic").alias("model"), F.col("model").alias("parameters"), "winner")
    features = {"base": {"numeric": SETS["base"]}, "flags": {"numeric": SETS["base"], "binary": ["flag_a", "flag_b"]}}
    made = run_document(parts, "entity", "label", features, {"threshold": 0.5, "bootstrap": REPS, "calibration_bins": 10}, table(spark, sf), tuning, view(spark, sf, "v_dictionary"), view(spark, sf, "v_visits"))
    out = place(spark)
    made.coalesce(1).write.text(out)
    d = spark.read.json(out)
    shared = F.aggregate("overlaps", F.lit(0).cast("long"), lambda s, x: s + x["entities"])
    model_rows = F.filter("providers", lambda x: x["provider"] == "model")[0]["rows"]
    one = d.select(F.explode("splits").alias("s"), F.col("source.rows").alias("source_rows"), F.col("cohort.rows").alias("cohort_rows"), shared.alias("shared"), F.col("tuned")[0]["parameters"].alias("tuned"), "best_model", model_rows.alias("model_rows"), F.col("features.base.numeric").alias("base_numeric"), F.get_json_object("parameters", "$.bootstrap").cast("int").alias("bootstrap"))
    return one.select("s.split", "s.rows", "s.entities", "s.events", *one.columns[1:])
