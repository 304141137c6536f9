"""Evaluation of scored predictions in the long form (row, entity, model, y, risk); every operator handles all models in one job."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.hashing import poisson_weights, seeds
from cohortspark.functions.values import flag
from cohortspark.operators.ranges import exact_quantiles, salted, with_range
from cohortspark.sources.tables import written

KEYS = ["model"]


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confusion(scored: DataFrame, keys: list[str] = KEYS, threshold: float = 0.5) -> DataFrame:
    """Counts at risk >= threshold and the rates from them; empty denominators give 0."""
    high, y = F.col("risk") >= threshold, F.col("y") == 1
    return _rates(scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(high & y).alias("tp"), F.count_if(high & ~y).alias("fp"), F.count_if(~high & ~y).alias("tn"), F.count_if(~high & y).alias("fn")))


def _rates(c: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    c = c.withColumns({"prevalence": _share(tp + fn, F.col("n")), "accuracy": _share(tp + tn, F.col("n")), "sensitivity": _share(tp, tp + fn), "specificity": _share(tn, tn + fp), "precision": _share(tp, tp + fp)})
    return c.withColumns({"balanced_accuracy": (F.col("sensitivity") + F.col("specificity")) / 2, "f1": _share(2 * tp, 2 * tp + fp + fn)})


def by_score(scored: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Positives and negatives of each distinct score: all that ranking metrics need, pre-aggregated by Spark."""
    w = F.lit(1) if weight is None else weight
    return scored.groupBy(*keys, "risk").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0).otherwise(w)).alias("neg"))


def ranking(scored: DataFrame, keys: list[str] = KEYS, weight: Column | None = None) -> DataFrame:
    """auc (ties count half) and average precision over distinct thresholds; null without both classes.

    Distinct scores are cut into ranges; sums over ranges carry over, and windows run inside a range only.
    """
    return ranking_of(by_score(scored, keys, weight), keys)


def ranking_of(by: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """auc and average precision from positives and negatives by distinct score."""
    return _areas(with_range(by, "risk"), keys).select(*keys, "auc", "ap")


def _areas(g: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """auc, ap, brier and balanced accuracy of each key from positives and negatives by distinct score and range; null without both classes."""
    inside = [*keys, "_range"]
    up, every = Window.partitionBy(*keys).orderBy("_range"), Window.partitionBy(*keys)
    part = g.groupBy(*inside).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    above = lambda c: F.sum(c).over(every) - F.sum(c).over(up) + F.col(c)  # noqa: E731  of this range and greater ones
    part = part.select(*inside, (F.sum("_q").over(up) - F.col("_q")).alias("_below"), above("_p").alias("_p"), above("_q").alias("_q"))
    at = Window.partitionBy(*inside).orderBy("risk")
    upto = lambda c: F.sum(c).over(at) - F.col(c)
    g = g.join(part, inside).withColumns({"below": F.col("_below") + upto("neg"), "tp": F.col("_p") - upto("pos"), "fp": F.col("_q") - upto("neg")})
    u = F.sum(F.col("pos") * F.col("below") + 0.5 * F.col("pos") * F.col("neg"))
    ap = F.sum(F.col("pos") * F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")))
    r, high = F.col("risk"), F.col("risk") >= threshold
    squares = F.sum(F.col("pos") * (r - 1) * (r - 1) + F.col("neg") * r * r)
    out = g.groupBy(*keys).agg(u.alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("q"), ap.alias("ap"), squares.alias("b"), F.sum(F.when(high, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(high, 0).otherwise(F.col("neg"))).alias("tn"))
    p, q, ok = F.col("p").cast("double"), F.col("q").cast("double"), (F.col("p") > 0) & (F.col("q") > 0)
    return out.select(*keys, *[F.when(ok, c).alias(k) for k, c in {"auc": F.col("u") / (p * q), "ap": F.col("ap") / p, "brier": F.col("b") / (p + q), "balanced_accuracy": (F.col("tp") / p + F.col("tn") / q) / 2}.items()])


def brier(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return scored.groupBy(*keys).agg(F.avg((F.col("risk") - F.col("y")) * (F.col("risk") - F.col("y"))).alias("brier"))


def metrics(scored: DataFrame, keys: list[str] = KEYS, threshold: float = 0.5) -> DataFrame:
    """The confusion's counts and rates, auc, ap and Brier score, all from sums by distinct score, which are written once: the rows are scored and read once."""
    y, error = F.col("y") == 1, F.col("risk") - F.col("y")
    by = scored.groupBy(*keys, "risk").agg(F.count(F.lit(1)).alias("_n"), F.count_if(y).alias("pos"), F.count_if(~y).alias("_no"), F.sum(error * error).alias("_b"), F.count(error).alias("_known"))
    by = written(by)
    total = lambda c, side: F.sum(F.when(side, F.col(c)).otherwise(0))
    high = F.col("risk") >= threshold
    c = by.groupBy(*keys).agg(F.sum("_n").alias("n"), total("pos", high).alias("tp"), total("_no", high).alias("fp"), total("_no", ~high).alias("tn"), total("pos", ~high).alias("fn"), F.try_divide(F.sum("_b"), F.sum("_known")).alias("brier"))
    areas = ranking_of(by.select(*keys, "risk", "pos", (F.col("_n") - F.col("pos")).alias("neg")), keys)
    rates = _rates(c.drop("brier"))
    return rates.join(areas, keys).join(c.select(*keys, "brier"), keys)


_KEY = np.dtype([("model", np.int32), ("risk", np.float64), ("event", np.bool_)])
_HELD = 20_000  #: keys whose sums a task holds, of one long per replicate


def _weighted(reps: int):
    """Sums of the replicates' weights by (model, risk, event). A task adds blocks of 65,536 rows up and hands its sums on when it holds more than _HELD keys, so that few rows leave it where scores repeat."""

    def block(rows: pa.Table, names: dict) -> tuple[np.ndarray, np.ndarray]:
        coded = rows["model"].combine_chunks().dictionary_encode()
        ids = np.array([names.setdefault(m, len(names)) for m in [*coded.dictionary.to_pylist(), None]])  # null is a model
        scores, risk = np.unique(rows["risk"].to_numpy(), return_inverse=True)
        key = (risk * len(ids) + coded.indices.fill_null(len(ids) - 1).to_numpy()) * 2 + rows["event"].to_numpy()
        order = np.argsort(key, kind="stable")
        found, g = np.unique(key[order], return_inverse=True)
        units, unit = np.unique(rows["one"].to_numpy() << 32 | rows["two"].to_numpy(), return_inverse=True)  # a unit's models share its weights
        weights, unit = poisson_weights(units >> 32 & 0xFFFFFFFF, units & 0xFFFFFFFF, reps), unit[order]
        sums = np.zeros((len(found), reps), np.int64)
        for at in range(0, len(g), 8192):
            some = g[at : at + 8192]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(some)) + 1])
            sums[some[cuts]] += np.add.reduceat(weights[unit[at : at + 8192]], cuts, axis=0, dtype=np.int64)
        keys = np.zeros(len(found), _KEY)
        keys["model"], keys["risk"], keys["event"] = ids[found // 2 % len(ids)], scores[found // 2 // len(ids)], found % 2 == 1
        return keys, sums

    def rows_of(keys: np.ndarray, sums: np.ndarray, names: dict) -> pa.RecordBatch:
        g, rep = np.nonzero(sums)
        models = pa.array(list(names), pa.string()).take(pa.array(keys["model"][g]))
        return pa.RecordBatch.from_pydict({"model": models, "risk": keys["risk"][g], "event": keys["event"][g], "rep": rep.astype(np.int32), "w": sums[g, rep]})

    def run(batches):
        names, held, keys, sums = {}, [], np.zeros(0, _KEY), np.zeros((0, reps), np.int64)
        for batch in _ended(batches):
            if batch is not None:
                held.append(batch)
            if sum(x.num_rows for x in held) >= (65_536 if batch is not None else 1):
                more, added = block(pa.Table.from_batches(held), names)
                both, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
                total = np.zeros((len(both), reps), np.int64)
                total[where[: len(keys)]] = sums
                total[where[len(keys) :]] += added
                keys, sums, held = both, total, []
            if len(keys) > _HELD or (batch is None and len(keys)):
                yield rows_of(keys, sums, names)
                keys, sums = np.zeros(0, _KEY), np.zeros((0, reps), np.int64)

    return run


def _ended(batches):
    """The batches, then None."""
    yield from batches
    yield None


def resampled(scored: DataFrame, reps: int, unit: str = "rid", threshold: float = 0.5) -> DataFrame:
    """auc, ap, brier and balanced accuracy of each model and replicate under Poisson weights that depend on (unit, replicate) alone, so models are paired.

    `unit` is the row, or the entity for a cluster bootstrap. Rows bring two seeds of their unit, and no rows meet by unit. Weights are summed by score inside each
    batch first. Ranges of scores are cut once, on the scores as they are; windows run inside a range of a replicate. Replicates without both classes are left out.
    """
    one, two = seeds(F.col(unit))
    rows = scored.select("model", F.col("risk").cast("double").alias("risk"), F.coalesce(F.col("y") == 1, F.lit(False)).alias("event"), one.alias("one"), two.alias("two")).where("risk is not null")
    w = rows.mapInArrow(_weighted(reps), "model string, risk double, event boolean, rep int, w long")
    g = w.groupBy("model", "rep", "risk").agg(F.sum(F.when(F.col("event"), F.col("w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("event"), 0).otherwise(F.col("w"))).alias("neg"))
    ranged = with_range(g, "risk", edges_of=rows.select("model", "risk").distinct())
    return _areas(ranged, ["model", "rep"], threshold).where("auc is not null")


def _long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.unpivot(keys, names, "metric", "value")


def intervals(reps: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    lo = (1 - level) / 2
    return reps.groupBy(*by).agg(F.count("value").alias("n_valid"), F.expr(f"percentile(value, {lo}D)").alias("low"), F.expr(f"percentile(value, {1 - lo}D)").alias("high"))


METRICS = ["auc", "ap", "brier", "balanced_accuracy"]


def bootstrap(scored: DataFrame, reps: int, unit: str = "rid") -> DataFrame:
    """Percentile intervals of each model's metrics."""
    return intervals(_long(resampled(scored, reps, unit), ["model", "rep"], METRICS), ["model", "metric"])


def bootstrap_delta(scored: DataFrame, pairs: list[tuple[str, str]], reps: int, unit: str = "rid") -> DataFrame:
    """Percentile intervals of the metrics' differences (second minus first) of named pairs, in the same replicates."""
    long = _long(resampled(scored, reps, unit), ["model", "rep"], METRICS)
    named = scored.sparkSession.createDataFrame(pairs, "reference string, enhanced string")
    a, b = long.select(F.col("model").alias("reference"), "rep", "metric", F.col("value").alias("va")), long.select(F.col("model").alias("enhanced"), "rep", "metric", F.col("value").alias("vb"))
    d = named.join(a, "reference").join(b, ["enhanced", "rep", "metric"]).select("reference", "enhanced", "metric", (F.col("vb") - F.col("va")).alias("value"))
    return intervals(d, ["reference", "enhanced", "metric"])


def incremental(table: DataFrame, pairs: list[tuple[str, str, str]], names: list[str] = METRICS) -> DataFrame:
    """Differences of point metrics for labelled pairs."""
    named = table.sparkSession.createDataFrame(pairs, "label string, reference string, enhanced string")
    a = table.select(F.col("model").alias("reference"), *[F.col(m).alias(f"a_{m}") for m in names])
    b = table.select(F.col("model").alias("enhanced"), *[F.col(m).alias(f"b_{m}") for m in names])
    return named.join(a, "reference").join(b, "enhanced").select("label", "reference", "enhanced", *[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(f"delta_{m}") for m in names])


def with_quantile_bin(scored: DataFrame, keys: list[str], bins: int = 10, value: str = "risk", out: str = "bin", weight: str | None = None) -> DataFrame:
    """Right-closed quantile bins from 0 with duplicate edges dropped; -1 for a null value and where all values are equal.

    Edges are exact percentiles, one array per key, and come back by salted keys, so that a hot key is dealt to many tasks. `weight`: how many rows a row stands for.
    """
    edges = exact_quantiles(scored, keys, value, [i / bins for i in range(bins + 1)], weight=weight)
    edges = edges.select(*keys, F.array_sort(F.array_distinct("quantiles")).alias("_e"))
    both = salted(scored, edges, keys, "left") if keys else scored.join(F.broadcast(edges.agg(F.first("_e").alias("_e"))), how="cross")
    below = F.size(F.filter("_e", lambda e: e < F.col(value)))
    flat = F.col("_e").isNull() | (F.size("_e") < 2)
    return both.withColumn(out, F.when(F.col(value).isNull() | flat, -1).otherwise(F.greatest(F.lit(1), below) - 1)).drop("_e")


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Observed and predicted risk per bin and their difference; bins are told for distinct scores."""
    by = scored.groupBy("model", "risk").agg(F.count(F.lit(1)).alias("_c"), F.count("y").alias("_known"), F.sum("y").alias("_y"))
    b = with_quantile_bin(by, KEYS, bins, weight="_c")
    scores = F.sum(F.when(F.col("risk").isNotNull(), F.col("_c")))
    out = b.groupBy("model", "bin").agg(F.sum("_c").alias("n"), F.sum("_y").cast("long").alias("events"), (F.sum("_y") / F.sum("_known")).alias("observed"), (F.sum(F.col("risk") * F.col("_c")) / scores).alias("mean_risk"), F.min("risk").alias("min_risk"), F.max("risk").alias("max_risk"))
    return out.withColumn("error", F.col("mean_risk") - F.col("observed"))


def decision_curve(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Net benefit of each model at each threshold in (0, 1), of treating all and of treating none; one pass over the distinct scores."""
    g = by_score(scored, KEYS).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds if 0 < t < 1])))
    high = F.col("risk") >= F.col("threshold")
    s = g.groupBy("model", "threshold").agg(F.sum(F.when(high, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(high, F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    odds, n = F.col("threshold") / (1 - F.col("threshold")), F.col("p") + F.col("q")
    return s.select("model", "threshold", "tp", "fp", (F.col("tp") / n - F.col("fp") / n * odds).alias("net_benefit"), (F.col("p") / n - F.col("q") / n * odds).alias("treat_all"), F.lit(0.0).alias("treat_none"))


def subgroups(scored: DataFrame, groups: list[str], least: int) -> DataFrame:
    """Metrics of each model in each value of each group column (a null value is a group) with at least `least` rows and both classes."""
    long = scored.select("model", "y", "risk", F.inline(F.array(*[F.struct(F.lit(g).alias("group_name"), F.col(g).cast("string").alias("group_value")) for g in groups])))
    long = long.withColumn("group_value", F.coalesce("group_value", F.lit("(missing)")))
    m = metrics(long, ["model", "group_name", "group_value"])
    return m.where((F.col("n") >= least) & F.col("auc").isNotNull())


def bounded_sample(df: DataFrame, key: str, salt: str, most: int) -> DataFrame:
    """At most `most` rows, the same ones each time: those of the smallest hashes."""
    return df.orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key).limit(most)


def risk_table(scored: DataFrame, models: list[str], threshold: float = 0.5) -> DataFrame:
    """One row per scored row with every model's risk and high-risk flag."""
    wide = scored.groupBy("rid", "y").pivot("model", models).agg(F.first("risk"))
    return wide.select("rid", "y", *[F.col(m).alias(f"risk_{m}") for m in models], *[flag(F.col(m) >= threshold).alias(f"high_{m}") for m in models])


def risk_deltas(wide: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return wide.select("rid", "y", *[(F.col(f"risk_{b}") - F.col(f"risk_{a}")).alias(f"delta_{a}_{b}") for a, b in pairs])


def reclassified(wide: DataFrame, a: str, b: str) -> Column:
    """1 where the reference is low and the enhanced model high."""
    return flag((F.col(f"high_{a}") == 0) & (F.col(f"high_{b}") == 1))


def top_reclassified(wide: DataFrame, a: str, b: str, n: int = 100) -> DataFrame:
    d = wide.select("rid", "y", F.round(F.col(f"risk_{b}") - F.col(f"risk_{a}"), 9).alias("delta"), reclassified(wide, a, b).alias("up"), F.col(f"risk_{b}").alias("risk"))
    return d.orderBy(F.desc("up"), F.desc("y"), F.desc("delta"), F.desc("risk"), "rid").limit(n)


def performance(table: DataFrame, labels: DataFrame) -> DataFrame:
    """Metrics with the models' feature set and family; unknown models keep their name."""
    return table.join(labels, "model", "left").withColumn("feature_set", F.coalesce("feature_set", "model")).withColumn("family", F.coalesce("family", F.lit("other")))


def melted(table: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return _long(table, keys, names)


def select_best(table: DataFrame) -> DataFrame:
    """The model of the highest auc, then ap, then the lowest Brier score, then by name."""
    return table.orderBy(F.desc("auc"), F.desc("ap"), "brier", "model").limit(1)
