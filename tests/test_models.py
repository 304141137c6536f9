"""Models against known optima, and calibrations against their definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cohortspark.operators import boosting, isotonic
from cohortspark.operators import evaluate as E
from cohortspark.operators import models as M


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(12)
    rows = []
    for i in range(1500):
        x, noise, c = r.gauss(0, 1), r.gauss(0, 1), r.randint(0, 1)
        y = int(r.random() < 1 / (1 + math.exp(-(1.5 * x + 0.8 * c - 0.5))))
        rows.append((i, x, noise, float(c), y))
    return spark.createDataFrame(rows, "id long, x double, noise double, c double, label int").cache()


def newton(X, y, w, c):
    """The optimum of the weighted, penalised loss."""
    Z, beta = np.column_stack([X, np.ones(len(y))]), np.zeros(X.shape[1] + 1)
    pull = np.append(np.full(X.shape[1], 1 / c if c else 0.0), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(Z @ beta)))
        beta = beta - np.linalg.solve(Z.T @ (Z * (w * p * (1 - p))[:, None]) + np.diag(pull), Z.T @ (w * (p - y)) + pull * beta)
    return beta


def test_logistic_optimum(made):
    """Candidates of other features and strengths, fitted together, all reach their own optimum."""
    arms = {f"{'+'.join(cols)} {c}": M.Arm("l", "logistic", cols, {"c": c}) for cols in (("x", "c"), ("noise",), ("c", "x", "noise")) for c in (0.01, 2.0, 50.0)}
    got = M.fit_arms(made, arms)
    pdf = made.toPandas()
    y = pdf["label"].to_numpy()
    w = len(y) / (2 * np.where(y == 1, y.sum(), len(y) - y.sum()))
    for name, arm in arms.items():
        want = newton(pdf[list(arm.features)].to_numpy(), y, w, arm.parameters["c"])
        assert [*got[name].coefficients, got[name].intercept] == pytest.approx(want, abs=1e-6)
    name = "x+c 2.0"
    risk = M.predict(got[name], made).select("x", "c", "risk").first()
    z = got[name].coefficients[0] * risk["x"] + got[name].coefficients[1] * risk["c"] + got[name].intercept
    assert risk["risk"] == pytest.approx(1 / (1 + math.exp(-z)))


def test_logistic_odd_rows(spark):
    """Null features and labels are left out of the fit and have no risk; constant and missing classes give finite models."""
    rows = [(1.0, 1.0, 1), (2.0, 1.0, 0), (None, 1.0, 1), (3.0, 1.0, 1), (2.5, 1.0, None), (0.5, 1.0, 0)] * 5
    df = spark.createDataFrame(rows, "x double, k double, label int")
    m = M.fit(df, M.Arm("l", "logistic", ("x", "k"), {"c": 1.0}))
    assert all(map(math.isfinite, [*m.coefficients, m.intercept])) and m.coefficients[1] == pytest.approx(0, abs=1e-6)
    assert M.predict(m, df).where("x is null").select("risk").distinct().collect()[0][0] is None
    assert M.fit(df.where("false"), M.Arm("l", "logistic", ("x",))).coefficients == (0.0,)


def test_scoring_after_an_observation(made):
    """A session that has observed something still scores, tunes and saves."""
    seen = Observation()
    made.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 1500
    fitted = M.fit_arms(made, {"l": M.Arm("l", "logistic", ("x", "c")), "g": M.Arm("g", "gbt", ("x", "c"), {"trees": 2})})
    assert E.metrics(M.scored(fitted, made, "id", "label")).count() == 2


def brute_tree(x, y, w, leaves, l2, least, rate):
    """Leaf-wise growth by trying every value of every feature at every leaf: the first tree's scores."""
    p = (w * y).sum() / w.sum()
    g, h = w * (p - y), w * p * (1 - p) + 0 * y
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
    parts = [np.ones(len(y), bool)]

    def best(m):
        out = (0.0, None)
        for j in range(x.shape[1]):
            for v in np.unique(x[m, j])[:-1]:
                a, b = m & (x[:, j] <= v), m & (x[:, j] > v)
                if min(a.sum(), b.sum()) >= least and gain(a) + gain(b) - gain(m) > out[0] * (1 + 1e-12) + 1e-12:
                    out = (gain(a) + gain(b) - gain(m), (a, b))
        return out

    while len(parts) < leaves:
        found = [best(m) for m in parts]
        i = max(range(len(parts)), key=lambda i: found[i][0])
        if found[i][1] is None:
            break
        parts[i : i + 1] = found[i][1]
    out = np.full(len(y), math.log(p / (1 - p)))
    for m in parts:
        out[m] -= rate * g[m].sum() / (h[m].sum() + l2)
    return out


@pytest.mark.parametrize(("leaves", "l2", "least"), [(2, 0.05, 1), (6, 0.05, 20), (15, 30.0, 5)])
def test_one_tree_is_the_best_gain_tree(made, leaves, l2, least):
    pdf = made.where("id < 400").withColumn("x", F.round("x", 1)).toPandas()
    df = made.sparkSession.createDataFrame(pdf)
    model = boosting.fit(df, ("x", "c"), trees=1, rate=0.3, leaves=leaves, l2=l2, least=least)
    want = brute_tree(pdf[["x", "c"]].to_numpy(), pdf["label"].to_numpy().astype(float), np.ones(len(pdf)), leaves, l2, least, 0.3)
    got = {r["id"]: r["risk"] for r in M.predict(model, df).select("id", "risk").collect()}
    assert [got[i] for i in pdf["id"]] == pytest.approx(list(1 / (1 + np.exp(-want))))
    assert sum(f < 0 for f in model.trees[0].feature) <= leaves


def test_trees_stop_early_and_take_missing_values(made):
    gone = made.withColumn("x", F.when(F.col("id") % 5 != 0, F.col("x")))
    p = {"trees": 25, "least": 5, "leaves": 4, "rate": 0.9, "patience": 3, "tolerance": 0.0}
    many, few = (M.fit(gone, M.Arm("g", "gbt", ("x", "c"), q)) for q in ({**p, "trees": 12}, {**p, "stop": 0.2}))
    assert len(many.trees) == 12 and len(few.trees) < 25
    # what stopped it: no tree of the last three has a lower held loss than the one before them
    assert len(few.held_loss) == len(few.trees) + 1 and min(few.held_loss[-3:]) >= few.held_loss[-4] and few.held_loss[-4] < few.held_loss[0]
    tiny = M.fit(made.where("id < 60"), M.Arm("g", "gbt", ("x", "c"), {"trees": 3, "stop": 0.2, "least": 5}))
    assert len(tiny.trees) == 3
    table = E.metrics(M.scored({"many": many, "few": few}, gone, "id", "label")).collect()
    assert all(r["auc"] > 0.7 for r in table)
    assert M.fit(made.where("label = 1"), M.Arm("g", "gbt", ("x",))).trees == ()


@pytest.mark.parametrize("more", [{}, {"stop": 0.2, "rate": 0.6, "patience": 3}])
def test_one_task_and_jobs_grow_the_same_trees(made, monkeypatch, more):
    """Wherever the kept rows are, with missing values and held rows, over more trees than passes walk anew."""
    gone = made.withColumn("x", F.when(F.col("id") % 5 != 0, F.col("x"))).unionAll(made.where("id < 100"))
    arm = M.Arm("g", "gbt", ("x", "c"), {"trees": boosting.SETTLED + 3, "least": 20, "leaves": 5, **more})
    task = M.fit(gone, arm)
    monkeypatch.setattr(boosting, "FEW", 0)
    monkeypatch.setattr(boosting, "_in_one_task", None)
    jobs = M.fit(gone, arm)
    assert (len(jobs.trees) == boosting.SETTLED + 3) != bool(more) and (task.edges, len(task.trees)) == (jobs.edges, len(jobs.trees))
    for a, b in zip(task.trees, jobs.trees, strict=True):
        assert (a.feature, a.bin, a.missing_left, a.left, a.right) == (b.feature, b.bin, b.missing_left, b.left, b.right)
        assert a.value == pytest.approx(b.value)
    assert task.held_loss == pytest.approx(jobs.held_loss) and bool(task.held_loss) == bool(more)


def test_tuning_ranks_candidates(made):
    arm = M.Arm("l", "logistic", ("x", "c"), {"c": 1.0})
    got = M.tune(made.where("id % 2 = 0"), made.where("id % 2 = 1"), arm, [{"c": 1e-6}, {"c": 1.0}], "id").collect()
    assert len(got) == 2 and sum(r["winner"] for r in got) == 1 and sorted(r["rank"] for r in got) == [1, 2]
    best = min(got, key=lambda r: (-r["auc"], -r["ap"], r["brier"], r["model"]))
    assert best["winner"] and [a.name for a in M.arm_matrix({"s": ["x"]}, ["logistic", "gbt"])] == ["logistic_s", "gbt_s"]


def pav(pairs):
    """Pool adjacent violators by hand: blocks of (sum, weight, scores)."""
    by = {}
    for s, y in pairs:
        by.setdefault(s, []).append(y)
    blocks = []
    for s in sorted(by):
        blocks.append([sum(by[s]), len(by[s]), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return {s: a / w for a, w, ss in blocks for s in ss}


@pytest.mark.parametrize("few", [isotonic.FEW, 0])
@pytest.mark.parametrize("parts", [1, 3, 20])
def test_isotonic_by_hand(spark, few, parts):
    """Both levels give the fit of one pass, by both ways of applying it; between corners it is linear, beyond them flat."""
    r = random.Random(2)
    for shape in (lambda k: k / 14, lambda k: 1 - k / 14, lambda k: 0.5, lambda k: (k % 3) / 3):
        pairs = [(round(k / 10, 1), int(r.random() < shape(k))) for k in range(1, 10) for _ in range(12)]
        rows = spark.createDataFrame([(i, y, s) for i, (s, y) in enumerate(pairs)] + [(900, None, 0.5), (901, 1, None)], "rid long, y int, risk double")
        want = pav(pairs)
        xs = sorted(want)
        points = isotonic.corners(isotonic.blocks(rows, parts=parts))
        asked = spark.createDataFrame([(s,) for s in [*xs, 0.0, 0.149, 0.777, 2.0, None]], "risk double")
        got = {x["risk"]: x["calibrated"] for x in isotonic.apply(asked, points, few=few).collect()}
        corners = sorted({x["x"]: x["v"] for x in points.collect()}.items())
        assert got.pop(None) is None and got == pytest.approx({s: np.interp(s, *zip(*corners, strict=True)) for s in got}) and {s: got[s] for s in xs} == pytest.approx(want)
    assert isotonic.apply(asked, points.limit(0)).where("calibrated is not null").count() == 0


def test_training_only_calibration(made):
    """No entity is on both sides, and the three models score all test rows."""
    df = made.withColumn("entity", F.floor(F.col("id") / 3))
    sides = df.withColumn("side", M.calibration_side(F.col("entity"))).groupBy("entity").agg(F.count_distinct("side").alias("n"), F.first("side").alias("side"))
    assert {r["n"] for r in sides.select("n").distinct().collect()} == {1}
    assert 0.12 < sides.where("side = 'test'").count() / sides.count() < 0.28
    train, test = df.where("entity % 4 > 0"), df.where("entity % 4 = 0")
    for arm in (M.Arm("l", "logistic", ("x", "c")), M.Arm("g", "gbt", ("x", "c"), {"trees": 2, "leaves": 4})):
        out = M.training_only(train, test, arm, "entity", "id")
        assert {r["model"]: r["n"] for r in out.groupBy("model").agg(F.count("risk").alias("n")).collect()} == dict.fromkeys(M.INTERNAL, test.count())
    # calibrators see the scores of their own side alone
    model = M.fit(train.where(M.calibration_side(F.col("entity")) == "train"), M.Arm("l", "logistic", ("x", "c")))
    cal = M.predict(model, train.where(M.calibration_side(F.col("entity")) == "test")).select("risk", "label").toPandas()
    want = pav(list(zip(cal["risk"], cal["label"], strict=True)))
    got = M.training_only(train, test, M.Arm("l", "logistic", ("x", "c")), "entity", "id").where("model = 'internal_isotonic'").agg(F.min("risk"), F.max("risk")).first()
    assert min(want.values()) <= got[0] + 1e-9 and got[1] <= max(want.values()) + 1e-9
    assert M.training_only(train.where("label = 1"), test, M.Arm("l", "logistic", ("x",)), "entity", "id") is None


def test_sigmoid_optimum(spark):
    r = random.Random(5)
    pairs = [(round(r.random(), 3), 0) for _ in range(400)]
    pairs = [(s, int(r.random() < 1 / (1 + math.exp(-(4 * s - 2))))) for s, _ in pairs]
    rows = spark.createDataFrame([(i, y, s) for i, (s, y) in enumerate(pairs)], "rid long, y int, risk double")
    a, b = 0.0, 0.0
    X, y = np.array([[s, 1.0] for s, _ in pairs]), np.array([y for _, y in pairs])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ beta))
        beta -= np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]), X.T @ (p - y))
    a, b = beta
    got = M.sigmoid(rows, rows).select("risk", "calibrated").collect()
    assert all(x["calibrated"] == pytest.approx(1 / (1 + math.exp(-(a * x["risk"] + b))), abs=2e-3) for x in got)
    names = {x["model"] for x in M.calibration_compare(rows, rows).select("model").distinct().collect()}
    assert names == {"raw", "isotonic", "sigmoid"}


def test_importance_of_a_useless_column(made):
    model = M.fit(made, M.Arm("l", "logistic", ("x", "noise", "c")))
    got = {r["block"]: r for r in M.permutation_importance(model, made, {"x": ["x"], "noise": ["noise"], "both": ["x", "c"]}, "id", "label", repeats=3).collect()}
    assert abs(got["noise"]["importance"]) < 0.02 < 0.1 < got["x"]["importance"] < got["both"]["importance"] + 0.05 and got["x"]["repeats"] == 3


def test_bundle(spark, made, tmp_path):
    fitted = M.fit_arms(made, {"l": M.Arm("l", "logistic", ("x", "c")), "g": M.Arm("g", "gbt", ("x", "c"), {"trees": 2})})
    M.save(fitted, spark, str(tmp_path / "bundle"), {"label": "label"})
    models, metadata = M.load(spark, str(tmp_path / "bundle"))
    assert models == fitted and metadata == {"label": "label"}


def test_feature_groups():
    assert M.feature_groups({"a": ["x", "gone"], "b": ["gone"]}, ("x", "c")) == {"a": ["x"]}


def test_alike_rows_are_kept_as_one(spark, monkeypatch):
    kept = []

    class Counted(boosting.Kept):
        def __init__(self, df):
            super().__init__(df)
            kept.append(self.rows.count())

    monkeypatch.setattr(boosting, "Kept", Counted)
    rows = [(float(i % 5), float(i % 2) if i % 7 else None, int(i * 7 % 11 < 4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    p = {"trees": 12, "least": 1, "bins": 16}
    many = boosting.fit(df, ("a", "b"), **p)
    few = boosting.fit(df.groupBy("a", "b", "label").agg(F.count("*").cast("double").alias("w")), ("a", "b"), weight="w", **p)
    assert kept[0] <= 30 and len(many.trees) == 12  # 5 values, 2 and null, 2 labels
    x = np.array([[a, b] for a in range(5) for b in (0.0, 1.0, np.nan)])
    score = lambda m: m.base + sum(t.scores(m.binned(x), boosting._missing(m.edges)) for t in m.trees)
    assert np.allclose(score(many), score(few))


def test_metrics_read_the_rows_once(spark):
    df = spark.range(400).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS model", "CASE WHEN id % 50 = 7 THEN NULL ELSE CAST(id * 7 % 5 < 2 AS INT) END AS y", "CASE WHEN id % 60 = 9 THEN NULL ELSE round(id * 13 % 97 / 97, 2) END AS risk")
    got = E.metrics(df)
    assert "Range (" not in got._jdf.queryExecution().executedPlan().toString()
    want = E.confusion(df).join(E.ranking(df), "model").join(E.brier(df), "model")
    assert got.dtypes == want.dtypes
    for a, b in zip(got.orderBy("model").collect(), want.orderBy("model").collect(), strict=True):
        assert all(a[c] == pytest.approx(b[c], abs=1e-12) if isinstance(a[c], float) else a[c] == b[c] for c in got.columns)


def test_importance_samples_once(spark):
    df = spark.range(300).selectExpr("id AS k", "CAST(id % 3 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "CAST(id % 2 AS INT) AS label")
    m = M.Logistic(("a", "b"), (1.0, -1.0), 0.0)
    assert "Range (" not in M.permutation_importance(m, df, {"a": ["a"], "b": ["b"]}, "k", "label")._jdf.queryExecution().executedPlan().toString()
