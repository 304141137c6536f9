"""Models of arms: fits, tuning on validation, calibration and permutation importance."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.operators import boosting, isotonic
from cohortspark.operators import evaluate as E
from cohortspark.operators import split as S
from cohortspark.operators.boosting import Boosted, Tree
from cohortspark.operators.logistic import Candidate, Logistic, fit_all
from cohortspark.sources.tables import written


@dataclass(frozen=True)
class Arm:
    """A model of one family on one feature set."""

    name: str
    family: str  # logistic or gbt
    features: tuple[str, ...]
    parameters: dict = field(default_factory=dict, hash=False)


def arm_matrix(sets: dict[str, list[str]], families: list[str]) -> list[Arm]:
    """All arms: every family on every feature set."""
    return [Arm(f"{family}_{name}", family, tuple(columns)) for name, columns in sets.items() for family in families]


def fit_arms(train: DataFrame, arms: dict[str, Arm], label: str = "label") -> dict[str, Logistic | Boosted]:
    """Fitted arms by name; classes are balanced by weights. All logistic arms are fitted together, one aggregate per round.

    Logistic: L2 with strength `c`. gbt: leaf-wise trees with `trees`, `rate`, `leaves`, `l2`, `least` rows in a leaf, `bins`, and an early stop after `patience` trees that don't
    lower the loss by `tolerance` on the share `stop` of the training rows (by a hash of their features); under 100 rows, or 5 of a class, all rows train and all trees are grown.
    """
    weighted = S.balanced_weights(train, label)
    linear = {n: Candidate(a.features, a.parameters.get("c", 1.0)) for n, a in arms.items() if a.family == "logistic"}
    out = fit_all(weighted, linear, label, "weight") if linear else {}
    counts = None
    for name, arm in arms.items():
        if name in linear:
            continue
        p = dict(arm.parameters)
        stop, held = p.pop("stop", None), None
        if stop:
            counts = counts or [r["count"] for r in train.groupBy(label).count().collect()]
            if sum(counts) >= 100 and len(counts) == 2 and min(counts) >= 5:
                held = F.pmod(F.xxhash64(*arm.features), F.lit(1000)) < int(stop * 1000)
        out[name] = boosting.fit(weighted, arm.features, label, "weight", held, **p)
    return {name: out[name] for name in arms}


def fit(train: DataFrame, arm: Arm, label: str = "label") -> Logistic | Boosted:
    """One fitted arm."""
    return fit_arms(train, {arm.name: arm}, label)[arm.name]


def predict(model: Logistic | Boosted, df: DataFrame, out: str = "risk") -> DataFrame:
    """Adds P(y = 1)."""
    return df.withColumn(out, model.risk())


def scored(models: dict[str, Logistic | Boosted], df: DataFrame, key: str, label: str, *keep: str) -> DataFrame:
    """Predictions of all models in the long form, from one pass over the rows."""
    wide = df.select(F.col(key).alias("rid"), F.col(label).alias("y"), *keep, *[m.risk().alias(f"_r{i}") for i, m in enumerate(models.values())])
    return wide.select("rid", "y", *keep, F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_r{i}").alias("risk")) for i, n in enumerate(models)]))).select("model", "rid", "y", "risk", *keep)


def save(models: dict[str, Logistic | Boosted], spark: SparkSession, path: str, metadata: dict | None = None) -> None:
    """A table with one row per model and one of metadata, which load() turns back into models that score alike."""
    rows = [(n, type(m).__name__, json.dumps(asdict(m))) for n, m in models.items()] + [("", "metadata", json.dumps(metadata or {}))]
    spark.createDataFrame(rows, "name string, kind string, content string").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> tuple[dict[str, Logistic | Boosted], dict]:
    """Models by name, and metadata."""
    models, metadata = {}, {}
    for r in spark.read.parquet(path).collect():  # a row per model
        x = json.loads(r["content"])
        if r["kind"] == "metadata":
            metadata = x
        elif r["kind"] == "Logistic":
            models[r["name"]] = Logistic(tuple(x["features"]), tuple(x["coefficients"]), x["intercept"])
        else:
            trees = tuple(Tree(**{k: tuple(v) for k, v in t.items()}) for t in x["trees"])
            models[r["name"]] = Boosted(tuple(x["features"]), tuple(map(tuple, x["edges"])), x["base"], trees, tuple(x["held_loss"]))
    return models, metadata


def tune(train: DataFrame, validation: DataFrame, arm: Arm, grid: list[dict], key: str, label: str = "label") -> DataFrame:
    """Validation metrics of the distinct candidates, ranked by auc, ap and Brier score; all are fitted and evaluated together."""
    seen = {repr(sorted(p.items())): p for p in [arm.parameters, *grid]}
    fitted = fit_arms(train, {name: Arm(arm.name, arm.family, arm.features, p) for name, p in seen.items()}, label)
    table = E.metrics(scored(fitted, validation, key, label))
    rank = F.row_number().over(Window.orderBy(F.desc("auc"), F.desc("ap"), "brier", "model"))  # a few candidates
    return table.select("model", "auc", "ap", "brier", rank.alias("rank"), (rank == 1).alias("winner"))


def calibrate_isotonic(validation: DataFrame, test: DataFrame, risk: str = "risk", label: str = "y") -> DataFrame:
    """Test rows with the isotonic fit of the validation rows, linear between its corners."""
    points = isotonic.corners(isotonic.blocks(validation, risk, label))
    return isotonic.apply(test, points, risk)


def sigmoid(validation: DataFrame, test: DataFrame, risk: str = "risk", label: str = "y") -> DataFrame:
    """Test rows with Platt-calibrated risk: a logistic model of the risk alone, without penalty."""
    model = fit_all(validation.select(F.col(risk).alias("_f"), F.col(label).alias("_y")), {"m": Candidate(("_f",), None)}, "_y")["m"]
    return test.withColumn("_f", F.col(risk)).withColumn("calibrated", model.risk()).drop("_f")


def calibrations(validation: DataFrame, test: DataFrame, names: tuple[str, str, str] = ("raw", "isotonic", "sigmoid")) -> DataFrame:
    """Raw, isotonic and sigmoid risks of the test rows (rid, y, risk) as three models."""
    raw = test.select(F.lit(names[0]).alias("model"), "rid", "y", "risk")
    for name, f in zip(names[1:], (calibrate_isotonic, sigmoid), strict=True):
        raw = raw.unionAll(f(validation, test).select(F.lit(name).alias("model"), "rid", "y", F.col("calibrated").alias("risk")))
    return raw


INTERNAL = ("internal_raw", "internal_isotonic", "internal_sigmoid")


def training_only(train: DataFrame, test: DataFrame, arm: Arm, entity: str, key: str, label: str = "label", share: float = 0.2, salt: str = "calibration") -> DataFrame | None:
    """Calibration that looks at training rows alone, as three models of the test rows (INTERNAL); None where a side lacks a class.

    Training entities are split: the arm is fitted on one side, calibrators on its scores of the other, so no entity is on both.
    """
    sides = train.withColumn("_side", calibration_side(F.col(entity), share, salt))
    counts = {(r["_side"], r["y"]): r["n"] for r in sides.groupBy("_side", F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not counts.get((side, y)) for side in ("train", "test") for y in (0, 1)):
        return None
    model = fit(sides.where("_side = 'train'").drop("_side"), arm, label)
    ask = lambda df: scored({"m": model}, df, key, label).drop("model")
    return calibrations(ask(sides.where("_side = 'test'")), ask(test), INTERNAL)


def calibration_side(entity: Column, share: float = 0.2, salt: str = "calibration") -> Column:
    """`train` for the base model, `test` for the calibrators."""
    return S.two_way(entity, share if 0.05 <= share <= 0.5 else 0.2, salt)


def calibration_compare(validation: DataFrame, test: DataFrame, train: DataFrame | None = None, arm: Arm | None = None, features_of_test: DataFrame | None = None, entity: str = "entity", key: str = "rid", label: str = "y") -> DataFrame:
    """Scored rows of raw, isotonic and sigmoid risks fitted on validation, and with `train` and `arm` also those fitted inside the training rows, as up to six models."""
    out = calibrations(validation, test)
    inner = training_only(train, features_of_test, arm, entity, key, label) if train is not None else None
    return out if inner is None else out.unionAll(inner)


def _ranked(df: DataFrame, key: str, salt: str, buckets: int, name: str) -> DataFrame:
    """Rows numbered inside buckets of the key by a hash order: a permutation that is never one global sort."""
    b = F.pmod(F.xxhash64(key), F.lit(buckets))
    return df.withColumn("_b", b).withColumn(name, F.row_number().over(Window.partitionBy("_b").orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key)))


def feature_groups(groups: dict[str, list[str]], columns: list[str] | tuple[str, ...]) -> dict[str, list[str]]:
    """The groups' columns that are there; groups without any are left out."""
    some = {name: [c for c in group if c in columns] for name, group in groups.items()}
    return {name: group for name, group in some.items() if group}


def permutation_importance(model: Logistic | Boosted, df: DataFrame, blocks: dict[str, list[str]], key: str, label: str, repeats: int = 1, rows: int = 2000, buckets: int = 1) -> DataFrame:
    """Drop of auc when a block of columns is permuted jointly: mean and sample deviation over repeats, on at most `rows` rows (the documented bound of this diagnostic).

    All blocks and repeats are stacked and evaluated in one job. The bounded rows are written once, as every block reads them.
    """
    base = written(E.bounded_sample(df, key, "importance", rows))
    stack = predict(model, base).select(F.lit("|0").alias("model"), F.col(label).alias("y"), "risk")
    for name, columns in blocks.items():
        for r in range(repeats):
            left = _ranked(base.drop(*columns), key, "keep", buckets, "_n")
            right = _ranked(base.select(key, *columns), key, f"{name}{r}", buckets, "_n").drop(key)
            mixed = left.join(right, ["_b", "_n"])
            stack = stack.unionAll(predict(model, mixed).select(F.lit(f"{name}|{r}").alias("model"), F.col(label).alias("y"), "risk"))
    auc = E.ranking(stack).select(F.split("model", r"\|")[0].alias("block"), "auc")
    whole = auc.where("block = ''").select(F.col("auc").alias("base_auc"))
    return auc.where("block <> ''").join(whole, how="cross").groupBy("block").agg(F.avg(F.col("base_auc") - F.col("auc")).alias("importance"), F.stddev_samp(F.col("base_auc") - F.col("auc")).alias("sd"), F.count(F.lit(1)).alias("repeats"))
