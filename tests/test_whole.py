"""Registered queries do the whole job: expected rows come from plain Python over the input rows, not from the SQL texts."""

import datetime
import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortspark.functions.hashing import MIXER, POISSON_STEPS
from cohortspark.operators import evaluate, models, tokens
from cohortspark.plans import ORACLES, QUERIES
from cohortspark.plans.views import view


def test_orders_of_more_than_13_lines(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    one = lines.first()["l_orderkey"]
    n = 240  # over 100 parts in the last column
    longer = lines.limit(n).withColumn("l_orderkey", F.lit(one).cast(dict(lines.dtypes)["l_orderkey"])).withColumn("l_linenumber", (F.lit(100) + F.row_number().over(Window.orderBy("l_orderkey", "l_linenumber", "l_partkey"))).cast(dict(lines.dtypes)["l_linenumber"]))
    for t in ("orders", "part"):
        spark.read.parquet(f"{sf}/{t}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    lines.unionByName(longer).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    raws = [r["raw"] for r in view(spark, str(tmp_path), "v_tokens_long").where(F.col("visit_id") == one).orderBy("pos").collect()]
    assert len(raws) > n
    parts = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").select("i", tokens.tokens_of(F.col("raw")).alias("t")).orderBy("i").collect()
    want = list(dict.fromkeys(t for r in parts for t in r["t"]))
    got = QUERIES["wide_to_token_array"](spark, str(tmp_path)).where(F.col("visit_id") == one).first()
    assert got["token_text"] == " | ".join(want) and got["token_count"] == len(want)
    con = duckdb.connect()
    for t in ("orders", "part", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert con.execute(f"SELECT token_text FROM ({ORACLES['wide_to_token_array']}) WHERE visit_id = {one}").fetchone()[0] == got["token_text"]


def by_hand(texts, share, most=None):
    counts = sorted(Counter(t for t in texts if t).items(), key=lambda x: (-x[1], x[0]))
    total, seen, out = sum(n for _, n in counts), 0, []
    for rank, (t, n) in enumerate(counts, 1):
        if seen < total * share and (most is None or rank <= most):
            out.append((t, n, rank))
        seen += n
    return out


def test_coverage_alone_ends_the_selection(spark):
    texts = [f"t{i % 90 if i % 3 else i}" for i in range(700)] + ["", None, "ü", "Z"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "txt string")
    for share, most in ((0.4, None), (0.8, None), (1.0, None), (0.8, 25), (0.0, None)):
        for ranges in (1, 7, 64):
            got = tokens.by_coverage(df, "txt", share, most, ranges)
            assert sorted((r["txt"], r["n"], r["rank"]) for r in got.collect()) == sorted(by_hand(texts, share, most))
    assert tokens.by_coverage(df.where("false"), "txt", 0.8).count() == 0
    sf = "/root/testdata/sf0.01"
    texts = [r["token_text"] for r in QUERIES["wide_to_token_array"](spark, sf).collect()]
    got = sorted(map(tuple, QUERIES["select_by_coverage"](spark, sf).collect()))
    assert len(got) > 3000 and got == sorted(by_hand(texts, 0.8))
    assert sum(n for _, n, _ in got) >= 0.8 * sum(t != "" for t in texts)


def weight_by_hand(unit, rep):
    """The weight of a unit in a replicate, in whole numbers."""
    hexed = hashlib.md5(unit.encode()).hexdigest()
    x = (int(hexed[:8], 16) + rep * (int(hexed[8:16], 16) | 1)) % 2**32
    for _ in range(2):
        x = ((x >> 16) ^ x) * MIXER % 2**32
    return sum(((x >> 16) ^ x) / 2**32 >= s for s in POISSON_STEPS)


def replicates(rows, reps):
    """auc, ap, brier and balanced accuracy of each replicate by the definitions, over repeated rows."""
    out = {"auc": [], "ap": [], "brier": [], "balanced_accuracy": []}
    for rep in range(reps):
        w = [weight_by_hand(rid, rep) for rid, _, _ in rows]
        pos = [(r, k) for (_, y, r), k in zip(rows, w, strict=True) if y == 1 and k]
        neg = [(r, k) for (_, y, r), k in zip(rows, w, strict=True) if y == 0 and k]
        p, q = sum(k for _, k in pos), sum(k for _, k in neg)
        if not p or not q:
            continue
        out["auc"].append(sum(k * j * ((r > s) + 0.5 * (r == s)) for r, k in pos for s, j in neg) / (p * q))
        at = lambda side, r: sum(k for s, k in side if s >= r)
        out["ap"].append(sum(k * at(pos, r) / (at(pos, r) + at(neg, r)) for r, k in pos) / p)
        out["brier"].append((sum(k * (1 - r) ** 2 for r, k in pos) + sum(k * r * r for r, k in neg)) / (p + q))
        out["balanced_accuracy"].append((at(pos, 0.5) / p + 1 - at(neg, 0.5) / q) / 2)
    return {m: np.array(x) for m, x in out.items()}


def test_bootstrap_of_200_replicates(spark):
    rows = [(f"r{i % 22}", int(i % 3 == 0), round((i * 7 % 10) / 10, 1)) for i in range(25)]  # some identifiers repeat
    other = [(rid, y, round(1 - r * r, 2)) for rid, y, r in rows]
    df = spark.createDataFrame([("a", *x) for x in rows] + [("b", *x) for x in other], "model string, rid string, y int, risk double")
    a, b = replicates(rows, 200), replicates(other, 200)
    assert len(a["auc"]) > 190
    for r in evaluate.bootstrap(df, 200).collect():
        x = (a if r["model"] == "a" else b)[r["metric"]]
        assert r["n_valid"] == len(x) and np.allclose([r["low"], r["high"]], np.quantile(x, [0.025, 0.975]))
    for r in evaluate.bootstrap_delta(df, [("a", "b")], 200).collect():
        x = b[r["metric"]] - a[r["metric"]]
        assert r["n_valid"] == len(x) and np.allclose([r["low"], r["high"]], np.quantile(x, [0.025, 0.975]))
    assert {r["n_valid"] for r in QUERIES["bootstrap_ci"](spark, "/root/testdata/sf0.001").collect()} == {200}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_computed_once(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("select_first", "select_most_frequent", "alias_normalize", "wide_to_token_array"):
        plan = plan_of(QUERIES[name](spark, sf))
        assert plan.count("l_linenumber") and plan.count("split(") == 1 and "Window [row_number" not in plan, name
    for name in ("select_by_coverage", "dictionary_rollup", "dictionary_attach", "abstraction_progress", "encode_distinct_texts"):
        assert "l_linenumber" not in plan_of(QUERIES[name](spark, sf)), name  # rows that are read several times are written once


def test_clean_tokens_by_hand(spark):
    import re

    some = ["", " ", "N/A", "n  a", "*not-codable*", "not app", "Not applicable!", "not  \t applied", "\t*abc*", "a\tb", "a \n b", "a  b", "a b", "nan.", "-", "--x--", "nano", "no", "none of", "`A'b`", "é", "n\u00e9a", "unk\u2028", "x\u00a0y", "  \" q \" "]

    def by_hand(c):
        t = re.sub(r"[ \t\n\x0b\f\r]+", " ", (c or "").lower().strip(" ").strip("*\"'` ")).strip(" ")
        return "" if re.sub(r"[^a-z0-9]+", " ", t).strip(" ") in tokens.PLACEHOLDERS else t

    df = spark.createDataFrame([(i, c) for i, c in enumerate([*some, None])], "i int, c string")
    for r in df.select("c", tokens.clean_token(F.col("c")).alias("t")).collect():
        assert r["t"] == by_hand(r["c"]), repr(r["c"])
    wide = spark.createDataFrame([("a|B| n/a", None, "b|C", "", "*c* |d"), (None,) * 5], "a string, b string, c string, d string, e string")
    assert [r["t"] for r in wide.select(tokens.tokens_of_columns(wide.columns).alias("t")).collect()] == [["a", "b", "c", "d"], []]


def test_arms_grow_all_trees(spark, tmp_path, monkeypatch):
    """Labels that depend on bands of the price: trees end near the share of labels that are turned round, which a few of them can't."""
    r = random.Random(8)
    rows = []
    for c in range(500):
        for k in range(0, 8, 2):
            price = round(r.uniform(1000, 400_000), 2)
            band = (price // 80_000) % 2 == 0
            for i, status in enumerate(("P", "F" if band != (r.random() < 0.05) else "O")):
                rows.append((8 * c + k + i, c, status, price, datetime.datetime(1992 + k + i, 6, 15), f"{1 + c % 5}-X"))
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    fitted, fit = {}, models.fit_arms
    monkeypatch.setattr(models, "fit_arms", lambda *args: fitted.update(fit(*args)) or fitted)
    got = {x["model"]: x for x in QUERIES["arm_matrix"](spark, str(tmp_path)).collect()}
    assert list(got) and got.keys() == fitted.keys() == {f"{f}_{s}" for f in ("logistic", "gbt") for s in ("base", "flags")}
    assert [len(fitted[f"gbt_{s}"].trees) for s in ("base", "flags")] == [300, 300]
    assert len({x["n"] for x in got.values()}) == 1 and got["gbt_base"]["n"] > 100
    assert all(got[f"gbt_{s}"]["brier"] < 0.1 < 0.2 < got[f"logistic_{s}"]["brier"] for s in ("base", "flags")), got
