"""Hand-made frames: nulls, ties, invalid dates, placeholders, empty tables."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortspark.functions import hashing, values
from cohortspark.operators import clean, cohort, evaluate, ranges, records, split, tokens, vectors
from cohortspark.sources import cache, codebooks, tables
from cohortspark.streaming import feed

VISITS = "entity long, visit_id long, y int, m int, d int, state int"


def test_visits(spark):
    v = spark.createDataFrame([(1, 1, 2000, 1, 1, 3), (1, 2, 2000, 1, 1, 4), (1, 3, 2001, 2, 31, 3), (2, 4, 2000, 13, 1, 3), (3, 5, 2000, 5, 5, 3), (3, 6, 2000, 6, 5, None)], VISITS)
    got = {r["visit_id"]: (r["next_state"], r["label"]) for r in cohort.with_next_state(v, cohort.VisitSpec(), 4).collect()}
    assert got == {1: (4, 1), 2: (3, 0), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}
    c = cohort.index_cohort(v, cohort.VisitSpec(), 3, 4)
    assert [r["visit_id"] for r in c.collect()] == [1]
    assert cohort.summary(c.where("false")).first().asDict() == {"rows": 0, "entities": 0, "events": 0, "non_events": 0, "prevalence": 0.0}
    assert cohort.eligibility(c).first()["reason"] == "too_few_entities"
    dates = [r[0] for r in v.orderBy("visit_id").select(values.to_date(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert dates[2] is None and dates[3] is None and str(dates[4]) == "2000-05-05"


def test_trajectories(spark):
    v = spark.createDataFrame([(1, 1, 2000, 1, 1, 0, 5.0), (1, 2, 2000, 1, 1, 1, 7.0), (1, 3, 2001, 1, 1, None, None), (1, 4, 2002, 1, 1, 0, 9.0)], "entity long, visit_id long, y int, m int, d int, flag int, x double")
    v = v.withColumn("date", values.to_date(F.col("y"), F.col("m"), F.col("d")))
    t = {r["visit_id"]: r for r in cohort.trajectories(v, cohort.VisitSpec(), ["x"], ["flag"]).collect()}
    assert t[2]["traj_x_per_year"] is None and t[2]["traj_x_delta"] == 2.0 and t[2]["traj_flag_new"] == 1
    assert t[3]["traj_x_delta"] is None and t[4]["traj_flag_stopped"] == 0 and t[4]["traj_x_prior"] is None


def test_codes(spark):
    df = spark.createDataFrame([(1, "-4"), (2, " -4.0 "), (3, "-4.4"), (4, "8"), (5, "x"), (6, None), (7, "")], "k int, c string")
    got = [r["c"] for r in clean.replace_codes(df, [-4.0, -4.4, 8.0], ["c"], {"c": [8.0]}).orderBy("k").collect()]
    assert got == [None, None, None, "8", "x", None, ""]
    back = clean.restore_preserved(df.withColumn("c", F.lit(None).cast("string")), df, "k", {"c": [8.0]})
    assert [r["c"] for r in back.orderBy("k").collect()][3] == "8"
    with pytest.raises(clean.ConstraintError, match="sentinels: 4"):
        clean.guard(clean.violations(df, [-4.0, -4.4, 8.0], ["c"], [], []))
    assert clean.blank_columns(df.where("k >= 6")) == ["c"]
    assert clean.blank_columns(df.where("false")) == ["k", "c"]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "*Aspirin*", "aspirin |  N/A"), (2, None, ""), (3, "*not codable*", "Red  Rod|`x`")], "k int, a string, b string")
    got = [r["t"] for r in df.orderBy("k").select(tokens.tokens_of_columns(["a", "b"]).alias("t")).collect()]
    assert got == [["aspirin"], [], ["red rod", "x"]]
    d = {r["token"]: (r["row_frequency"], r["source_columns"]) for r in tokens.dictionary(df, "k", ["a", "b"]).collect()}
    assert d["aspirin"] == (1, "a;b") and len(d) == 3
    n = {r["token"]: (r["match"], r["status"]) for r in tokens.nearest(df.select(F.explode(tokens.tokens_of_columns(["a", "b"])).alias("token")), spark.createDataFrame([("aspirim",), ("x",)], "term string"), 0.8).collect()}
    assert n == {"aspirin": ("aspirim", "nearest"), "x": ("x", "exact"), "red rod": ("red rod", "kept_original")}


def test_records(spark):
    texts = ['{"f1": 1}', 'noise {"f1": 2, "f2": "no"} tail', '```json {"response": {"f1": true}} ```', '{"f1": 1, "con', "", None, "[]", '{"response": "{\\"f1\\": 0}"}', '{"f1":' * 3000 + "1" + "}" * 3000, "x" + '{"f1":' * 3000 + "1" + "}" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, response string")
    got = {r["k"]: r["record"] for r in records.extract_json(df, "response").collect()}
    assert [got[i] and got[i]["f1"] for i in range(10)] == ["1", "2", "true", None, None, None, None, "0", None, None]
    v, b = records.binary_with_violation(F.col("x"))
    seen = spark.createDataFrame([("1",), ("2",), ("yes",), (None,), ("?",), ("-1",)], "x string").select(v.alias("v"), b.alias("b")).collect()
    assert [tuple(r) for r in seen] == [(1, 0), (1, 1), (1, 0), (0, 0), (0, 1), (0, 1)]

    def failing():
        def ask(batch):
            raise RuntimeError("down")

        return ask

    out = records.call_in_batches(spark.createDataFrame([("a",), ("b",)], "t string"), "t", failing, 2).collect()
    assert sorted((r["t"], r["status"]) for r in out) == [("a", "fallback"), ("b", "fallback")]


def test_json_objects():
    first = records.first_object
    assert first("{" * 100_000) is None and first('{"a":' * 200_000 + "1" + "}" * 200_000) is None
    assert first('{"a": {"f1": 1}, "tru') is None and first('x {"a": "}"} y {"b": 1}') == '{"a": "}"}'
    assert first('{"response": {"f1": 1}, "f2": 2}', ["f1", "f2"]) == '{"response": {"f1": 1}, "f2": 2}'
    assert first('{"response": "text {\\"f1\\": 3}"}', ["f1"]) == '{"f1": 3}' and first('{"response": 5}', ["f1"]) is None
    assert first('[{"f1": 1}, 2]') == '{"f1": 1}' and first("[1]") is None and first("no { brace } here") is None and first('{"f1": "\\ud800"}') is not None


def test_batches_are_halved(spark):
    def picky():
        def ask(batch):
            if "bad" in batch:
                raise RuntimeError("no")
            return [{"f1": 1}] * (len(batch) - (len(batch) > 3))

        return ask

    texts = [f"t{i}" for i in range(9)] + ["bad"]
    out = records.call_in_batches(spark.createDataFrame([(t,) for t in texts], "t string"), "t", picky, 1).collect()
    assert {r["t"]: r["status"] for r in out} == {t: "fallback" if t == "bad" else "called" for t in texts}


def test_roll_up_by_salted_keys(spark):
    profiles = spark.createDataFrame([(i, ["hot", f"t{i % 3}"]) for i in range(40)] + [(99, None)], "k int, tokens array<string>")
    recs = spark.createDataFrame([(t, *[1] * 8, 0.5, "model", 1, 2, 0) for t in ("hot", "t0", "t1")], "token string, " + ", ".join(f"{f} int" for f in records.FLAGS) + ", confidence double, provider string, attempts int, elapsed int, review int")
    rows = lambda n: sorted(map(str, records.rolled_up(profiles, "k", "tokens", recs, most_sent=n).collect()))
    assert rows(0) == rows(100) and len(rows(0)) == 41


def test_aliases_by_map_and_by_join(spark, monkeypatch):
    table = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "alias string, canonical string")
    df = spark.createDataFrame([("k", ["c", "a", "b", "q"]), ("k", ["b"]), (None, ["c"]), ("n", None), ("e", []), ("k", ["b"])], "key string, tokens array<string>")
    small = sorted(map(str, tokens.canonical_tokens(df, "tokens", table).collect()))
    monkeypatch.setattr(tokens, "_ALIAS_ROWS", 1)
    assert sorted(map(str, tokens.canonical_tokens(df, "tokens", table).collect())) == small
    assert "canonical=['q', 'x', 'y']" in str(small) and "canonical=None" in str(small) and "canonical=[]" in str(small)


def test_ranges(spark):
    r = random.Random(6)
    data = [(f"k{i % 3}", None if r.random() < 0.1 else round(r.gauss(0, 1), 2)) for i in range(900)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, x double")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {row["k"]: row["quantiles"] for row in ranges.exact_quantiles(df, ["k"], "x", shares).collect()}
    want = {row["k"]: row["q"] for row in df.groupBy("k").agg(F.expr(f"percentile(x, array({', '.join(map(str, shares))}))").alias("q")).collect() if row["q"]}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert ranges.exact_quantiles(df.where("false"), [], "x", [0.5]).first()["quantiles"] == []
    counts = spark.createDataFrame([(f"t{i}", 1 + (i * 7) % 5) for i in range(200)], "t string, n int")
    ranks = {row["t"]: row["rank"] for row in tokens.numbered(counts, "t", "n", 4).collect()}
    assert ranks == {t: i for i, (_, t) in enumerate(sorted((-(1 + (i * 7) % 5), f"t{i}") for i in range(200)), 1)}


def test_quantile_between_equal_values(spark):
    df = spark.createDataFrame([(0.0, 1), (0.22, 35_999_998), (0.5, 1)], "x double, c long")  # at 7,199,999.8 of 0.22: 0.2 * 0.22 + 0.8 * 0.22 is less than 0.22
    assert ranges.exact_quantiles(df, [], "x", [0.2], weight="c").first()["quantiles"] == [0.22]
    assert evaluate.with_quantile_bin(df, [], 5, "x", weight="c").where("x = 0.22").first()["bin"] == 0
    skewed = spark.createDataFrame([(i if i < 900 else i * 10**9,) for i in range(1000)], "id long")
    assert sorted(row["id"] for row in tables.row_window(skewed, "id", 895, 905, rows=50).collect()) == [*range(895, 900), *[i * 10**9 for i in range(900, 905)]]


def test_nearest_vectors(spark):
    r = random.Random(3)
    e = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(60)], "id long, v array<double>")
    one = {(row["id"], row["rank"]): row["neighbour"] for row in vectors.cosine_top(e.where("id < 5"), e, "id", "v", 4, rows=7).collect()}
    rows = {row["id"]: np.array(row["v"]) / np.linalg.norm(row["v"]) for row in e.collect()}
    for q in range(5):
        want = sorted((x for x in rows if x != q), key=lambda x: (-round(float(rows[q] @ rows[x]), 9), x))[:4]
        assert [one[(q, k)] for k in range(1, 5)] == want
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, " "), (4, None)], "k int, t string")
    seen = vectors.encode_distinct(texts, "t", lambda: lambda ts: [[1.0, 2.0] for _ in ts], 2).collect()
    assert {row["k"]: row["vector"] for row in seen} == {1: [1.0, 2.0], 2: [1.0, 2.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}


def test_metrics(spark):
    rows = [("m", 1, 0.9), ("m", 0, 0.9), ("m", 0, 0.1), ("c", 1, 0.5), ("c", 0, 0.5), ("one", 1, 0.2)]
    s = spark.createDataFrame(rows, "model string, y int, risk double")
    r = {x["model"]: x for x in evaluate.metrics(s).collect()}
    assert r["m"]["auc"] == 0.75 and r["m"]["ap"] == 0.5 and r["c"]["auc"] == 0.5 and r["one"]["auc"] is None
    assert r["one"]["precision"] == 0.0 and r["one"]["specificity"] == 0.0
    assert {x["bin"] for x in evaluate.calibration(s.where("model = 'c'")).collect()} == {-1}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=40))
def test_auc_of_the_opposite_risk(spark, pairs):
    s = spark.createDataFrame([("m", y, r / 6.0) for y, r in pairs], "model string, y int, risk double")
    a, b = evaluate.ranking(s).first()["auc"], evaluate.ranking(s.withColumn("risk", 1 - F.col("risk"))).first()["auc"]
    assert (a is None and b is None) or abs(a + b - 1) < 1e-9
    bins = evaluate.calibration(s).agg(F.sum("n")).first()[0]
    assert bins == len(pairs)


def test_splits(spark):
    df = spark.range(2000).select((F.col("id") % 300).alias("entity"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    parts = df.withColumn("split", split.three_way(F.col("entity"), 0.2, 0.1, "x"))
    assert all(not r["leak"] for r in split.overlaps(parts, "entity").collect())
    total = {r["split"]: r["rows"] for r in split.share_table(parts, "entity", "label").collect()}
    assert total["Total"] == 2000 == total["train"] + total["validation"] + total["test"]
    assert split.first_valid_salt(df.where("label = 0"), "entity", "label", ["a", "b"], 0.2, 0.1) is None
    # golden arithmetic of published shares: 16,593, 2,348 and 4,724 of 23,665 visits
    assert [round(100 * n / 23665, 1) for n in (16593, 2348, 4724)] == [70.1, 9.9, 20.0]


def test_poisson(spark):
    one, two = hashing.seeds(F.col("id"))
    seeds = spark.range(20000).select(one.alias("a"), two.alias("b")).toPandas()
    w = hashing.poisson_weights(seeds["a"].to_numpy(), seeds["b"].to_numpy(), 40)
    assert abs(np.corrcoef(w[:, :8].T) - np.eye(8)).max() < 0.03 and abs(np.bincount(w.ravel(), minlength=3)[:3] / w.size - [0.368, 0.368, 0.184]).max() < 0.003
    got = w[:, 3].mean(), w[:, 3].var()
    assert abs(got[0] - 1) < 0.03 and abs(got[1] - 1) < 0.06


def test_sources(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    assert sorted(r["id"] for r in tables.row_window(df, "id", 10, 15).collect()) == [10, 11, 12, 13, 14]
    with pytest.raises(tables.MissingColumns, match="nope"):
        tables.select_columns(df, ["id", "nope"])
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + "name,description\nC1,first côde\nc2,\n".encode())
    (tmp_path / "b.csv").write_text("<html>,</html> not found at all")
    (tmp_path / "d.csv").write_bytes("FIELD,Short Descriptor,code\nc1,låter,7\nC2,sécond,8\n".encode("latin1"))
    (tmp_path / "e.csv").write_text("neither,nor\nno header, of use\n")
    got = {r["name"]: r["status"] for r in codebooks.file_audit(spark, str(tmp_path), ["a.csv", "b.csv", "c.csv", "d.csv"]).collect()}
    assert got == {"a.csv": "ok", "b.csv": "invalid", "c.csv": "missing", "d.csv": "ok"}
    books = codebooks.read_books(spark, str(tmp_path), ["code"])
    assert sorted((r["book"], r["line"], r["name"], r["code"]) for r in books.collect()) == [("a.csv", 1, "C1", None), ("a.csv", 2, "c2", None), ("d.csv", 1, "c1", "7"), ("d.csv", 2, "C2", "8")]
    united = codebooks.unite(books)
    assert {r["key"]: (r["book"], r["description"]) for r in united.collect()} == {"C1": ("a.csv", "first côde"), "C2": ("d.csv", "sécond")}
    names = spark.createDataFrame([("C1",), ("c1",), ("zz",)], "column_name string")
    assert sorted(r["match"] for r in codebooks.look_up(names, united, F.lit("none")).collect()) == ["case_insensitive", "exact", "fallback"]
    with pytest.raises(ValueError, match="no usable"):
        codebooks.read_books(spark, str(tmp_path / "e.csv"))
    assert tables.read_csv(spark, str(tmp_path / "a.csv"), ["name"]).first()["name"] == "C1"
    one = spark.createDataFrame([("k", 1, "old"), ("j", 1, "only")], "key string, batch int, v string")
    two = spark.createDataFrame([("k", 2, "new")], "key string, batch int, v string")
    assert {r["key"]: r["v"] for r in cache.upsert(one, two, "key").collect()} == {"k": "new", "j": "only"}


@pytest.mark.parametrize("compact", [1, 2, 50])
def test_feed(spark, tmp_path, compact):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "1"), ("b", "1")], "key string, v string").coalesce(1).write.parquet(str(src))
    run = lambda: feed.feed(spark.readStream.schema("key string, v string").parquet(str(src)), str(tmp_path / "cache"), "key", str(tmp_path / "ckpt"), compact)
    q = run()
    q.processAllAvailable()
    q.stop()
    spark.createDataFrame([("a", "2")], "key string, v string").coalesce(1).write.mode("append").parquet(str(src))
    q = run()
    q.processAllAvailable()
    q.stop()
    assert {r["key"]: r["v"] for r in feed.latest(spark, str(tmp_path / "cache"), "key").collect()} == {"a": "2", "b": "1"}


def test_split_codes(spark):
    cells = {"8=Unknown; 9 Refused": [8.0, 9.0], "-4.4": [-4.4], "5-8": [5.0, 8.0], "a | -4,b2": ["a", -4.0, "b2"], " , ;": [], "NaN": [], None: [], "88, 99": [88.0, 99.0], "none left": ["none left"]}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    for r in df.select("c", clean.split_codes(F.col("c")).alias("x")).collect():
        assert [x["number"] if x["text"] is None else x["text"] for x in r["x"]] == cells[r["c"]]
    book = spark.createDataFrame([("A ", None, "7", "Unknowns"), ("a", None, "x9", "form versions"), ("b", "1", "2", "known")], "name string, missing_codes string, code string, label string")
    assert sorted((r["column_name"], r["code"], r["text"]) for r in clean.codes_from_codebook(book).collect() if r["code"]) == [("a", 7.0, None), ("b", 1.0, None)]
    assert [(r["column_name"], r["text"]) for r in clean.codes_from_codebook(book).where("code is null").collect()] == [("a", "x9")]


def test_feature_lists(spark):
    df = spark.createDataFrame([(1, 0.5, "x", None, 3), (0, 2.0, None, None, 4)], "flag_z int, price double, note string, gone int, n int")
    got = {r["column_name"]: (r["family"], r["n"]) for r in clean.feature_lists(df, {"flag_": "flag"}, ["n"]).collect()}
    assert got == {"flag_z": ("flag", 2), "price": ("numeric", 2), "note": ("text", 1), "gone": ("empty", 0)}


def test_run_document(spark):
    import json

    from cohortspark.operators.document import run_document

    df = spark.createDataFrame([(1, 0, "train"), (1, 1, "train"), (2, 1, "validation"), (3, 0, "test"), (1, 0, "test")], "entity long, label int, split string")
    models = spark.createDataFrame([("a", 0.7, 0.5, 0.2), ("b", 0.7, 0.6, 0.2)], "model string, auc double, ap double, brier double")
    d = json.loads(run_document(df, "entity", "label", {"arm": {"numeric": ["x", "y"]}}, {"t": 0.5}, models, providers=spark.createDataFrame([("m",), ("m",), ("r",)], "provider string")).first()["document"])
    assert d["cohort"] == {"rows": 5, "entities": 3, "events": 2} and d["best_model"] == "b" and d["features"] == {"arm": {"numeric": 2}} and json.loads(d["parameters"]) == {"t": 0.5}
    assert {s["split"]: (s["rows"], s["entities"]) for s in d["splits"]} == {"train": (2, 1), "validation": (1, 1), "test": (2, 2), "train+validation": (3, 2)}
    assert {o["pair"]: o["entities"] for o in d["overlaps"]} == {"train-validation": 0, "train-test": 1, "validation-test": 0} and {p["provider"]: p["rows"] for p in d["providers"]} == {"m": 2, "r": 1}
