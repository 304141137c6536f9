"""The operators of the llm subpackage against brute force, held-out accuracy, exact round trips and SQL, with edge cases."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from cohortspark.llm import common, components, decontamination, embedding_dedup, language_id, license_scan, ngram_join, packing, pii_crf, quality_cnn, substring_dedup, tool_calls
from cohortspark.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, k string, t int"
ODD = [(1, None, None, None, None, None, None, None), (2, "", "en", None, 0, 1.0, "x", 1), (3, "   \n\t", "en", "a", 5, 0.0, "x", 1), (4, "...!!! 123", "fr", "a", 9, 0.0, "y", 2), (None, "A text without a key, but with words enough for it to count as one.", "en", "b", 3, 0.0, "z", 3), (6, "é" * 300 + " ok", "fr", "b", 1, 0.0, "z", 3)]
SAME = "One and the same text, which is long enough to be found again: " + " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    long_text = " ".join(random.Random(3).choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(40_000))
    return spark.createDataFrame([*ODD, (7, SAME, "en", "c", 1, 0.0, "q", 4), (8, SAME, "en", "c", 1, 0.0, "q", 4), (8, SAME, "en", "c", 1, 0.0, "q", 4), (9, long_text, "en", "c", 1, 0.0, "q", 4)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    index, up = defaultdict(list), {k: k for k in sets}
    for k, s in sets.items():
        for x in s:
            index[x].append(k)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in sets.items():
        for o, n in Counter(o for x in s for o in index[x] if o < k).items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                a, b = find(k), find(o)
                up[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in sets}


def brute_repeats(texts):
    seen, out = set(), {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                covered[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out[k] = (len(b), sum(covered), sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert len(names) == 11 and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    plain = lambda x: "null" if x is None or x != x else repr(round(float(x), 9)) if isinstance(x, (int, float, np.number)) else str(x)
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].map(plain).to_numpy().tolist()))
    assert rows(got) == rows(want)


# ---- personal data
PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 12 <= len(digits(s)) <= 19 and pii_crf.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    return sorted(((m.start(), m.end(), k) for k, p in enumerate(PATTERNS) for m in p.finditer(t) if ok[k](m.group())), key=lambda s: (s[0], s[2]))


def test_base_spans(texts):
    r = random.Random(1)
    made = ["".join(r.choice("01259@@..-+( )ab \n") for _ in range(r.randint(0, 40))) for _ in range(5000)]
    assert all(pii_crf.base_spans(t) == brute_spans(t) for t in [*made, *texts.values()])


def test_crf_carries_labels(spark, docs, texts):
    model = pii_crf.fit(docs)
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    _, spans = pii_crf.annotate([f'token = "{key}" and much later once more {key} here'], model)[0]
    assert [k for _, _, k in spans] == [4, 4]
    got = {r["doc_id"]: r for r in pii_crf.find(docs, model, redacted=True).collect()}
    assert set(got) == set(texts)
    assert all(got[k]["base_sha256"] == hashlib.sha256(",".join(f"{pii_crf.KINDS[c]}:{a}:{b}" for a, b, c in brute_spans(t)).encode()).hexdigest() for k, t in texts.items())
    assert not any(brute_spans(r["redacted"]) for r in got.values())
    secrets = [k for k, t in texts.items() if re.search(r'token = "[0-9a-f]{40}"', t)]
    assert all("secret:" in got[k]["spans"] for k in secrets)


def test_crf_labels_all_repeats_by_one_cue(docs):
    model = pii_crf.fit(docs)
    for key in ("Ab9dEf3hIj5lMn7pQr1tUv3x", "04dbebab91ab85687d33eeaaf9ac699e1188f962"):
        for far in (" and then many plain words follow in the text ", "\nline {i}: 10.0.0.1 GET "):
            first = f'token = "{key}"'
            for text in (first + "".join(far.replace("{i}", str(i)) + key for i in range(99)), "".join(key + far.replace("{i}", str(i)) for i in range(99)) + first):
                _, spans = pii_crf.annotate([text], model)[0]
                assert sum(k == 4 and text[a:b] == key for a, b, k in spans) == 100
                assert key not in pii_crf.redact(text, spans)


KEY = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def labelled(model, text):
    return [text[a:b] for a, b, k in pii_crf.annotate([text], model)[0][1] if k == 4]


def test_skip_edges_decide(docs):
    model = pii_crf.fit(docs)
    near = KEY[:-1] + "3"
    for key, cue in ((KEY, "token = "), ("Ab9dEf3hIj5lMn7pQr1tUv3x", "api_key: "), ("sess4f7a9b21", "password = ")):
        text = f'first {key} some words {cue}"{key}" and much later once more {key} here'
        assert labelled(model, f"some words {key} and others") == [] and labelled(model, text) == [key] * 3
        alone = pii_crf.Crf(model.unary, model.chain, np.zeros_like(model.skip), model.similar)
        assert labelled(alone, text) == [key]
    text = f'token = "{KEY}" and elsewhere {near} stands'
    assert labelled(model, text) == [KEY, near]
    assert labelled(pii_crf.Crf(model.unary, model.chain, model.skip, np.zeros_like(model.similar)), text) == [KEY]


@pytest.mark.parametrize("cycle", [False, True])
def test_marginals_by_enumeration(cycle):
    r = np.random.default_rng(11)
    for _ in range(20):
        n, k = 6, 4
        unary = r.normal(0, 1.5, (n, k))
        edges = np.array([(int(r.integers(0, i)), i) for i in range(1, n)] + [(0, n - 1)] * cycle)
        pots = np.exp(r.normal(0, 0.3 if cycle else 1.5, (len(edges), k, k)))
        grid = np.indices((k,) * n).reshape(n, -1)
        p = np.exp(sum(unary[i, grid[i]] for i in range(n)) + sum(np.log(pots[e, grid[a], grid[b]]) for e, (a, b) in enumerate(edges)))
        want = np.array([[p[grid[i] == x].sum() for x in range(k)] for i in range(n)]) / p.sum()
        got = pii_crf.sum_product(unary, edges, pots, settled=1e-9)
        got = np.exp(got - got.max(1, keepdims=True))
        assert np.abs(got / got.sum(1, keepdims=True) - want).max() < (0.03 if cycle else 1e-5)


def test_graph_of_repeats_and_likenesses():
    g = pii_crf.graph(["a1b2c3d4e5 x a1b2c3d4e5 word a1b2c3d4e6 999999999", "a1b2c3d4e5"])
    assert g.skip.tolist() == [[0, 1]] and g.similar.tolist() == [[0, 0], [2, 0]] and [0, 1] in g.chain.tolist() and g.docs == [0, 0, 0, 0, 1]
    unary, edges, pots, _ = pii_crf.factors(pii_crf.fit_texts([]), g)
    assert len(unary) == 6 and [5, 2] in edges.tolist() and len(edges) == len(pots)


def test_all_similar_tokens_share_a_factor():
    rng = random.Random(4)
    base = ["order-0000001", "4111222233334444", "user1@site.example", "ab12cd34ef56ab12cd34ef56"]
    names = {b: 0 for b in base} | {f"order-{i:07d}": 0 for i in range(0, 300, 7)}
    for b in base * 12:
        w = list(b)
        for _ in range(rng.choice([1, 1, 2, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice("0123456789")
        names["".join(w)] = 0
    first = {n: i for i, n in enumerate(names)}
    kind = lambda n: (len(n), any(c.isalpha() for c in n), "@" in n)
    near = lambda a, b: kind(a) == kind(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 2
    want = {(i, j) for a, i in first.items() for b, j in first.items() if i < j and near(a, b)}
    groups = pii_crf._alike(first)
    assert {(i, j) for g in groups for k, i in enumerate(g) for j in g[k + 1 :]} == want
    assert not any(set(a) <= set(b) for a in groups for b in groups if a is not b)
    g = pii_crf.graph([" word ".join(names)])
    unary, edges, pots, _ = pii_crf.factors(pii_crf.fit_texts([]), g)
    assert len(edges) == len(pots) and edges.max() < len(unary)
    assert pii_crf.marginals(pii_crf.fit_texts([]), g).shape == (len(g.spans), 6)


def test_many_similar_tokens_share_a_hub():
    text = " and ".join(f"ab12cd34ef5{c}" for c in "0123456789")
    g = pii_crf.graph([text])
    _, edges, _, _ = pii_crf.factors(pii_crf.fit_texts([]), g)
    assert sum(e[1] == 10 for e in edges.tolist()) == 10 and len(edges) <= 10 + 9


def test_pii_odd(odd):
    model = pii_crf.fit_texts([])
    assert pii_crf.find(odd, model).count() == 10 and pii_crf.find(odd.where("false"), model).count() == 0
    assert pii_crf.redacted(odd, model).columns == odd.columns


# ---- tool calls
def test_tool_calls(spark):
    calls = spark.createDataFrame([("a", "search", '{"limit":3,"query":"x"}', None), ("b", "search", '{"limit":99,"other":1}', ["a"]), ("c", "search", "no json", ["b", "missing"]), ("d", "unknown", "{}", ["e"]), ("e", "lookup", '{"query":"é\\n"}', ["d"]), ("a", "search", '{"limit":3,"query":"x"}', None), (None, "x", "{}", None)], "id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([("a", "r1"), ("a", "r0"), ("z", None), (None, "q")], "id string, content string")
    got = {r["id"]: r for r in tool_calls.link(calls, results, tool_calls.TOOLS).collect()}
    assert set(got) == {"a", "b", "c", "d", "e", "z"}
    assert (got["a"]["status"], got["a"]["n_calls"], got["a"]["n_results"]) == ("linked", 2, 2) and got["z"]["status"] == "no_call"
    assert [got[i]["level"] for i in "abcde"] == [0, 1, 2, None, None]
    assert got["b"]["errors"] == "$.query:required;$.limit:maximum;$.other:unknown" and got["c"]["errors"] == "$:json" and got["d"]["errors"] == "$:tool"
    assert got["a"]["canonical"] == '{"arguments":{"limit":3,"query":"x"},"id":"a","level":0,"name":"search","result":"r0"}'
    assert tool_calls.link(calls.where("false"), results.where("false"), {}).count() == 0
    assert tool_calls.violations([1, "a", True], {"type": "array", "items": {"type": ["integer", "string"], "enum": [1, "a"]}}) == ["$[2]:type"]


def test_arguments_without_a_canonical_form(spark):
    bad = ["[" * 100_000, '{"a":' * 200_000 + "1" + "}" * 200_000, '{"a":"\\ud800"}', '{"a":NaN}', '{"a":-Infinity}', '{"a":1e999}', '{"a":1,"a":2}', "9" * 5000, ""]
    good = ['{"a":' + "9" * 400 + "}", '{"a":1.0}', "null", '"\\ud83d\\ude00"']
    calls = spark.createDataFrame([(f"b{i}", "t", x, None) for i, x in enumerate(bad)] + [(f"g{i}", "t", x, None) for i, x in enumerate(good)], "id string, name string, arguments string, needs array<string>")
    calls = calls.withColumn("content", F.lit("clash")).withColumn("level", F.lit(9))
    results = spark.createDataFrame([], "id string, content string").withColumn("name", F.lit("x"))
    got = {r["id"]: r["errors"] for r in tool_calls.link(calls, results, {"t": {}}).collect()}
    assert all(got[f"b{i}"] == "$:json" for i in range(len(bad))) and all(got[f"g{i}"] == "" for i in range(len(good)))
    assert tool_calls.violations(True, {"enum": [1]}) == ["$:enum"] and tool_calls.violations([1.0], {"enum": [[1]]}) == [] and tool_calls.violations({"a": True}, {"enum": [{"a": 1}]}) == ["$:enum"]
    assert tool_calls.violations(10**400, {"type": "integer"}) == [] and tool_calls.violations(1.5, {"type": "integer"}) == ["$:type"]


def test_long_chains_have_levels(spark):
    ids = spark.createDataFrame([(str(i),) for i in range(12)], "id string")
    needs = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1, 12)] + [("3", "0")], "id string, need string")
    assert {r["id"]: r["level"] for r in tool_calls.levels(ids, needs).collect()} == {str(i): i for i in range(12)}


# ---- packing
def test_round_trip(spark, docs, texts):
    tokenizer = packing.tokenizer(packing.vocabulary_path())
    want = {k: [*tokenizer.whole.encode(t, add_special_tokens=False).ids, packing.END] for k, t in texts.items()}
    got = packing.pack(docs, packing.vocabulary_path()).toPandas()
    for k, g in got.sort_values("start").groupby("doc_id"):
        assert g["length"].sum() == len(want[k]) == g["doc_tokens"].iloc[0]
        for r in g.itertuples():
            assert zlib.crc32(np.array(want[k][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    seq = got.sort_values("offset").groupby("sequence_id")
    assert (seq["length"].cumsum() - got.sort_values("offset")["length"] == got.sort_values("offset")["offset"]).all()
    sizes = got.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 4096 and sum(4096 - s for s in sizes if s & (s - 1)) < 0.02 * sizes.sum()


def test_tokenizer_is_exact():
    t = packing.tokenizer(packing.vocabulary_path())
    odd = ["it's DON'T we'll ’quote’ ½ ²", "<|endoftext|> x", "Σίσυφος ΣΑΣ", "İstanbul K", "", "naïve × ÷ ÆØÅ ß ÿ Ÿ", "日本語", "é é", "tab\tx\x0by", "_a_b__ 12.5 1,000", "é" * 50, "x\x00y", "A B"]
    assert [a[:-1].tolist() for a in t.encode(pa.array(odd))] == [t.whole.encode(o, add_special_tokens=False).ids for o in odd]
    assert t.encode(pa.array([None], pa.string()))[0].tolist() == [packing.END]


def test_words_of_one_hash_keep_their_ids(monkeypatch, texts):
    hashes = packing.span_hashes
    monkeypatch.setattr(packing, "span_hashes", lambda *a: hashes(*a) & np.uint64(15))
    monkeypatch.setattr(packing, "_SLICE", 100)
    t = packing.WordTokenizer(packing.vocabulary_path(), most=8)
    some = [x or "" for x in list(texts.values())[:40]]
    for rows in (some[:20], some[20:]):
        assert [a[:-1].tolist() for a in t.encode(pa.array(rows))] == [t.whole.encode(o, add_special_tokens=False).ids for o in rows]
    words = packing.WordTokenizer(packing.vocabulary_path())
    assert [words.encode(pa.array([w]))[0][:-1].tolist() == words.whole.encode(w, add_special_tokens=False).ids for w in ("one", "two", "three", "onetwo") for _ in range(2)] == [True] * 8


def test_packing_odd(odd):
    got = packing.pack(odd, packing.vocabulary_path()).toPandas()
    assert got["length"].sum() == got.drop_duplicates(["doc_id", "doc_tokens"])["doc_tokens"].sum() + got[got.doc_id == 8]["doc_tokens"].iloc[0]
    assert packing.pack(odd.where("false"), packing.vocabulary_path()).count() == 0


# ---- n-gram join
def test_join_against_brute_force(spark, docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_components(texts)


def test_join_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(120):
        w = base.copy()
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"x{r.randrange(10_000)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_units_meet_what_groups_miss(spark):
    r = random.Random(4)
    tails = [[f"t{k}-{i}" for i in range(8)] for k in range(40)]
    texts = {}
    for i in range(700):
        core = [f"v{r.randrange(10**9)}" for _ in range(56)]
        for k, tail in enumerate(r.sample(tails, 2)):
            texts[2 * i + k] = " ".join(core + tail)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(texts)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.near_duplicates(df).collect()} == want
    both = ngram_join._survivors(ngram_join._common(ngram_join._shingles(df.select(F.col("doc_id").alias("k"), F.col("text").alias("t")), 5, 4), 4), 4, 75, ngram_join.SHARED)
    classes = common.cut(both.where("doc is null").drop("doc"))
    groups = common.cut(ngram_join._groups(classes))
    near = common.cut(ngram_join._inside(classes, groups, 75))
    far = ngram_join._across(classes, groups, components.components(near), 75, ngram_join.SHARED).count()
    # pairs with the same least shingle meet in a group, the others only across units
    assert near.count() > 100 and far > 2


def test_unions_bound_overlaps():
    a, b, c, q = (np.array(x, np.uint64) for x in ([1, 2, 3, 4], [3, 4, 5, 6], [7, 8], [1, 2, 5, 9]))
    assert ngram_join.qualifying([a, b, c], [q, c, a], np.array([4, 2, 4]), 75).tolist() == [0, 1, 2]
    assert ngram_join.qualifying([b, c], [q], np.array([4]), 75).tolist() == []


def test_shingles_of_units(spark):
    with pytest.raises(TypeError):
        ngram_join.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_join_odd(odd):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.near_duplicates(odd).collect()}
    assert got[(1, 0)] == 1 and got[(2, 0)] == 2 and got[(3, 0)] == 3 and got[(4, 1)] == 4 and got[(None, 11)] is None
    assert [c for (d, _), c in got.items() if d in (7, 8)] == [7, 7]
    assert ngram_join.near_duplicates(odd.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 100), (7, 7), (None, 3)] + [(500, k) for k in range(501, 540)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[200] == 100 and {got[k] for k in range(500, 540)} == {500}


# ---- language
def test_language_held_out(spark, docs):
    out = QUERIES["op5_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert len(held) and (held["lang"] == held["lang_pred"]).mean() > 0.95 and out["score"].between(0, 1).all()


def test_language_against_brute_force(spark, docs, texts):
    model = language_id.fit(docs)

    def grams(t):
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())
        b = bytes(0x20 if c < 0x80 and not 97 <= c <= 122 and not (c < 9 or 13 < c < 32) and not c == 0 else c for c in b)
        b = re.sub(rb"\xc3([\x80-\x9e])", lambda m: bytes([0xC3, m[1][0] + 32]), b)
        b = re.sub(rb" +", b" ", b)
        for k in (1, 2, 3):
            for i in range(len(b) - k + 1):
                if k == 1:
                    yield b[i] & 4095
                else:
                    g = (b[i] * 257 + b[i + 1]) & 0xFFFFFFFF
                    g = g if k == 2 else (g * 263 + b[i + 2]) & 0xFFFFFFFF
                    yield ((g * 2654435761 & 0xFFFFFFFF) >> 20) + (k - 1) * 4096

    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    for k in sorted(texts)[:40]:
        counts = Counter(grams(texts[k] or ""))
        v = {i: n**0.5 * float(model.idf[i]) for i, n in counts.items()}
        norm = sum(x * x for x in v.values()) ** 0.5 or 1
        cos = [sum(x * float(c[i]) for i, x in v.items()) / norm for c in model.units]
        best = max(range(len(cos)), key=lambda i: cos[i])
        assert got[k]["score"] == pytest.approx(max(0, min(1, cos[best])), abs=1e-4)
        assert got[k]["lang_pred"] == model.languages[model.owner[best]] or sorted(cos)[-1] - sorted(cos)[-2] < 1e-4


def test_languages_of_short_texts_only(spark):
    rows = [(i, "a rather long text in the first language, of some words " * 2, "aa") for i in range(30)] + [(100 + i, "ßüß öäö", "bb") for i in range(5)] + [(200, "x", None)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb"]
    seen = language_id.identify(spark.createDataFrame([(1, "ßü öäö ßß")], "doc_id long, text string"), model).first()
    assert seen["lang_pred"] == "bb"


def test_language_odd(odd, docs):
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["rejected"] for k in (1, 2, 3, 4))
    assert language_id.accepted(odd, model).columns == odd.columns and language_id.identify(odd.where("false"), model).count() == 0
    none = language_id.fit(odd.where("false"))
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}
    far = odd.sparkSession.createDataFrame([(1, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 20)], "doc_id long, text string")
    assert language_id.identify(far, model).first()["rejected"]


# ---- decontamination
def test_leaks_against_brute_force(spark, docs, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    runs = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])
    want = {}
    for k, t in texts.items():
        w = t.lower().split()
        for i, it in items.items():
            m = it.lower().split()
            if not set(runs(w)) & set(runs(m)):
                continue
            b = Counter(runs(m))
            best = max(sum((Counter(runs(w[s : s + len(m)])) & b).values()) / sum((Counter(runs(w[s : s + len(m)])) | b).values()) for s in range(max(1, len(w) - len(m) + 1)))
            if best >= 0.75:
                want[(k, i)] = best
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert got == pytest.approx(want)


def leaky(spark, r, edits=0):
    items = [" ".join(f"w{r.randrange(500)}" for _ in range(r.randint(3, 70))) for _ in range(30)]
    texts = []
    for i in range(120):
        own = [f"w{r.randrange(500)}" for _ in range(r.randint(0, 60))]
        item = r.choice(items).split()
        for _ in range(edits):
            item[r.randrange(len(item))] = "edited"
        texts.append(" ".join(own[: len(own) // 2] + (item if i % 3 else []) + own[len(own) // 2 :]))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), texts, items


def brute_leaks(texts, items):
    runs = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] * bool(w))
    out = {}
    for k, t in enumerate(texts):
        w = t.split()
        for i, item in enumerate(items):
            m = item.split()
            b = runs(m)
            best = max((sum((a & b).values()) / sum((a | b).values()), -s) for s in range(max(1, len(w) - len(m) + 1)) for a in [runs(w[s : s + len(m)])])
            if best[0] >= 0.75:
                out[(k, i)] = (best[0], -best[1], len(m))
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_every_copied_item_is_found(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "_BROADCAST_ROWS", most)
    docs, items, texts, made = leaky(spark, random.Random(21))
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"], r["n_words"]) for r in decontamination.decontaminate(docs, items).collect()}
    want = brute_leaks(texts, made)
    assert len(want) > 70 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_most_edited_items_are_found(spark):
    docs, items, texts, made = leaky(spark, random.Random(22), edits=1)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.decontaminate(docs, items).collect()}
    want = set(brute_leaks(texts, made))
    assert got <= want and len(got) >= 0.9 * len(want) > 15


def test_recall_by_kind_and_number_of_edits(spark):
    """Items with one to four words replaced, inserted or deleted: of those still alike by brute force, nine in ten are found in every kind."""
    r = random.Random(31)
    runs = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    items, texts, alike = [], [], {}
    for kind in ("replace", "insert", "delete"):
        for n in (1, 2, 3, 4):
            for _ in range(25):
                item = [f"w{r.randrange(900)}" for _ in range(r.randint(15 + 35 * (n - 1), 40 + 35 * n))]
                copy = list(item)
                for _ in range(n):
                    at = r.choice([r.randrange(len(copy)), r.choice([0, 1, len(copy) - 1])])
                    copy[at : at + (kind != "insert")] = ["edited"] * (kind != "delete")
                before = r.randrange(40)
                w = [f"v{r.randrange(900)}" for _ in range(before)] + copy + [f"v{r.randrange(900)}" for _ in range(r.randrange(40))]
                b = runs(item)
                spots = [runs(w[s : s + len(item)]) for s in range(max(0, before - 8), min(before + 9, max(1, len(w) - len(item) + 1)))]
                if any(4 * sum((a & b).values()) >= 3 * sum((a | b).values()) for a in spots):
                    alike.setdefault((kind, n), []).append(len(items))
                items.append(" ".join(item))
                texts.append(" ".join(w))
    docs, known = (spark.createDataFrame(list(enumerate(x)), f"{k} long, text string") for k, x in (("doc_id", texts), ("item_id", items)))
    got = {x["doc_id"] for x in decontamination.decontaminate(docs, known).where("doc_id = item_id").collect()}
    recall = {k: sum(i in got for i in v) / len(v) for k, v in alike.items()}
    assert len(alike) == 12 and sum(map(len, alike.values())) > 100 and min(recall.values()) >= 0.9, recall


def test_hamming_index_finds_all_within_the_radius(spark):
    r = random.Random(9)
    known = [(i, 8, r.getrandbits(56), r.getrandbits(56)) for i in range(40)]
    seen = []
    for j in range(400):
        _, length, x, y = r.choice(known)
        for b in r.sample(range(112), r.randint(0, 20)):
            x, y = (x ^ (1 << b), y) if b < 56 else (x, y ^ (1 << (b - 56)))
        seen.append((j, length if j % 7 else 16, x, y))
    a = spark.createDataFrame(seen, "doc long, length int, x long, y long")
    b = spark.createDataFrame(known, "item long, length int, x long, y long")
    got = {(row["doc"], row["item"]) for row in decontamination.hamming(a, b).collect()}
    assert got == {(j, i) for j, m, x, y in seen for i, n, p, q in known if m == n and (x ^ p).bit_count() + (y ^ q).bit_count() <= decontamination.RADIUS}
    with pytest.raises(ValueError, match="index"):
        decontamination.hamming(a, b, 16)


def test_fingerprints_by_brute_force(spark):
    r = random.Random(1)
    words = [[f"w{r.randrange(40)}" for _ in range(n)] for n in (0, 7, 8, 30, 61)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc long, t string")
    pairs = decontamination._hashed(df.select(decontamination._words(F.col("t")).alias("w"))).selectExpr("inline(arrays_zip(w, h))").distinct().collect()
    hashes = {w["w"]: (w["h"]["x"], w["h"]["y"]) for w in pairs}
    assert [decontamination.fitting(m) for m in (3, 14, 15, 22, 23, 45, 47, 52, 111, 500)] == [3, 14, 8, 8, 16, 32, 40, 40, 104, 104]
    strided = [8, 24, 32, 40]
    got = {(x["doc"], x["start"], x["length"]): (x["x"], x["y"]) for x in decontamination._fingerprints(decontamination._windows(df.repartition("doc"), strided, [5]), ["doc", "start"]).collect()}
    want = {}
    for d, w in enumerate(words):
        places = [(s, n) for n in strided for s in range(0, len(w) - n + 1, 8)] + [(s, 5) for s in range(len(w) - 4)]
        for s, n in places:
            half = [sum(1 << b for b in range(56) if 2 * sum(hashes[x][k] >> b & 1 for x in w[s : s + n]) > n) for k in (0, 1)]
            want[(d, s, n)] = tuple(half)
    assert got == want


def test_words_of_documents(spark):
    texts = ["", "  ", "A b", " a  b\tc\nd\x0be ", "x\r\ny", None, "é É", "one"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", decontamination._words(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in sorted(got)] == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]


def test_leaks_odd(odd, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, SAME), (4, SAME.upper()), (5, "ok")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.decontaminate(odd, items).collect())
    assert got == [(6, 5), (7, 3), (7, 4), (8, 3), (8, 4)]
    edited = SAME.split()
    edited[20] = "other"
    near = spark.createDataFrame([(1, "before " + " ".join(edited) + " after")], "doc_id long, text string")
    assert decontamination.decontaminate(near, items).where("item_id = 3").count() == 1
    assert decontamination.decontaminate(odd.where("false"), items).count() == 0 and decontamination.decontaminate(odd, items.where("false")).count() == 0


# ---- quality
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    out = QUERIES["op7_quality_cnn"](spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = out[out.quality == 1]["score"].to_numpy(), out[out.quality == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.9 and (out["predicted"] == (out["score"] >= 0.3)).all()


def test_quality_odd(odd):
    net = quality_cnn.fit_network([b"good words here " * 9, b"##$$%% " * 20] * 20, np.array([1, 0] * 20, np.float32), epochs=4)
    got = quality_cnn.score(odd, net).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got) and quality_cnn.score(odd.where("false"), net).count() == 0


def test_network_by_brute_force():
    r = random.Random(3)
    net = quality_cnn.fit_network([bytes(r.randrange(32, 127) for _ in range(r.randrange(0, 400))) for _ in range(60)], np.array([0, 1] * 30, np.float32), epochs=2)
    texts = [b"", b"x", bytes(range(256)) * 3, bytes(r.randrange(256) for _ in range(1000)), b"word " * 77]
    for t in texts:
        pad = t + b"\0" * (((len(t) + 8 + 127) // 128) * 128 - len(t)) + b"\0" * 4
        x = net.embed[np.frombuffer(pad, np.uint8)]
        steps = [np.maximum(x[i : i + 8].ravel() @ net.filters + net.bias, 0) if i + 8 <= len(pad) else None for i in range(0, len(pad) - 4, 4)]
        blocks = [np.max(steps[i : i + 32], axis=0) for i in range(0, len(steps), 32)]
        chunks = [np.maximum(a, b) for a, b in zip(blocks, [*blocks[1:], blocks[-1]], strict=True)]
        z = np.concatenate([np.max(blocks, axis=0), np.mean(chunks, axis=0)]) @ net.unit + net.offset
        data = np.frombuffer(b"ahead" + t + b"behind", np.uint8)
        got = quality_cnn.predict(net, data, np.array([0, 5, 5 + len(t), len(data)]))[1]
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_ties_of_training_rows(spark):
    docs = spark.createDataFrame([(i, f"good text {i} " * 5) for i in range(20)] + [(0, "another text of the same key")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0), (4, None), (5, 7)], "doc_id long, quality int")
    one, two = (quality_cnn.fit(d.repartition(n), m.repartition(n)) for d, m, n in ((docs, labels, 2), (docs, labels, 5)))
    assert all(np.array_equal(getattr(one, f), getattr(two, f)) for f in ("embed", "filters", "bias", "unit"))


# ---- substrings
def test_repeats_against_brute_force(spark, docs, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute_repeats(texts)


def made_repeats(r):
    line = "".join(r.choice("abcdefgh ") for _ in range(130))
    texts = {}
    for i in range(60):
        own = "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 150)))
        texts[i] = own + line[: r.randint(90, 130)] + own[: r.randint(0, 150)] + ("ab" * 120 if i % 7 == 0 else "") + ("é" * 80 if i % 9 == 0 else "")
    return texts


@pytest.mark.parametrize(("narrow", "slab", "local"), [(False, 30_000, 1), (True, 30_000, 1), (True, 8, 6 << 20), (False, 8, 4000)])
def test_repeats_made(spark, monkeypatch, narrow, slab, local):
    monkeypatch.setattr(substring_dedup, "_SLAB", slab)
    monkeypatch.setattr(substring_dedup, "_LOCAL", local)
    texts = made_repeats(random.Random(2))
    every = np.unique(substring_dedup.anchors(*common.flat_bytes(pa.array(list(texts.values()))))[4])
    monkeypatch.setattr(substring_dedup, "hot_anchors", lambda docs: every if narrow else every[:0])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(texts)


def test_hot_anchors(spark):
    line = "a line that very many of all the documents of this table hold, and that is long enough for an anchor and its windows"
    df = spark.createDataFrame([(i, f"{i * 7919} own words {i} " * 3 + line) for i in range(4000)], "k long, t string").withColumn("t", F.col("t").cast("binary"))
    hot = substring_dedup.hot_anchors(df)
    assert len(hot) and np.isin(hot, substring_dedup.anchors(*common.flat_bytes(pa.array([line])))[4]).any()


def test_longest_previous_factors_decide():
    r = random.Random(8)
    n, reach = 90, substring_dedup._REACH
    core = bytes(r.choice(b"abcd") for _ in range(substring_dedup._WIDTH))
    rows = np.frombuffer(b"".join(core for _ in range(n)), np.uint8).reshape(n, -1).copy()
    for row in rows:
        for _ in range(r.randint(0, 3)):
            row[r.choice([*range(reach), *range(substring_dedup.LENGTH, len(core))])] = r.choice(b"abcd")
    group, place = np.sort(np.array([r.randrange(6) for _ in range(n)])), np.array(r.sample(range(n - 3), n - 3) + [0, 1, 2])
    first = np.array([r.randint(0, 30) for _ in range(n)])
    last = first + np.array([r.randint(0, 38) for _ in range(n)])
    got = substring_dedup.previous_factors(group, place, rows, first, last)
    for i in range(n):
        for d in range(reach + 1):
            alike = [len(os.path.commonprefix([bytes(rows[i, reach - d :]), bytes(rows[j, reach - d :])])) for j in range(n) if group[j] == group[i] and place[j] < place[i] and first[j] <= d <= last[j]]
            want = max(alike, default=0) if first[i] <= d <= last[i] else 0
            assert (got[i, d] == want) if want >= substring_dedup.LENGTH else got[i, d] < substring_dedup.LENGTH


def test_nothing_goes_without_previous_factors(monkeypatch):
    monkeypatch.setattr(substring_dedup, "previous_factors", lambda group, *rest: np.zeros((len(group), substring_dedup._REACH + 1), np.int16))
    texts = made_repeats(random.Random(2))
    ids = np.arange(len(texts))
    data, offsets = common.flat_bytes(pa.array(list(texts.values())))
    doc, start, more, anchor, hashes, _ = substring_dedup.anchors(data, offsets)
    order = np.argsort(hashes, kind="stable")
    pick = lambda x: x[order]
    rows = lambda part: substring_dedup.aligned(data, pick(start)[part], pick(more)[part], pick(anchor - start)[part])
    args = pick(hashes), pick(ids[doc]), pick(anchor - offsets[doc]), pick(anchor - start), pick(more), rows
    assert not substring_dedup._repeats(*args).any()
    monkeypatch.undo()
    assert substring_dedup._repeats(*args).any()


def test_repeats_odd(odd):
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in substring_dedup.remove_repeats(odd).collect()}
    n = len(SAME.encode())
    assert got[(7, n)] == 0 and got[(8, n)] == n and got[(1, 0)] == 0 and any(d is None and v == 0 for (d, _), v in got.items())
    assert substring_dedup.remove_repeats(odd.where("false")).count() == 0


# ---- embeddings
def test_embeddings_against_brute_force(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in e.collect()}
    ids = sorted(rows)
    m = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    hit = (m @ m.T >= 0.9) & ~np.eye(len(ids), dtype=bool)
    label = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.array([min([label[i], *label[hit[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    want = {i: (int(hit[k].sum()), ids[label[k]]) for k, i in enumerate(ids)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(e, block=100).collect()}
    assert got == want


def test_embeddings_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [1e300, 1.0]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got[1] == got[2] == (4, 1) and got[10] == (4, 1) and got[11] == (4, 1) and got[12] == (0, 12) and got[9] == (0, 9)
    assert all(got[k] == (0, k) for k in (3, 4, 5, 6, 7, 8)) and got[None] == (0, None)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_a_key_with_two_vectors(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [0.01, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, block=1).collect())
    assert got == [(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5)]
    apart = {(r["vec_id"], r["component_id"]) for r in embedding_dedup.near_duplicates(df.withColumn("vec_id", F.when(F.col("embedding")[1] == 1, 9).otherwise(F.col("vec_id")))).collect()}
    assert apart == {(5, 5), (6, 5), (9, 9)}


def near_vectors(n, size, seed=0):
    """Unit vectors of which many pairs lie close to a cosine of 0.9."""
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, size))
    m[n // 2 :] = m[: n - n // 2] + r.normal(size=(n - n // 2, size)) * 0.48
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize("size", [3, 24, 1100])
def test_bounds_hold_and_leave_few_pairs(size):
    m = near_vectors(300, size)
    codes = embedding_dedup.quantise(m)
    (_, sure, unsure), = embedding_dedup.tile_bounds(codes, codes, 0.9, False)
    true = m @ m.T >= 0.9
    assert not (sure & ~true).any() and not (true & ~sure & ~unsure).any() and not (sure & unsure).any()
    assert unsure.any() and unsure.sum() < 0.05 * unsure.size
    halves = [s for _, *s in embedding_dedup.tile_bounds(codes, codes, 0.9, True, rows=7)]
    assert (np.concatenate([h[0] for h in halves]) == np.triu(sure, 1)).all() and (np.concatenate([h[1] for h in halves]) == np.triu(unsure, 1)).all()
    some = np.arange(5, 300, 11)
    (_, alone, _), = embedding_dedup.tile_bounds(tuple(x[some] for x in codes), codes, 0.9, False)
    assert (alone == sure[some]).all()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_unsure_pairs_are_decided_in_double_precision(spark, kind):
    m = near_vectors(240, 24, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"vec_id long, embedding array<{kind}>")
    kept = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()])
    kept /= np.linalg.norm(kept, axis=1, keepdims=True)
    hit = (kept @ kept.T >= 0.9) & ~np.eye(len(kept), dtype=bool)
    i, j = np.nonzero(hit)
    label = components.spanning(i, j, len(kept))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, block=50).collect()}
    assert got == {k: (int(hit[k].sum()), int(label[k])) for k in range(len(kept))}


# ---- licences
def test_licences_odd(odd, spark):
    got = license_scan.scan(odd)
    assert got.count() == 10 and license_scan.scan(odd.where("false")).count() == 0
    df = spark.createDataFrame([(1, "MIT License, mit LICENSE"), (2, "cc by"), (3, "xcc by mit licensed K"), (4, "GNU general\npublic-license")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert (rows[1]["n_base"], rows[1]["first_word"], rows[1]["last_word"]) == (2, 0, 2) and rows[2]["base_labels"] == "cc-by" and rows[3]["n_base"] == 0 and rows[4]["base_labels"] == "gpl"


# ---- hashing and the pipeline
def test_word_hashes(texts):
    for t in [*list(texts.values())[:50], "A a\x0bB", "\n", "é É", "x" * 5000]:
        w = t.encode().lower().split()
        h, o = common.word_hashes(pa.array([t, t]))
        assert o.tolist() == [0, len(w), 2 * len(w)] and len(set(h.tolist())) == len(set(w))


def test_pipeline(spark, docs, texts):
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, state, SF)
        assert after.columns == docs.columns, name
        state = spark.createDataFrame(after.collect(), after.schema)
    kept = {r["doc_id"]: r["text"] for r in state.collect()}
    comp = brute_components(texts)
    assert set(kept) <= {k for k, (_, c) in comp.items() if k == c} and len(kept) > 0.7 * len(set(c for _, c in comp.values()))
    assert not any(brute_spans(t) for t in kept.values())
    pieces = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(kept)


def test_pipeline_odd(spark, odd):
    state = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, SF)
    kept = sorted(str(r["doc_id"]) for r in state.select("doc_id").collect())
    # 1 to 4 have no letter, 6 is far from both languages, 8 repeats 7
    assert kept == ["7", "9", "None"]
