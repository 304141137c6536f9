"""Nearest terms and neighbours against all pairs, on both sides of the size checks."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from cohortspark.operators import matching, tokens, vectors
from cohortspark.plans.q_tokens import SIZE, _bigrams

R = random.Random(5)
WORDS = ["".join(R.choice("abcdeé ") for _ in range(R.randint(1, 14))).strip() or "a" for _ in range(150)]
TERMS = sorted(set(WORDS[:80] + [w[1:] + "x" for w in WORDS[80:100]]))


def frames(spark):
    return spark.createDataFrame([(w,) for w in [*WORDS, "zzz", "", None]], "token string"), spark.createDataFrame([(t,) for t in [*TERMS, None]], "term string")


def expected(score, least):
    out = {}
    for w in {*WORDS, "zzz", ""}:
        s, t = min((-score(w, t), t) for t in TERMS)
        out[w] = (w, 1.0, "exact") if w in TERMS else (t, round(-s, 9), "nearest") if -s >= least else (w, None, "kept_original")
    return out


@pytest.mark.parametrize("held", [matching.HELD, 0])
@pytest.mark.parametrize("least", [0.3, 0.6, 0.86])
def test_blocks_by_all_pairs(spark, held, least, monkeypatch):
    monkeypatch.setattr(matching, "HELD", held), monkeypatch.setattr(matching, "BLOCK", 40)
    t, v = frames(spark)
    got = {r["token"]: (r["match"], r["score"], r["status"]) for r in matching.nearest_blocks(t, v, least).collect()}
    assert got == expected(lambda a, b: SequenceMatcher(None, a, b).ratio(), least)


def test_the_bound_loses_no_pair():
    alphabet = {c: i for i, c in enumerate(sorted({c for t in TERMS for c in t}))}
    have = matching._counts(TERMS, alphabet)[:, :-1]
    for w in WORDS:
        bound = 2 * np.minimum(have, matching._counts([w], alphabet)[0, :-1]).sum(axis=1) / np.maximum([len(t) + len(w) for t in TERMS], 1)
        assert all(matching.block_ratio(w, t) <= b + 1e-12 for t, b in zip(TERMS, bound, strict=True))


def unit(t):
    v = np.array(_bigrams([t])[0])
    return v / np.linalg.norm(v) if v.any() else None


@pytest.mark.parametrize("held", [matching.HELD, 0])
def test_vectors_by_all_pairs(spark, held, monkeypatch):
    monkeypatch.setattr(matching, "HELD", held), monkeypatch.setattr(matching, "BLOCK", 40)
    t, v = frames(spark)
    got = {r["token"]: (r["match"], r["score"], r["status"]) for r in matching.nearest_vectors(t, v, lambda: _bigrams, SIZE, 0.6).collect()}
    vec = {w: unit(w) for w in {*WORDS, *TERMS, "zzz", ""}}
    want = expected(lambda a, b: -2.0 if vec[a] is None or vec[b] is None else round(float(vec[a] @ vec[b]), 9), 0.6)
    assert {k: x[0::2] for k, x in got.items()} == {k: x[0::2] for k, x in want.items()}
    assert all(got[k][1] == pytest.approx(x[1]) for k, x in want.items())


def test_both_matchers_vote(spark):
    t, v = frames(spark)
    one, two = matching.nearest_blocks(t, v, 0.6), matching.nearest_vectors(t, v, lambda: _bigrams, SIZE, 0.6)
    a, b = ({r["token"]: r for r in m.collect()} for m in (one, two))
    for r in tokens.vote(one, two).collect():
        x, y = a[r["token"]], b[r["token"]]
        if x["match"] == y["match"] and "kept_original" not in (x["status"], y["status"]):
            assert r["status"] == "agree" and r["match"] == x["match"]
        elif x["status"] == y["status"] == "kept_original":
            assert r["status"] == "kept_original" and r["match"] == r["token"]
        else:
            assert r["match"] in (x["match"], y["match"]) and r["score"] == max(s for s in (x["score"], y["score"]) if s is not None)


@pytest.fixture(scope="module")
def points(spark):
    """Three narrow bundles, one of them of a third of all rows that are equal, and some scattered, null, zero and short vectors."""
    g = np.random.default_rng(3)
    rows = []
    for i in range(900):
        kind = i % 3
        center = np.eye(8)[kind * 2]
        v = center if kind == 0 else center + g.normal(0, 0.08, 8) if i % 30 else g.normal(0, 1, 8)
        rows.append((i, [float(x) for x in v]))
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [1.0]), (1003, [float("nan")] * 8)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(5)


def brute(points, keys, k):
    rows = {r["id"]: np.array(r["v"]) for r in points.collect() if r["v"] is not None and len(r["v"]) == 8}
    rows = {i: v / np.linalg.norm(v) for i, v in rows.items() if np.isfinite(v).all() and v.any()}
    out = []
    for q in keys:
        if q in rows:
            best = sorted((-round(float(rows[q] @ v), 9), i) for i, v in rows.items() if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5, 2000])
def test_neighbours_by_all_pairs(points, k):
    asked = points.where("id % 30 = 0 or id > 995")
    want = brute(points, [*range(0, 900, 30), 1000, 1001, 1002, 1003], k)
    got = sorted(map(tuple, vectors.cosine_top(asked, points, "id", "v", k, rows=200).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want])


@pytest.mark.parametrize(("k", "lists", "rows"), [(1, 16, 4096), (5, 40, 64), (5, 1, 4096), (2000, 16, 300)])
def test_lists_are_exact(points, k, lists, rows):
    asked = points.where("id % 30 = 1 or id > 995")
    index = vectors.Lists(points, "id", "v", lists, rows)
    top, opened = index.top(asked, k)
    want = brute(points, [*range(1, 900, 30), 1000, 1001, 1002, 1003], k)
    got = sorted(map(tuple, top.select("id", "rank", "neighbour", "cosine").collect()))
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want])
    share = opened.count() / (30 * len(index.centroids))
    assert share <= 1 and (k > 5 or lists == 1 or share < 0.8)  # of all lists of the 30 queries, so many were opened
    assert vectors.Lists(points.where("id = 1001"), "id", "v").top(asked, 2)[0].count() == 0
