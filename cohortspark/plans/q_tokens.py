"""Queries on wide text columns."""

import hashlib

from pyspark.sql import functions as F

from cohortspark.operators import matching as X
from cohortspark.operators import tokens as T
from cohortspark.plans.registry import query
from cohortspark.plans.views import sql, view

WIDE = [f"drug{k}" for k in range(1, 14)]
PATTERNS = {"cat_bar": ["rod", "bar"], "cat_ring": ["ring", "hoop"], "cat_gear": ["gear", r"c.g\b"], "cat_red": ["^red"], "cat_size": ["small", "tiny", "large"]}
GROUPS = {"metal_count": ["cat_bar", "cat_ring", "cat_gear"], "look_count": ["cat_red", "cat_size"]}
KEYWORDS = {"kw_bar": ["rod", "bar"], "kw_ring": ["ring"], "kw_red": ["red "]}
UNIONS = {"kw_any": ["kw_bar", "kw_ring"]}
_PH = ", ".join(f"'{p}'" for p in T.PLACEHOLDERS)


def clean(x):
    t = f"trim(regexp_replace(trim(trim(lower(coalesce({x}, ''))), '*\"''` '), '\\s+', ' ', 'g'))"
    return f"CASE WHEN trim(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g')) IN ({_PH}) THEN '' ELSE {t} END"


#: tokens of every row, one line per token, in the order of columns and of their parts
LONG = "cells AS (" + " UNION ALL ".join(f"SELECT visit_id, {k} AS col, 'drug{k}' AS source, drug{k} AS raw FROM v_tokens_wide" for k in range(1, 14)) + f"), parts AS (SELECT visit_id, col, source, unnest(string_split(raw, '|')) AS part, generate_subscripts(string_split(raw, '|'), 1) AS i FROM cells WHERE raw IS NOT NULL), long AS (SELECT visit_id, source, token, col * 100 + i AS o FROM (SELECT *, {clean('part')} AS token FROM parts) WHERE token <> ''), firsts AS (SELECT visit_id, token, min(o) AS o FROM long GROUP BY ALL), rowtok AS (SELECT o_orderkey AS visit_id, coalesce(list(token ORDER BY f.o) FILTER (token IS NOT NULL), []) AS tokens FROM orders LEFT JOIN firsts AS f ON f.visit_id = o_orderkey GROUP BY 1)"


def wide(spark, sf):
    return view(spark, sf, "v_tokens_wide").select("visit_id", T.tokens_of_columns(WIDE).alias("tokens"))


@query(sql("v_tokens_long", f"SELECT visit_id, pos, {clean('raw')} AS token FROM v_tokens_long"))
def token_clean(spark, sf):
    return view(spark, sf, "v_tokens_long").select("visit_id", "pos", T.clean_token(F.col("raw")).alias("token"))


@query(sql("v_tokens_long", f"p AS (SELECT visit_id, pos, unnest(string_split(raw, '|')) AS part, generate_subscripts(string_split(raw, '|'), 1) AS i FROM v_tokens_long WHERE raw IS NOT NULL), c AS (SELECT visit_id, pos, {clean('part')} AS token, min(i) AS i FROM p GROUP BY ALL), g AS (SELECT visit_id, pos, string_agg(token, ' | ' ORDER BY i) AS joined, count(*) AS n FROM c WHERE token <> '' GROUP BY ALL);; SELECT visit_id, pos, coalesce(joined, '') AS joined, CAST(coalesce(n, 0) AS INT) AS n FROM v_tokens_long LEFT JOIN g USING (visit_id, pos)"))
def token_list_normalize(spark, sf):
    t = view(spark, sf, "v_tokens_long").withColumn("t", T.tokens_of(F.col("raw")))
    return t.select("visit_id", "pos", F.array_join("t", " | ").alias("joined"), F.size("t").alias("n"))


@query(sql("v_tokens_wide", LONG + ";; SELECT visit_id, array_to_string(tokens, ' | ') AS token_text, CAST(len(tokens) AS INT) AS token_count FROM rowtok"))
def wide_to_token_array(spark, sf):
    return wide(spark, sf).select("visit_id", F.array_join("tokens", " | ").alias("token_text"), F.size("tokens").alias("token_count"))


@query(sql("v_tokens_wide", LONG + ";; SELECT token, row_frequency, source_columns, row_number() OVER (ORDER BY row_frequency DESC, token) AS rank, sha256(token) AS token_key FROM (SELECT token, count(DISTINCT visit_id) AS row_frequency, array_to_string(list_sort(list(DISTINCT source)), ';') AS source_columns FROM long GROUP BY token)"))
def token_dictionary(spark, sf):
    return T.dictionary(view(spark, sf, "v_tokens_wide"), "visit_id", WIDE)


def _aliases(spark, sf):
    a = view(spark, sf, "v_aliases")
    return T.aliases(a.where("batch = 1"), a.where("batch = 2"))


_AL = "al AS (SELECT alias, canonical FROM v_aliases QUALIFY row_number() OVER (PARTITION BY alias ORDER BY batch DESC, canonical DESC) = 1)"


@query(sql("v_aliases", _AL + ";; SELECT * FROM al"))
def alias_map_load(spark, sf):
    return _aliases(spark, sf)


@query(sql("v_aliases v_tokens_wide", LONG + ", " + _AL + ";; SELECT token, coalesce(canonical, token) AS canonical FROM (SELECT DISTINCT token FROM long) LEFT JOIN al ON alias = token"))
def alias_normalize(spark, sf):
    t = wide(spark, sf).select(F.explode_outer("tokens").alias("token")).distinct().where("token is not null")  # explode() would filter the rows by tokens first, and compute them twice
    return t.join(_aliases(spark, sf), F.col("token") == F.col("alias"), "left").select("token", F.coalesce("canonical", "token").alias("canonical"))


@query(sql("v_aliases v_tokens_wide", LONG + ", " + _AL + ", k AS (SELECT DISTINCT visit_id, coalesce(canonical, token) AS c FROM firsts LEFT JOIN al ON alias = token);; SELECT o_orderkey AS visit_id, coalesce(string_agg(c, ' | ' ORDER BY c), '') AS canonical FROM orders LEFT JOIN k ON k.visit_id = o_orderkey GROUP BY 1"))
def canonical_token_list(spark, sf):
    return T.canonical_tokens(wide(spark, sf), "tokens", _aliases(spark, sf)).select("visit_id", F.array_join("canonical", " | ").alias("canonical"))


def _match(p):
    return f"regexp_matches(t, '(?i){'|'.join(p)}')"


@query(sql("v_tokens_wide", LONG + ";; SELECT visit_id, " + ", ".join(f"CASE WHEN len(list_filter(tokens, lambda t: {_match(p)})) > 0 THEN 1 ELSE 0 END AS {k}" for k, p in PATTERNS.items()) + " FROM rowtok"))
def category_flags(spark, sf):
    return wide(spark, sf).select("visit_id", *T.category_flags("tokens", PATTERNS))


@query(sql("v_tokens_wide", LONG + ";; SELECT visit_id, " + ", ".join(f"CAST(len(list_filter(tokens, lambda t: {_match([x for c in names for x in PATTERNS[c]])})) AS INT) AS {g}" for g, names in GROUPS.items()) + " FROM rowtok"))
def category_domain_counts(spark, sf):
    return wide(spark, sf).select("visit_id", *T.category_counts("tokens", PATTERNS, GROUPS))


def _kw(words):
    return "(" + " OR ".join(f"contains(j, '{w}')" for w in words) + ")"


@query(sql("v_tokens_wide", LONG + ", jt AS (SELECT visit_id, array_to_string(tokens, ' | ') AS j FROM rowtok);; SELECT visit_id, " + ", ".join(f"CASE WHEN {_kw(w)} THEN 1 ELSE 0 END AS {k}" for k, w in (KEYWORDS | {u: [x for k in ks for x in KEYWORDS[k]] for u, ks in UNIONS.items()}).items()) + " FROM jt"))
def keyword_flags(spark, sf):
    return wide(spark, sf).select("visit_id", *T.keyword_flags(F.array_join("tokens", " | "), KEYWORDS, UNIONS))


def _vocab(spark, sf):
    extra = view(spark, sf, "v_dictionary").where("f1 = 1").select(F.col("token").alias("term"))
    return T.vocabulary(_aliases(spark, sf), {"a": ["hot gear", "Steel Ring", "n/a"]}, extra)


_VOC = _AL + f", voc AS (SELECT DISTINCT {clean('x')} AS term FROM (SELECT alias AS x FROM al UNION ALL SELECT canonical FROM al UNION ALL SELECT unnest(['hot gear', 'Steel Ring', 'n/a']) UNION ALL SELECT token FROM v_dictionary WHERE f1 = 1) WHERE {clean('x')} <> '')"


@query(sql("v_aliases v_dictionary", _VOC + ";; SELECT term FROM voc"))
def reference_vocabulary(spark, sf):
    return _vocab(spark, sf)


def _near(tag, flt, least):
    return f"{tag} AS (SELECT token, coalesce(term, token) AS match, score, CASE WHEN score = 1 THEN 'exact' WHEN score IS NOT NULL THEN 'nearest' ELSE 'kept_original' END AS status FROM v_dictionary LEFT JOIN (SELECT token, term, round(s, 9) AS score FROM (SELECT token, term, 1 - levenshtein(token, term) / greatest(length(token), length(term)) AS s FROM v_dictionary, voc WHERE {flt}) WHERE s >= {least} QUALIFY row_number() OVER (PARTITION BY token ORDER BY s DESC, term) = 1) USING (token))"


@query(sql("v_aliases v_dictionary", _VOC + ", " + _near("nm", "true", 0.75) + ";; SELECT * FROM nm"))
def vocab_nearest_match(spark, sf):
    return T.nearest(view(spark, sf, "v_dictionary"), _vocab(spark, sf), 0.75)


SIZE = 64


def _bigrams(texts):
    """Counts of pairs of characters, hashed to SIZE places: a stand-in for a text encoder."""
    out = []
    for t in texts:
        v = [0.0] * SIZE
        for i in range(len(t) - 1):
            v[int(hashlib.md5(t[i : i + 2].encode()).hexdigest()[:8], 16) % SIZE] += 1.0
        out.append(v)
    return out


def _vectors_sql(tag, src, column):
    grams = f"SELECT x, $h(substr(x, i, 2)) % {SIZE} AS j FROM (SELECT x, unnest(range(1, length(x))) AS i FROM (SELECT DISTINCT {column} AS x FROM {src}))"
    return f"{tag}c AS (SELECT x, j, count(*) AS n FROM ({grams}) GROUP BY ALL), {tag} AS (SELECT x, list_transform(v, lambda e: e / sqrt(list_inner_product(v, v))) AS v FROM (SELECT x, list_transform(range({SIZE}), lambda k: coalesce(m[k], 0.0E0)) AS v FROM (SELECT x, map(list(j), list(CAST(n AS DOUBLE))) AS m FROM {tag}c GROUP BY x)))"


_VEC = _vectors_sql("va", "v_dictionary", "token") + ", " + _vectors_sql("vb", "voc", "term") + """, n2 AS (SELECT token, CASE WHEN own.term IS NOT NULL THEN token ELSE coalesce(b.term, token) END AS match, CASE WHEN own.term IS NOT NULL THEN 1.0E0 ELSE b.s END AS score, CASE WHEN own.term IS NOT NULL THEN 'exact' WHEN b.s IS NOT NULL THEN 'nearest' ELSE 'kept_original' END AS status FROM v_dictionary
 LEFT JOIN voc AS own ON own.term = token LEFT JOIN (SELECT va.x AS t, vb.x AS term, round(list_inner_product(va.v, vb.v), 9) AS s FROM va, vb WHERE round(list_inner_product(va.v, vb.v), 9) >= 0.7 QUALIFY row_number() OVER (PARTITION BY va.x ORDER BY s DESC, vb.x) = 1) AS b ON b.t = token)"""


@query(sql("v_aliases v_dictionary", _VOC + ", " + _near("n1", "true", 0.75) + ", " + _VEC + """;; SELECT token, CASE WHEN a.status = 'kept_original' AND b.status = 'kept_original' THEN 'kept_original' WHEN a.match = b.match THEN 'agree' WHEN (a.status = 'exact') <> (b.status = 'exact') THEN 'exact_wins' ELSE 'best_score' END AS status,
 CASE WHEN (a.status = 'exact') AND b.status <> 'exact' THEN a.match WHEN b.status = 'exact' AND a.status <> 'exact' THEN b.match WHEN coalesce(a.score, -1) >= coalesce(b.score, -1) THEN a.match ELSE b.match END AS match, nullif(greatest(coalesce(a.score, -1), coalesce(b.score, -1)), -1) AS score FROM n1 AS a JOIN n2 AS b USING (token)"""))
def two_matcher_vote(spark, sf):
    """The string matcher and the vector matcher vote."""
    d, v = view(spark, sf, "v_dictionary"), _vocab(spark, sf)
    return T.vote(T.nearest(d, v, 0.75), X.nearest_vectors(d, v, lambda: _bigrams, SIZE, 0.7))


@query()
def vocab_block_match(spark, sf):
    """Nearest terms by matching blocks, which SQL can't express."""
    return X.nearest_blocks(view(spark, sf, "v_dictionary"), _vocab(spark, sf), 0.75)


_TEXT = LONG + ", jt AS (SELECT visit_id, array_to_string(tokens, ' | ') AS txt FROM rowtok)"


def _texts(spark, sf):
    return wide(spark, sf).select("visit_id", F.array_join("tokens", " | ").alias("txt"))


@query(sql("v_tokens_wide", _TEXT + ";; SELECT txt, count(*) AS n FROM jt WHERE txt <> '' GROUP BY txt ORDER BY n DESC, txt LIMIT 50"))
def select_most_frequent(spark, sf):
    return T.most_frequent(_texts(spark, sf), "txt", 50)


@query(sql("v_tokens_wide", _TEXT + ";; SELECT txt, min(visit_id) AS first FROM jt WHERE txt <> '' GROUP BY txt ORDER BY 2, 1 LIMIT 50"))
def select_first(spark, sf):
    return T.first_seen(_texts(spark, sf), "txt", "visit_id", 50)


COVERAGE = 0.80


@query(sql("v_tokens_wide", _TEXT + f", c AS (SELECT txt, count(*) AS n FROM jt WHERE txt <> '' GROUP BY txt), r AS (SELECT *, sum(n) OVER (ORDER BY n DESC, txt ROWS UNBOUNDED PRECEDING) AS running, row_number() OVER (ORDER BY n DESC, txt) AS rank, sum(n) OVER () AS total FROM c);; SELECT txt, n, rank FROM r WHERE running - n < total * {COVERAGE}"))
def select_by_coverage(spark, sf):
    return T.by_coverage(_texts(spark, sf), "txt", COVERAGE)
