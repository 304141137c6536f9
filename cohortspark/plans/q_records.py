"""Queries on abstraction records and vectors."""

import hashlib
import json

from pyspark.sql import functions as F

from cohortspark.functions.values import flag
from cohortspark.operators import records as R
from cohortspark.operators import vectors as V
from cohortspark.plans.q_clean import place
from cohortspark.plans.q_tokens import LONG, wide
from cohortspark.plans.registry import query
from cohortspark.plans.views import sql, view

FL = R.FLAGS
KEYS = ["f1", "f2", "confidence", "summary"]


def _case(c):
    t = f"lower(trim(CAST({c} AS VARCHAR)))"
    n = f"TRY_CAST({t} AS DOUBLE)"
    yes, no = f"{t} IN ('true', 'yes', 'y', 'present')", f"{t} IN ('false', 'no', 'n', 'absent')"
    return f"CASE WHEN {t} IS NULL THEN 0 WHEN {yes} THEN 1 WHEN {no} THEN 0 WHEN {n} > 0 THEN 1 ELSE 0 END", f"CASE WHEN {t} IS NULL OR {yes} OR {no} THEN 0 WHEN {n} IN (0, 1) THEN 0 ELSE 1 END"


#: responses with their object cut out by the positions of its braces; unusable ones have a null object
PARSED = """obj AS (SELECT token, response, CASE WHEN response LIKE '%"response": {%' THEN regexp_extract(response, '"response": (\\{.*\\})\\}', 1) WHEN response LIKE '%}%' THEN regexp_extract(response, '\\{.*\\}') END AS j FROM v_responses),
rec AS (SELECT token, j, json_extract_string(j, '$.f1') AS f1, json_extract_string(j, '$.f2') AS f2, CAST(json_extract_string(j, '$.confidence') AS DOUBLE) AS confidence, json_extract_string(j, '$.summary') AS summary FROM obj)"""


def parsed(spark, sf):
    return R.extract_json(view(spark, sf, "v_responses"), "response")


@query(sql("v_dictionary", "SELECT token, lower(trim(token)) AS normalized, sha256(lower(trim(token))) AS token_key, provider, greatest(0.0, least(1.0, confidence * 2 - 0.5)) AS similarity FROM v_dictionary"))
def dictionary_identity(spark, sf):
    return view(spark, sf, "v_dictionary").select("token", *R.identity(F.col("token"), F.col("provider"), F.col("confidence") * 2 - 0.5))


@query(sql("v_responses", PARSED + ";; SELECT token, f1, f2, confidence, summary FROM rec"))
def json_object_extract(spark, sf):
    return parsed(spark, sf).select("token", "record.f1", "record.f2", "record.confidence", "record.summary")


@query(sql("v_responses", PARSED + ";; SELECT token, array_to_string(list_filter(['f1', 'f2', 'confidence', 'summary'], lambda k: j IS NULL OR NOT list_contains(json_keys(j), k)), ';') AS missing FROM rec"))
def required_keys_check(spark, sf):
    return parsed(spark, sf).select("token", F.array_join(R.missing_keys(F.col("json_text"), KEYS), ";").alias("missing"))


@query(sql("v_responses", PARSED + f";; SELECT token, {_case('f1')[0]} AS v1, {_case('f1')[1]} AS bad1, {_case('f2')[0]} AS v2, {_case('f2')[1]} AS bad2 FROM rec"))
def binary_coerce_with_violation(spark, sf):
    (v1, b1), (v2, b2) = R.binary_with_violation(F.col("record.f1")), R.binary_with_violation(F.col("record.f2"))
    return parsed(spark, sf).select("token", v1.alias("v1"), b1.alias("bad1"), v2.alias("v2"), b2.alias("bad2"))


ANCHOR = {"a1": "gear", "a2": "red", "a3": "ring"}
_ANCH = ", ".join(f"CASE WHEN contains(token, '{w}') THEN 1 ELSE 0 END AS {a}" for a, w in ANCHOR.items())


def anchored(spark, sf):
    return view(spark, sf, "v_dictionary").select("*", *[flag(F.col("token").contains(w)).alias(a) for a, w in ANCHOR.items()])


@query(sql("v_dictionary", f"SELECT token, greatest(f1, a1) AS f1, greatest(f2, a2) AS f2, greatest(f3, a3) AS f3, concat_ws(';', CASE WHEN a1 = 1 AND f1 = 0 THEN 'f1' END, CASE WHEN a2 = 1 AND f2 = 0 THEN 'f2' END, CASE WHEN a3 = 1 AND f3 = 0 THEN 'f3' END) AS raised FROM (SELECT *, {_ANCH} FROM v_dictionary)"))
def anchor_repair(spark, sf):
    return anchored(spark, sf).select("token", *R.repaired(["f1", "f2", "f3"], ["a1", "a2", "a3"]))


_SUMF = " + ".join(FL)


@query(sql("v_dictionary", f"SELECT token, CASE WHEN elapsed % 12 >= 5 THEN 1 ELSE 0 END AS many, {_SUMF} + CASE WHEN elapsed % 12 >= 5 THEN 1 ELSE 0 END AS domain_count, least(5, CASE WHEN elapsed % 12 >= 5 THEN 2 ELSE 0 END + CASE WHEN elapsed % 12 >= 10 THEN 1 ELSE 0 END + f1 + f2 + f3 + f4 + f5) AS score FROM v_dictionary"))
def formula_fields(spark, sf):
    return view(spark, sf, "v_dictionary").select("token", *R.formulas(F.col("elapsed") % 12, FL, FL[:5]))


_BADC = "(confidence IS NULL OR confidence <= 0 OR confidence > 1)"


@query(sql("v_responses", PARSED + f";; SELECT token, CASE WHEN NOT {_BADC} THEN confidence WHEN length(token) % 5 = 0 THEN 0.20 WHEN {_case('f1')[1]} > 0 THEN 0.60 ELSE 0.75 END AS confidence, CASE WHEN {_BADC} THEN 1 ELSE 0 END AS confidence_repaired FROM rec"))
def confidence_repair(spark, sf):
    _, b1 = R.binary_with_violation(F.col("record.f1"))
    return parsed(spark, sf).select("token", *R.repaired_confidence(F.col("record.confidence"), F.length("token") % 5, b1))


_RULE = {"k_gear": "gear", "k_red": "red", "k_ring": "ring"}


@query(sql("v_tokens_wide", LONG + ", jt AS (SELECT visit_id, tokens, array_to_string(tokens, ' | ') AS j FROM rowtok), k AS (SELECT visit_id, j, len(tokens) AS n, " + ", ".join(f"CASE WHEN contains(j, '{w}') THEN 1 ELSE 0 END AS {k}" for k, w in _RULE.items()) + """ FROM jt), m AS (SELECT *, CASE WHEN n >= 5 THEN 1 ELSE 0 END AS many, concat_ws(', ', CASE WHEN k_gear = 1 THEN 'gears' END, CASE WHEN k_red = 1 THEN 'red parts' END, CASE WHEN n >= 5 THEN 'many tokens' END) AS told FROM k);;
SELECT visit_id, k_gear, k_red, k_ring, k_gear + k_red + k_ring + many AS domain_count, CASE WHEN j = '' THEN 0.20 WHEN k_gear + k_red + k_ring + many > 0 THEN 0.80 ELSE 0.65 END AS confidence, CASE WHEN j = '' THEN 1 ELSE 0 END AS review, CASE WHEN j = '' THEN 'no text' ELSE 'suggests ' || CASE WHEN told = '' THEN 'nothing in particular' ELSE told END END AS summary FROM m"""))
def rule_abstraction(spark, sf):
    t = wide(spark, sf).select("visit_id", F.array_join("tokens", " | ").alias("j"), F.size("tokens").alias("n"))
    return t.select("visit_id", *R.by_rules(F.col("j"), F.col("n"), {k: flag(F.col("j").contains(w)) for k, w in _RULE.items()}, {"k_gear": "gears", "k_red": "red parts"}))


def _mock():
    return lambda texts: [None if len(t) % 9 == 0 else {"f1": len(t) % 2, "f2": 0, "confidence": 0.9, "summary": t} for t in texts]


@query(sql("v_dictionary", "SELECT token, CASE WHEN length(token) % 9 = 0 THEN NULL ELSE '{\"confidence\": 0.9, \"f1\": ' || length(token) % 2 || ', \"f2\": 0, \"summary\": \"' || token || '\"}' END AS response, CASE WHEN length(token) % 9 = 0 THEN 'fallback' ELSE 'called' END AS status FROM v_dictionary WHERE attempts > 0"))
def batch_abstraction(spark, sf):
    """Answers are committed by task; the second run finds them all and asks for the rest alone."""
    pending, folder = view(spark, sf, "v_dictionary").where("attempts > 0").select("token"), place(spark)
    R.call_committed(pending.where("length(token) % 2 = 0"), "token", _mock, folder)
    return R.call_committed(pending, "token", _mock, folder)


def _records(spark, sf):
    (v1, b1), (v2, b2) = R.binary_with_violation(F.col("record.f1")), R.binary_with_violation(F.col("record.f2"))
    d = view(spark, sf, "v_dictionary").select("token", "provider", "review", "attempts")
    p = parsed(spark, sf).select("token", v1.alias("f1"), v2.alias("f2"), (b1 + b2).alias("repaired"), F.col("record.confidence").alias("c"), F.coalesce("record.summary", F.lit("")).alias("summary"), flag(F.size(R.missing_keys(F.col("json_text"), KEYS)) == 0).alias("parsed"))
    out = p.join(d, "token")
    conf, fixed = R.repaired_confidence(F.col("c"), F.lit(1), F.col("repaired"))
    return out.select("token", "provider", R.source_class(F.col("provider")).alias("source_class"), "review", "f1", "f2", "repaired", conf, fixed, F.substring("summary", 1, 8).alias("summary"), "parsed", F.when(F.col("attempts") == 3, "timeout").otherwise("").alias("error"), F.when(F.col("token").contains("red") & (F.col("f1") == 0), "f1").otherwise("").alias("raised"))


_REC = PARSED + f""", norm AS (SELECT token, d.provider, CASE WHEN d.provider = 'model' THEN 'true_source' WHEN d.provider IN ('rules', 'mock') THEN 'local' ELSE 'other' END AS source_class, review, {_case('r.f1')[0]} AS f1, {_case('r.f2')[0]} AS f2, {_case('r.f1')[1]} + {_case('r.f2')[1]} AS repaired,
 CASE WHEN NOT {_BADC.replace('confidence', 'r.confidence')} THEN r.confidence WHEN {_case('r.f1')[1]} + {_case('r.f2')[1]} > 0 THEN 0.60 ELSE 0.75 END AS confidence, CASE WHEN {_BADC.replace('confidence', 'r.confidence')} THEN 1 ELSE 0 END AS confidence_repaired, substr(coalesce(summary, ''), 1, 8) AS summary,
 CASE WHEN j IS NOT NULL AND len(list_filter(['f1', 'f2', 'confidence', 'summary'], lambda k: NOT list_contains(json_keys(j), k))) = 0 THEN 1 ELSE 0 END AS parsed, CASE WHEN attempts = 3 THEN 'timeout' ELSE '' END AS error, CASE WHEN contains(token, 'red') AND {_case('r.f1')[0]} = 0 THEN 'f1' ELSE '' END AS raised FROM rec AS r JOIN v_dictionary AS d USING (token)),
cert AS (SELECT *, concat_ws(';', CASE WHEN provider <> 'model' THEN 'not_true_source' END, CASE WHEN parsed <> 1 THEN 'not_parsed' END, CASE WHEN error <> '' THEN 'error_present' END, CASE WHEN confidence_repaired > 0 THEN 'confidence_repaired' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END, CASE WHEN review <> 0 THEN 'review_required' END, CASE WHEN provider = 'model' AND trim(summary) = '' THEN 'summary_empty' END) AS reasons FROM norm),
fin AS (SELECT *, CASE WHEN reasons = '' THEN 1 ELSE 0 END AS certified, CASE WHEN reasons <> '' THEN 'not_certified' WHEN raised <> '' THEN 'certified_after_anchor_repair' WHEN repaired > 0 THEN 'certified_after_repair' ELSE 'certified' END AS status FROM cert)"""
_V = "v_responses v_dictionary"


@query(sql(_V, _REC + ";; SELECT * FROM norm"))
def record_normalize(spark, sf):
    return _records(spark, sf)


@query(sql("v_dictionary", "SELECT token, CASE WHEN length(token) % 7 = 0 THEN 'empty_text' WHEN provider = 'mock' THEN 'mock_source' WHEN attempts = 0 THEN 'not_selected' WHEN review = 1 THEN 'source_unavailable' END AS status FROM v_dictionary"))
def local_fallback_status(spark, sf):
    d = view(spark, sf, "v_dictionary")
    text = F.when(F.length("token") % 7 == 0, F.lit(" ")).otherwise(F.col("token"))
    return d.select("token", R.fallback_status(text, F.col("provider"), F.col("attempts") > 0, F.col("review") == 0).alias("status"))


@query(sql(_V, PARSED + ";; SELECT token, CASE WHEN j IS NOT NULL AND response NOT LIKE '{\"f1\"%' THEN 1 ELSE 0 END AS promoted, CASE WHEN j IS NOT NULL AND response NOT LIKE '{\"f1\"%' THEN rec.summary END AS summary FROM rec JOIN v_responses USING (token)"))
def legacy_recover(spark, sf):
    failed = ~F.col("response").startswith('{"f1"')
    p = parsed(spark, sf).withColumn("ok", failed & F.col("json_text").isNotNull())
    return p.select("token", flag(F.col("ok")).alias("promoted"), F.when(F.col("ok"), F.col("record.summary")).alias("summary"))


def _cert(spark, sf):
    return R.certified(_records(spark, sf))


@query(sql(_V, _REC + ";; SELECT token, reasons, certified AS structural_pass, certified, status FROM fin"))
def certify_records(spark, sf):
    return _cert(spark, sf).select("token", "reasons", "structural_pass", "certified", "status")


@query(sql(_V, _REC + ", rs AS (SELECT r, count(*) AS n FROM (SELECT unnest(string_split(reasons, ';')) AS r FROM fin WHERE reasons <> '') GROUP BY r ORDER BY n DESC, r LIMIT 20);; SELECT count(*) AS records, CAST(sum(certified) AS BIGINT) AS certified, round(avg(certified) * 100, 6) AS pct_certified, count(*) FILTER (status = 'certified_after_repair') AS after_repair, (SELECT string_agg(r || ':' || n, ';' ORDER BY n DESC, r) FROM rs) AS top_reasons FROM fin"))
def certification_summary(spark, sf):
    return R.certification_summary(_cert(spark, sf))


@query(sql(_V, _REC + ";; SELECT status, count(*) AS records, CAST(sum(repaired) AS BIGINT) AS repairs, CAST(sum(confidence_repaired) AS BIGINT) AS confidence_repairs, CAST(sum(parsed) AS BIGINT) AS parsed, round(avg(confidence), 9) AS mean_confidence FROM fin GROUP BY status"))
def quality_summary(spark, sf):
    return _cert(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("records"), F.sum("repaired").alias("repairs"), F.sum("confidence_repaired").alias("confidence_repairs"), F.sum("parsed").alias("parsed"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))


_OTHER = ["f1", "f3", "f5", "f7"]


@query(sql("v_dictionary", f"b AS (SELECT token, f2 AS f1, f3, f4 AS f5, f7 FROM v_dictionary WHERE attempts > 0);; SELECT token, CAST(n AS INT) AS disagreements, 1 - n / 4.0E0 AS agreement FROM (SELECT token, {' + '.join(f'CASE WHEN a.{f} <> b.{f} THEN 1 ELSE 0 END' for f in _OTHER)} AS n FROM v_dictionary AS a JOIN b USING (token))"))
def pairwise_agreement(spark, sf):
    d = view(spark, sf, "v_dictionary")
    two = d.where("attempts > 0").select("token", F.col("f2").alias("f1"), "f3", F.col("f4").alias("f5"), "f7")
    return R.agreement(d, two, "token", _OTHER)


_ROLL = LONG + ", roll AS (SELECT visit_id, " + ", ".join(f"max({f}) AS {f}" for f in FL) + ", max(review) AS review, min(confidence) AS confidence, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(elapsed) AS BIGINT) AS elapsed, CASE WHEN count(*) = count(*) FILTER (provider = 'model') THEN 'all' WHEN count(*) FILTER (provider = 'model') > 0 THEN 'mixed' ELSE 'none' END AS provider_mix, count(*) AS n_known FROM firsts JOIN v_dictionary USING (token) GROUP BY 1)"
_OUT = [*FL, "review", "confidence", "attempts", "elapsed", "provider_mix", "n_known"]


def _rolled(spark, sf):
    return R.rolled_up(wide(spark, sf), "visit_id", "tokens", view(spark, sf, "v_dictionary"))


@query(sql("v_tokens_wide v_dictionary", _ROLL + ";; SELECT * FROM roll"))
def dictionary_rollup(spark, sf):
    return _rolled(spark, sf).where("n_known > 0").select("visit_id", *_OUT)


@query(sql("v_tokens_wide v_dictionary", _ROLL + ";; SELECT o_orderkey AS visit_id, " + ", ".join(f"coalesce({c}, {chr(39) + 'none' + chr(39) if c == 'provider_mix' else 0}) AS {c}" for c in _OUT) + " FROM orders LEFT JOIN roll ON visit_id = o_orderkey"))
def dictionary_attach(spark, sf):
    return R.attached(_rolled(spark, sf)).select("visit_id", *_OUT)


@query(sql("v_dictionary v_cache", "m AS (SELECT DISTINCT token, token_key AS k FROM v_cache), d AS (SELECT token, sha256(token) AS k FROM v_dictionary);; SELECT *, (only_raw = 0 AND only_mapped = 0 AND moved = 0) AS ok FROM (SELECT (SELECT count(DISTINCT k) FROM d WHERE k IN (SELECT k FROM m)) AS \"both\", (SELECT count(DISTINCT k) FROM d WHERE k NOT IN (SELECT k FROM m)) AS only_raw, (SELECT count(DISTINCT k) FROM m WHERE k NOT IN (SELECT k FROM d)) AS only_mapped, (SELECT count(*) FROM d JOIN m USING (token) WHERE d.k <> m.k) AS moved)"))
def dictionary_mapping_audit(spark, sf):
    raw = view(spark, sf, "v_dictionary").select("token", F.sha2("token", 256).alias("k"))
    return R.mapping_audit(raw, view(spark, sf, "v_cache").select("token", F.col("token_key").alias("k")).distinct(), "k", "token")


@query(sql(_V, _REC + ";; SELECT count(*) FILTER (provider = 'model' AND parsed = 1) AS true_source_rows, count(*) FILTER (provider = 'model' AND parsed = 1) >= 10 AS ok FROM fin"))
def success_floor_guard(spark, sf):
    n = F.count_if((F.col("provider") == "model") & (F.col("parsed") == 1))
    return _records(spark, sf).agg(n.alias("true_source_rows"), (n >= 10).alias("ok"))


@query(sql("v_tokens_wide v_cache", LONG + ", x AS (SELECT f.visit_id, f.token, f.token IN (SELECT token FROM v_cache WHERE token_key = sha256(token)) AS done FROM firsts AS f);; SELECT count(DISTINCT token) AS total, count(DISTINCT token) FILTER (done) AS done, round(count(DISTINCT token) FILTER (done) * 100.0E0 / count(DISTINCT token), 6) AS pct, count(DISTINCT visit_id) FILTER (done) AS rows_touched FROM x"))
def abstraction_progress(spark, sf):
    done = view(spark, sf, "v_cache").where(F.col("token_key") == F.sha2("token", 256))
    return R.progress(wide(spark, sf), "visit_id", "tokens", done)


def _hashed(texts):
    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts]


@query()
def encode_distinct_texts(spark, sf):
    t = wide(spark, sf).select("visit_id", F.array_join("tokens", " | ").alias("txt"))
    return V.encode_distinct(t, "txt", lambda: _hashed, 8).select("visit_id", "vector")


@query(sql("", "x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM x GROUP BY ALL);; SELECT label, i - 1 AS i, round(x, 9) AS x FROM m"))
def mean_pool(spark, sf):
    out = V.mean_pool(view(spark, sf, "embeddings"), "label", "embedding")
    return out.select("label", F.posexplode("mean").alias("i", "x")).select("label", "i", F.round("x", 9).alias("x"))


_CELL = "(($h('{i}-' || j || '-a') + $h('{i}-' || j || '-b') + $h('{i}-' || j || '-c')) / 4294967296.0E0 - 1.5) * 2.0 / sqrt(4.0)"


@query(sql("", "x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings);; SELECT vec_id, " + ", ".join(f"round(sum(x * {_CELL.format(i=i)}), 7) AS p{i}" for i in range(4)) + " FROM x GROUP BY vec_id"))
def gaussian_projection(spark, sf):
    e = view(spark, sf, "embeddings").withColumn("p", V.project(F.col("embedding"), V.projection(64, 4)))
    return e.select("vec_id", *[F.round(F.col("p")[i], 7).alias(f"p{i}") for i in range(4)])


@query(sql("", "SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda k: (CAST(embedding[k] AS DOUBLE) + CAST(embedding[k + 32] AS DOUBLE)) / 2)), 7) AS total, round((CAST(embedding[5] AS DOUBLE) + CAST(embedding[37] AS DOUBLE)) / 2, 9) AS fifth FROM embeddings"))
def vector_fusion_mean(spark, sf):
    e = view(spark, sf, "embeddings").withColumn("f", V.fused(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)))
    return e.select("vec_id", F.round(F.aggregate("f", F.lit(0.0), lambda s, x: s + x), 7).alias("total"), F.round(F.col("f")[4], 9).alias("fifth"))


@query(sql("v_tokens_long", "h AS (SELECT sha256(coalesce(raw, '')) AS h, count(*) AS c FROM v_tokens_long GROUP BY 1), p AS (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h || ':' || c, ',' ORDER BY h)) AS hh, sum(c) AS c FROM h GROUP BY 1);; SELECT CAST(sum(c) AS BIGINT) AS rows, sha256('v1|' || string_agg(hh, ',' ORDER BY b)) AS fingerprint FROM p"))
def content_fingerprint(spark, sf):
    return V.fingerprint(view(spark, sf, "v_tokens_long"), "raw", "v1")


@query(sql("", "SELECT count(embedding) AS vectors, count(DISTINCT embedding) AS distinct_vectors, count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero_vectors, min(len(embedding)) AS least_size, max(len(embedding)) AS most_size FROM embeddings"))
def vector_audit(spark, sf):
    return V.audit(view(spark, sf, "embeddings"), "embedding")


@query(sql("", "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 9) AS cosine FROM e AS a, e AS b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id);; SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, neighbour) AS rank, neighbour, cosine FROM p QUALIFY rank <= 3"))
def cosine_topk(spark, sf):
    e = view(spark, sf, "embeddings")
    return V.cosine_top(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 3)
