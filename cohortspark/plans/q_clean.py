"""Queries on coded tables: cleaning, profiles, audits, guards, sinks and codebooks."""

from pyspark.sql import functions as F

from cohortspark.functions.values import is_blank, recode_binary, to_number
from cohortspark.operators import clean as K
from cohortspark.plans.registry import query
from cohortspark.plans.views import sql, view
from cohortspark.sources import cache, codebooks, tables, textfiles

CODES = [-4.0, -4.4, -5.0]
KEEP = {"c1": [8.0], "c2": [88.0]}
BY = {"c1": [8.0, 9.0], "c2": [88.0, 99.0]}
_COLS = ["c1", "c2", "c3"]


def num(c):
    return f"TRY_CAST(trim({c}) AS DOUBLE)"


def blank(c):
    return f"({c} IS NULL OR trim({c}) = '')"


def _without(c, codes):
    return f"CASE WHEN coalesce({num(c)} IN ({', '.join(f'{x}E0' for x in codes)}), false) THEN NULL ELSE {c} END"


def coded(spark, sf):
    return view(spark, sf, "v_coded")


place = tables.scratch


@query(sql("v_coded", "SELECT visit_id, c1, c2, state FROM (SELECT *, row_number() OVER (ORDER BY visit_id) - 1 AS n FROM v_coded) WHERE n >= 100 AND n < 900"))
def scan_columns_window(spark, sf):
    """A window of the rows of CSV files in file order: the table is written in the order of its key first."""
    out = place(spark)
    keep = coded(spark, sf).orderBy("visit_id").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    keep.csv(out)
    rows = textfiles.csv_window(spark, out, ["visit_id", "c1", "c2", "state"], 100, 900)
    return rows.withColumns({"visit_id": F.col("visit_id").cast("long"), "state": F.col("state").cast("int")})


def _books(spark, sf):
    """The codebook of the parts as two books of CSV files: with other headers, one in UTF-8, the other in Latin-1; beside them a file that is none."""
    out = place(spark)
    v = view(spark, sf, "v_codebook")
    one = v.where("book = 'book1'").select("line", F.col("name").alias("Variable Name"), F.col("description").alias("Short Descriptor"), "missing_codes")
    two = v.where("book = 'book2'").select("line", F.col("name").alias("FIELD"), F.col("description").alias("Definition"), "code", F.col("label").alias("code_label"))
    for number, (book, encoding) in enumerate(((one, "UTF-8"), (two, "ISO-8859-1")), 1):
        keep = book.write.option("header", True).option("encoding", encoding).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        keep.csv(f"{out}/book{number}")
    spark.range(1).select(F.lit("<html>, no codebook at all</html>")).write.text(f"{out}/book3")
    return out


def _united(spark, sf):
    return codebooks.unite(codebooks.read_books(spark, _books(spark, sf)))


_UNITED = "u AS (SELECT upper(trim(name)) AS key, book, line, trim(name) AS name, trim(description) AS description FROM v_codebook WHERE lower(trim(name)) NOT IN ('', 'nan', 'none') AND trim(description) <> '' QUALIFY row_number() OVER (PARTITION BY upper(trim(name)) ORDER BY book, line) = 1)"


@query(sql("v_codebook", _UNITED + ";; SELECT * FROM u"))
def scan_codebook_union(spark, sf):
    return _united(spark, sf)


@query(sql("v_codebook v_variables", _UNITED + ";; SELECT column_name, coalesce(description, 'no description of ' || column_name) AS description, book, CASE WHEN key IS NULL THEN 'fallback' WHEN name = column_name THEN 'exact' ELSE 'case_insensitive' END AS match FROM v_variables LEFT JOIN u ON upper(column_name) = key"))
def codebook_description_lookup(spark, sf):
    return codebooks.look_up(view(spark, sf, "v_variables"), _united(spark, sf), F.concat(F.lit("no description of "), "column_name"))


_HAVE = "n AS (SELECT unnest(['book1', 'book2', 'book3', 'book4']) AS name), have AS (SELECT DISTINCT book AS name, true AS h FROM v_codebook UNION ALL SELECT 'book3', true)"


@query(sql("v_codebook", _HAVE + ";; SELECT name, h IS NOT NULL AS exists, h IS NOT NULL AND name <> 'book3' AS valid, CASE WHEN h IS NULL THEN 'missing' WHEN name = 'book3' THEN 'invalid' ELSE 'ok' END AS status FROM n LEFT JOIN have USING (name)"))
def codebook_file_audit(spark, sf):
    return codebooks.file_audit(spark, _books(spark, sf), ["book1", "book2", "book3", "book4"])


@query(sql("v_visits", "SELECT visit_id, round_even(price / 7, 2) AS unit, CAST(flag_a AS INT) AS flag_a, CAST(state AS BIGINT) AS state FROM v_visits"))
def table_sink_rounded(spark, sf):
    df = view(spark, sf, "v_visits").select("visit_id", (F.col("price") / 7).alias("unit"), F.col("flag_a").cast("double").alias("flag_a"), F.col("state").cast("double").alias("state"))
    kinds = {r["column_name"]: r for r in K.type_profile(df, ["flag_a", "state"]).collect()}
    out = place(spark)
    K.rounded(df, 2, [c for c, r in kinds.items() if r["is_binary"]], [c for c, r in kinds.items() if r["is_integral"] and not r["is_binary"]]).write.parquet(out)
    return spark.read.parquet(out)


@query(sql("v_coded", f"SELECT rule, CAST(n AS BIGINT) AS n FROM (SELECT 'non_empty' AS rule, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS n FROM v_coded UNION ALL SELECT 'forbidden_columns', 0 UNION ALL SELECT 'sentinels', 0 UNION ALL SELECT 'priority_le_state', count(*) FILTER (priority > state) FROM v_coded)"))
def sink_readback_guard(spark, sf):
    out = place(spark)
    K.replace_codes(coded(spark, sf), CODES, _COLS).drop("c4").write.parquet(out)
    found = K.violations(spark.read.parquet(out), CODES, _COLS, ["c4"], [("priority", "state")])
    K.guard(found.where("rule <> 'priority_le_state'"))
    return found


@query(sql("v_cache", "SELECT token, raw, token_key, batch, f1, round(confidence, 6) AS confidence, provider, error FROM v_cache QUALIFY row_number() OVER (PARTITION BY token ORDER BY batch DESC) = 1"))
def keyed_cache_upsert(spark, sf):
    v = view(spark, sf, "v_cache")
    return cache.upsert(v.where("batch = 1"), v.where("batch = 2"), "token").withColumn("confidence", F.round("confidence", 6))


@query(sql("v_cache", "SELECT DISTINCT token, batch, lookup, error FROM (SELECT token, batch, unnest([raw, lower(trim(raw))]) AS lookup, CASE WHEN starts_with(error, 'stale') THEN '' ELSE error END AS error FROM v_cache WHERE trim(raw) <> '')"))
def keyed_cache_load(spark, sf):
    return cache.load(view(spark, sf, "v_cache"), "raw", "error", "stale").select("token", "batch", "lookup", "error")


@query(sql("v_cache", "SELECT token, batch, provider, coalesce(f1, 0) AS f1, 0 AS f9, round(coalesce(confidence, 0.2), 6) AS confidence, CASE WHEN starts_with(error, 'stale') THEN '' ELSE error END AS error, CASE WHEN provider = 'model' THEN 1 ELSE 0 END AS parsed FROM v_cache"))
def cache_row_upgrade(spark, sf):
    out = cache.upgrade(view(spark, sf, "v_cache"), {"f1": 0, "f9": 0, "confidence": 0.2}, "model")
    return out.select("token", "batch", "provider", "f1", "f9", F.round("confidence", 6).alias("confidence"), "error", "parsed")


@query(sql("v_cache", "SELECT token, batch, token_key FROM v_cache WHERE token_key = sha256(token)"))
def stable_key_cache_filter(spark, sf):
    return cache.stable_keys(view(spark, sf, "v_cache"), "token", "token_key").select("token", "batch", "token_key")


@query(sql("v_cache v_dictionary v_responses", "hit AS (SELECT DISTINCT token FROM v_cache WHERE token_key = sha256(token)), back AS (SELECT DISTINCT token FROM v_responses WHERE response LIKE '%```%');; SELECT token, CASE WHEN token IN (SELECT token FROM back) THEN 'recovered' WHEN token IN (SELECT token FROM hit) THEN 'cache_hit' WHEN attempts > 0 THEN 'pending_call' ELSE 'local_only' END AS status FROM v_dictionary"))
def pending_split(spark, sf):
    d = view(spark, sf, "v_dictionary").withColumn("selected", F.col("attempts") > 0)
    hit = cache.stable_keys(view(spark, sf, "v_cache"), "token", "token_key")
    back = view(spark, sf, "v_responses").where(F.col("response").contains("```"))
    return cache.pending(d, hit, back, "token", "selected").select("token", "status")


@query(sql("v_coded", f"SELECT visit_id, {blank('c1')} AS blank_c1, {blank('c4')} AS blank_c4 FROM v_coded"))
def blank_predicate(spark, sf):
    return coded(spark, sf).select("visit_id", is_blank(F.col("c1")).alias("blank_c1"), is_blank(F.col("c4")).alias("blank_c4"))


@query(sql("v_coded", f"SELECT visit_id, c1, c2, state FROM v_coded WHERE NOT {blank('c1')} AND NOT {blank('c2')} AND state IS NOT NULL"))
def required_row_filter(spark, sf):
    return K.required_rows(coded(spark, sf), ["c1", "c2", "state"]).select("visit_id", "c1", "c2", "state")


@query(sql("v_coded", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({blank(c)}) AS n_blank FROM v_coded" for c in ("c1", "c2", "c3")) + f" UNION ALL SELECT 'ANY_REQUIRED_COLUMN', count(*) FILTER ({blank('c1')} OR {blank('c2')} OR {blank('c3')}) FROM v_coded"))
def required_row_audit(spark, sf):
    return K.required_audit(coded(spark, sf), _COLS)


@query(sql("v_coded", "SELECT visit_id, c1, c2, c3 FROM v_coded"))
def drop_all_blank_columns(spark, sf):
    kept, _ = K.drop_blank_columns(coded(spark, sf).select("visit_id", "c1", "c2", "c3", "c4"))
    return kept


@query(sql("v_coded", " UNION ALL ".join(f"SELECT '{c}' AS column_name, CASE WHEN '{c}' = 'c3' THEN 'unselected' WHEN bool_and({blank(c)}) THEN 'all_blank' ELSE 'kept' END AS status, '{'bigint' if c == 'visit_id' else 'string'}' AS dtype, CAST(coalesce(max(length(CAST({c} AS VARCHAR))), 0) AS INT) AS max_length FROM v_coded" for c in ("visit_id", "c1", "c2", "c3", "c4")).replace("visit_id IS NULL OR trim(visit_id) = ''", "visit_id IS NULL")))
def column_audit(spark, sf):
    return K.column_audit(coded(spark, sf).select("visit_id", "c1", "c2", "c3", "c4"), ["visit_id", "c1", "c2", "c4"])


@query(sql("v_coded", f"SELECT count(*) AS loaded, count(*) FILTER ({blank('c1')} OR {blank('c2')}) AS removed, count(*) FILTER (NOT ({blank('c1')} OR {blank('c2')})) AS retained, count(DISTINCT entity) FILTER (NOT ({blank('c1')} OR {blank('c2')})) AS entities, 12 AS n_columns FROM v_coded"))
def input_profile(spark, sf):
    return K.input_profile(coded(spark, sf), ["c1", "c2"], "entity")


@query(sql("v_coded", "SELECT visit_id, " + ", ".join(f"CASE WHEN isnan({num(c)}) THEN NULL ELSE {num(c)} END AS {c}" for c in _COLS) + " FROM v_coded"))
def numeric_coerce(spark, sf):
    return coded(spark, sf).select("visit_id", *[to_number(F.col(c)).alias(c) for c in _COLS])


@query(sql("v_coded", f"SELECT visit_id, {_without('c1', [88.0, 99.0])} AS c1, {_without('c2', [88.0, 99.0])} AS c2 FROM v_coded"))
def missing_global_codes(spark, sf):
    return K.replace_codes(coded(spark, sf), [88.0, 99.0], _COLS).select("visit_id", "c1", "c2")


@query(sql("v_coded", "SELECT visit_id, " + ", ".join(f"{_without(c, CODES)} AS {c}" for c in _COLS) + " FROM v_coded"))
def missing_structural_codes(spark, sf):
    return K.replace_codes(coded(spark, sf), CODES, _COLS).select("visit_id", *_COLS)


@query(sql("v_coded", f"SELECT visit_id, {_without('c1', [-4.0, -4.4, -5.0, 9.0])} AS c1, {_without('c2', [-4.0, -4.4, -5.0, 99.0])} AS c2 FROM v_coded"))
def missing_codes_by_column(spark, sf):
    return K.replace_codes(coded(spark, sf), CODES, _COLS, KEEP, BY).select("visit_id", "c1", "c2")


_HELD = " OR ".join("contains(lower(label), '" + t.replace("'", "''") + "')" for t in K.MISSING_TERMS)


@query(sql("v_codebook", f"a AS (SELECT lower(trim(name)) AS column_name, missing_codes AS cell FROM v_codebook UNION ALL SELECT lower(trim(name)), code FROM v_codebook WHERE {_HELD}), p AS (SELECT column_name, trim(unnest(regexp_split_to_array(cell, '[,;|]'))) AS part FROM a WHERE cell IS NOT NULL), w AS (SELECT column_name, part, list_filter(regexp_extract_all(regexp_replace(part, '([0-9A-Za-z])-', '\\1 ', 'g'), '[0-9A-Za-z.-]+'), lambda x: TRY_CAST(x AS DOUBLE) IS NOT NULL) AS numbers FROM p WHERE part <> '');; SELECT DISTINCT column_name, code, text FROM (SELECT column_name, CAST(unnest(numbers) AS DOUBLE) AS code, CAST(NULL AS VARCHAR) AS text FROM w UNION ALL SELECT column_name, NULL, part FROM w WHERE len(numbers) = 0) WHERE column_name <> 'nan'"))
def missing_codes_from_codebook(spark, sf):
    books = codebooks.read_books(spark, _books(spark, sf), ["missing_codes", "code", "code_label"])
    return K.codes_from_codebook(books.where("lower(name) <> 'nan'").withColumnRenamed("code_label", "label"))


@query(sql("v_coded", f"SELECT visit_id, {_without('c1', [-4.0, -4.4, -5.0, 9.0])} AS c1, {_without('c2', [-4.0, -4.4, -5.0, 99.0])} AS c2 FROM v_coded"))
def restore_preserved_values(spark, sf):
    raw = coded(spark, sf).select("visit_id", "c1", "c2")
    return K.restore_preserved(K.replace_codes(raw, CODES, ["c1", "c2"], None, BY), raw, "visit_id", KEEP)


@query(sql("v_coded", "SELECT visit_id, c1, CASE TRY_CAST(trim(c1) AS DOUBLE) WHEN 0 THEN 0 WHEN 2 THEN 0 WHEN 1 THEN 1 END AS bin FROM v_coded"), "recode_binary")
def recode_binary_values(spark, sf):
    return coded(spark, sf).select("visit_id", "c1", recode_binary(F.col("c1")).alias("bin"))


_IN = "coalesce({} IN (-4.0E0, -4.4E0, -5.0E0), false)"


@query(sql("v_coded", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({_IN.format(num(c))}) AS n FROM v_coded" for c in _COLS) + ") WHERE n > 0"))
def sentinel_audit(spark, sf):
    return K.sentinel_audit(coded(spark, sf), CODES, _COLS)


@query(sql("v_coded", "SELECT rule, CAST(n AS BIGINT) AS n FROM (SELECT 'non_empty' AS rule, 0 AS n UNION ALL SELECT 'forbidden_columns', 1 UNION ALL SELECT 'sentinels', (SELECT sum(" + " + ".join(f"CASE WHEN {_IN.format(num(c))} THEN 1 ELSE 0 END" for c in _COLS) + ") FROM v_coded) UNION ALL SELECT 'priority_le_state', (SELECT count(*) FILTER (priority > state) FROM v_coded))"))
def constraint_guard(spark, sf):
    return K.violations(coded(spark, sf), CODES, _COLS, ["c4"], [("priority", "state")])


@query(sql("v_coded", f"SELECT visit_id, CASE {num('c1')} WHEN 0 THEN 0 WHEN 2 THEN 0 WHEN 1 THEN 1 END AS c1, {_without('c2', CODES)} AS c2, {_without('c3', CODES)} AS c3 FROM v_coded"))
def finalize_frame(spark, sf):
    raw = coded(spark, sf).select("visit_id", "c1", "c2", "c3", "c4")
    return K.finalize(raw, raw, "visit_id", CODES, _COLS, {"c2": [88.0]}, ["c1"], ["c4"])


def _profile(c):
    return f"SELECT '{c}' AS column_name, count({c}) AS n, coalesce(bool_and({c} IN (0, 1)), false) AS is_binary, coalesce(bool_and(abs({c} - round({c})) <= 1e-9), false) AS is_integral FROM p"


@query(sql("v_visits", "p AS (SELECT CAST(flag_a AS DOUBLE) AS flag_a, CAST(flag_b AS DOUBLE) AS flag_b, CAST(state AS DOUBLE) AS state, price FROM v_visits);; " + " UNION ALL ".join(map(_profile, ["flag_a", "flag_b", "state", "price"]))))
def profile_column_types(spark, sf):
    return K.type_profile(view(spark, sf, "v_visits"), ["flag_a", "flag_b", "state", "price"])


@query(sql("v_visits", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique, round((count(*) - count({c})) * 100.0E0 / count(*), 6) AS pct_missing FROM v_visits" for c in ("state", "price", "priority", "flag_b"))))
def feature_summary(spark, sf):
    return K.feature_summary(view(spark, sf, "v_visits"), ["state", "price", "priority", "flag_b"])


PREFIXES = {"traj_": "longitudinal", "llm_": "record", "med_": "token", "drug": "source_text"}
MEMBERS = {"visit_time": ["y", "m", "d", "visit_id"], "severity": ["state", "priority"], "comorbidity": ["flag_a", "flag_b"]}
_NAMES = ["entity", "visit_id", "y", "m", "d", "state", "price", "priority", "flag_a", "flag_b", "label"]


_KINDS = "k AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, CASE WHEN count({c}) = 0 THEN 'empty' WHEN bool_and({c} IN (0, 1)) THEN 'binary' WHEN bool_and(abs({c} - round({c})) <= 1e-9) THEN 'integral' ELSE 'numeric' END AS kind FROM v_cohort" for c in _NAMES) + ")"


@query(sql("v_cohort", _KINDS + ";; SELECT column_name, kind, n, CASE WHEN column_name IN ('y', 'm', 'd', 'visit_id') THEN 'visit_time' WHEN column_name IN ('state', 'priority') THEN 'severity' WHEN column_name IN ('flag_a', 'flag_b') THEN 'comorbidity' ELSE 'other' END AS domain FROM k"))
def column_domain(spark, sf):
    """The domain of each column by its name, with the kind and number of its values."""
    kinds = K.feature_lists(view(spark, sf, "v_cohort"), {}, [])
    return kinds.select("column_name", F.col("family").alias("kind"), "n", K.column_domain(F.col("column_name"), PREFIXES, MEMBERS, "other").alias("domain"))


@query(sql("v_cohort", _KINDS + ";; SELECT CASE WHEN column_name LIKE 'flag\\_%' ESCAPE '\\' THEN 'flag' ELSE kind END AS family, column_name, n FROM k WHERE column_name NOT IN ('entity', 'visit_id', 'label')"))
def feature_lists(spark, sf):
    return K.feature_lists(view(spark, sf, "v_cohort"), {"flag_": "flag"}, ["entity", "visit_id", "label"])


@query(sql("v_cohort", "SELECT entity, visit_id, price, priority, flag_a, flag_b FROM v_cohort"))
def analysis_projection(spark, sf):
    return view(spark, sf, "v_cohort").select(*K.analysis_columns([["entity", "visit_id", "price"], ["price", "priority"], ["entity", "flag_a", "flag_b"]]))


@query(sql("v_cohort", "SELECT visit_id, coalesce(flag_b, 0) AS flag_b FROM v_cohort"))
def fill_llm_zero(spark, sf):
    return view(spark, sf, "v_cohort").select("visit_id", "flag_b").fillna(0, ["flag_b"])
