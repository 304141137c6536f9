"""Views over the given tables that have the shapes the operators need; one text serves Spark and the SQL checks, but for the views in WIDER, whose rows Spark gets by a shorter way.

$h(x) is the first eight hex digits of md5 of x as a number, $s(x) is x as a string, $lines(x, k) joins the texts x of a group by '|' in the order of k.
v_tokens_wide has 13 text columns at any size: the last one holds the 13th line of an order and all later ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations"]

ROW = "concat_ws('|', $s(l_orderkey), $s(l_linenumber), $s(l_partkey), $s(l_suppkey), $s(CAST(round(l_quantity) AS BIGINT)), $s(CAST(round(l_extendedprice * 100) AS BIGINT)), $s(CAST(round(l_discount * 100) AS BIGINT)), $s(CAST(round(l_tax * 100) AS BIGINT)))"

_RAW = f"""SELECT {{columns}},
        CASE rh % 11 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('*', p_name, '*') WHEN 2 THEN '*not codable*' WHEN 3 THEN 'N/A' WHEN 4 THEN '' WHEN 5 THEN concat(' ', p_name, '  |', upper(p_name), ' | unknown') WHEN 6 THEN NULL ELSE p_name END AS raw
        FROM (SELECT l_orderkey AS visit_id, l_linenumber, $h({ROW}) AS rh, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)"""

VIEWS = {
    "v_visits": (["orders"], """SELECT o_custkey AS entity, o_orderkey AS visit_id, CAST(year(o_orderdate) AS INT) AS y,
        CAST(CASE WHEN $h(o_orderkey) % 101 = 0 THEN 2 ELSE month(o_orderdate) END AS INT) AS m, CAST(CASE WHEN $h(o_orderkey) % 101 = 0 THEN 31 ELSE day(o_orderdate) END AS INT) AS d,
        CASE WHEN $h(concat('s', $s(o_orderkey))) % 53 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 3 WHEN o_orderstatus = 'F' THEN 4 ELSE 1 END AS state,
        o_totalprice AS price, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, CAST($h(concat('b', $s(o_orderkey))) % 2 AS INT) AS flag_a,
        CASE WHEN $h(concat('n', $s(o_orderkey))) % 7 = 0 THEN NULL ELSE CAST($h(concat('c', $s(o_orderkey))) % 2 AS INT) END AS flag_b FROM orders"""),
    "v_coded": (["v_visits"], """SELECT entity, visit_id, y, m, d, state, price, priority,
        CASE k1 WHEN 0 THEN '-4' WHEN 1 THEN '-4.4' WHEN 2 THEN ' ' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '8' WHEN 6 THEN '9' WHEN 7 THEN '2' WHEN 8 THEN '-4.0' ELSE $s(k1 % 2) END AS c1,
        CASE k2 WHEN 0 THEN '-5' WHEN 1 THEN 'abc' WHEN 2 THEN '88' WHEN 3 THEN NULL WHEN 4 THEN '99' ELSE $s(k2 * 3) END AS c2,
        CASE k3 WHEN 0 THEN ' -4 ' WHEN 1 THEN '9' WHEN 2 THEN '8' WHEN 3 THEN '' ELSE concat($s(k3), '.5') END AS c3, CASE WHEN k1 % 2 = 0 THEN ' ' END AS c4
        FROM (SELECT *, CAST($h(concat('1', $s(visit_id))) % 17 AS INT) AS k1, CAST($h(concat('2', $s(visit_id))) % 17 AS INT) AS k2, CAST($h(concat('3', $s(visit_id))) % 17 AS INT) AS k3 FROM v_visits)"""),
    "v_codebook": (["part"], """SELECT book, CAST(p_partkey AS INT) AS line, CASE $h(concat('n', $s(p_partkey))) % 5 WHEN 0 THEN lower(v) WHEN 1 THEN concat(' ', v) WHEN 2 THEN 'nan' ELSE v END AS name, CASE WHEN $h(concat('t', $s(p_partkey))) % 5 = 0 THEN ' ' ELSE concat(p_name, ' é ', p_brand) END AS description,
        CASE WHEN book = 'book1' THEN CASE p_partkey % 4 WHEN 0 THEN concat($s(p_size), '=Unknown; -4.4 Not collected') WHEN 1 THEN '88, 99' WHEN 2 THEN 'left blank | 5-8' END END AS missing_codes, CASE WHEN book = 'book2' THEN $s(p_size) END AS code,
        CASE WHEN book = 'book2' THEN CASE p_partkey % 5 WHEN 0 THEN 'missing value' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Not collected' WHEN 3 THEN 'much missingness' ELSE concat(p_type, ' part') END END AS label
        FROM (SELECT *, concat('V', $s(p_partkey - p_partkey % 3)) AS v, CASE WHEN $h(concat('f', $s(p_partkey))) % 2 = 0 THEN 'book1' ELSE 'book2' END AS book FROM part)"""),
    "v_variables": (["lineitem"], """SELECT DISTINCT concat(CASE l_suppkey % 5 WHEN 0 THEN 'v' WHEN 1 THEN 'w' ELSE 'V' END, $s(l_partkey - l_partkey % 3)) AS column_name FROM lineitem"""),
    "v_tokens_long": (["lineitem", "part"], _RAW.format(columns="visit_id, CAST(row_number() OVER (PARTITION BY visit_id ORDER BY l_linenumber, rh) AS INT) AS pos")),
    "v_tokens_wide": (["orders", "v_tokens_long"], "SELECT o_orderkey AS visit_id, " + ", ".join(f"w.drug{k}" for k in range(1, 14)) + " FROM orders LEFT JOIN (SELECT visit_id, " + ", ".join(f"max(CASE WHEN pos = {k} THEN raw END) AS drug{k}" for k in range(1, 13)) + ", $lines(CASE WHEN pos >= 13 THEN raw END, pos) AS drug13 FROM v_tokens_long GROUP BY visit_id) AS w ON w.visit_id = o_orderkey"),
    "v_aliases": (["part"], """SELECT DISTINCT p_name AS alias, CASE WHEN t.batch = 1 THEN first_name ELSE last_name END AS canonical, t.batch AS batch FROM (SELECT p_name, min(p_name) OVER (PARTITION BY substr(p_name, 1, 4)) AS first_name, max(p_name) OVER (PARTITION BY substr(p_name, 1, 4)) AS last_name FROM part)
        CROSS JOIN (VALUES (1), (2)) AS t(batch) WHERE $h(concat('al', p_name)) % 3 = 0 AND (t.batch = 1 OR $h(concat('bl', p_name)) % 2 = 0)"""),
    "v_dictionary": (["part"], """SELECT token, CAST($h(concat('a', token)) % 2 AS INT) AS f1, CAST($h(concat('b', token)) % 3 % 2 AS INT) AS f2, CAST($h(concat('c', token)) % 2 AS INT) AS f3, CAST($h(concat('d', token)) % 5 % 2 AS INT) AS f4, CAST($h(concat('e', token)) % 2 AS INT) AS f5, CAST($h(concat('f', token)) % 3 % 2 AS INT) AS f6,
        CAST($h(concat('g', token)) % 2 AS INT) AS f7, CAST($h(concat('h', token)) % 7 % 2 AS INT) AS f8, ($h(concat('i', token)) % 101) / 100.0E0 AS confidence, CASE WHEN $h(concat('j', token)) % 3 = 0 THEN 'rules' ELSE 'model' END AS provider, CAST($h(concat('k', token)) % 4 AS INT) AS attempts, CAST($h(concat('l', token)) % 1000 AS INT) AS elapsed,
        CASE WHEN $h(concat('m', token)) % 6 = 0 THEN 1 ELSE 0 END AS review FROM (SELECT DISTINCT p_name AS token FROM part)"""),
    "v_cache": (["v_dictionary"], """SELECT token, concat(token, CASE WHEN $h(token) % 5 = 0 THEN ' ' ELSE '' END) AS raw, CASE WHEN $h(token) % 7 = 0 THEN 'bad' ELSE $sha(token) END AS token_key, b AS batch, f1, confidence + b / 1000.0E0 AS confidence, provider, CASE WHEN $h(token) % 4 = 0 THEN 'stale: timeout' ELSE '' END AS error FROM v_dictionary CROSS JOIN (VALUES (1), (2)) AS t(b) WHERE $h(token) % 3 <> 0 AND (b = 1 OR $h(concat(token, 'x')) % 2 = 0)"""),
    "v_responses": (["v_dictionary"], """SELECT token, CASE k WHEN 0 THEN concat('{"f1": 2, "f2": "yes", "confidence": 0.9, "summary": "', token, '"}') WHEN 1 THEN '{"f1": 1, "confidence": 0.5}' WHEN 2 THEN concat('{"f1": 1, "f2": 0, "confid') WHEN 3 THEN concat('text before ```json {"f1": 1, "f2": 1, "confidence": 1.5, "summary": "', token, '"} ``` after')
        WHEN 4 THEN concat('{"response": {"f1": 0, "f2": true, "confidence": 0.7, "summary": "', token, '"}}') ELSE concat('{"f1": ', $s(f1), ', "f2": ', $s(f2), ', "confidence": ', $s(CAST(round(confidence * 100) AS INT)), 'e-2, "summary": "', token, '"}') END AS response FROM (SELECT *, $h(concat('r', token)) % 13 AS k FROM v_dictionary)"""),
    "v_scored": (["lineitem"], f"""SELECT rid, entity, y, grp, grp2, model, CAST(CASE model WHEN 'tied' THEN tied WHEN 'signal' THEN signal ELSE 0.5E0 END AS DOUBLE) AS risk FROM (SELECT md5({ROW}) AS rid, l_orderkey AS entity, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_linestatus AS grp, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE $s(l_suppkey % 7) END AS grp2,
        round(l_discount * 5 + l_tax * 3, 6) AS tied, round(CASE WHEN l_returnflag = 'R' THEN 0.2E0 ELSE 0.0E0 END + ($h({ROW}) % 1000) / 1250.0E0, 6) AS signal FROM lineitem) CROSS JOIN (VALUES ('tied'), ('signal'), ('constant')) AS t(model)"""),
    "v_cohort": (["v_visits"], """SELECT entity, visit_id, y, m, d, state, price, priority, flag_a, flag_b, CASE WHEN nxt = 4 THEN 1 ELSE 0 END AS label FROM (SELECT *, lead(state) OVER (PARTITION BY entity ORDER BY y, m, d, visit_id) AS nxt FROM v_visits) WHERE state = 3 AND nxt IS NOT NULL"""),
    "v_risks": (["v_cohort"], """SELECT *, round(label * 0.15E0 + ($h(concat('ra', $s(visit_id))) % 1000) / 1300.0E0, 6) AS risk_a, round(label * 0.25E0 + ($h(concat('rb', $s(visit_id))) % 1000) / 1400.0E0, 6) AS risk_b FROM v_cohort"""),
    "v_anchor": (["v_risks"], "SELECT *, " + ", ".join(f"CASE WHEN $h(concat('o{k}', $s(visit_id))) % 10 < 6 THEN NULL ELSE CAST($h(concat('p{k}', $s(visit_id))) % 7 AS INT) END AS o{k}" for k in range(1, 6)) + " FROM v_risks"),
}


_DRUGS = ", ".join(f"w.drug{k}" for k in range(1, 14))
_LATE = "slice(lines, 13, size(lines))"

#: Spark's own texts. The lines of an order are dealt to its task once and sorted there as one array, without a window and without a maximum per column; a column's lines in the order of v_tokens_long
WIDER = {
    "v_tokens_wide": f"""SELECT o_orderkey AS visit_id, {_DRUGS} FROM orders LEFT JOIN (SELECT visit_id, {", ".join(f"get(lines, {k - 1}).raw AS drug{k}" for k in range(1, 13))},
        CASE WHEN size(lines) > 12 AND exists({_LATE}, x -> x.raw IS NOT NULL) THEN array_join(transform({_LATE}, x -> x.raw), '|') END AS drug13
        FROM (SELECT visit_id, sort_array(collect_list(struct(l_linenumber, rh, raw))) AS lines FROM ({_RAW.format(columns="visit_id, l_linenumber, rh")} DISTRIBUTE BY visit_id) GROUP BY visit_id)) AS w ON w.visit_id = o_orderkey""",
}


def _macros(text: str, spark: bool) -> str:
    kind = "STRING" if spark else "VARCHAR"

    def close(t: str, at: int) -> int:
        depth = 0
        for i in range(at, len(t)):
            depth += (t[i] == "(") - (t[i] == ")")
            if not depth:
                return i
        raise ValueError(t[at : at + 40])

    while m := re.search(r"\$(h|sha|s|lines)\(", text):
        end = close(text, m.end() - 1)
        x = text[m.end() : end]
        if m[1] == "s":
            new = f"CAST({x} AS {kind})"
        elif m[1] == "lines":
            x, _, k = x.rpartition(",")
            new = f"listagg({x}, '|') WITHIN GROUP (ORDER BY {k})" if spark else f"string_agg({x}, '|' ORDER BY {k})"
        elif m[1] == "sha":
            new = f"sha2({x}, 256)" if spark else f"sha256({x})"
        else:
            hexed = f"substr(md5(CAST({x} AS {kind})), 1, 8)"
            new = f"CAST(conv({hexed}, 16, 10) AS BIGINT)" if spark else f"CAST(concat('0x', {hexed}) AS BIGINT)"
        text = text[: m.start()] + new + text[end + 1 :]
    return text.replace("$STR", kind)


def chain(*names: str, spark: bool = False) -> str:
    """WITH clauses of the named views and of those they read."""
    order: list[str] = []

    def need(n: str) -> None:
        if n in VIEWS and n not in order:
            for d in VIEWS[n][0]:
                need(d)
            order.append(n)

    for n in names:
        need(n)
    return ", ".join(f"{n} AS ({_macros(WIDER.get(n, VIEWS[n][1]) if spark else VIEWS[n][1], spark)})" for n in order)


def sql(names: str, body: str) -> str:
    """A DuckDB text: the views it reads, then its own clauses and SELECT (body may start with more clauses, ended by ';;')."""
    head = chain(*names.split())
    more, sep, select = body.rpartition(";;")
    parts = [p for p in (head, _macros(more, False) if sep else "") if p]
    return (f"WITH {', '.join(parts)} " if parts else "") + _macros(select, False)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or a given table) as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used, todo = set(), [name]
    while todo:
        for d in VIEWS[todo.pop()][0]:
            (todo.append if d in VIEWS else used.add)(d)
    for t in used:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"WITH {chain(name, spark=True)} SELECT * FROM {name}")
