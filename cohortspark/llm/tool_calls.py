"""Tool-call linking: calls joined to results by identifier, ordered topologically, validated and written as canonical JSON."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import cut, query, stored, table

_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _same(a, b) -> bool:
    """Equality of JSON values: true is not 1, at any depth."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return False
        return kind == "number" or isinstance(value, int) or value.is_integer()
    return isinstance(value, _TYPES[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What in a parsed value breaks a schema (type, enum, required, properties, additionalProperties, items, lengths and bounds), in document order."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}:type"]
    out = []
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{at}:enum")
    if isinstance(value, str):
        size = len(value)
        out += [f"{at}:{k}" for k, bad in (("minLength", size < schema.get("minLength", 0)), ("maxLength", size > schema.get("maxLength", size))) if bad]
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}:{k}" for k, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    elif isinstance(value, list):
        for i, x in enumerate(value):
            out += violations(x, schema.get("items", {}), f"{at}[{i}]")
    elif isinstance(value, dict):
        out += [f"{at}.{k}:required" for k in schema.get("required", []) if k not in value]
        known = schema.get("properties", {})
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}:unknown")
    return out


def _object(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key repeats")
    return out


def _finite(text: str) -> float:
    x = float(text)
    if x in (float("inf"), float("-inf")):
        raise ValueError("too large")
    return x


def _no_constant(name: str):
    raise ValueError(name)


def parsed(text: str):
    """The value of a JSON text. ValueError for what is none or has no canonical form: NaN and infinities, numbers beyond double precision's
    range, repeated keys, lone surrogates, and nesting or integers beyond Python's limits."""
    try:
        value = json.loads(text, parse_constant=_no_constant, parse_float=_finite, object_pairs_hook=_object)
        canonical(value).encode()
    except RecursionError as e:
        raise ValueError("nested too deep") from e
    return value


def canonical(value) -> str:
    """JSON with sorted keys, no white space and no escapes beyond the necessary ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def levels(ids: DataFrame, needs: DataFrame) -> DataFrame:
    """Columns (id, level): 0 for calls that need none, else one more than the highest level needed; null on a cycle or behind one.

    One round per level, however many there are; the rounds end when none gets a level.
    """
    some = F.count(F.lit(1))
    left, open_ = stored(needs.distinct().join(ids.select(F.col("id").alias("need")), "need", "left_semi"), n=some)
    done, _ = stored(ids.join(left, "id", "left_anti").select("id", F.lit(0).cast("long").alias("level")))
    while open_["n"]:
        seen = left.join(done.select(F.col("id").alias("need"), "level"), "need", "left")
        ready = seen.groupBy("id").agg(F.max("level").alias("top"), F.count_if(F.col("level").isNull()).alias("open"))
        ready, new = stored(ready.where("open = 0").select("id", (F.col("top") + 1).alias("level")), n=some)
        if not new["n"]:
            break
        left, open_ = stored(left.join(ready, "id", "left_anti"), n=some)
        done, _ = stored(done.unionAll(ready))
    return ids.join(done, "id", "left")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per identifier of `calls` (id, name, arguments, needs: array of ids) or `results` (id, content).

    Columns: id, name, status (`linked`, `no_result`, `no_call`), level, n_calls, n_results, n_errors, errors, canonical. Of several calls or results with one identifier the least
    row counts, and the counts tell how many there were. errors joins by `;` what the arguments break: `$:json` where parsed() refuses them, `$:tool` where no schema has the name,
    else paths and rules. canonical is {"arguments", "id", "level", "name", "result"}; unreadable arguments stay a string. Rows with a null identifier can't be linked and are left out;
    needs of unknown identifiers are ignored. Empty tables give no rows; other columns are ignored. `schemas` is configuration, one per tool.
    """
    c = calls.where("id is not null").groupBy("id").agg(F.min(F.struct(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("arguments", F.lit("")).alias("arguments"), F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    c = cut(c.select("id", "c.name", "c.arguments", "c.needs", "n_calls"))
    r = results.where("id is not null").groupBy("id").agg(F.min(F.coalesce("content", F.lit(""))).alias("content"), F.count(F.lit(1)).alias("n_results"))
    order = levels(c.select("id"), c.select("id", F.explode("needs").alias("need")).where("need is not null"))
    both = c.drop("needs").join(order, "id").join(r, "id", "full_outer")
    status = F.when(F.col("name").isNull(), "no_call").when(F.col("n_results").isNull(), "no_result").otherwise("linked")
    both = both.select("id", "name", "arguments", "content", "level", status.alias("status"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"))

    def run(batches):
        for batch in batches:
            rows, errors, texts = batch.to_pylist(), [], []
            for row in rows:
                found, value = [], None
                if row["status"] != "no_call":
                    try:
                        value = parsed(row["arguments"])
                        found = violations(value, schemas[row["name"]]) if row["name"] in schemas else ["$:tool"]
                    except (ValueError, RecursionError):
                        value, found = row["arguments"], ["$:json"]
                errors.append(found)
                texts.append(canonical({"arguments": value, "id": row["id"], "level": row["level"], "name": row["name"], "result": row["content"]}))
            cols = {k: batch.column(k) for k in ("id", "name", "status", "level", "n_calls", "n_results")}
            cols |= {"n_errors": pa.array([len(e) for e in errors], pa.int64()), "errors": pa.array([";".join(e) for e in errors], pa.string()), "canonical": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    return both.mapInArrow(run, "id string, name string, status string, level long, n_calls long, n_results long, n_errors long, errors string, canonical string")


# The tools that the query reads into the conversations.
TOOLS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 0, "maximum": 40}, "after": {"type": "string"}}},
    "lookup": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "minLength": 60}, "limit": {"type": "integer"}}},
    "extend": {"type": "object", "required": ["after", "query"], "properties": {"query": {"type": "string"}}},
}
_TOOL = "CASE WHEN {n} % 3 = 0 THEN 'search' WHEN {n} % 3 = 1 THEN 'lookup' ELSE 'extend' END"

_SQL = f"""
WITH base AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
raw AS (SELECT conv_id || '-' || turn AS id, {_TOOL.format(n="length(text)")} AS name, text, length(text) % 50 AS lim, CASE WHEN turn % 8 > 1 THEN conv_id || '-' || (turn - 2) END AS need, turn % 8 // 2 AS deep FROM base WHERE role = 'user'),
c AS (SELECT id, count(*) AS n_calls, min((name, '{{"query":' || to_json(text) || ',"limit":' || lim || CASE WHEN need IS NOT NULL THEN ',"after":"' || need || '"' ELSE '' END || '}}')) AS least, arg_min(struct_pack(text := text, lim := lim, need := need, deep := deep, name := name), (name, '{{"query":' || to_json(text) || ',"limit":' || lim || '}}')) AS x FROM raw GROUP BY id),
l0 AS (SELECT c.id, x.need AS need FROM c),
lev AS (WITH RECURSIVE r(id, need, depth) AS (SELECT id, need, 0 FROM l0 UNION ALL SELECT r.id, l0.need, depth + 1 FROM r JOIN l0 ON r.need = l0.id) SELECT id, max(depth) AS level FROM r GROUP BY id),
r AS (SELECT conv_id || '-' || (turn - 1) AS id, min(text) AS content, count(*) AS n_results FROM base WHERE role = 'assistant' GROUP BY 1),
e AS (SELECT id, x.name AS name, x.text AS text, x.lim AS lim, x.need AS need, n_calls,
  array_to_string(list_filter([CASE WHEN x.name = 'extend' AND x.need IS NULL THEN '$.after:required' END, CASE WHEN x.name = 'search' AND x.lim > 40 THEN '$.limit:maximum' END, CASE WHEN x.name = 'lookup' AND length(x.text) < 60 THEN '$.query:minLength' END], lambda z: z IS NOT NULL), ';') AS errors FROM c),
j AS (SELECT coalesce(e.id, r.id) AS id, e.name, lev.level, n_calls, n_results, errors, content, text, lim, need FROM e LEFT JOIN lev USING (id) FULL OUTER JOIN r ON e.id = r.id)
SELECT id, name, CASE WHEN name IS NULL THEN 'no_call' WHEN n_results IS NULL THEN 'no_result' ELSE 'linked' END AS status, level, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
  CASE WHEN coalesce(errors, '') = '' THEN 0 ELSE len(string_split(errors, ';')) END AS n_errors, coalesce(errors, '') AS errors,
  '{{"arguments":' || CASE WHEN name IS NULL THEN 'null' ELSE '{{' || CASE WHEN need IS NOT NULL THEN '"after":"' || need || '",' ELSE '' END || '"limit":' || lim || ',"query":' || to_json(text) || '}}' END || ',"id":"' || id || '","level":' || coalesce(CAST(level AS VARCHAR), 'null')
  || ',"name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}}' AS canonical
FROM j"""


@query("op2_tool_calls", _SQL)
def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn read as a call of one of TOOLS, in chains of four; every assistant turn as the result of the turn before it."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    need = F.when(F.col("turn") % 8 > 1, F.concat_ws("-", "conv_id", F.col("turn") - 2))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), (F.length("text") % 50).alias("limit"), need.alias("after")))
    name = F.expr(_TOOL.format(n="length(text)"))
    calls = turns.where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), name.alias("name"), arguments.alias("arguments"), F.array_compact(F.array(need)).alias("needs"))
    results = turns.where("role = 'assistant'").select(F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("id"), F.col("text").alias("content"))
    return link(calls, results, TOOLS)
