"""Abstraction records: identity, JSON parsing, coercion, repairs, certification, roll-up and audits."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.values import flag, total
from cohortspark.sources.tables import written

FLAGS = [f"f{i}" for i in range(1, 9)]
RECORD = "f1 string, f2 string, confidence double, summary string"


def identity(token: Column, provider: Column, score: Column) -> list[Column]:
    """Normalised token, its sha256 key (empty for an empty token), provider and similarity clamped to 0..1."""
    norm = F.lower(F.trim(F.coalesce(token, F.lit(""))))
    return [norm.alias("normalized"), F.when(norm == "", F.lit("")).otherwise(F.sha2(norm, 256)).alias("token_key"), provider.alias("provider"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("similarity")]


_DEEPEST = 100  # envelopes inside envelopes that are opened


def _balanced(text: str):
    """Stretches of the text from an outer opening brace to the brace that closes it; braces inside strings don't count, and one never closed has none."""
    start, depth, quoted, skip = -1, 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start, depth = (i, 1) if not depth else (start, depth + 1)
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                yield text[start : i + 1]


def _parsed(text: str):
    """The JSON value of a text; None for none, and for what is nested too deep or holds what JSON has no value for."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _object(text: str, required: list[str], depth: int = 0) -> dict | None:
    """The object of a whole text, else of its first balanced stretch that is JSON; of a list its first element.

    An envelope (`response`, and none of the required keys) stands for what it holds, itself or as text.
    """
    for part in [text, *_balanced(text)]:
        value = _parsed(part)
        if isinstance(value, list):
            value = value[0] if value and isinstance(value[0], dict) else None
        for _ in range(_DEEPEST):
            if not isinstance(value, dict) or "response" not in value or any(k in value for k in required):
                break
            value = value["response"]
            if isinstance(value, str):
                return _object(value, required, depth + 1) if depth < _DEEPEST else None
            if not isinstance(value, dict):
                return None
        if isinstance(value, dict):
            return value
    return None


def first_object(text: str | None, required: list[str] = ()) -> str | None:
    """The first JSON object in a noisy text; None without any.

    Only outer, closed objects count: of a cut-off answer no inner object is taken for it. What is nested beyond Python's limit counts as none.
    """
    try:
        found = _object(text, list(required)) if text else None
        return None if found is None else json.dumps(found)
    except RecursionError:
        return None


def extract_json(df: DataFrame, response: str, schema: str = RECORD, out: str = "record", required: list[str] = ("f1", "f2")) -> DataFrame:
    """Adds the parsed record (null where no object is found) and json_text.

    Texts that are one clean object stay on the JVM; only the others go through Python, in Arrow batches.
    """

    @F.pandas_udf("string")
    def noisy(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: first_object(t, required))

    c = F.trim(F.col(response))
    clean = c.startswith("{") & c.endswith("}") & ~c.contains('"response"') & F.json_object_keys(c).isNotNull()
    df = df.withColumn("_clean", F.coalesce(clean, F.lit(False)))
    residue = df.where(~F.col("_clean")).withColumn("json_text", noisy(F.col(response)))
    both = df.where("_clean").withColumn("json_text", F.col(response)).unionByName(residue)
    return both.withColumn(out, F.when(F.col("json_text").isNotNull(), F.from_json("json_text", schema))).drop("_clean")


def missing_keys(json_text: Column, keys: list[str]) -> Column:
    """The required keys that an object lacks; all of them where there is no object."""
    have = F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>"))
    return F.filter(F.array(*map(F.lit, keys)), lambda k: ~F.array_contains(have, k))


def binary_with_violation(c: Column) -> tuple[Column, Column]:
    """0/1 of a loose value and whether it had to be repaired (counts over 1 become 1, unreadable values 0; a missing value is 0 without a repair)."""
    t = F.lower(F.trim(c.cast("string")))
    n = t.try_cast("double")
    yes, no = t.isin("true", "yes", "y", "present"), t.isin("false", "no", "n", "absent")
    value = F.when(t.isNull(), 0).when(yes, 1).when(no, 0).when(n > 0, 1).otherwise(0)
    bad = F.when(t.isNull() | yes | no, 0).when(n.isin(0.0, 1.0), 0).otherwise(1)
    return value, bad


def repaired(flags: list[str], anchors: list[str]) -> list[Column]:
    """Flags raised to 1 where their anchor says so, and the names of the raised ones, sorted and joined by ;."""
    raised = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when((F.col(a) == 1) & (F.col(f) == 0), F.lit(f)) for f, a in zip(flags, anchors, strict=True)]))), ";")
    return [F.greatest(f, a).alias(f) for f, a in zip(flags, anchors, strict=True)] + [raised.alias("raised")]


def formulas(n: Column, flags: list[str], scored: list[str]) -> list[Column]:
    """many (5 tokens or more), domain_count (flags and many), score (2 for 5 tokens, 1 more for 10, 1 for each scored flag, 5 at most)."""
    many = flag(n >= 5)
    return [many.alias("many"), (total([F.col(f) for f in flags]) + many).alias("domain_count"), F.least(F.lit(5), 2 * many + flag(n >= 10) + total([F.col(f) for f in scored])).alias("score")]


def repaired_confidence(conf: Column, n: Column, other: Column) -> list[Column]:
    """A usable confidence (0, 1]: else 0.20 without tokens, 0.60 beside other repairs, 0.75; and whether it was repaired."""
    bad = conf.isNull() | F.isnan(conf) | (conf <= 0) | (conf > 1)
    return [F.when(~bad, conf).when(n == 0, 0.20).when(other > 0, 0.60).otherwise(0.75).alias("confidence"), flag(bad).alias("confidence_repaired")]


def by_rules(text: Column, n: Column, flags: dict[str, Column], labels: dict[str, str]) -> list[Column]:
    """A record from flags alone: domain count, confidence 0.20 without text, 0.80 with a flag, else 0.65, review flag and a sentence."""
    some = total(list(flags.values())) + flag(n >= 5)
    told = F.array_join(F.array_compact(F.array(*[F.when(flags[k] == 1, F.lit(v)) for k, v in labels.items()], F.when(n >= 5, F.lit("many tokens")))), ", ")
    summary = F.when(text == "", F.lit("no text")).otherwise(F.concat(F.lit("suggests "), F.when(told == "", F.lit("nothing in particular")).otherwise(told)))
    return [*[c.alias(k) for k, c in flags.items()], some.alias("domain_count"), F.when(text == "", 0.20).when(some > 0, 0.80).otherwise(0.65).alias("confidence"), flag(text == "").alias("review"), summary.alias("summary")]


def _answers(ask: Callable, texts: list[str], retries: int) -> list:
    """One answer per text, None where there is none: a batch that fails or comes back short is halved, so that one bad text costs no other its answer."""
    for _ in range(retries + 1):
        try:
            got = list(ask(texts))
        except Exception:  # noqa: BLE001  whatever the client raises, the rows must not be lost
            continue
        if len(got) == len(texts):
            return got
    if len(texts) < 2:
        return [None] * len(texts)
    half = len(texts) // 2
    return _answers(ask, texts[:half], 0) + _answers(ask, texts[half:], 0)


def call_in_batches(pending: DataFrame, token: str, client: Callable[[], Callable[[list[str]], list[dict | None]]], parts: int, retries: int = 2) -> DataFrame:
    """Answers of an injected client for each pending text: `parts` tasks bound the concurrency, failed batches are tried again and then halved, texts without an answer come back with status `fallback`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for pdf in batches:
            texts = pdf[token].tolist()
            answers = _answers(ask, texts, retries)
            responses = [None if a is None else json.dumps(a, sort_keys=True) for a in answers]
            yield pd.DataFrame({token: texts, "response": responses, "status": ["fallback" if a is None else "called" for a in answers]})

    return pending.select(token).repartition(parts, token).mapInPandas(run, f"{token} string, response string, status string")


def answered(spark: SparkSession, folder: str, token: str) -> DataFrame:
    """(token, response, status) of the answers committed in a folder, one row per text: an answer before a fallback."""
    schema = f"{token} string, response string, status string"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).groupBy(token).agg(F.min_by(F.struct("response", "status"), F.struct(F.col("status") != "called", "response")).alias("_x")).select(token, "_x.*")


def call_committed(pending: DataFrame, token: str, client: Callable[[], Callable[[list[str]], list[dict | None]]], folder: str, parts: int = 4, flight: int = 4, batch: int = 8, rounds: int = 8, retries: int = 2) -> DataFrame:
    """The answers to the pending texts, kept in `folder` as they come, so that a job that dies asks only for what is still pending.

    Texts without a committed answer are dealt into waves of `parts` tasks of up to `batch` * `flight` * `rounds` texts. A task keeps at most `flight` calls of `batch` texts in flight, each thread with a
    client of its own, and its answers are committed to the folder when it ends, also where its job fails later. Answers are keyed by text: what two attempts wrote twice counts once. Texts that got no answer come back as
    `fallback` and are asked again by the next run only. Null texts are left out.
    """
    spark = pending.sparkSession
    schema = f"{token} string, response string, status string"
    done = answered(spark, folder, token).where("status = 'called'")
    todo = written(pending.select(token).where(F.col(token).isNotNull()).distinct().join(done, token, "left_anti").withColumn("_at", F.xxhash64(token)))
    size = parts * batch * flight * rounds
    waves = -(-todo.count() // size)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = threading.local()

        def one(texts: list[str]) -> list:
            if not hasattr(own, "ask"):
                own.ask = client()
            return _answers(own.ask, texts, retries)

        with ThreadPoolExecutor(flight) as pool:
            for pdf in batches:
                texts = pdf[token].tolist()
                answers = [a for some in pool.map(one, [texts[i : i + batch] for i in range(0, len(texts), batch)]) for a in some]
                yield pd.DataFrame({token: texts, "response": [None if a is None else json.dumps(a, sort_keys=True) for a in answers], "status": ["fallback" if a is None else "called" for a in answers]})

    for wave in range(waves):
        some = todo.where(F.pmod("_at", F.lit(waves)) == wave).select(token)
        # a task's files move to the folder when the task commits, and stay there if the job fails
        some.repartition(parts, token).mapInPandas(ask, schema).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
    return pending.select(token).join(answered(spark, folder, token), token, "left")


def source_class(provider: Column) -> Column:
    return F.when(provider == "model", "true_source").when(provider.isin("rules", "mock"), "local").otherwise("other")


def fallback_status(text: Column, provider: Column, selected: Column, reachable: Column) -> Column:
    """Why a record is local: empty, mock, not selected, unavailable; null where it is not."""
    return F.when(F.trim(text) == "", "empty_text").when(provider == "mock", "mock_source").when(~selected, "not_selected").when(~reachable, "source_unavailable")


def certified(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds reasons (joined by ;), structural_pass, certified and status: a record is certified where no reason stands against it.

    Needs provider, parsed, error, confidence_repaired, repaired, raised, confidence, review and summary.
    """
    conf = F.coalesce("confidence", F.lit(0.0))
    why = [(F.col("provider") != "model", "not_true_source"), (F.col("parsed") != 1, "not_parsed"), (F.trim(F.coalesce("error", F.lit(""))) != "", "error_present"), (F.col("confidence_repaired") > 0, "confidence_repaired"), (conf < least, "low_confidence"), (F.col("review") != 0, "review_required"), ((F.col("provider") == "model") & (F.trim(F.coalesce("summary", F.lit(""))) == ""), "summary_empty")]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in why]))
    df = df.withColumn("reasons", F.array_join(reasons, ";")).withColumn("structural_pass", flag(F.size(reasons) == 0)).withColumn("certified", F.col("structural_pass"))
    status = F.when(F.col("certified") == 0, "not_certified").when(F.col("raised") != "", "certified_after_anchor_repair").when(F.col("repaired") > 0, "certified_after_repair").otherwise("certified")
    return df.withColumn("status", status)


def certification_summary(df: DataFrame, top: int = 20) -> DataFrame:
    """Counts and shares of certified records and the most frequent reasons (reason:count, joined by ;)."""
    reasons = df.where("reasons <> ''").select(F.explode(F.split("reasons", ";")).alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "r").limit(top)
    told = reasons.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "r"))), lambda x: F.concat(x["r"], F.lit(":"), -x["o"])), ";").alias("top_reasons"))
    one = df.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("certified"), F.lit(0)).cast("long").alias("certified"), F.round(F.coalesce(F.avg("certified") * 100, F.lit(0.0)), 6).alias("pct_certified"), F.count_if(F.col("status") == "certified_after_repair").alias("after_repair"))
    return one.join(told, how="cross")  # one row by one row


def rolled_up(profiles: DataFrame, key: str, tokens: str, records: DataFrame, flags: list[str] = FLAGS, most_sent: int = 100_000, salts: int = 16) -> DataFrame:
    """One record per distinct profile from its tokens' records: largest flags and review, smallest confidence, summed attempts and time, provider all/mixed/none.

    Up to `most_sent` records (rows of a fixed width) are sent to every task; more meet the profiles by salted keys. The profiles are written once, as they are read twice.
    """
    profiles = written(profiles.withColumn("_profile", F.sha2(F.array_join(tokens, "|"), 256)))
    distinct = profiles.select("_profile", tokens).distinct()
    long = distinct.select("_profile", F.explode(tokens).alias("token")).withColumn("token_key", F.sha2("token", 256)).drop("token")
    keyed = records.withColumn("token_key", F.sha2("token", 256)).drop("token")
    if keyed.limit(most_sent + 1).count() <= most_sent:
        joined = long.join(F.broadcast(keyed), "token_key")
    else:
        # a token of most profiles is one hot key: its record goes to several places, profiles are dealt among them
        spread = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = long.withColumn("_salt", F.pmod(F.hash("_profile"), F.lit(salts)).cast("int")).join(spread, ["token_key", "_salt"]).drop("_salt")
    n, true = F.count(F.lit(1)), F.count_if(F.col("provider") == "model")
    rolled = joined.groupBy("_profile").agg(*[F.max(f).alias(f) for f in flags], F.max("review").alias("review"), F.min(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))).alias("confidence"), F.sum("attempts").alias("attempts"), F.sum("elapsed").alias("elapsed"), F.when(true == n, "all").when(true > 0, "mixed").otherwise("none").alias("provider_mix"), n.alias("n_known"))
    return profiles.join(rolled, "_profile", "left").drop("_profile")


def attached(rolled: DataFrame, flags: list[str] = FLAGS) -> DataFrame:
    """Numbers of rows without a record become 0, their provider `none`."""
    return rolled.fillna(0, [*flags, "review", "confidence", "attempts", "elapsed", "n_known"]).fillna("none", ["provider_mix"])


def mapping_audit(raw: DataFrame, mapped: DataFrame, key: str, index: str) -> DataFrame:
    """One row: keys in both, only in one, index positions whose keys differ, and whether all agree."""
    a, b = raw.select(F.col(key).alias("ka")).distinct(), mapped.select(F.col(key).alias("kb")).distinct()
    sets = a.join(b, F.col("ka") == F.col("kb"), "full_outer").agg(F.count_if(F.col("ka").isNotNull() & F.col("kb").isNotNull()).alias("both"), F.count_if(F.col("kb").isNull()).alias("only_raw"), F.count_if(F.col("ka").isNull()).alias("only_mapped"))
    moved = raw.select(index, F.col(key).alias("k1")).join(mapped.select(index, F.col(key).alias("k2")), index).agg(F.count_if(F.col("k1") != F.col("k2")).alias("moved"))
    return sets.join(moved, how="cross").withColumn("ok", (F.col("only_raw") == 0) & (F.col("only_mapped") == 0) & (F.col("moved") == 0))


def agreement(one: DataFrame, two: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Of rows in both sources: share of equal flags and number of unequal ones."""
    a, b = one.select(key, F.array(*flags).alias("a")), two.select(key, F.array(*flags).alias("b"))
    diff = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x != y), lambda z: z))
    return a.join(b, key).select(key, diff.alias("disagreements"), (1 - diff / len(flags)).alias("agreement"))


def progress(rows: DataFrame, key: str, tokens: str, done: DataFrame) -> DataFrame:
    """One row: distinct tokens, those done, per cent, and rows with at least one done token.

    The rows are written once: tokens and keys are counted apart, so that no row is repeated for each distinct count.
    """
    long = written(rows.select(key, tokens)).select(key, F.explode(tokens).alias("token"))
    done = done.select("token").distinct().withColumn("_d", F.lit(1))
    counts = long.select("token").distinct().join(done, "token", "left").agg(F.count("token").alias("total"), F.count("_d").alias("done"))
    touched = long.join(done, "token").agg(F.count_distinct(key).alias("rows_touched"))
    return counts.join(touched, how="cross").select("total", "done", F.round(F.coalesce(F.try_divide(F.col("done") * 100.0, F.col("total")), F.lit(0.0)), 6).alias("pct"), "rows_touched")  # one row by one row
