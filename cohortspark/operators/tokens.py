"""Wide text columns as token arrays: cleaning, dictionaries, aliases, categories and nearest vocabulary terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.values import flag
from cohortspark.sources.tables import written

# Texts that name no token, as they read once punctuation is gone.
PLACEHOLDERS = ["", "nan", "none", "unknown", "unk", "not reported", "not recorded", "not available", "missing", "n a", "na", "null", "no", "no meds", "no med", "no medication", "no medications", "not applicable", "not app",
                "not codable", "not codeable", "non codable", "non codeable", "uncodable", "not coded", "not entered", "not specified", "not otherwise specified"]
_ALIAS_ROWS = 1000  #: larger alias tables are joined instead of becoming a map literal


#: what is left of a text that names no token: a placeholder's words between any punctuation, or punctuation alone
_NOTHING = r"^[^a-z0-9]*+(?:(?:" + "|".join(p.replace(" ", "[^a-z0-9]++") for p in PLACEHOLDERS if p) + r")[^a-z0-9]*+)?\z"


def _plain(c: Column) -> Column:
    """Lower case, without wrapping asterisks, quotes and back-ticks, white space collapsed; only stretches that differ from one space are replaced."""
    return F.trim(F.regexp_replace(F.btrim(F.trim(F.lower(c)), F.lit("*\"'` ")), r"[^\S ]\s*+| \s++", " "))


def clean_token(c: Column) -> Column:
    """Lower case, without wrapping asterisks, quotes and back-ticks, white space collapsed; empty for placeholders and null."""
    t = _plain(F.coalesce(c, F.lit("")))
    return F.when(t.rlike(_NOTHING), F.lit("")).otherwise(t)


def tokens_of(c: Column) -> Column:
    """The distinct clean tokens of a text with | between them, in their order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), _plain), lambda t: ~t.rlike(_NOTHING)))


def tokens_of_columns(columns: list[str]) -> Column:
    """Distinct tokens over all columns in their order; an empty array without columns. The columns are read as one text, so that parts are cleaned in one step."""
    if not columns:
        return F.array().cast("array<string>")
    return tokens_of(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def dictionary(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each token with the number of rows that have it, its source columns, its rank (by frequency, then token) and sha256 key.

    The dictionary is written once, as its ranks take it several times; no window runs over all tokens.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("source"), tokens_of(F.col(c)).alias("tokens")) for c in columns])
    long = df.select(F.col(key).alias("_row"), F.explode(cells).alias("x")).select("_row", "x.source", F.explode("x.tokens").alias("token"))
    per = long.groupBy("token", "_row").agg(F.collect_set("source").alias("s"))
    out = per.groupBy("token").agg(F.count(F.lit(1)).alias("row_frequency"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))), ";").alias("source_columns"))
    out = numbered(written(out), "token", "row_frequency")
    return out.select("token", "row_frequency", "source_columns", "rank", F.sha2("token", 256).alias("token_key"))


def numbered(counts: DataFrame, text: str, n: str, ranges: int = 64) -> DataFrame:
    """Adds the rank of each distinct text by descending frequency, ties by text.

    Windows run over the distinct frequencies and inside counted ranges of the texts of one frequency.
    """
    cuts = _ranges(counts, text, ranges)
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(text))) if cuts else F.lit(0)
    counts = counts.withColumn("_range", at)
    cells = counts.groupBy(n, "_range").agg(F.count(F.lit(1)).alias("_k"))
    freq = cells.groupBy(n).agg(F.sum("_k").alias("_f"))
    freq = freq.select(n, (F.sum("_f").over(Window.orderBy(F.desc(n))) - F.col("_f")).alias("_ahead"))
    before = F.sum("_k").over(Window.partitionBy(n).orderBy("_range")) - F.col("_k")
    starts = cells.select(n, "_range", before.alias("_inside")).join(freq, n)
    row = F.row_number().over(Window.partitionBy(n, "_range").orderBy(text))
    both = counts.join(starts, [n, "_range"]).withColumn("rank", (F.col("_ahead") + F.col("_inside") + row).cast("int"))
    return both.drop("_range", "_ahead", "_inside")


def aliases(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(alias, canonical) of both, cleaned; overrides win."""
    both = defaults.select("alias", "canonical", F.lit(0).alias("p")).unionByName(overrides.select("alias", "canonical", F.lit(1).alias("p")))
    both = both.select(clean_token(F.col("alias")).alias("alias"), clean_token(F.col("canonical")).alias("canonical"), "p").where("alias <> ''")
    return both.groupBy("alias").agg(F.max_by("canonical", F.struct("p", "canonical")).alias("canonical"))


def alias_map(table: DataFrame) -> Column | None:
    """A map literal of a small alias table, None where it has over _ALIAS_ROWS rows."""
    rows = table.select("alias", "canonical").limit(_ALIAS_ROWS + 1).collect()
    if len(rows) > _ALIAS_ROWS:
        return None
    return F.create_map(*[F.lit(x) for r in rows for x in (r["alias"], r["canonical"])]) if rows else F.create_map().cast("map<string,string>")


def canonical_tokens(df: DataFrame, tokens: str, table: DataFrame, out: str = "canonical") -> DataFrame:
    """Adds the tokens under their canonical names, distinct and sorted; a null array stays null, repeated rows stay as they are.

    A small alias table becomes a map literal; a larger one is joined to the distinct token arrays, which then join back. Both give the same rows.
    """
    names = alias_map(table)
    if names is not None:
        return df.withColumn(out, F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.coalesce(names[t], t)))))
    every = df.select(F.col(tokens).alias("_t")).where("_t is not null").distinct()
    long = every.select("_t", F.explode_outer("_t").alias("alias")).join(table.select("alias", "canonical"), "alias", "left")
    got = long.groupBy("_t").agg(F.array_sort(F.collect_set(F.coalesce("canonical", "alias"))).alias(out))
    return df.join(got, df[tokens] == got["_t"], "left").drop("_t")


def _any_of(terms: list[str]) -> str:
    return "(?i)" + "|".join(terms)


def category_flags(tokens: str, patterns: dict[str, list[str]]) -> list[Column]:
    """One 0/1 column per category: any token matches any of its patterns."""
    def hit(p):
        return flag(F.exists(tokens, lambda t: t.rlike(_any_of(p))))

    return [hit(p).alias(k) for k, p in patterns.items()]


def category_counts(tokens: str, patterns: dict[str, list[str]], groups: dict[str, list[str]]) -> list[Column]:
    """One column per group of categories: distinct tokens that match any of them, so never more than there are tokens."""
    def n(names):
        regex = _any_of([p for c in names for p in patterns[c]])
        return F.size(F.filter(F.array_distinct(tokens), lambda t: t.rlike(regex)))

    return [n(names).alias(g) for g, names in groups.items()]


def keyword_flags(text: Column, lists: dict[str, list[str]], unions: dict[str, list[str]]) -> list[Column]:
    """0/1 for keyword lists as substrings of a text, then for unions of lists."""
    has = {k: reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in words]) for k, words in lists.items()}
    return [flag(c).alias(k) for k, c in has.items()] + [flag(reduce(lambda a, b: a | b, [has[x] for x in xs])).alias(k) for k, xs in unions.items()]


def vocabulary(table: DataFrame, patterns: dict[str, list[str]], extra: DataFrame) -> DataFrame:
    """Distinct clean terms of aliases, category patterns and another column `term`."""
    spark = table.sparkSession
    terms = spark.createDataFrame([(p,) for ps in patterns.values() for p in ps], "term string")
    both = table.select(F.col("alias").alias("term")).unionAll(table.select("canonical")).unionAll(terms).unionAll(extra.select("term"))
    return both.select(clean_token(F.col("term")).alias("term")).where("term <> ''").distinct()


def nearest(tokens: DataFrame, vocab: DataFrame, least: float = 0.86) -> DataFrame:
    """Each distinct token with the most similar vocabulary term (1 - Levenshtein distance / longer length), kept as it is below `least`.

    Terms and tokens meet by length only where the lengths allow the similarity, so no pair is compared that can't reach it.
    """
    size = F.length("token")
    reach = tokens.select("token").distinct().withColumn("len", F.explode(F.sequence(F.ceil(size * least).cast("int"), F.floor(size / least).cast("int"))))
    near = reach.join(vocab.withColumn("len", F.length("term")), "len")
    score = 1 - F.levenshtein("token", "term") / F.greatest(F.length("token"), F.length("term"))
    best = near.withColumn("score", score).where(F.col("score") >= least).groupBy("token").agg(F.min(F.struct((-F.col("score")).alias("s"), "term")).alias("x"))
    out = tokens.select("token").distinct().join(best, "token", "left")
    return out.select("token", F.coalesce("x.term", "token").alias("match"), F.round(-F.col("x.s"), 9).alias("score"), F.when(F.col("x.s") == -1.0, "exact").when(F.col("x.s").isNotNull(), "nearest").otherwise("kept_original").alias("status"))


def vote(one: DataFrame, two: DataFrame) -> DataFrame:
    """The better of two matches of each token: agreement, then an exact one, then the higher score; the token itself where both kept it."""
    a, b = one.alias("a"), two.alias("b")
    both = a.join(b, "token")
    sa, sb = F.coalesce("a.score", F.lit(-1.0)), F.coalesce("b.score", F.lit(-1.0))
    exact = (F.col("a.status") == "exact") != (F.col("b.status") == "exact")
    status = F.when((F.col("a.status") == "kept_original") & (F.col("b.status") == "kept_original"), "kept_original").when(F.col("a.match") == F.col("b.match"), "agree").when(exact, "exact_wins").otherwise("best_score")
    first = F.when(exact, F.col("a.status") == "exact").otherwise(sa >= sb)
    return both.select("token", status.alias("status"), F.when(first, F.col("a.match")).otherwise(F.col("b.match")).alias("match"), F.when(status == "kept_original", F.lit(None)).otherwise(F.greatest(sa, sb)).alias("score"))


def _grouped(texts: DataFrame, text: str, value: Column) -> DataFrame:
    """A value of each distinct non-empty text. Empty ones leave after the grouping: a filter below it would compute a text that is an expression once more."""
    return texts.groupBy(text).agg(value, F.max(F.length(text)).alias("_size")).where("_size > 0").drop("_size")


def most_frequent(texts: DataFrame, text: str, n: int) -> DataFrame:
    """The n most frequent non-empty texts, ties by text."""
    return _grouped(texts, text, F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), text).limit(n)


def first_seen(texts: DataFrame, text: str, order: str, n: int) -> DataFrame:
    """The n non-empty texts seen first."""
    return _grouped(texts, text, F.min(order).alias("first")).orderBy("first", text).limit(n)


def _ranges(texts: DataFrame, text: str, ranges: int) -> list[str]:
    """Texts that cut distinct texts into about equal ranges, from the same sample each time: that of the smallest hashes."""
    some = texts.where(F.col(text) != "").select(F.col(text).alias("t")).orderBy(F.xxhash64("t"), "t").limit(ranges * 20).collect()
    some = sorted(r["t"] for r in some)
    return some[20::20]


def by_coverage(texts: DataFrame, text: str, share: float, most: int | None = None, ranges: int = 64) -> DataFrame:
    """Texts by descending frequency, ties by text, until they cover the share of all non-empty rows; `most` of them at most, if given.

    No window runs over all texts: frequencies are added up over the distinct ones, and the texts of one frequency are ranked
    inside counted ranges of the text. The counts are written once, as they are read three times.
    """
    counts = written(_grouped(texts, text, F.count(F.lit(1)).alias("n")))
    cuts = _ranges(counts, text, ranges)
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(text))) if cuts else F.lit(0)
    counts = counts.withColumn("_range", at)
    cells = counts.groupBy("n", "_range").agg(F.count(F.lit(1)).alias("k"))
    down = Window.orderBy(F.desc("n"))
    freq = cells.groupBy("n").agg(F.sum("k").alias("k"))
    freq = freq.select("n", (F.sum("k").over(down) - F.col("k")).alias("_ahead"), (F.sum(F.col("n") * F.col("k")).over(down) - F.col("n") * F.col("k")).alias("_rows"), F.sum(F.col("n") * F.col("k")).over(Window.partitionBy()).alias("_total"))
    before = F.sum("k").over(Window.partitionBy("n").orderBy("_range")) - F.col("k")
    taken = lambda inside: F.col("_rows") + inside * F.col("n") < F.col("_total") * share
    starts = cells.select("n", "_range", before.alias("_inside")).join(freq, "n").where(taken(F.col("_inside")))
    inside = F.col("_inside") + F.row_number().over(Window.partitionBy("n", "_range").orderBy(text)) - 1
    ranked = counts.join(starts, ["n", "_range"]).withColumn("_at", inside)
    ranked = ranked.where(taken(F.col("_at"))).select(text, "n", (F.col("_ahead") + F.col("_at") + 1).alias("rank"))
    return ranked if most is None else ranked.where(F.col("rank") <= most)
