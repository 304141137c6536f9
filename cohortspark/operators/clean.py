"""Coded missing values, required rows, profiles and guards; every profile is one aggregate of its table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.values import flag, is_blank, recode_binary, to_number, without_codes


class ConstraintError(ValueError):
    """A table breaks its constraints; the message lists how."""


def stacked(one_row: DataFrame, keys: list[str], fields: list[str], key: str = "column_name") -> DataFrame:
    """A one-row table with columns <key>__<field> turned into a row for each key."""
    rows = F.array(*[F.struct(F.lit(k).alias(key), *[F.col(f"{k}__{f}").alias(f) for f in fields]) for k in keys])
    return one_row.select(F.inline(rows))


def required_rows(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows where no required column is blank."""
    return df.where(reduce(lambda a, b: a & b, [~is_blank(F.col(c)) for c in required]))


def required_audit(df: DataFrame, required: list[str]) -> DataFrame:
    """Blank cells of each required column, and rows with any."""
    any_blank = reduce(lambda a, b: a | b, [is_blank(F.col(c)) for c in required])
    names = [*required, "ANY_REQUIRED_COLUMN"]
    one = df.agg(*[F.count_if(is_blank(F.col(c))).alias(f"{c}__n_blank") for c in required], F.count_if(any_blank).alias("ANY_REQUIRED_COLUMN__n_blank"))
    return stacked(one, names, ["n_blank"])


def blank_columns(df: DataFrame) -> list[str]:
    """Names of the columns that are blank in every row (of an empty table: all)."""
    row = df.agg(*[F.coalesce(F.bool_or(~is_blank(F.col(c))), F.lit(False)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if not row[c]]


def drop_blank_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    gone = blank_columns(df)
    return df.select(*[c for c in df.columns if c not in gone]), gone


def column_audit(df: DataFrame, selected: list[str]) -> DataFrame:
    """For each column of the source: its status (kept, all_blank, unselected), type and longest text."""
    one = df.agg(*[x for c in df.columns for x in (F.max(F.length(F.col(c).cast("string"))).alias(f"{c}__max_length"), F.coalesce(F.bool_or(~is_blank(F.col(c))), F.lit(False)).alias(f"{c}__any"))])
    out = stacked(one, df.columns, ["max_length", "any"])
    kinds = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    status = F.when(~F.col("column_name").isin(selected), "unselected").when(~F.col("any"), "all_blank").otherwise("kept")
    return out.select("column_name", status.alias("status"), kinds[F.col("column_name")].alias("dtype"), F.coalesce("max_length", F.lit(0)).alias("max_length"))


def input_profile(df: DataFrame, required: list[str], entity: str) -> DataFrame:
    """Loaded, removed and retained rows and the entities retained."""
    bad = reduce(lambda a, b: a | b, [is_blank(F.col(c)) for c in required])
    return df.agg(F.count(F.lit(1)).alias("loaded"), F.count_if(bad).alias("removed"), F.count_if(~bad).alias("retained"), F.count_distinct(F.when(~bad, F.col(entity))).alias("entities"), F.lit(len(df.columns)).cast("long").alias("n_columns"))


def replace_codes(df: DataFrame, codes: list[float], columns: list[str], keep: dict[str, list[float]] | None = None, by_column: dict[str, list[float]] | None = None) -> DataFrame:
    """Numeric or textual codes become null in the given columns; by_column adds codes, keep protects values. One projection, whatever the number of columns."""
    keep, by_column = keep or {}, by_column or {}
    return df.select(*[without_codes(F.col(c), [*codes, *by_column.get(c, [])], keep.get(c, [])).alias(c) if c in columns else F.col(c) for c in df.columns])


# What labels of missing values say.
MISSING_TERMS = ["missing", "unknown", "not available", "not assessed", "not asked", "not applicable", "not app", "not collected", "did not collect", "not done", "not performed", "refused", "don't know", "dont know",
                 "unable to determine", "no information", "blank", "not reported", "not recorded", "not obtained", "not administered", "form version", "skipped"]


def split_codes(cell: Column) -> Column:
    """The codes of a cell as (number, text): parts lie between , ; and |, and a part gives its numbers, or itself where it has none.

    A number is a word of digits with a decimal point or a sign at most; words end at other signs, and at a minus that follows a letter or a digit, as in a range.
    """
    def of(part: Column) -> Column:
        words = F.split(F.regexp_replace(part, r"(?<=[0-9A-Za-z])-", " "), r"[^0-9A-Za-z.-]+")
        numbers = F.filter(words, lambda w: w.rlike(r"^-?[0-9.]*[0-9]$") & to_number(w).isNotNull())
        whole = F.array(F.struct(F.lit(None).cast("double").alias("number"), part.alias("text")))
        return F.when(F.size(numbers) > 0, F.transform(numbers, lambda w: F.struct(to_number(w).alias("number"), F.lit(None).cast("string").alias("text")))).otherwise(whole)

    cell = F.when(~F.lower(F.trim(cell)).isin("nan", "none", "null"), F.trim(cell))
    parts = F.filter(F.transform(F.split(cell, r"[,;|]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(F.flatten(F.transform(parts, of)), F.array().cast("array<struct<number:double,text:string>>"))


def codes_from_codebook(codebook: DataFrame, terms: list[str] = MISSING_TERMS) -> DataFrame:
    """(column_name, code, text) that the codebook declares missing: the codes of its missing-code cells, and codes whose label holds one of the terms anywhere. A code that is no number stands in `text`."""
    reads = reduce(lambda a, b: a | b, [F.lower("label").contains(t) for t in terms])
    label = F.when(reads, split_codes(F.col("code"))).otherwise(F.array().cast("array<struct<number:double,text:string>>"))
    return codebook.select(F.lower(F.trim("name")).alias("column_name"), F.explode(F.concat(split_codes(F.col("missing_codes")), label)).alias("x")).select("column_name", F.col("x.number").alias("code"), "x.text").distinct()


def restore_preserved(clean: DataFrame, raw: DataFrame, key: str, keep: dict[str, list[float]]) -> DataFrame:
    """Where the raw value is to be kept and the cleaned one is missing, the raw one comes back; rows meet by key."""
    r = raw.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_raw_{c}") for c in keep])
    both = clean.join(r, clean[key] == r["_key"], "left")

    def back(c: str) -> Column:
        raw_c = F.col(f"_raw_{c}")
        return F.when(F.col(c).isNull() & F.coalesce(to_number(raw_c).isin([float(x) for x in keep[c]]), F.lit(False)), raw_c).otherwise(F.col(c)).alias(c)

    return both.select(*[back(c) if c in keep else clean[c] for c in clean.columns])


def sentinel_audit(df: DataFrame, codes: list[float], columns: list[str]) -> DataFrame:
    """Columns that hold codes, with how many."""
    one = df.agg(*[F.count_if(F.coalesce(to_number(F.col(c)).isin([float(x) for x in codes]), F.lit(False))).alias(f"{c}__n") for c in columns])
    return stacked(one, columns, ["n"]).where("n > 0")


def violations(df: DataFrame, codes: list[float], columns: list[str], forbidden: list[str], at_most: list[tuple[str, str]]) -> DataFrame:
    """One row per rule (non_empty, forbidden_columns, sentinels, <part>_le_<total>) with its number of violations."""
    bad = reduce(lambda a, b: a + b, [flag(F.coalesce(to_number(F.col(c)).isin([float(x) for x in codes]), F.lit(False))) for c in columns])
    one = df.agg(flag(F.count(F.lit(1)) == 0).cast("long").alias("non_empty__n"), F.lit(len(set(forbidden) & set(df.columns))).cast("long").alias("forbidden_columns__n"), F.coalesce(F.sum(bad), F.lit(0)).cast("long").alias("sentinels__n"), *[F.count_if(F.col(a) > F.col(b)).alias(f"{a}_le_{b}__n") for a, b in at_most])
    return stacked(one, ["non_empty", "forbidden_columns", "sentinels", *[f"{a}_le_{b}" for a, b in at_most]], ["n"], "rule")


def guard(found: DataFrame) -> None:
    """Raises ConstraintError where a rule is violated; a handful of rows come to the driver."""
    bad = [f"{r['rule']}: {r['n']}" for r in found.where("n > 0").collect()]
    if bad:
        raise ConstraintError("; ".join(bad))


def type_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of each column: non-missing numbers, whether all are 0 or 1, whether all are whole."""
    fields = []
    for c in columns:
        n = to_number(F.col(c))
        fields += [F.count(n).alias(f"{c}__n"), F.coalesce(F.bool_and(n.isin(0.0, 1.0)), F.lit(False)).alias(f"{c}__is_binary"), F.coalesce(F.bool_and(F.abs(n - F.rint(n)) <= 1e-9), F.lit(False)).alias(f"{c}__is_integral")]
    return stacked(df.agg(*fields), columns, ["n", "is_binary", "is_integral"])


def rounded(df: DataFrame, digits: int, binary: list[str] = (), integral: list[str] = ()) -> DataFrame:
    """Binary and whole columns as nullable integers, other doubles rounded half to even."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("int").alias(c) if c in binary else F.col(c).cast("long").alias(c) if c in integral else F.bround(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def feature_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, missing share and distinct values of each column."""
    one = df.agg(*[x for c in columns for x in (F.count(F.lit(1)).alias(f"{c}__rows"), F.count_if(F.col(c).isNull()).alias(f"{c}__n_missing"), F.count_distinct(F.col(c)).alias(f"{c}__n_unique"))])
    return stacked(one, columns, ["rows", "n_missing", "n_unique"]).withColumn("pct_missing", F.round(F.coalesce(F.try_divide(F.col("n_missing") * 100.0, F.col("rows")), F.lit(0.0)), 6))


def column_domain(name: Column, prefixes: dict[str, str], members: dict[str, list[str]], default: str) -> Column:
    """The domain of a column name: prefixes (case-insensitive) first, then exact names, else the default."""
    out = None
    for p, d in prefixes.items():
        c = F.lower(name).startswith(p.lower())
        out = F.when(c, d) if out is None else out.when(c, d)
    for d, names in members.items():
        c = F.lower(name).isin([n.lower() for n in names])
        out = F.when(c, d) if out is None else out.when(c, d)
    return out.otherwise(default) if out is not None else F.lit(default)


def analysis_columns(arms: list[list[str]]) -> list[str]:
    """Distinct names of all arms in the order of their first use."""
    return list(dict.fromkeys(c for arm in arms for c in arm))


def feature_lists(df: DataFrame, prefixes: dict[str, str], skip: list[str]) -> DataFrame:
    """(family, column_name, n): the first prefix that fits, else `text` by type, else what the values are: `binary`, `integral`, `numeric`, or `empty` without any; one aggregate."""
    names = [c for c, _ in df.dtypes if c not in skip]
    texts = [c for c, kind in df.dtypes if kind == "string" and c in names]
    numbers = [c for c in names if c not in texts]
    profile = type_profile(df, numbers) if numbers else None
    count = df.agg(*[F.count(c).alias(c) for c in texts]).unpivot([], texts, "column_name", "n").select("column_name", "n", F.lit("text").alias("kind")) if texts else None
    kind = F.when(F.col("n") == 0, "empty").when(F.col("is_binary"), "binary").when(F.col("is_integral"), "integral").otherwise("numeric")
    told = profile.select("column_name", "n", kind.alias("kind")) if numbers else count
    if numbers and texts:
        told = told.unionAll(count)
    family = F.coalesce(*[F.when(F.startswith("column_name", F.lit(p)), f) for p, f in prefixes.items()], "kind") if prefixes else F.col("kind")
    return told.select(family.alias("family"), "column_name", "n")


def finalize(clean: DataFrame, raw: DataFrame, key: str, codes: list[float], columns: list[str], keep: dict[str, list[float]], binary: list[str], drop: list[str]) -> DataFrame:
    """Codes to null, kept values back, binary recoding and dropped columns in one lazy plan."""
    out = restore_preserved(replace_codes(clean, codes, columns, keep), raw, key, keep)
    return out.select(*[recode_binary(F.col(c)).alias(c) if c in binary else F.col(c) for c in out.columns if c not in drop])
