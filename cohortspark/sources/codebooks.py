"""Codebooks in CSV files with differing headers and encodings: found, resolved, united and looked up."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Headers that name a variable and that describe it, in the order of preference.
NAME_HEADERS = ["name", "variable", "variable name", "field", "column"]
TEXT_HEADERS = ["description", "label", "short descriptor", "definition"]
_NO_TEXT = ["", "nan", "none"]


def _plain(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", header.lower()).strip()


def resolve(headers: list[str], wanted: list[str]) -> str | None:
    """The header that equals a wanted one, else the first that contains one; None without any."""
    plain = {h: _plain(h) for h in headers}
    for w in wanted:
        for h in headers:
            if plain[h] == w:
                return h
    return next((h for w in wanted for h in headers if w in plain[h]), None)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per non-empty text file under a folder: path, book (the folder it lies in, or its name), size, header (bytes) and whether it is UTF-8, holds a comma, or HTML."""
    read = spark.read.option("recursiveFileLookup", True).text(folder)
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), place.alias("at"), "value")
    low = F.lower(F.make_valid_utf8("value"))
    out = lines.groupBy("path").agg(
        F.max("size").alias("size"), F.min_by(F.col("value").cast("binary"), "at").alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(low.contains(",")).alias("comma"), F.bool_or(low.rlike("<html|<!doctype")).alias("html"),
    )
    inside = F.element_at(F.split("path", "/"), -2)
    name = F.element_at(F.split("path", "/"), -1)
    return out.withColumn("book", F.when(name.startswith("part-"), inside).otherwise(name))


def valid(size: Column, comma: Column, html: Column) -> Column:
    """Over 20 bytes, with a comma, no HTML."""
    return (size > 20) & comma & ~html


def read_books(spark: SparkSession, folder: str, more: list[str] = ()) -> DataFrame:
    """(book, line, name, description) and the columns of `more` (null where a book lacks them), of all usable CSV files under a folder.

    Files are UTF-8, with or without a byte order mark, or else Latin-1. Those without a name and description header, or without content, are
    skipped. `line` is a book's own column of that name, else counted within its file. Files of one header and encoding are read together, one row per file comes to the driver.
    """
    alike: dict[tuple, list[str]] = {}
    for r in files(spark, folder).where(valid(F.col("size"), F.col("comma"), F.col("html"))).select("path", "header", "utf8").collect():
        head = next(csv.reader([bytes(r["header"]).decode("utf-8-sig" if r["utf8"] else "latin1")]), [])
        alike.setdefault((tuple(head), "UTF-8" if r["utf8"] else "ISO-8859-1"), []).append(r["path"])
    out = None
    for (head, encoding), paths in sorted(alike.items()):
        name, text = resolve(list(head), NAME_HEADERS), resolve(list(head), TEXT_HEADERS)
        if name is None or text is None:
            continue
        read = spark.read.option("header", True).option("encoding", encoding).csv(paths)
        path = F.col("_metadata.file_path")
        at = {h: F.col(f"`{c}`") for h, c in zip(head, read.columns, strict=True)}
        book = F.when(F.element_at(F.split(path, "/"), -1).startswith("part-"), F.element_at(F.split(path, "/"), -2)).otherwise(F.element_at(F.split(path, "/"), -1))
        place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        line = at["line"].cast("int") if "line" in at else F.row_number().over(Window.partitionBy(path).orderBy(place))
        rest = [(at[c] if c in at else F.lit(None).cast("string")).alias(c) for c in more]
        rows = read.select(book.alias("book"), line.alias("line"), F.trim(at[name]).alias("name"), F.trim(at[text]).alias("description"), *rest)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no usable codebook")
    return out


def unite(books: DataFrame) -> DataFrame:
    """(key, book, line, name, description): the first description of each name, ignoring case, by book and line."""
    good = books.where(~F.lower(F.coalesce("name", F.lit(""))).isin(_NO_TEXT) & ~F.lower(F.coalesce("description", F.lit(""))).isin(_NO_TEXT)).withColumn("key", F.upper("name"))
    return good.groupBy("key").agg(F.min(F.struct("book", "line", "name", "description")).alias("x")).select("key", "x.book", "x.line", "x.name", "x.description")


def look_up(columns: DataFrame, united: DataFrame, fallback: Column) -> DataFrame:
    """Each column_name with its description, book and match: exact, case_insensitive or fallback."""
    both = columns.join(united, F.upper("column_name") == F.col("key"), "left")
    match = F.when(F.col("key").isNull(), "fallback").when(F.col("column_name") == F.col("name"), "exact").otherwise("case_insensitive")
    return both.select("column_name", F.coalesce("description", fallback).alias("description"), "book", match.alias("match"))


def file_audit(spark: SparkSession, folder: str, expected: list[str]) -> DataFrame:
    """Of each expected book: exists, valid (all its files over 20 bytes, with a comma, no HTML) and status. An empty file counts as missing."""
    found = files(spark, folder).groupBy(F.col("book").alias("name")).agg(F.bool_and(valid(F.col("size"), F.col("comma"), F.col("html"))).alias("valid"))
    names = spark.createDataFrame([(e,) for e in expected], "name string")
    out = names.join(found, "name", "left")
    status = F.when(F.col("valid").isNull(), "missing").when(F.col("valid"), "ok").otherwise("invalid")
    return out.select("name", F.col("valid").isNotNull().alias("exists"), F.coalesce("valid", F.lit(False)).alias("valid"), status.alias("status"))
