"""License scans by a positional index of rare words, with built-in functions only.

Every template is a wording with one mandatory key phrase. Corpus-wide document counts rank the words of the key phrases;
each phrase is indexed under its two rarest words and their positions in it. A file's occurrences of such words give
starts, both words' starts are intersected, and only the places that survive are compared with the whole phrase.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import query, table

# Label, wording, and the key phrase in it that must stand consecutively. The first four key phrases are the base ones.
TEMPLATES = [
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("cc-by", "licensed under cc by", "cc by"),
    ("mit", "released under the mit license", "mit license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("epl", "under the terms of the eclipse public license", "eclipse public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    ("isc-text", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("reserved", "all rights reserved", "all rights reserved"),
]
BASE = 4
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """The words in order, maybe with an empty string at either end; A-Z in lower case.

    lower() may change other letters too, but no word with such a letter equals an ASCII word; the Kelvin sign, the
    one exception, is replaced first.
    """
    return F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ÿ"))), _SEPARATORS)


def rarest(docs: DataFrame, text: str = "text", templates=TEMPLATES, most: int = 2) -> dict[str, list[tuple[str, int]]]:
    """For each key phrase, its words of the highest IDF over the whole corpus (at most `most` places) with their positions.

    One row per word of the templates comes back to the driver, whatever the corpus.
    """
    vocabulary = sorted({w for _, _, key in templates for w in key.split()})
    seen = docs.select(F.explode(F.array_intersect(_words(F.col(text)), F.array(*map(F.lit, vocabulary)))).alias("w"))
    df = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    idf = {w: -math.log1p(df.get(w, 0)) for w in vocabulary}
    return {key: sorted(enumerate_words(key), key=lambda x: (-idf[x[0]], x[1]))[:most] for _, _, key in templates}


def enumerate_words(phrase: str) -> list[tuple[str, int]]:
    return [(w, i) for i, w in enumerate(phrase.split())]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, base: int = BASE) -> DataFrame:
    """Columns (key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    A null or empty text has no words, no labels, null first and last word and score 0. score is the largest share of a template's wording
    that stands in its place around a verified key phrase. Nothing is shuffled but the words' counts.
    """
    index = rarest(docs, text, templates)
    anchors = sorted({w for places in index.values() for w, _ in places})
    rows = docs.select(F.col(key), _words(F.col(text)).alias("w"))
    lead = (F.get("w", F.lit(0)) == "").cast("int")
    tail = ((F.size("w") > 1) & (F.get("w", F.size("w") - 1) == "")).cast("int")
    literal = F.array(*map(F.lit, anchors))
    hits = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(anchors))
    none = F.array().cast("array<struct<w:string,i:int>>")
    rows = rows.select(key, "w", (F.size("w") - lead - tail).cast("long").alias("n_words"), lead.alias("lead"), F.when(F.arrays_overlap("w", literal), hits).otherwise(none).alias("hits"))

    def starting(word: str, place: int) -> Column:
        return F.transform(F.filter("hits", lambda x: x["w"] == word), lambda x: x["i"] - place)

    def places(phrase: str) -> Column:
        starts = reduce(F.array_intersect, [starting(word, place) for word, place in index[phrase]])
        words = phrase.split()
        return F.filter(starts, lambda s: (s >= 0) & (F.slice("w", F.greatest(s, F.lit(0)) + 1, len(words)) == F.array(*map(F.lit, words))))

    phrases = list(dict.fromkeys(k for _, _, k in templates))
    # one column per phrase; files without a rare word skip all of them
    some = F.size("hits") > 0
    found = F.struct(*[F.when(some, places(p)).otherwise(F.array().cast("array<int>")).alias(f"p{i}") for i, p in enumerate(phrases)])
    rows = rows.withColumn("f", found)

    def at(label: int) -> Column:
        return F.col("f")[f"p{phrases.index(templates[label][2])}"]

    def share(n: int) -> Column:
        wording, phrase = templates[n][1].split(), templates[n][2].split()
        off = next(i for i in range(len(wording)) if wording[i : i + len(phrase)] == phrase)
        one = lambda s: reduce(lambda a, b: a + b, [F.when((s - off + i >= F.col("lead")) & (F.get("w", F.greatest(s - off + i, F.lit(0))) == w), 1).otherwise(0) for i, w in enumerate(wording)]) / F.lit(len(wording))
        return F.coalesce(F.array_max(F.transform(at(n), one)), F.lit(0.0))

    def labels(ids) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(at(i)) > 0, F.lit(templates[i][0])) for i in ids])))), ",")

    every = F.concat(*[at(i) for i in range(base)])
    return rows.select(
        key, "n_words", F.size(every).cast("long").alias("n_base"), (F.array_min(every) - F.col("lead")).cast("long").alias("first_word"), (F.array_max(every) - F.col("lead")).cast("long").alias("last_word"),
        labels(range(base)).alias("base_labels"), labels(range(len(templates))).alias("labels"), F.when(some, F.greatest(*[share(i) for i in range(len(templates))])).otherwise(F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL that tries every phrase at every word of every text."""
    items = []
    for n, (label, wording, key) in enumerate(TEMPLATES):
        off = wording.split().index(key.split()[0]) if wording.split().count(key.split()[0]) == 1 else next(i for i in range(99) if wording.split()[i : i + len(key.split())] == key.split())
        items.append(f"({n}, '{label}', {str(wording.split())}, {str(key.split())}, {off}, {'true' if n < BASE else 'false'})")
    return f"""
WITH t(n, label, wording, phrase, off, base) AS (VALUES {", ".join(items)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
hit AS (SELECT doc_id, label, base, i, list_sum(list_transform(range(len(wording)), lambda k: CASE WHEN i - off + k >= 0 AND w[greatest(i - off + k, 0) + 1] = wording[k + 1] THEN 1 ELSE 0 END)) / len(wording) AS share
  FROM (SELECT * FROM c WHERE w[i + 1] IN (SELECT phrase[1] FROM t)) JOIN t ON w[i + 1] = phrase[1] AND w[i + 1 : i + len(phrase)] = phrase),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word, array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN g USING (doc_id)"""


@query("op10_license_scan", oracle())
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
