"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte n-grams; each language has several
centroids, clustered by cosine; a text takes the language of the nearest one. A text is
rejected where its cosine is far below what the language's own training texts have.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import flat_bytes, held_out, query, table, text_chunks

_ORDERS = (1, 2, 3)
_BITS = 12
#: Texts shorter than this many bytes have smaller cosines for want of n-grams; the accepted cosine shrinks with them.
FULL_BYTES = 400
_DIMS = len(_ORDERS) << _BITS
_ROWS = 256  # texts whose vectors are held at once
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[0x20, *range(0x09, 0x0E), *range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
#: The second byte of upper-case letters U+00C0 to U+00DE in UTF-8, which their lower-case forms exceed by 32.
_UPPER_TAIL = (0x80, 0x9E)


@dataclass(frozen=True)
class Centroids:
    """A fitted model: one row of `weights` per centroid, with IDF already multiplied in; `floor` is the least cosine accepted per language."""

    languages: list[str]
    owner: np.ndarray
    idf: np.ndarray
    units: np.ndarray
    floor: np.ndarray

    def predict(self, texts: pa.Array, letters: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each text (null: empty); `letters`: whether it has any."""
        data, offsets = flat_bytes(texts)
        letters = letters.to_numpy(zero_copy_only=False)
        if len(self.languages):
            cos = _vectors(_counts(data, offsets), self.idf) @ self.units.T
            at = np.argmax(cos, axis=1)
            score = np.clip(cos[np.arange(len(at)), at].astype(np.float64), 0, 1)
            owner = self.owner[at]
            names = np.array(self.languages, object)[owner]
            far = score < self.floor[owner] * np.sqrt(np.minimum(1, np.diff(offsets) / FULL_BYTES))
        else:
            n = len(offsets) - 1
            score, names, far = np.zeros(n), np.full(n, "und", object), np.ones(n, bool)
        return np.where(letters, names, "und"), np.where(letters, score, 0.0), far | ~letters


def _counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Of each row, hashed counts of letter n-grams; digits, punctuation and runs of white space count as one space."""
    data = _FOLD[data]
    tail = np.flatnonzero(data == 0xC3) + 1
    tail = tail[tail < len(data)]
    up = tail[(data[tail] >= _UPPER_TAIL[0]) & (data[tail] <= _UPPER_TAIL[1])]
    data[up] += 32
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    d = data[keep].astype(np.uint32)
    grams = [d & np.uint32((1 << _BITS) - 1)]
    pair = d[:-1] * np.uint32(257) + d[1:] if len(d) > 1 else d[:0]
    three = pair[:-1] * np.uint32(263) + d[2:] if len(d) > 2 else d[:0]
    for g in (pair, three):
        grams.append((g * np.uint32(2654435761)) >> np.uint32(32 - _BITS))
    flat = [g.astype(np.int64) + (k << _BITS) for k, g in enumerate(grams)]
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        out.append(np.bincount(np.concatenate([f[a : max(a, b - k)] for k, f in enumerate(flat)]), minlength=_DIMS).astype(np.float32))
    return out


def _vectors(counts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(np.stack(counts)) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from spread starting rows, the farthest from those taken so far."""
    taken = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        taken.append(x[np.argmin(np.max(x @ np.stack(taken).T, axis=1))])
    c = np.stack(taken)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400, centroids: int = 4, slack: float = 0.5, least: int = 40, longest: int = 200_000) -> Centroids:
    """Centroids from at most `per_language` labelled rows of each language (the documented bound; rows by hash order of key and text).

    Only rows with a non-null text of at most `longest` characters and a label count; those of up to `least` characters count where a language has no
    longer ones. `slack`: the accepted cosine is this share of the lowest percentile of a language's own training texts. Without any
    labelled row the model knows no language.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) <= longest))
    rows = rows.select(F.col(lang).alias("_l"), F.col(text).alias("_t"), F.xxhash64(F.col(key), F.col(text)).alias("_o"), (F.length(text) > least).alias("_long"))
    names = sorted((r["_l"], r["n"], r["k"]) for r in rows.groupBy("_l").agg(F.count(F.lit(1)).alias("n"), F.count_if("_long").alias("k")).collect())
    if not names:
        return Centroids([], np.zeros(0, int), np.ones(_DIMS, np.float32), np.zeros((0, _DIMS), np.float32), np.zeros(0))
    # a hash threshold thins each language to about twice the bound before the exact cut; one scan serves all languages
    at = F.pmod("_o", F.lit(1_000_000))
    thin = reduce(lambda x, y: x | y, [(F.col("_l") == name) & (F.col("_long") | F.lit(not k)) & (at < int(min(1.0, 2.0 * per_language / (k or n)) * 1_000_000) + 1) for name, n, k in names])
    number = F.row_number().over(Window.partitionBy("_l").orderBy("_o", "_t"))
    got = rows.where(thin).withColumn("_n", number).where(F.col("_n") <= per_language).select("_l", "_t", "_o").toPandas().sort_values(["_l", "_o", "_t"])
    data, offsets = flat_bytes(pa.array(got["_t"].tolist(), pa.string()))
    counts = _counts(data, offsets)
    df = sum((c > 0).astype(np.float64) for c in counts)
    idf = np.sqrt(np.log((1 + len(counts)) / (1 + df)) + 0.05).astype(np.float32)  # the square root: as for the counts
    x, label = _vectors(counts, idf), got["_l"].to_numpy()
    units, owner, floor = [], [], []
    for i, (name, _, _) in enumerate(names):
        mine = x[label == name]
        c = _clusters(mine, centroids)
        units.append(c)
        owner += [i] * len(c)
        floor.append(slack * np.quantile((mine @ c.T).max(1), 0.01))
    return Centroids([name for name, _, _ in names], np.array(owner), idf, np.concatenate(units), np.array(floor))


def identify(docs: DataFrame, model: Centroids, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns (key, lang_pred, score, rejected) of every row.

    score is the cosine with the nearest centroid, 0 to 1. A null text or one without a letter gives `und`, score 0
    and is rejected; so are short cosines. Empty tables give no rows; other columns are ignored.
    """

    def predict(batches):
        for batch in text_chunks(batches, "t", 1 << 20, _ROWS):
            names, score, rejected = model.predict(batch.column("t"), batch.column("letters"))
            yield pa.RecordBatch.from_pydict({"k": batch.column("k"), "lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(score), "rejected": pa.array(rejected)})

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("letters", F.col("t").rlike(r"\p{L}"))
    out = rows.mapInArrow(predict, f"k {dict(docs.dtypes)[key]}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("k", key)


def accepted(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """The rows that identify() doesn't reject, with all their columns; each row by itself, so keys don't matter and nothing is shuffled."""
    at = docs.columns.index(text)

    def keep(batches):
        for batch in text_chunks(batches, at, 1 << 20, _ROWS):
            _, _, rejected = model.predict(batch.column(at), batch.column(batch.num_columns - 1))
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(~rejected))

    marked = docs.select("*", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_has_letters"))
    return marked.mapInArrow(keep, docs.schema)


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, fit(docs.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def accuracy(predicted: pd.DataFrame, truth: pd.Series) -> float:
    """Share of the rows whose predicted language is the true one."""
    return float((predicted["lang_pred"].to_numpy() == truth.to_numpy()).mean())
