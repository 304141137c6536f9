"""Vectors of texts: encoding once per distinct text, pooling, projection, fusion, audits and nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.hashing import hash32
from cohortspark.sources.tables import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def encode_distinct(df: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], size: int) -> DataFrame:
    """Adds `vector`: the injected encoder sees each distinct non-empty text once; empty texts get zeros. The rows are written once, as they are read twice."""
    df = written(df)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for pdf in batches:
            yield pd.DataFrame({text: pdf[text], "vector": encode(pdf[text].tolist())})

    got = df.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(text).distinct().mapInPandas(run, f"{text} string, vector array<double>")
    return df.join(got, text, "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), size)))


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The element-wise mean of each key's vectors."""
    long = df.select(key, F.posexplode(vector).alias("i", "x"))
    means = long.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


def projection(size: int, k: int) -> Column:
    """A k by size matrix literal of numbers from md5 (sums of uniform ones, scaled by 1 / sqrt(k)); the identity where k >= size."""
    if k >= size:
        return F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(size)]) for i in range(size)])

    def cell(i: int, j: int) -> Column:
        return (hash32(F.lit(f"{i}-{j}-a")) + hash32(F.lit(f"{i}-{j}-b")) + hash32(F.lit(f"{i}-{j}-c"))) / 4294967296.0 - 1.5

    return F.array(*[F.array(*[cell(i, j) * 2.0 / F.sqrt(F.lit(float(k))) for j in range(size)]) for i in range(k)])


def project(vector: Column, matrix: Column) -> Column:
    return F.transform(matrix, lambda row: dot(vector, row))


def fused(a: Column, b: Column) -> Column:
    """The mean of two vectors over their common length; a missing element counts as 0."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (F.coalesce(x.cast("double"), F.lit(0.0)) + F.coalesce(y.cast("double"), F.lit(0.0))) / 2)


def fingerprint(df: DataFrame, text: str, parameters: str, buckets: int = 4096) -> DataFrame:
    """sha256 over the sorted hashes of a column, by way of one hash per bucket, so no task holds all hashes; with the number of rows and the parameters."""
    rows = df.select(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    part = rows.groupBy(F.conv(F.substring("h", 1, 3), 16, 10).cast("int").alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "h", "c"))), ","), 256).alias("h"), F.sum("c").alias("c"))
    whole = part.agg(F.sum("c").alias("rows"), F.sha2(F.concat(F.lit(parameters + "|"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ",")), 256).alias("fingerprint"))
    return whole.select(F.coalesce("rows", F.lit(0)).alias("rows"), "fingerprint")


def audit(df: DataFrame, vector: str) -> DataFrame:
    """One row: vectors, distinct and zero ones, shortest and longest."""
    v = F.col(vector)
    return df.agg(F.count(v).alias("vectors"), F.count_distinct(v).alias("distinct_vectors"), F.count_if(~F.exists(v, lambda x: x != 0)).alias("zero_vectors"), F.min(F.size(v)).alias("least_size"), F.max(F.size(v)).alias("most_size"))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows and rows with other than finite numbers become NaN."""
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.isfinite(n) & (n > 0), m / n, np.nan)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a table's column as unit rows; a null vector, or one of another size than the first, is NaN."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    size = int(sizes[sizes > 0][0]) if (sizes > 0).any() else 1
    out = np.full((len(rows), size), np.nan)
    ok = np.flatnonzero(sizes == size)
    if len(ok):
        out[ok] = rows.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), size)
    return unit(out)


def _tile(k: int):
    """The k best rows of a block for each of its queries: one matrix product for every 256 queries."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"q": [], "c": [], "cosine": []}
        keep = pc.sort_indices(right["c"])
        right = right.take(keep)
        a, b = _matrix(left["qv"]), _matrix(right["cv"])
        if a.shape[1] == b.shape[1] and len(a) and len(b):
            q, c = left["q"].to_numpy(), right["c"].to_numpy()
            for at in range(0, len(a), 256):
                cos = np.round(a[at : at + 256] @ b.T, 9)
                cos[q[at : at + 256][:, None] == c[None, :]] = np.nan
                cos = np.where(np.isnan(cos), -np.inf, cos)
                n = min(k, cos.shape[1])
                kth = -np.partition(-cos, n - 1, axis=1)[:, n - 1]
                i, j = np.nonzero((cos >= kth[:, None]) & np.isfinite(cos))  # ties of the last one too; keys ascend
                order = np.lexsort((j, -cos[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[place < k], j[place < k]
                out["q"].append(q[at + i]), out["c"].append(c[j]), out["cosine"].append(cos[i, j])
        return pa.table({n: np.concatenate(v) if v else np.zeros(0, np.float64 if n == "cosine" else np.int64) for n, v in out.items()}, pa.schema([("q", pa.int64()), ("c", pa.int64()), ("cosine", pa.float64())]))

    return best


_BEST = "q long, c long, cosine double"


def _keep(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query; blocks have left few rows of each."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "c"))).where(F.col("rank") <= k)


def cosine_top(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, rows: int = 4096) -> DataFrame:
    """The k nearest rows of the corpus to each query by cosine (nine digits), ties by key: (key, rank, neighbour, cosine).

    Queries and corpus are dealt into blocks of about `rows` rows; a task holds one block of each, takes their matrix product and leaves k rows of a query. Work is
    the product of both sides: a stated, smaller set of queries is meant to come against a large corpus. Zero and null vectors have no neighbours and are none. Keys are whole numbers.
    """
    one, two = max(1, -(-queries.count() // rows)), max(1, -(-corpus.count() // rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
    q = queries.select(F.col(key).alias("q"), F.col(vector).alias("qv"), place(one).alias("i"), every(two).alias("j"))
    c = corpus.select(F.col(key).alias("c"), F.col(vector).alias("cv"), place(two).alias("j"), every(one).alias("i"))
    best = q.groupBy("i", "j").cogroup(c.groupBy("i", "j")).applyInArrow(_tile(k), _BEST)
    return _keep(best, k).select(F.col("q").alias(key), "rank", F.col("c").alias("neighbour"), "cosine")


def _nearest_lists(centroids: np.ndarray, vector: str, n: int):
    """Adds to each row its n nearest centroids and their angles."""

    def run(batches):
        for batch in batches:
            m = _matrix(batch.column(vector))
            angle = np.arccos(np.clip(np.nan_to_num(m, nan=0.0) @ centroids.T, -1, 1))
            order = np.argsort(angle, axis=1, kind="stable")[:, :n]
            angles = np.take_along_axis(angle, order, axis=1)
            known = ~np.isnan(m).any(axis=1)
            yield batch.filter(pa.array(known)).append_column("lists", pa.array(order[known].tolist(), pa.list_(pa.int32()))).append_column("angles", pa.array(angles[known].tolist(), pa.list_(pa.float64())))

    return run


class Lists:
    """An exact index: the corpus in lists around centroids, each with the largest angle of its rows to the centroid."""

    def __init__(self, corpus: DataFrame, key: str, vector: str, lists: int = 64, rows: int = 4096):
        """Centroids are `lists` vectors of the corpus, those of the smallest hashes of their keys, so any corpus is divided alike again. A list of over `rows` rows is held in parts."""
        self.key, self.vector, self.rows = key, vector, rows
        some = corpus.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.col(vector).alias("v")).orderBy("h", "k").limit(lists).toArrow()
        m = _matrix(some["v"])
        self.centroids = np.unique(m[~np.isnan(m).any(axis=1)], axis=0)
        self.spark = corpus.sparkSession
        if not len(self.centroids):
            self.corpus, self.radius = None, []
            return
        kind = corpus.schema[vector].dataType.simpleString()
        self.corpus = corpus.select(F.col(key).cast("long").alias("c"), F.col(vector).alias("cv")).mapInArrow(_nearest_lists(self.centroids, "cv", 1), f"c long, cv {kind}, lists array<int>, angles array<double>").select("c", "cv", F.col("lists")[0].alias("list"), F.col("angles")[0].alias("angle"))
        sizes = self.corpus.groupBy("list").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # a row per centroid
        self.radius = [(r["list"], r["r"], -(-r["n"] // rows)) for r in sizes]

    def top(self, queries: DataFrame, k: int, first: int = 2) -> tuple[DataFrame, DataFrame]:
        """The same rows as cosine_top, and (q, list) of the lists opened.

        Each query opens its `first` nearest lists. Their k-th cosine is a bound: a list can be skipped where even its nearest possible row, at the angle to the centroid less
        the list's radius, is farther. All others are opened, so nothing is lost.
        """
        if self.corpus is None:
            return self.spark.createDataFrame([], f"{self.key} long, rank int, neighbour long, cosine double"), self.spark.createDataFrame([], "q long, list int")
        kind = queries.schema[self.vector].dataType.simpleString()
        asked = queries.select(F.col(self.key).cast("long").alias("q"), F.col(self.vector).alias("qv")).mapInArrow(_nearest_lists(self.centroids, "qv", len(self.centroids)), f"q long, qv {kind}, lists array<int>, angles array<double>")
        asked = asked.select("q", "qv", F.posexplode(F.arrays_zip("lists", "angles")).alias("place", "x")).select("q", "qv", F.col("x.lists").alias("list"), F.col("x.angles").alias("angle"))
        known = F.broadcast(self.spark.createDataFrame(self.radius, "list int, radius double, parts long"))  # a row per centroid
        asked = asked.join(known, "list").withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("angle", "list")))  # a query's lists alone
        near = asked.where(F.col("place") <= first)
        one = self._opened(near, k)
        bound = one.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).alias("bound"))
        reach = F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius"))) + 1e-7  # over the error of the angles, cosines and digits
        more = asked.where(F.col("place") > first).join(bound, "q", "left").where(F.col("bound").isNull() | (reach >= F.col("bound"))).drop("bound")
        both = _keep(one.drop("rank").unionAll(self._opened(more, k).drop("rank")), k)
        return both.select(F.col("q").alias(self.key), "rank", F.col("c").alias("neighbour"), "cosine"), near.select("q", "list").unionAll(more.select("q", "list"))

    def _opened(self, asked: DataFrame, k: int) -> DataFrame:
        """The k best rows in the lists that are asked for; lists and their queries meet in parts."""
        q = asked.select("q", "qv", "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("q"), F.lit(16)).cast("int").alias("side"))
        parts = F.broadcast(self.spark.createDataFrame(self.radius, "list int, radius double, parts long"))
        c = self.corpus.select("c", "cv", "list").join(parts, "list").select("c", "cv", "list", F.pmod(F.xxhash64("c"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("side"))
        keys = ["list", "part", "side"]
        c = c.join(q.select(*keys).distinct(), keys, "left_semi")
        return _keep(q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(_tile(k), _BEST), k)
