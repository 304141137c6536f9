"""Feeding a keyed cache from a stream: every micro-batch adds a delta, and every so often a full version is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.sources.cache import upsert


def _numbers(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the complete folders of a kind (`full` or `delta`), from the listing."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[len(kind) :]) for n in names if n.startswith(kind) and fs.exists(Path(f"{folder}/{n}/_SUCCESS")))


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _upto(spark: SparkSession, folder: str, key: str, number: int | None) -> DataFrame | None:
    """The cache after batch `number` (None: the newest): the last full version not beyond it and the deltas after that."""
    fulls = [n for n in _numbers(spark, folder, "full") if number is None or n <= number]
    since = fulls[-1] if fulls else -1
    paths = [f"{folder}/full{since}"] * bool(fulls) + [f"{folder}/delta{n}" for n in _numbers(spark, folder, "delta") if n > since and (number is None or n <= number)]
    if not paths:
        return None
    first = spark.read.parquet(paths[0])
    for p in paths[1:]:
        first = first.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return upsert(first, first.limit(0), key)


def latest(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    """The newest state of the cache, one row per key; None before the first batch."""
    return _upto(spark, folder, key, None)


def feed(stream: DataFrame, folder: str, key: str, checkpoint: str, compact: int = 50):
    """Starts a query that upserts each micro-batch into the cache in `folder`.

    Batch n writes delta n, and nothing else of the cache moves; every `compact` batches a full version takes the deltas in, and what is two full versions old is removed. A batch that runs
    again after a failure writes the same delta: exactly once by key.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("batch", F.lit(number).cast("long"))
        rest = F.struct(*[c for c in new.columns if c != key])
        new.groupBy(key).agg(F.max_by(rest, rest).alias("_x")).select(key, "_x.*").write.mode("overwrite").parquet(f"{folder}/delta{number}")
        if number % compact == compact - 1:
            _upto(spark, folder, key, number).write.mode("overwrite").parquet(f"{folder}/full{number}")
            old = [n for n in _numbers(spark, folder, "full") if n < number]
            for n in old[:-1]:
                _remove(spark, f"{folder}/full{n}")
            for n in _numbers(spark, folder, "delta"):
                if old and n <= old[-1]:
                    _remove(spark, f"{folder}/delta{n}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
