"""Reading selected columns and row windows of tables and text files, and writing with read-back checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumns(ValueError):
    """A source lacks columns that were asked for."""


def select_columns(df: DataFrame, columns: list[str], text: list[str] = ()) -> DataFrame:
    """Only the given columns (MissingColumns names those that aren't there), those of `text` as strings; the scan reads no others."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(", ".join(missing))
    return df.select(*[F.col(c).cast("string").alias(c) if c in text else F.col(c) for c in columns])


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder. Only a session in one process may leave that unset, and gets one in its warehouse."""
    d = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = d.get() if d.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/tables-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows written as a table in the shared folder and read again, for what is read several times."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Kept:
    """Rows kept as a table in the shared folder while a fit runs: evenly dealt, with a plan of one scan, and removed at the end or when others take their place."""

    def __init__(self, df: DataFrame):
        self.path, self.spark = None, df.sparkSession
        self.replace(df.hint("rebalance"))

    def replace(self, df: DataFrame) -> None:
        old, self.path = self.path, scratch(self.spark)
        self.rows = written(df, self.path)
        self._remove(old)

    def _remove(self, path: str | None) -> None:
        if path:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *_) -> None:
        self._remove(self.path)


def row_window(df: DataFrame, key: str, start: int = 0, stop: int | None = None, rows: int = 500_000) -> DataFrame:
    """Rows number start to stop (from 0, exclusive) by the order of a unique numeric key; Spark tables have no order of their own.

    Keys are counted in ranges of about `rows` rows first, cut by an approximate percentile so that skewed keys fill no range; only ranges that
    reach into the window are numbered, each by itself, so no task sorts the whole table.
    """
    if start < 0 or (stop is not None and stop < start):
        raise ValueError("0 <= start <= stop is needed")
    keyed = df.where(F.col(key).isNotNull())
    parts = min(10_000, max(1, -(-keyed.count() // rows)))
    edges = []
    if parts > 1:
        edges = sorted(set(keyed.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0]))
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(key))) if edges else F.lit(0)
    counts = sorted((r["b"], r["n"]) for r in keyed.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for b, n in counts:
        if total + n > start and (stop is None or total < stop):
            before[b] = total
        total += n
    if not before:
        return df.limit(0)
    inside = keyed.withColumn("_range", at).where(F.col("_range").between(min(before), max(before)))
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("_range")]
    number = offset + F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    keep = (F.col("_at") >= start) if stop is None else (F.col("_at") >= start) & (F.col("_at") < stop)
    return inside.withColumn("_at", number).where(keep).select(*df.columns)


def read_csv(spark: SparkSession, path: str, columns: list[str], text: list[str] = (), encoding: str = "UTF-8") -> DataFrame:
    """Selected columns of a CSV file with a header, all as strings until they are cast."""
    return select_columns(spark.read.option("header", True).option("encoding", encoding).csv(path), columns, text)


def columns_of(schema: T.StructType, kind: type) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, kind)]
