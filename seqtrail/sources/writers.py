"""Sinks: windows, token maps, reports and caches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrail.sources.readers import bucket_of, exists


def write_windows(windows: DataFrame, path: str, *, buckets: int = 64) -> None:
    """All windows as one Parquet table, a folder per kind of window and bucket of orders.

    An order's windows are in the bucket of its hashed ``idx``, so reading a few orders opens
    few folders. Rows are gathered by folder before, so that there are no files by task and
    folder; Spark splits large folders over several tasks and files at run time.
    """
    name = f"idx_of_{buckets}"
    rows = windows.withColumn(name, bucket_of(F.col("idx"), buckets))
    rows.hint("rebalance", "kind", name).write.mode("overwrite").partitionBy("kind", name).parquet(path)


def write_token_map(token_map: DataFrame, path: str) -> None:
    """The action map (top-k rows) as one file of JSON lines of ``action`` and ``token``."""
    token_map.select("action", "token").repartition(1).write.mode("overwrite").json(path)


def read_token_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("action string, token string").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    report.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def combined_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Named result tables as rows of (table, record), the record in JSON."""
    rows = [
        df.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("record"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def write_combined_json(tables: Mapping[str, DataFrame], path: str, *, period: str) -> None:
    combined_report(tables).withColumn("period", F.lit(period)).repartition(1).write.mode(
        "overwrite"
    ).partitionBy("period").json(path)


def materialize(
    df: DataFrame,
    path: str,
    *,
    overwrite: bool = False,
    rows_per_file: int | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Write ``df`` unless the cache is there, and return the cached table.

    With ``rows_per_file`` the cache is written in chunks of at most that many rows;
    reading the folder puts them together again.
    """
    spark = df.sparkSession
    if overwrite or not exists(path, spark):
        writer = df.write.mode("overwrite")
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
