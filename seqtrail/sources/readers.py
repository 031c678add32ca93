"""Readers and guards for order lists, audit logs and caches."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtrail.functions.timing import epoch_micros

ORDER_LIST_SCHEMA = T.StructType(
    [
        T.StructField("idx", T.LongType()),
        T.StructField("ORDER_DTTM_raw", T.TimestampNTZType()),
        T.StructField("ORDERING_USER_ID", T.StringType()),
        T.StructField("PROV_TYPE", T.StringType()),
    ]
)
REQUIRED_LOG_COLUMNS = ("METRIC_ID", "METRIC_NAME", "PAT_ID", "ACCESS_TIME", "ACCESS_INSTANT", "USER_ID")


class MissingColumns(ValueError):
    """A table lacks columns an operator needs."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Return ``df`` if it has all columns, else say which ones are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def read_order_list(
    spark: SparkSession, path: str, *, timestamp_format: str = "yyyy-MM-dd HH:mm:ss"
) -> DataFrame:
    """The CSV list of index orders as ``orders(idx, user_id, order_us, prov_type)``."""
    raw = (
        spark.read.schema(ORDER_LIST_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("timestampNTZFormat", timestamp_format)
        .csv(path)
    )
    return raw.select(
        "idx",
        F.col("ORDERING_USER_ID").alias("user_id"),
        epoch_micros(F.col("ORDER_DTTM_raw")).alias("order_us"),
        F.col("PROV_TYPE").alias("prov_type"),
    )


def read_audit_log(
    spark: SparkSession, path: str, *, columns: Sequence[str] = REQUIRED_LOG_COLUMNS
) -> DataFrame:
    """Raw log rows of all orders; only ``columns`` are read from the files.

    ``path`` is a folder of Parquet files, if need be with one ``idx=...`` folder per order.
    """
    log = require_columns(spark.read.parquet(path), columns)
    partition = ["idx"] if "idx" in log.columns and "idx" not in columns else []
    return log.select(*columns, *partition)


def bucket_of(idx: Column, buckets: int) -> Column:
    """The folder of an order among ``buckets``, by the text of its ``idx``, whatever its type."""
    return F.pmod(F.xxhash64(idx.cast("string")), F.lit(buckets)).cast("int")


def read_windows(spark: SparkSession, path: str, orders: DataFrame | None = None) -> DataFrame:
    """The windows that ``write_windows`` stored, of all orders or of those in ``orders`` (``idx``).

    The orders' buckets prune the folders when the query runs, if the orders are few enough
    to be broadcast. The number of buckets is in the name of the folders.
    """
    stored = spark.read.parquet(path)
    name = next(c for c in stored.columns if re.fullmatch(r"idx_of_\d+", c))
    if orders is None:
        return stored.drop(name)
    buckets = int(name.removeprefix("idx_of_"))
    asked = orders.select("idx").distinct().withColumn(name, bucket_of(F.col("idx"), buckets))
    # True for all; Spark prunes folders only by a side that a comparison may make smaller.
    asked = asked.filter(F.col(name) < buckets)
    return stored.join(asked, ["idx", name], "left_semi").drop(name)


def first_rows(df: DataFrame, n: int | None, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in a stated order (all rows for None)."""
    return df if n is None else df.orderBy(*order).limit(n)


def log_presence(orders: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Per order the number of log rows of its key and whether there are any."""
    counts = log.groupBy(key).agg(F.count(F.lit(1)).alias("n_logs"))
    return orders.join(counts, key, "left").select(
        *orders.columns,
        F.coalesce("n_logs", F.lit(0)).alias("n_logs"),
        F.col("n_logs").isNotNull().alias("found"),
    )


def exists(path: str, spark: SparkSession) -> bool:
    """Does a path hold a finished Spark output?"""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
