"""Cutting lineage through shared storage, so a lost executor costs only its own tasks."""

from __future__ import annotations

import atexit
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Has Spark delete an action's shuffle files when it ends, not when the driver next collects garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's folder for intermediate tables, below the shared folder.

    The cluster names its shared folder in ``spark.checkpoint.dir``. A session without that
    setting uses a folder of its warehouse, which executors and driver share as well; a
    local session removes that one when it ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        sc.setCheckpointDir(named)
        if sc.master.startswith("local["):
            atexit.register(shutil.rmtree, urlparse(sc.getCheckpointDir()).path, ignore_errors=True)
        return sc.getCheckpointDir()
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame, *, free_shuffles: bool = False) -> DataFrame:
    """Write ``df`` as a table next to the checkpoints and go on from the files.

    Unlike a checkpoint of rows, the table can be read by column, and its known size lets
    Spark broadcast it in later joins if (and only if) it is below the session's limit.
    With ``free_shuffles`` the shuffle files of the writing are deleted after it, so that large
    ones do not lie beside each other; the session's setting is as before then.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    if not free_shuffles:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def remove_table(table: DataFrame) -> None:
    """Delete a table that ``cut`` stored, once no plan reads it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_intermediate(spark: SparkSession) -> None:
    """Delete the session's folder of intermediate tables; results must have been stored elsewhere.

    The folder has a name of its own for each application, so other sessions keep theirs.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        path = spark._jvm.org.apache.hadoop.fs.Path(current)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
