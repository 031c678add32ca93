"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrail.functions.storage import cut, ensure_checkpoint_dir

BLANKS = r"[\x20\x09-\x0D]+"

__all__ = ["BLANKS", "cut", "connected", "fit_in_task", "fold_case", "new_folder", "runs", "slices", "words"]


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def fold_case(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def words(text: Column) -> Column:
    """Words between blanks, empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fit_in_task(sample: DataFrame, fit: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Any:
    """The model that ``fit`` pickles, fitted in one task over a sample of bounded size.

    The driver gets the model alone, so its memory does not hold the sample. A sample without
    rows is fitted too.
    """
    # Spark may run no task at all over no rows.
    found = sample.repartition(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(found["model"] if found else next(fit(iter([]))).column(0)[0].as_py())


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return first, np.diff(np.append(first, len(keys)))


def connected(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node that has an edge: columns ``node``, ``root``.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until the edge
    set no longer changes. Each step is a grouped minimum and a join; nothing of the graph
    comes to the driver but a row count and a hash. Null ends are dropped. Raises if
    ``rounds`` do not suffice.
    """
    edges = cut(
        edges.select(
            F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
        ).filter(F.col("u") > F.col("v")).distinct()
    )
    seen = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        mark = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)
        ).first()
        if mark == seen:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return nodes.union(roots)
        seen = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
