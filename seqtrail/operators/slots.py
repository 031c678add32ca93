"""Filling short top-k lists from a ranked table without pairing everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_slots(
    short: DataFrame,
    ranked: DataFrame,
    taken: DataFrame,
    *,
    key: str,
    value: str,
    start: Column,
    n_values: Column,
    k: int,
) -> DataFrame:
    """Values for the empty places of top-k lists, as (key, slot, value).

    ``short(key, n_have)`` lists the keys with fewer than ``k`` values, ``taken(key,
    value)`` those values, and ``ranked(rank, value)`` all values in some fixed order.
    From rank ``start`` on (going round at the end) at most k - 1 values are taken
    already, so 2k - 1 ranks per key are always enough.
    """
    reach = F.least(F.lit(2 * k - 1).cast("long"), n_values)
    tried = (
        short.filter((F.col("n_have") < k) & (n_values > 0))
        .withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), reach - 1)))
        .withColumn("rank", F.pmod(start + F.col("_step"), n_values))
    )
    free = tried.join(ranked, "rank").join(taken.select(key, value), [key, value], "left_anti")
    window = Window.partitionBy(key).orderBy("_step")
    return (
        free.withColumn("slot", F.col("n_have") + F.row_number().over(window) - 1)
        .filter(F.col("slot") < k)
        .select(key, F.col("slot").cast("long").alias("slot"), value)
    )
