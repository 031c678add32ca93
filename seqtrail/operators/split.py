"""Splits, cohort periods and batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtrail.functions.hashing import hash_text
from seqtrail.functions.numbers import int_div
from seqtrail.functions.ordered import lookup, rank_by_hash

DEFAULT_FRACTIONS = {"train": 0.7, "val": 0.1, "test": None}


def fixed_split(
    ids: DataFrame,
    *,
    seed: int,
    key: str = "idx",
    group_cols: Sequence[str] = (),
    fractions: Mapping[str, float | None] = DEFAULT_FRACTIONS,
) -> DataFrame:
    """Split ids by the rank of a seeded hash, with exact (floored) sizes.

    The last part takes the rest. With ``group_cols`` whole groups (say user and month)
    are drawn instead of single ids, so they never straddle two parts.
    """
    if group_cols:
        unit = F.concat_ws("|", *[F.col(c).cast("string") for c in group_cols])
    else:
        unit = F.col(key).cast("string")
    members = ids.select(key, *group_cols).distinct().withColumn("_unit", unit)
    units = members.select("_unit").distinct() if group_cols else members
    ranked = rank_by_hash(units, "_unit", hash_text(seed, F.col("_unit")), "_rank")
    total = units.agg(F.count(F.lit(1))).scalar()
    names = list(fractions)
    upper: Column = F.lit(0)
    part = F.lit(names[-1])
    bounds = []
    for name in names[:-1]:
        upper = upper + F.floor(total * F.lit(fractions[name]))
        bounds.append((name, upper))
    for name, bound in reversed(bounds):
        part = F.when(F.col("_rank") < bound, F.lit(name)).otherwise(part)
    placed = ranked.withColumn("split", part)
    if group_cols:
        return members.join(placed.select("_unit", "split"), "_unit").select(key, "split")
    return placed.select(key, "split")


def route(rows: DataFrame, splits: DataFrame, key: str = "idx") -> DataFrame:
    """Add the split of each row's id; rows without one are dropped."""
    return lookup(rows, splits, [key], "inner")


def split_report(sequences: DataFrame) -> DataFrame:
    """A5: case and control sequences per split, and controls per case."""
    is_case = F.col("kind") == "case"
    counts = sequences.groupBy("split").agg(
        F.sum(is_case.cast("long")).alias("n_cases"),
        F.sum((~is_case).cast("long")).alias("n_controls"),
    )
    return counts.withColumn(
        "controls_per_case", F.col("n_controls") / F.greatest(F.col("n_cases"), F.lit(1))
    )


def period_orders(
    orders: DataFrame, periods: Mapping[str, tuple[int, int]], *, column: str = "order_us"
) -> DataFrame:
    """P5, H8: orders of each named half-open period, with the period as a column."""
    inside = [
        F.when((F.col(column) >= start) & (F.col(column) < end), F.lit(name))
        for name, (start, end) in periods.items()
    ]
    names = F.filter(F.array(*inside), lambda name: name.isNotNull())
    return orders.withColumn("period", F.explode(names))


def assign_batches(
    sequences: DataFrame, key: str, *, batch_size: int, seed: int | None = None
) -> DataFrame:
    """Mini-batches of ``batch_size`` in an order fixed by a hash of the key."""
    order = hash_text("" if seed is None else seed, F.col(key).cast("string"))
    ranked = rank_by_hash(sequences, key, order, "_rank")
    return ranked.select(
        "*",
        int_div(F.col("_rank"), batch_size).alias("batch_id"),
        F.pmod(F.col("_rank"), F.lit(batch_size)).cast("long").alias("batch_pos"),
    ).drop("_rank")

