"""Order-dependent columns that survive a group holding most of the table.

A Spark window sorts each of its groups in one task, a dead end when one group has a third
of all rows. ``order_rows`` and ``running_total`` therefore range-partition the table by
group and order, whatever the groups' sizes, work within the slices, and add what the
earlier slices of the same group contribute. Only a group that begins in one slice and goes
on in another needs that, so there are no more such pieces than slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtrail.functions.numbers import int_div
from seqtrail.functions.storage import cut

BLOCK_ROWS = 2_000_000


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` in slices of its order by group, stored: range bounds are sampled, so it is sliced once."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(
        df.repartitionByRange(slices, *[F.col(k) for k in keys], *_columns(order)).withColumn(
            "_slice", F.spark_partition_id()
        )
    )


def _attach(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join ``carried`` on group and slice, null keys being equal too.

    It has at most twice as many rows as there are slices, which bounds the broadcast.
    """
    names = {c: f"_on_{i}" for i, c in enumerate([*keys, "_slice"])}
    condition = F.lit(True)
    for name, other in names.items():
        condition &= F.col(name).eqNullSafe(F.col(other))
    return rows.join(F.broadcast(carried.withColumnsRenamed(names)), condition, "left").drop(*names.values())


def _pieces(sliced: DataFrame, keys: Sequence[str], total: Column, edges: Sequence[Column]) -> DataFrame:
    """Pieces of the groups that span several slices: their ``edges`` and what is ``_carried`` into them.

    Such groups have two pieces or more, each in a slice of its own or at a slice's end, so
    there are at most twice as many pieces as slices.
    """
    keys = list(keys)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = sliced.groupBy(*keys).agg(F.min("_slice").alias("_first"), F.max("_slice").alias("_last"))
    names = {k: f"_of_{i}" for i, k in enumerate(keys)}
    condition = F.lit(True)
    for name, other in names.items():
        condition &= F.col(name).eqNullSafe(F.col(other))
    # Fewer groups than slices go over a slice's end; only their rows are aggregated with edges.
    spread = F.broadcast(ends.filter("_first < _last").select(*keys).withColumnsRenamed(names))
    pieces = sliced.join(spread, condition, "left_semi").groupBy(*keys, "_slice").agg(total.alias("_total"), *edges)
    return pieces.withColumn("_carried", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, out: str
) -> DataFrame:
    """Add the inclusive running sum of ``value``; ``order`` must be unique in a group."""
    return running_totals(df, keys, order, {out: value})


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: Mapping[str, Column]
) -> DataFrame:
    """Add the inclusive running sums of several ``values``, named by their keys, in one go."""
    named = {f"_value_{i}": value.cast("long") for i, value in enumerate(values.values())}
    sliced = _sliced(df.withColumns(named), keys, order)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    pieces = _pieces(sliced, keys, F.count(F.lit(1)), [F.sum(name).alias(name) for name in named])
    carried = pieces.select(*keys, "_slice", *[F.sum(name).over(earlier).alias(f"_carried{name}") for name in named])
    local = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*_columns(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _attach(sliced, carried, keys)
        .withColumns(
            {out: F.sum(name).over(local) + F.coalesce(f"_carried{name}", F.lit(0)) for out, name in zip(values, named, strict=True)}
        )
        .drop("_slice", *named, *[f"_carried{name}" for name in named])
    )


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Mapping[str, str],
    *,
    step: int,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add columns of the previous (``step=-1``) or next (``step=1``) row of the group.

    ``pos`` numbers the rows 0, 1, 2, ... in each group. Groups are cut into blocks of
    ``block_rows``; the row at a block's edge is also given to the adjoining block, so
    every block can be worked on alone.
    """
    block = int_div(F.col(pos), block_rows)
    edge_at = block_rows - 1 if step < 0 else 0
    at_edge = (F.pmod(F.col(pos), F.lit(block_rows)) == edge_at) & (F.col(pos) - step >= 0)
    window = Window.partitionBy(*keys, "_block").orderBy(pos)
    take = F.lag if step < 0 else F.lead
    shared = df.withColumn("_home", block).withColumn(
        "_block",
        F.explode(
            F.when(at_edge, F.array("_home", F.col("_home") - step)).otherwise(F.array("_home"))
        ),
    )
    for out, source in columns.items():
        shared = shared.withColumn(out, take(source).over(window))
    return shared.filter(F.col("_home") == F.col("_block")).drop("_home", "_block")


def order_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    *,
    pos: str = "pos",
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
) -> DataFrame:
    """Number the rows of each group from 0 and look at the rows next to each one.

    ``previous`` and ``following`` map new column names to the column they read from
    the row before or after; with them ``order`` consists of column names. ``order`` must
    be unique within a group.
    """
    previous, following, keys = dict(previous or {}), dict(following or {}), list(keys)
    sliced = _sliced(df, keys, order)
    at = F.struct(*order) if previous or following else None
    edges = [F.max_by(source, at).alias(f"_last_{out}") for out, source in previous.items()]
    edges += [F.min_by(source, at).alias(f"_first_{out}") for out, source in following.items()]
    pieces = _pieces(sliced, keys, F.count(F.lit(1)), edges)
    over = Window.partitionBy(*keys).orderBy("_slice")
    carried = pieces.select(
        *keys,
        "_slice",
        "_carried",
        *[F.lag(f"_last_{out}").over(over).alias(f"_edge_{out}") for out in previous],
        *[F.lead(f"_first_{out}").over(over).alias(f"_edge_{out}") for out in following],
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(*_columns(order))
    counted = {"_local": F.row_number().over(local).cast("long")}
    counted |= {f"_near_{out}": F.lag(source).over(local) for out, source in previous.items()}
    counted |= {f"_near_{out}": F.lead(source).over(local) for out, source in following.items()}
    if following:
        counted["_rest"] = F.lead(F.lit(1)).over(local)
    numbered = sliced.select("*", *[c.alias(name) for name, c in counted.items()])
    met = _attach(numbered, carried, keys)
    first, last = F.col("_local") == 1, F.col("_rest").isNull() if following else F.lit(False)
    return met.select(
        *df.columns,
        (F.col("_local") - 1 + F.coalesce("_carried", F.lit(0))).alias(pos),
        *[F.when(first, F.col(f"_edge_{out}")).otherwise(F.col(f"_near_{out}")).alias(out) for out in previous],
        *[F.when(last, F.col(f"_edge_{out}")).otherwise(F.col(f"_near_{out}")).alias(out) for out in following],
    )


def rank_by_hash(
    df: DataFrame, key: str, hash_column: Column, out: str, *, group_digits: int = 4
) -> DataFrame:
    """Number rows 0..n-1 in the order of an md5 text and then ``key``.

    The first hex digits cut the table into even groups that are ranked on their own;
    only one total per group (16 ** digits of them) has to be summed up in order.
    """
    hashed = df.withColumn("_h", hash_column).withColumn(
        "_g", F.substring("_h", 1, group_digits)
    )
    per_group = hashed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_group.select("_g", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_g").orderBy("_h", key)
    # offsets has at most 16 ** group_digits rows, which bounds the broadcast.
    return (
        hashed.join(F.broadcast(offsets), "_g")
        .withColumn(out, F.row_number().over(local) - 1 + F.col("_before"))
        .drop("_h", "_g", "_before")
    )


def lookup(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a keyed table to a big one whose keys may be badly skewed.

    A plain join: Spark broadcasts a side below the session's limit, and otherwise splits
    the partitions of hot keys of the big side at run time, into as many as their size asks for.
    """
    return big.join(small, list(keys), how)
