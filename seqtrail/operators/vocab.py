"""Action vocabularies: counts, top-k token maps, dense indexes and field codes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqtrail.functions.ordered import lookup, order_rows

RARE = "[ACT_RARE]"  # fixed value: token of an action outside the vocabulary
TOKEN_PREFIX = "[ACT_"  # fixed value: start of every action token
DEFAULT_TOP_K = 500


def action_counts(rows: DataFrame, column: str = "action") -> DataFrame:
    """A1: how often each action occurs, over all rows of all windows."""
    return (
        rows.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("action"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def action_tokens(counts: DataFrame, top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """The ``top_k`` most frequent actions as tokens ``[ACT_0]``, ``[ACT_1]``, ...

    The limit comes before the ranking, so only ``top_k`` rows are ever put in one order.
    """
    top = counts.orderBy(F.desc("n"), "action").limit(top_k)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "action")).cast("long") - 1
    ranked = top.withColumn("rank", rank)
    token = F.concat(F.lit(TOKEN_PREFIX), F.col("rank").cast("string"), F.lit("]"))
    return ranked.select("action", "n", "rank", token.alias("token"))


def tokenize_actions(rows: DataFrame, tokens: DataFrame, column: str = "action") -> DataFrame:
    """Add the token of each action, ``[ACT_RARE]`` where it has none."""
    known = tokens.select(F.col("action").alias(column), "token")
    joined = lookup(rows, known, [column])
    return joined.withColumn("token", F.coalesce("token", F.lit(RARE)))


def valid_actions(rows: DataFrame, column: str = "token") -> DataFrame:
    """P10: rows whose token is an action token (the rare one included)."""
    return rows.filter(F.col(column).startswith(TOKEN_PREFIX))


def dense_index(values: DataFrame, column: str, out: str = "token_idx") -> DataFrame:
    """distinct values with a dense index 0..N-1 in sorted order."""
    distinct = values.select(column).filter(F.col(column).isNotNull()).distinct()
    return order_rows(distinct, [], [column], pos=out)


def field_codes(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F16: dense, value-ordered integer codes of every distinct value of each column."""
    distinct = reduce(
        DataFrame.unionByName,
        [
            rows.select(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")).distinct()
            for c in columns
        ],
    ).filter(F.col("value").isNotNull())
    return order_rows(distinct, ["field"], ["value"], pos="code")


def encode_fields(rows: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F16: replace each column by the code of its value."""
    for column in columns:
        known = codes.filter(F.col("field") == column).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        rows = lookup(
            rows.withColumn("_value", F.col(column).cast("string")), known, ["_value"]
        ).withColumn(column, F.col("_code")).drop("_value", "_code")
    return rows
