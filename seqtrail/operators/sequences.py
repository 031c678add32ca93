"""Windows as ordered action sequences.

The truth is the long table ``sequences(seq_id, pos, ..., delta, ...)``. Session strings
are derived from it, in parts of bounded length, because one sequence may be larger
than a row should be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtrail.functions.numbers import int_div
from seqtrail.functions.ordered import order_rows, running_total
from seqtrail.functions.timing import delta_category, delta_seconds, is_first_or_slow

ROW = "<ROW>"  # fixed value: row delimiter of a session string
MAX_PART_ROWS = 100_000


def sequence_id() -> Column:
    return F.concat_ws(":", F.col("idx").cast("string"), "kind", F.col("control_idx").cast("string"))


def order_windows(
    windows: DataFrame,
    *,
    keys: Sequence[str] = ("idx", "kind", "control_idx"),
    order: Sequence[str] = ("us", "event_id"),
) -> DataFrame:
    """Number the rows of each window and add the seconds since the row before."""
    ordered = order_rows(windows, keys, order, previous={"previous_us": "us"})
    return ordered.withColumn("delta", delta_seconds(F.col("us"), F.col("previous_us"))).drop(
        "previous_us"
    )


def drop_automatic(sequences: DataFrame, cutoff: float | None) -> DataFrame:
    """Drop rows that follow the one before too fast to be a person's action."""
    return sequences.filter(is_first_or_slow(F.col("delta"), cutoff))


def row_text(fields: Sequence[str], separator: str = "") -> Column:
    """the fields of one row as text; ``delta`` stands for its category."""
    parts = [
        delta_category(F.col(f)) if f == "delta" else F.coalesce(F.col(f).cast("string"), F.lit("NULL"))
        for f in fields
    ]
    return F.concat_ws(separator, *parts)


def session_strings(
    sequences: DataFrame,
    *,
    keys: Sequence[str] = ("idx", "kind", "control_idx"),
    fields: Sequence[str] = ("action",),
    field_separator: str = "",
    row_separator: str = ROW,
    max_part_rows: int = MAX_PART_ROWS,
) -> DataFrame:
    """each sequence as text, every row followed by the row separator.

    A sequence of more than ``max_part_rows`` positions comes as several rows numbered
    by ``part``; put together in that order they are the whole text.
    """
    row = F.struct("pos", row_text(fields, field_separator).alias("text"))
    ordered = F.array_sort(F.collect_list(row))
    return (
        sequences.withColumn("part", int_div(F.col("pos"), max_part_rows))
        .groupBy(*keys, "part")
        .agg(ordered.alias("_rows"))
        .select(
            *keys,
            "part",
            F.size("_rows").alias("n_actions"),
            F.concat(
                F.array_join(F.col("_rows.text"), row_separator), F.lit(row_separator)
            ).alias("sequence"),
        )
    )


def non_blank(rows: DataFrame, column: str = "sequence") -> DataFrame:
    """Rows whose text is there and holds more than white space."""
    return rows.filter(F.col(column).rlike(r"\S"))


def run_sessions(
    ordered: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """Number the runs of equal ``value`` along the positions of each group from 0."""
    with_previous = order_rows(
        ordered.drop("pos"), keys, ["us", "event_id"], previous={"_before": value}
    )
    starts = (~F.col("_before").eqNullSafe(F.col(value))) & (F.col("pos") > 0)
    return running_total(
        with_previous, keys, ["pos"], starts.cast("long"), "session"
    ).drop("_before")
