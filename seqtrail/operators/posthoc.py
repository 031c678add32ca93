"""Matched-tail comparison of word-based and action-based models, and its checks.

``scored`` tables have one row per scored action: (seq_id, pos, flags). Sequences are
known by id, so nothing depends on the order of rows in a file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtrail.functions.numbers import ratio
from seqtrail.functions.ordered import lookup, order_rows
from seqtrail.functions.timing import DELTA_LABELS, FIRST_ROW
from seqtrail.operators.bootstrap import DEFAULT_REPLICATES, cluster_bootstrap
from seqtrail.operators.chunks import closed_chunks
from seqtrail.operators.sequences import ROW

NOT_ACTIONS = ["<PAD>", ROW, FIRST_ROW, *DELTA_LABELS]


class CountMismatch(ValueError):
    """Sequence counts do not allow the comparison asked for."""


def chunk_counts(sequences: DataFrame, numbered: DataFrame, key: str = "seq_id") -> DataFrame:
    """H1: scored chunks of each sequence, zeros kept."""
    counted = closed_chunks(numbered, [key]).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sequences.select(key).join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def action_counts(
    sequences: DataFrame, labels: DataFrame, key: str = "seq_id", *, label: str = "label"
) -> DataFrame:
    """H2: scored actions of each sequence: no padding, delimiters or time-delta tokens."""
    counted = labels.filter(~F.col(label).isin(NOT_ACTIONS)).groupBy(key).agg(
        F.count(F.lit(1)).alias("n")
    )
    return sequences.select(key).join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def sequence_sums(scored: DataFrame, flags: Sequence[str], key: str = "seq_id") -> DataFrame:
    """Rows and flag sums per sequence."""
    return scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f).cast("long").alias(f) for f in flags]
    )


def checked_sums(scored: DataFrame, counts: DataFrame, flags: Sequence[str], key: str = "seq_id") -> DataFrame:
    """Flag sums of every sequence of ``counts(key, n)``, whose rows must be as many as it says.

    Sequences without rows have sums of 0. Reading the result fails at a sequence with more
    or fewer scored rows than counted, and at scored rows of a sequence that is not counted.
    """
    found = sequence_sums(scored, flags, key).withColumnRenamed("n", "_found")
    joined = counts.select(key, "n").join(found, key, "full_outer")
    off = ~F.col("n").eqNullSafe(F.coalesce("_found", F.lit(0)))
    message = F.concat(
        F.lit("sequence "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": counted "),
        F.coalesce(F.col("n").cast("string"), F.lit("none")), F.lit(", found "), F.coalesce("_found", F.lit(0)).cast("string"),
    )
    checked = F.when(off, F.raise_error(message).cast("long")).otherwise(F.col("n"))
    return joined.select(key, checked.alias("n"), *[F.coalesce(f, F.lit(0)).alias(f) for f in flags])


def tail_sums(scored: DataFrame, keep: DataFrame, flags: Sequence[str], key: str = "seq_id") -> DataFrame:
    """Flag sums over the last ``keep`` scored rows of each sequence.

    The scored rows carry ``from_end`` (0 for the last one), so only a comparison is left.
    ``n_kept`` tells how many rows there were to keep.
    """
    kept = lookup(scored, keep, [key], "inner").filter(F.col("from_end") < F.col("keep"))
    return kept.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_kept"), *[F.sum(f).cast("long").alias(f) for f in flags]
    )


def match_counts(wb: DataFrame, fb: DataFrame, *, policy: str, key: str = "seq_id") -> DataFrame:
    """H3: rows to keep per sequence: all word-based ones, or what both models have."""
    joined = wb.select(key, F.col("n").alias("k_wb")).join(
        fb.select(key, F.col("n").alias("k_fb")), key, "full_outer"
    )
    joined = joined.select(
        key, F.coalesce("k_wb", F.lit(0)).alias("k_wb"), F.coalesce("k_fb", F.lit(0)).alias("k_fb")
    )
    if policy not in ("strict_wb", "common_tail"):
        raise ValueError(f"unknown match policy {policy}")
    keep = F.least("k_wb", "k_fb") if policy == "common_tail" else F.col("k_wb")
    return joined.withColumn("keep", keep)


def validation_record(counts: DataFrame) -> DataFrame:
    """H4: totals and exceedances of the two counts."""
    excess = F.col("k_wb") - F.col("k_fb")
    return counts.agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.sum("k_wb").alias("sum_wb"),
        F.sum("k_fb").alias("sum_fb"),
        F.sum((excess > 0).cast("long")).alias("n_wb_above_fb"),
        F.max(excess).alias("max_wb_minus_fb"),
        F.sum(F.greatest(excess, F.lit(0))).alias("n_not_in_common_tail"),
    )


def strict_failures(counts: DataFrame) -> DataFrame:
    """H3, H4: sequences that rule out the strict policy: more word-based rows than action rows."""
    return counts.filter("k_wb > k_fb").withColumn("excess", F.col("k_wb") - F.col("k_fb"))


def require_strict(counts: DataFrame) -> None:
    """H3, H4: the strict policy needs every word-based count to fit."""
    record = validation_record(counts).first()
    if record["n_wb_above_fb"]:
        raise CountMismatch(f"word-based counts exceed action counts: {record.asDict()}")


def matched_sums(
    models: Mapping[str, tuple[DataFrame, Sequence[str]]],
    counts: DataFrame,
    key: str = "seq_id",
) -> DataFrame:
    """H3: one row per sequence with the matched sums of every model's flags.

    ``models`` maps a model name to its scored rows (with ``from_end``) and flags; the
    sum of flag f of model m is the column ``m__f``. Reading the result fails if a model
    has fewer rows than are to be kept of a sequence.
    """
    keep = counts.select(key, "keep")
    result = keep
    for name, (scored, flags) in models.items():
        sums = tail_sums(scored, keep, flags, key).select(
            key, "n_kept", *[F.col(f).alias(f"{name}__{f}") for f in flags]
        )
        short = F.coalesce("n_kept", F.lit(0)) < F.col("keep")
        complete = F.when(short, F.raise_error(F.lit(f"{name} has fewer rows than are to be kept")).cast("long"))
        result = (
            result.join(sums, key, "left")
            .withColumn("keep", complete.otherwise(F.col("keep")))
            .drop("n_kept")
        )
    series = [c for c in result.columns if c not in (key, "keep")]
    return result.select(key, "keep", *[F.coalesce(c, F.lit(0)).alias(c) for c in series])


def series_of(matched: DataFrame, key: str = "seq_id") -> list[str]:
    return [c for c in matched.columns if c not in (key, "keep")]


def pooled_accuracy(matched: DataFrame, key: str = "seq_id") -> DataFrame:
    """Pooled accuracy of each series over the matched rows."""
    series = series_of(matched, key)
    wide = matched.agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.sum("keep").alias("n_actions"),
        *[ratio(F.sum(s), F.sum("keep")).alias(s) for s in series],
    )
    return wide.unpivot(["n_sequences", "n_actions"], series, "series", "accuracy")


def matched_intervals(
    matched: DataFrame, key: str = "seq_id", *, n_replicates: int = DEFAULT_REPLICATES, seed: int = 0
) -> DataFrame:
    """H5: pooled accuracy and cluster-bootstrap interval of each series."""
    drawn = cluster_bootstrap(
        matched, key, series_of(matched, key), "keep", n_replicates=n_replicates, seed=seed
    ).withColumnRenamed("metric", "series")
    return pooled_accuracy(matched, key).join(drawn, "series")


def compared_models(report: DataFrame, comparison: str) -> DataFrame:
    """H6: all models (``full``), or word-based and Markov only (``wb_markov``)."""
    if comparison == "full":
        return report
    if comparison != "wb_markov":
        raise ValueError(f"unknown comparison {comparison}")
    return report.filter(~F.col("series").startswith("fb__"))


#: Names of the three rescue metrics.
RESCUE = ("exact_match_accuracy_pre_mapping", "semantic_nn_mapped_accuracy", "nn_mapping_rescued_accuracy")


def mapping_rescue(chunks: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Exact accuracy, accuracy after mapping, and the share mapping rescued."""
    rescued = ((F.col("correct") == 0) & (F.col("nn_correct") == 1)).cast("int")
    wide = chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_actions"),
        F.avg("correct").alias(RESCUE[0]),
        F.avg("nn_correct").alias(RESCUE[1]),
        F.avg(rescued).alias(RESCUE[2]),
    )
    metrics = [c for c in wide.columns if c not in (*by, "n_actions")]
    return wide.unpivot([*by, "n_actions"], metrics, "metric", "value")


def reconcile_lengths(metrics: DataFrame, expected: DataFrame) -> DataFrame:
    """H7, H8: rows per period and model next to the expected number."""
    actual = metrics.groupBy("period", "model").agg(F.count(F.lit(1)).alias("actual"))
    return expected.join(actual, ["period", "model"], "full_outer").select(
        "period",
        "model",
        "expected",
        F.coalesce("actual", F.lit(0)).alias("actual"),
        F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)).alias("matches"),
    )


def by_period(tables: Mapping[str, DataFrame]) -> DataFrame:
    """H8: tables of several periods as one, with the period as a column."""
    return reduce(
        DataFrame.unionByName,
        [df.withColumn("period", F.lit(period)) for period, df in tables.items()],
    )


def number_from_end(scored: DataFrame, key: str = "seq_id", order: str = "pos") -> DataFrame:
    """Number the scored rows of each sequence from its end, 0 for the last one."""
    return order_rows(scored, [key], [F.desc(order)], pos="from_end")
