"""Action-level (chunk) metrics: the token positions between two row delimiters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtrail.functions.ordered import lookup, running_total
from seqtrail.functions.text import normalise
from seqtrail.operators.metrics import calibration_error
from seqtrail.operators.sequences import ROW


def number_chunks(
    positions: DataFrame,
    keys: Sequence[str],
    *,
    label: str = "label",
    row_token: str = ROW,
) -> DataFrame:
    """Add ``is_row`` and ``chunk_id``, the delimiters seen before each position.

    A delimiter belongs to the chunk it closes, so a chunk holding none is unclosed.
    """
    marked = positions.withColumn("is_row", (F.col(label) == row_token).cast("long"))
    counted = running_total(
        marked, keys, ["pos"], F.col("is_row"), "_seen"
    )
    return counted.withColumn("chunk_id", F.col("_seen") - F.col("is_row")).drop("_seen")


def closed_part(numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop what follows the last delimiter of each sequence, however long it is."""
    last = (
        numbered.filter(F.col("is_row") == 1)
        .groupBy(*keys)
        .agg(F.max("chunk_id").alias("_last"))
    )
    kept = lookup(numbered, last, keys, "inner").filter(F.col("chunk_id") <= F.col("_last"))
    return kept.drop("_last")


def closed_chunks(numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks that are closed by a delimiter and not empty."""
    return (
        numbered.groupBy(*keys, "chunk_id")
        .agg(F.max("is_row").alias("closed"), F.sum(1 - F.col("is_row")).alias("n_tokens"))
        .filter((F.col("closed") == 1) & (F.col("n_tokens") > 0))
        .drop("closed")
    )


def chunk_metrics(
    metrics: DataFrame,
    keys: Sequence[str],
    *,
    row_token: str = ROW,
) -> DataFrame:
    """Metrics of each closed, non-empty chunk of the scored positions.

    A chunk is right if all its tokens are. Of the top-k flags both the share
    (``topk_frac``) and 'all of them' (``topk_correct``) are given.
    """
    numbered = closed_part(
        number_chunks(metrics, keys, row_token=row_token), keys
    )
    token = F.col("is_row") == 0

    def words(column: str):
        return normalise(F.array_join(F.col("_words")[column], " ")).alias(f"{column}_text")

    return (
        numbered.groupBy(*keys, "chunk_id")
        .agg(
            F.sum(token.cast("long")).alias("n_tokens"),
            F.min(F.when(token, F.col("correct"))).alias("correct"),
            F.min(F.when(token, F.col("topk_correct"))).alias("topk_correct"),
            F.avg(F.when(token, F.col("topk_correct"))).alias("topk_frac"),
            F.avg(F.when(token, F.col("ce"))).alias("ce"),
            F.avg(F.when(token, F.col("entropy"))).alias("entropy"),
            F.avg(F.when(token, F.col("confidence"))).alias("confidence"),
            F.array_sort(F.collect_list(F.when(token, F.struct("pos", "label", "pred")))).alias("_words"),
        )
        .filter(F.col("n_tokens") > 0)
        .select("*", words("label"), words("pred"))
        .drop("_words")
    )


def chunk_summary(chunks: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """One row of chunk-level results per model."""
    flags = [c for c in ("nn_correct", "nn_topk_correct") if c in chunks.columns]
    summary = chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.avg("correct").alias("chunk_accuracy"),
        F.avg("topk_frac").alias("topk_frac"),
        F.avg("topk_correct").alias("topk_all"),
        F.avg("ce").alias("ce"),
        F.exp(F.avg("ce")).alias("perplexity"),
        F.avg("entropy").alias("entropy"),
        *[F.avg(c).alias(c) for c in flags],
    )
    return summary.join(calibration_error(chunks, by).drop("n_positions"), list(by))
