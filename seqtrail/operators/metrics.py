"""Scoring of any model's predictions, summaries, calibration and exact quantiles.

``predictions(model, <keys>, pos, label, top_tokens, top_probs, label_prob, entropy)`` is
the hand-over from any model; ``position_metrics(model, <keys>, pos, label, pred, correct,
topk_correct, ce, entropy, confidence)`` is what every report starts from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtrail.functions.numbers import ratio
from seqtrail.functions.storage import cut
from seqtrail.functions.ordered import lookup, running_total
from seqtrail.functions.text import mean_sd_cell
from seqtrail.operators.sequences import ROW

# Upper edges of the ten calibration bins as binary doubles.
CALIBRATION_EDGES = [0.1 * i for i in range(11)]
CALIBRATION_EDGES[10] = 1.0


def scorable(label: Column, ignored: Sequence[str] = (ROW, "<PAD>")) -> Column:
    """Is the label a real target (no padding, delimiter or missing label)?"""
    return label.isNotNull() & ~label.isin(*ignored)


def restrict_to_valid(
    probabilities: DataFrame, valid: DataFrame, keys: Sequence[str], *, token: str = "token", prob: str = "prob"
) -> DataFrame:
    """Keep only valid tokens of each distribution and scale it back to sum 1."""
    kept = probabilities.join(valid.select(token).distinct(), token, "left_semi")
    total = F.sum(prob).over(Window.partitionBy(*keys))
    return kept.withColumn(prob, ratio(F.col(prob), total))


def score_predictions(predictions: DataFrame, *, k: int = 5) -> DataFrame:
    """Position metrics of a table of predictions."""
    top = F.slice("top_tokens", 1, k)
    first = F.get("top_tokens", F.lit(0))
    made = ("top_tokens", "top_probs", "label_prob", "entropy")
    return predictions.select(
        *[c for c in predictions.columns if c not in made],
        first.alias("pred"),
        F.coalesce(first == F.col("label"), F.lit(False)).cast("int").alias("correct"),
        F.coalesce(F.array_contains(top, F.col("label")), F.lit(False))
        .cast("int")
        .alias("topk_correct"),
        F.when(F.col("label_prob") > 0, 0.0 - F.log("label_prob")).alias("ce"),
        "entropy",
        F.get("top_probs", F.lit(0)).alias("confidence"),
    )


def summarise(metrics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Means and population SDs, perplexity and unseen transitions."""
    return (
        metrics.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_positions"),
            F.count("ce").alias("n_ce"),
            F.avg("correct").alias("top1"),
            F.stddev_pop("correct").alias("top1_sd"),
            F.avg("topk_correct").alias("topk"),
            F.stddev_pop("topk_correct").alias("topk_sd"),
            F.avg("ce").alias("ce"),
            F.stddev_pop("ce").alias("ce_sd"),
            F.avg("entropy").alias("entropy"),
            F.stddev_pop("entropy").alias("entropy_sd"),
        )
        .withColumn("perplexity", F.exp("ce"))
        .withColumn("n_unseen", F.col("n_positions") - F.col("n_ce"))
        .withColumn("prop_unseen", F.col("n_unseen") / F.col("n_positions"))
    )


def report_cells(summary: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """the summary as report text."""
    return summary.select(
        *by,
        mean_sd_cell(F.col("top1"), F.col("top1_sd")).alias("top1_cell"),
        mean_sd_cell(F.col("topk"), F.col("topk_sd")).alias("topk_cell"),
        mean_sd_cell(F.col("entropy"), F.col("entropy_sd")).alias("entropy_cell"),
        mean_sd_cell(F.col("ce"), F.col("ce_sd")).alias("ce_cell"),
        "perplexity",
    )


def calibration_bin(confidence: Column) -> Column:
    """Bin 1..10 with ``lower < confidence <= upper``; null for 0 and nonsense."""
    chosen = F.lit(None).cast("int")
    for i in range(len(CALIBRATION_EDGES) - 1, 0, -1):
        chosen = F.when(confidence <= CALIBRATION_EDGES[i], F.lit(i)).otherwise(chosen)
    return F.when(confidence > 0, chosen)


def calibration_error(metrics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Expected calibration error; rows outside all bins count in the total only."""
    per_bin = metrics.groupBy(*by, calibration_bin(F.col("confidence")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("confidence").alias("conf"),
        F.sum("correct").alias("hits"),
    )
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("conf") - F.col("hits"))).otherwise(0.0)
    return per_bin.groupBy(*by).agg(
        F.sum("n").alias("n_positions"), (F.sum(gap) / F.sum("n")).alias("ece")
    )


def exact_quantiles(
    rows: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, as (by, probability, value).

    Works on the number of rows per distinct value and their running total, so no group
    is ever gathered in one place however many distinct values it has.
    """
    by = list(by)
    counts = cut(
        rows.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = running_total(counts, by, ["_v"], F.col("_n"), "_end")
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    asked = totals.withColumn(
        "probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    ).withColumn("_at", (F.col("_total") - 1) * F.col("probability"))
    # Without groups there is one row per probability asked for.
    candidates = lookup(placed, asked, by, "inner") if by else placed.join(F.broadcast(asked))

    def holds(index: Column) -> Column:
        return (F.col("_end") > index) & (F.col("_end") - F.col("_n") <= index)

    low, high = F.floor("_at"), F.ceil("_at")
    found = candidates.filter(holds(low) | holds(high)).groupBy(*by, "probability", "_at").agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_low"),
        F.max(F.when(holds(high), F.col("_v"))).alias("_high"),
    )
    value = F.col("_low") + (F.col("_at") - F.floor("_at")) * (F.col("_high") - F.col("_low"))
    return found.select(*by, "probability", value.alias("value"))
