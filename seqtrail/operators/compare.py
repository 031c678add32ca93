"""Paired tests between two models over the same positions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtrail.functions.numbers import erfc, ratio
from seqtrail.functions.ordered import running_total

Z95 = 1.96  # fixed value: normal quantile of the reported 95% intervals


class NotAligned(ValueError):
    """Two models do not cover the same positions."""


def align(metrics: DataFrame, first: str, second: str, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values of two models side by side, as ``<value>_1`` and ``<value>_2``."""
    sides = [
        metrics.filter(F.col("model") == name).select(
            *key, F.lit(True).alias(f"in_{i}"), *[F.col(v).alias(f"{v}_{i}") for v in values]
        )
        for i, name in ((1, first), (2, second))
    ]
    return sides[0].join(sides[1], list(key), "full_outer")


def alignment_report(aligned: DataFrame) -> DataFrame:
    """Positions both models have and positions only one of them has."""
    both = F.col("in_1").isNotNull() & F.col("in_2").isNotNull()
    return aligned.agg(
        F.sum(both.cast("long")).alias("n_both"),
        F.sum(F.col("in_2").isNull().cast("long")).alias("n_only_1"),
        F.sum(F.col("in_1").isNull().cast("long")).alias("n_only_2"),
    )


def require_aligned(aligned: DataFrame) -> DataFrame:
    """Fail unless both models cover exactly the same positions."""
    report = alignment_report(aligned).first()
    if report["n_only_1"] or report["n_only_2"]:
        raise NotAligned(f"{report['n_only_1']} positions only in the first, {report['n_only_2']} only in the second")
    return aligned


def model_pairs(models: DataFrame) -> DataFrame:
    """All ordered pairs of different models; the list has one row per model."""
    names = models.select("model").distinct().agg(F.array_sort(F.collect_list("model")))
    listed = models.select("model").distinct().withColumn("_all", names.scalar())
    return (
        listed.select(F.col("model").alias("model_1"), F.explode("_all").alias("model_2"))
        .filter(F.col("model_1") != F.col("model_2"))
    )


def contingency(aligned: DataFrame, flag: str) -> DataFrame:
    """Both right, only the first, only the second, both wrong."""
    one, two = F.col(f"{flag}_1") == 1, F.col(f"{flag}_2") == 1

    def count(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0)).alias(name)

    return aligned.agg(
        count(one & two, "both"),
        count(one & ~two, "only_1"),
        count(~one & two, "only_2"),
        count(~one & ~two, "neither"),
    )


def mcnemar(aligned: DataFrame, flag: str = "correct") -> DataFrame:
    """McNemar test with continuity correction and the discordant odds ratio."""
    b, c = F.col("only_1").cast("double"), F.col("only_2").cast("double")
    spread = F.lit(Z95) * F.sqrt(ratio(F.lit(1.0), b) + ratio(F.lit(1.0), c))
    odds = F.when((b > 0) & (c > 0), ratio(b, c))
    result = contingency(aligned, flag).select(
        F.lit(flag).alias("metric"),
        "both",
        "only_1",
        "only_2",
        "neither",
        ratio(F.pow(F.abs(b - c) - 1, F.lit(2)), b + c).alias("chi2"),
        odds.alias("odds_ratio"),
        F.exp(F.log(odds) - spread).alias("or_low"),
        F.exp(F.log(odds) + spread).alias("or_high"),
    )
    return result.withColumn("_x", F.sqrt(F.col("chi2") / 2)).withColumn("p_value", erfc(F.col("_x"))).drop("_x")


def ranked_differences(aligned: DataFrame, value: str, *, digits: int = 12) -> DataFrame:
    """Per distinct absolute difference its sign counts and average rank.

    Zero differences are left out of the ranking; their number is in ``n_zero``.
    """
    diff = F.round(F.col(f"{value}_1") - F.col(f"{value}_2"), digits)
    counts = (
        aligned.select(diff.alias("d"))
        .filter(F.col("d").isNotNull())
        .groupBy(F.abs("d").alias("abs_d"))
        .agg(
            F.sum((F.col("d") > 0).cast("long")).alias("n_plus"),
            F.sum((F.col("d") < 0).cast("long")).alias("n_minus"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    n_zero = F.coalesce(counts.filter("abs_d = 0").agg(F.sum("n")).scalar(), F.lit(0))
    placed = running_total(counts.filter("abs_d > 0"), [], ["abs_d"], F.col("n"), "_end")
    return placed.select(
        "abs_d",
        "n_plus",
        "n_minus",
        "n",
        (F.col("_end") - F.col("n") + (F.col("n") + 1) / 2.0).alias("rank"),
        n_zero.alias("n_zero"),
    )


def wilcoxon(aligned: DataFrame, value: str = "entropy") -> DataFrame:
    """Signed-rank test and rank-biserial effect size.

    The test drops zero differences and uses the normal approximation with tie
    correction; the effect size ranks zeros too, which lifts every rank by their number.
    """
    n, t = F.col("n_pairs").cast("double"), F.col("ties")
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - t / 48.0
    plus = F.col("w_plus") + F.col("n_zero") * F.col("n_plus")
    minus = F.col("w_minus") + F.col("n_zero") * F.col("n_minus")
    size = F.col("n").cast("double")
    result = (
        ranked_differences(aligned, value)
        .agg(
            F.sum("n").alias("n_pairs"),
            F.sum("n_plus").alias("n_plus"),
            F.sum("n_minus").alias("n_minus"),
            F.max("n_zero").alias("n_zero"),
            F.sum(F.col("rank") * F.col("n_plus")).alias("w_plus"),
            F.sum(F.col("rank") * F.col("n_minus")).alias("w_minus"),
            F.sum(size * size * size - size).alias("ties"),
        )
        .select(
            F.lit(value).alias("metric"),
            "n_pairs",
            "n_zero",
            "w_plus",
            "w_minus",
            ratio(F.least("w_plus", "w_minus") - n * (n + 1) / 4.0, F.sqrt(variance)).alias("z"),
            ratio(plus - minus, plus + minus).alias("effect_size"),
        )
    )
    return result.withColumn("_x", F.abs("z") / math.sqrt(2.0)).withColumn("p_value", erfc(F.col("_x"))).drop("_x")
