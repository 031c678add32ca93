"""Bootstrap intervals whose shuffle does not grow with replicates times rows.

Every position gets a Poisson(1) weight per replicate, which follows from seed, key and
replicate; so a position weighs the same in all models, and differences of two models stay
paired. Weights are drawn in the task that holds the positions and are added up there; what
is shuffled is one row per task, model, replicate and confidence bin. The number of positions
drawn varies around their count, which ratios of sums do not mind. ``value_counts`` is a
shorter way for those who want it: n positions of the same values together get one Poisson(n)
weight, which is what n weights of Poisson(1) add up to.

Whole sequences are drawn with replacement, exactly as many as there are. The draws of a
replicate are split down a tree over the sequences' hashed order, by a binomial draw at each
node that follows from seed, node and replicate; each task walks down to its own block of
sequences and on to the single ones, so no draws are shuffled, only sums per replicate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtrail.functions import draws
from seqtrail.functions.hashing import hash_points, hash_text
from seqtrail.functions.numbers import int_div, ratio
from seqtrail.functions.ordered import rank_by_hash
from seqtrail.operators.metrics import calibration_bin, calibration_error, summarise

DEFAULT_REPLICATES = 1000
METRICS = ["accuracy", "topk_accuracy", "nn_accuracy", "nn_topk_accuracy", "entropy", "perplexity", "ece"]
#: Values are taken to nine decimals, so that equal ones are equal however they were added up.
SCALE = 10**9
FLAGS = ["correct", "topk_correct", "nn_correct", "nn_topk_correct"]
AMOUNTS = ["ce", "entropy", "confidence"]
#: Sums per replicate, in the order in which tasks work them out.
SUMS = ["n", "hits", "topk", "nn", "nn_topk", "ce", "entropy", "conf", "n_ce"]
#: Sequences to a block, the unit of work of the exact resampling.
BLOCK = 1024
#: Rows that are weighed at a time, in all replicates.
ROWS_AT_ONCE = 256


def _with_flags(metrics: DataFrame) -> DataFrame:
    """Models without nearest-neighbour flags get null ones."""
    for flag in ("nn_correct", "nn_topk_correct"):
        if flag not in metrics.columns:
            metrics = metrics.withColumn(flag, F.lit(None).cast("int"))
    return metrics


def _part(by: Sequence[str], *, scaled: bool) -> Column:
    """The values of a position that its statistics depend on; if ``scaled``, amounts in units of 1 / SCALE."""
    amounts = [(F.round(F.col(c) * SCALE).cast("long") if scaled else F.col(c).cast("double")).alias(c) for c in AMOUNTS]
    return F.struct(*by, calibration_bin(F.col("confidence")).alias("bin"), *[F.col(c).cast("long").alias(c) for c in FLAGS], *amounts)


def single_positions(metrics: DataFrame, by: Sequence[str], key: Sequence[str], seed: int) -> DataFrame:
    """Every position by itself, as (p1, p2, parts): the two points of its key, and its values as one part."""
    # Weighing a row costs far more than moving it, so rows are dealt out evenly.
    tasks = 2 * metrics.sparkSession.sparkContext.defaultParallelism
    p1, p2 = hash_points(seed, *[F.col(k).cast("string") for k in key])
    dealt = _with_flags(metrics).repartition(tasks, *key)
    return dealt.select(p1.alias("p1"), p2.alias("p2"), F.array(_part(by, scaled=False)).alias("parts"))


def value_counts(metrics: DataFrame, by: Sequence[str], key: Sequence[str] | None = None) -> DataFrame:
    """Distinct values of positions with their number: (id, n, parts).

    With ``key`` the positions of all groups that share a key are taken together: ``parts``
    has one item per group, and positions are equal if they are in every group.
    """
    by = list(by)
    flagged = _with_flags(metrics)
    if key is None:
        joint = flagged.select(F.array(_part(by, scaled=True)).alias("parts"))
    else:
        rows = flagged.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], _part(by, scaled=True).alias("_part"))
        joint = rows.groupBy(*[f"_k{i}" for i in range(len(key))]).agg(F.array_sort(F.collect_list("_part")).alias("parts"))
    fields = [*by, "bin", *FLAGS, *AMOUNTS]
    told = F.transform("parts", lambda p: F.concat_ws("|", *[F.coalesce(p[f].cast("string"), F.lit("n")) for f in fields]))
    return joint.withColumn("id", F.array_join(told, ";")).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.first("parts").alias("parts")
    )


def replicate_sums(rows: DataFrame, by: Sequence[str], n_replicates: int, seed: int) -> DataFrame:
    """Weighted sums of every replicate, partly added up: (by, bin, b, n, hits, ...).

    ``rows`` are ``single_positions`` or ``value_counts``.
    """
    by, counted = list(by), "n" in rows.columns
    coefficients = draws.replicate_coefficients(seed, n_replicates)
    fields = rows.schema["parts"].dataType.elementType
    types = ", ".join(f"{c} {fields[c].dataType.simpleString()}" for c in [*by, "bin"])
    schema = f"{types}, b long, " + ", ".join(f"{c} double" for c in SUMS)

    def weigh(batch: pa.RecordBatch) -> np.ndarray:
        if not counted:
            return draws.poisson_weights(coefficients, np.asarray(batch["p1"]), np.asarray(batch["p2"])).astype(float)
        told = zip(batch["n"].to_pylist(), batch["id"].to_pylist(), strict=True)
        return np.array([draws.poisson(n, draws.uniforms(coefficients, f"{seed}|{key}")) for n, key in told], float)

    def add(totals: dict, batch: pa.RecordBatch) -> None:
        weights = weigh(batch)
        lists = batch["parts"]
        parts, owner = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths())
        column = lambda c: np.asarray(parts.field(c).cast(pa.float64()).fill_null(np.nan), float)
        values = [np.ones(len(parts)), *[column(c) for c in FLAGS], *[column(c) / (SCALE if counted else 1) for c in AMOUNTS]]
        values = np.column_stack([*values, ~np.isnan(values[5])])
        groups: dict[tuple, list[int]] = {}
        for i, group in enumerate(zip(*[parts.field(c).to_pylist() for c in [*by, "bin"]], strict=True)):
            groups.setdefault(group, []).append(i)
        for group, at in groups.items():
            sums, given = totals.setdefault(group, (np.zeros((n_replicates, len(SUMS))), np.zeros(len(SUMS), bool)))
            sums += weights[owner[at]].T @ np.nan_to_num(values[at])
            given |= ~np.isnan(values[at]).all(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                add(totals, batch.slice(at, ROWS_AT_ONCE))
        kinds = [pa.string() if fields[c].dataType.simpleString() == "string" else None for c in [*by, "bin"]]
        for group, (sums, given) in totals.items():
            labels = [pa.array([g] * n_replicates, k or (pa.int32() if name == "bin" else None)) for g, k, name in zip(group, kinds, [*by, "bin"], strict=True)]
            columns = [pa.array(sums[:, i]) if given[i] else pa.nulls(n_replicates, pa.float64()) for i in range(len(SUMS))]
            yield pa.RecordBatch.from_arrays([*labels, pa.array(np.arange(n_replicates)), *columns], names=[*by, "bin", "b", *SUMS])

    return rows.mapInArrow(run, schema)


def replicate_statistics(
    metrics: DataFrame,
    key: Sequence[str],
    *,
    by: Sequence[str] = ("model",),
    n_replicates: int = DEFAULT_REPLICATES,
    seed: int = 0,
    paired: bool = False,
    counted: bool = False,
) -> DataFrame:
    """B1, B2: every metric of every replicate, as (by, b, accuracy, ..., ece).

    A position (``key``) has a weight of its own, the same in all groups. With ``counted``
    positions of the same values are weighed together, with ``paired`` those that have the
    same values in all groups; only then groups share weights.
    """
    by = list(by)
    rows = value_counts(metrics, by, key if paired else None) if counted else single_positions(metrics, by, key, seed)
    sums = replicate_sums(rows, by, n_replicates, seed)
    per_bin = sums.groupBy(*by, "b", "bin").agg(*[F.sum(c).alias(c) for c in SUMS])
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("conf") - F.col("hits"))).otherwise(0.0)
    n = F.sum("n")
    return per_bin.groupBy(*by, "b").agg(
        ratio(F.sum("hits"), n).alias("accuracy"),
        ratio(F.sum("topk"), n).alias("topk_accuracy"),
        ratio(F.sum("nn"), n).alias("nn_accuracy"),
        ratio(F.sum("nn_topk"), n).alias("nn_topk_accuracy"),
        ratio(F.sum("entropy"), n).alias("entropy"),
        F.exp(ratio(F.sum("ce"), F.sum("n_ce"))).alias("perplexity"),
        ratio(F.sum(gap), n).alias("ece"),
    )


def _long(wide: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return wide.unpivot(list(by), METRICS, "metric", value)


def raw_statistics(metrics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """The plain value of every metric, as (by, metric, raw)."""
    flags = _with_flags(metrics)
    nn = flags.groupBy(*by).agg(
        F.avg("nn_correct").alias("nn_accuracy"), F.avg("nn_topk_correct").alias("nn_topk_accuracy")
    )
    wide = (
        summarise(metrics, by)
        .select(*by, F.col("top1").alias("accuracy"), F.col("topk").alias("topk_accuracy"), "entropy", "perplexity")
        .join(nn, list(by))
        .join(calibration_error(metrics, by).select(*by, "ece"), list(by))
    )
    return _long(wide, by, "raw")


def bootstrap_report(
    metrics: DataFrame,
    key: Sequence[str],
    *,
    by: Sequence[str] = ("model",),
    n_replicates: int = DEFAULT_REPLICATES,
    seed: int = 0,
) -> DataFrame:
    """Raw value, bootstrap mean and 95% percentile interval of each metric.

    A metric the model does not have comes as a row of nulls.
    """
    drawn = replicate_statistics(
        metrics, key, by=by, n_replicates=n_replicates, seed=seed
    )
    intervals = (
        _long(drawn, [*by, "b"], "value")
        .groupBy(*by, "metric")
        .agg(
            F.avg("value").alias("bootstrap_mean"),
            F.percentile("value", F.lit(0.025)).alias("ci_low"),
            F.percentile("value", F.lit(0.975)).alias("ci_high"),
        )
    )
    return raw_statistics(metrics, by).join(intervals, [*by, "metric"], "left")


def paired_difference(
    metrics: DataFrame,
    key: Sequence[str],
    first: str,
    second: str,
    *,
    n_replicates: int = DEFAULT_REPLICATES,
    seed: int = 0,
) -> DataFrame:
    """ECE and perplexity differences of two models over the same draws."""
    both = metrics.filter(F.col("model").isin(first, second))
    drawn = replicate_statistics(both, key, n_replicates=n_replicates, seed=seed)
    wide = drawn.groupBy("b").agg(
        *[
            F.sum(F.when(F.col("model") == first, F.col(m)).otherwise(-F.col(m))).alias(m)
            for m in ("ece", "perplexity")
        ]
    )
    return (
        wide.unpivot(["b"], ["ece", "perplexity"], "metric", "diff")
        .groupBy("metric")
        .agg(
            F.avg("diff").alias("mean_diff"),
            F.stddev_pop("diff").alias("sd_diff"),
            F.median("diff").alias("median_diff"),
            F.percentile("diff", F.lit(0.025)).alias("ci_low"),
            F.percentile("diff", F.lit(0.975)).alias("ci_high"),
        )
    )


def middle(low: int, high: int) -> int:
    """Where the tree splits the places low..high-1: between whole blocks, and in halves inside a block."""
    blocks = -(-(high - low) // BLOCK)
    return low + (BLOCK * -(-blocks // 2) if blocks > 1 else -(-(high - low) // 2))


def multinomial(n: int, low: int, high: int, coefficients: np.ndarray, seed: int) -> np.ndarray:
    """How often each of the places low..high-1 of ``n`` is drawn, per replicate, in ``n`` draws in all.

    ``low`` and ``high`` bound a block; only the nodes above and inside it are drawn.
    """
    replicates = len(coefficients)
    out = np.zeros((replicates, high - low), np.int64)
    nodes = [(0, n, np.full(replicates, n, np.int64))]
    while nodes:
        first, last, drawn = nodes.pop()
        if last - first == 1:
            out[:, first - low] = drawn
            continue
        half = middle(first, last)
        left = draws.binomial(drawn, half - first, last - first, draws.uniforms(coefficients, f"{seed}|{first}|{last}"))
        nodes += [(a, b, d) for a, b, d in ((first, half, left), (half, last, drawn - left)) if a < high and b > low]
    return out


def cluster_bootstrap(
    clusters: DataFrame,
    key: str,
    sums: Sequence[str],
    count: str,
    *,
    n_replicates: int = DEFAULT_REPLICATES,
    seed: int = 0,
) -> DataFrame:
    """Bootstrap of pooled means over whole clusters, as (metric, mean, interval).

    ``clusters`` has one row per sequence with the sum of each series and one count. Every
    replicate draws as many sequences as there are, with replacement; a sequence counts with
    all its positions as often as it is drawn.
    """
    columns = [*sums, count]
    coefficients = draws.replicate_coefficients(seed, n_replicates)
    total = clusters.agg(F.count(F.lit(1))).scalar()
    rows = clusters.select(F.col(key).cast("string").alias("_key"), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(columns)])
    ranked = rank_by_hash(rows, "_key", hash_text(seed, F.col("_key")), "_rank").withColumn("_total", total)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_rank")
        low, n = group["_rank"][0].as_py(), group["_total"][0].as_py()
        drawn = multinomial(n, low, low + len(group), coefficients, seed)
        added = drawn @ np.column_stack([np.asarray(group[c].fill_null(0.0)) for c in columns])
        return pa.table([pa.array(np.arange(n_replicates)), *added.T], names=["b", *[f"_s{i}" for i in range(len(columns))]])

    per_block = ranked.groupBy(int_div(F.col("_rank"), BLOCK).alias("_block")).applyInArrow(
        run, "b long, " + ", ".join(f"_s{i} double" for i in range(len(columns)))
    )
    whole = F.sum(f"_s{len(sums)}")
    means = per_block.groupBy("b").agg(*[ratio(F.sum(f"_s{i}"), whole).alias(s) for i, s in enumerate(sums)])
    return (
        means.unpivot(["b"], list(sums), "metric", "value")
        .groupBy("metric")
        .agg(
            F.avg("value").alias("bootstrap_mean"),
            F.percentile("value", F.lit(0.025)).alias("ci_low"),
            F.percentile("value", F.lit(0.975)).alias("ci_high"),
        )
    )
