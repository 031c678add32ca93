"""E5: first-order transition model over actions, fitted and scored sparsely.

A fitted model is a small sparse table of observed transitions. A prediction depends on the previous action alone, so everything
about it is worked out once per distinct (prev, label) pair and looked up per position.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from seqtrail.functions.hashing import hash32, hash_text
from seqtrail.functions.ordered import lookup, order_rows, rank_by_hash
from seqtrail.functions.storage import cut
from seqtrail.operators.slots import fill_slots

DEFAULT_SKIP = 10
DEFAULT_K = 5
EPSILON = 1e-12


@dataclass(frozen=True)
class Transitions:
    """A fitted model; both tables are stored and small (one row per observed pair)."""

    table: DataFrame  # (prev, next, n, prob) of every observed transition
    tokens: DataFrame  # (token, n, rank): training vocabulary in a hashed order
    size: int  # N, the number of training tokens
    seed: int


def with_previous(
    tokens: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """Number the tokens of each sequence from 0 and add the token before each."""
    unnumbered = tokens.withColumnRenamed("pos", "_at") if "pos" in tokens.columns else tokens
    order = ["_at" if c == "pos" else c for c in order]
    return order_rows(unnumbered, keys, order, previous={"prev": "token"}).drop("_at")


def fit(positions: DataFrame, *, seed: int = 0, count: str | None = None) -> Transitions:
    """Count the pairs of training positions ``(prev, token)``.

    A row stands for as many positions as its column ``count`` says, or for one.

    One pass counts pairs, sequence starts included (null ``prev``); transition
    probabilities and token frequencies both follow from these counts.
    """
    pairs = cut(
        positions.groupBy("prev", F.col("token").alias("next")).agg(
            (F.sum(count) if count else F.count(F.lit(1))).alias("n")
        )
    )
    total = F.sum("n").over(Window.partitionBy("prev"))
    table = cut(pairs.filter(F.col("prev").isNotNull()).withColumn("prob", F.col("n") / total))
    frequencies = pairs.groupBy(F.col("next").alias("token")).agg(F.sum("n").alias("n"))
    order = hash_text(seed, F.col("token"))
    tokens = cut(rank_by_hash(frequencies, "token", order, "rank", group_digits=2))
    return Transitions(table, tokens, tokens.count(), seed)


def scored_positions(
    positions: DataFrame, *, skip_n: int = DEFAULT_SKIP, delta_cutoff: float | None = None
) -> DataFrame:
    """Target positions after the warm-up, without automatic actions."""
    kept = positions.filter(F.col("pos") > skip_n)
    if delta_cutoff is not None:
        kept = kept.filter(F.col("delta") > delta_cutoff)
    return kept


def top_successors(table: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """The ``k`` most probable next tokens of each token, as (prev, slot, next)."""
    window = Window.partitionBy("prev").orderBy(F.desc("prob"), "next")
    return (
        table.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= k)
        .select("prev", (F.col("_rank").cast("long") - 1).alias("slot"), "next", "prob")
    )


def predictive_entropy(table: DataFrame) -> DataFrame:
    """entropy of the next token, its best probability and successor count per token."""
    return table.groupBy("prev").agg(
        F.sum(-F.col("prob") * F.log(F.col("prob") + EPSILON)).alias("entropy"),
        F.max("prob").alias("confidence"),
        F.count(F.lit(1)).alias("n_successors"),
    )


def predict(model: Transitions, previous: DataFrame, *, k: int = DEFAULT_K) -> DataFrame:
    """Top-k list, confidence and entropy for each distinct ``prev`` given.

    Lists shorter than ``k`` are filled with other training tokens in a hashed order
    (at random in the usual formulation). A token without any training successor gets
    confidence and entropy 0; one not seen in training gets the uniform distribution.
    """
    table, n = model.table, F.lit(model.size).cast("long")
    wanted = cut(previous.select("prev").distinct())
    seen = model.tokens.select(F.col("token").alias("prev"), F.lit(True).alias("seen"))
    described = wanted.join(seen, "prev", "left").join(predictive_entropy(table), "prev", "left")
    known = F.col("seen").isNotNull()
    uniform = F.lit(1.0) / n.cast("double")
    summary = described.select(
        "prev",
        known.alias("prev_seen"),
        F.coalesce("n_successors", F.lit(0)).alias("n_have"),
        F.when(known, F.coalesce("confidence", F.lit(0.0))).otherwise(uniform).alias("confidence"),
        F.when(known, F.coalesce("entropy", F.lit(0.0)))
        .otherwise(-F.log(uniform + EPSILON))
        .alias("entropy"),
    )
    best = top_successors(table, k).select("prev", "slot", F.col("next").alias("token"))
    filled = fill_slots(
        summary.select("prev", "n_have"),
        model.tokens.select("rank", "token"),
        best,
        key="prev",
        value="token",
        start=F.pmod(hash32(model.seed, F.col("prev")), n),
        n_values=n,
        k=k,
    )
    lists = (
        best.join(wanted, "prev", "left_semi")
        .unionByName(filled)
        .groupBy("prev")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "token"))).alias("_l"))
        .select("prev", F.col("_l.token").alias("top_tokens"))
    )
    return summary.join(lists, "prev", "left").withColumnRenamed("n_have", "n_successors")


def pair_metrics(model: Transitions, pairs: DataFrame, *, k: int = DEFAULT_K) -> DataFrame:
    """The metrics of each distinct (prev, label) pair."""
    predictions = predict(model, pairs, k=k)
    probabilities = model.table.select("prev", F.col("next").alias("label"), "prob")
    hit = F.coalesce(F.array_contains("top_tokens", F.col("label")), F.lit(False))
    return (
        pairs.join(predictions, "prev")
        .join(probabilities, ["prev", "label"], "left")
        .select(
            "prev",
            "label",
            F.get("top_tokens", F.lit(0)).alias("pred"),
            F.coalesce(F.get("top_tokens", F.lit(0)) == F.col("label"), F.lit(False))
            .cast("int")
            .alias("correct"),
            hit.cast("int").alias("topk_correct"),
            F.when(F.col("prob") > 0, 0.0 - F.log("prob")).alias("ce"),
            "entropy",
            "confidence",
        )
    )


def score(
    model: Transitions,
    positions: DataFrame,
    *,
    skip_n: int = DEFAULT_SKIP,
    delta_cutoff: float | None = None,
    k: int = DEFAULT_K,
) -> DataFrame:
    """E5: metrics of every scored position of a test set."""
    scored = scored_positions(positions, skip_n=skip_n, delta_cutoff=delta_cutoff)
    labelled = scored.withColumnRenamed("token", "label")
    # The pairs are few and feed several joins, so they are stored.
    pairs = cut(labelled.select("prev", "label").distinct())
    metrics = pair_metrics(model, pairs, k=k)
    return lookup(labelled, metrics, ["prev", "label"])


def frequency_predictions(
    model: Transitions, labels: DataFrame, *, name: str, k: int = DEFAULT_K
) -> DataFrame:
    """A model without context: every position gets the training frequencies.

    The comparator for paired tests, as a table of predictions.
    """
    tokens = model.tokens.select("token", "n")
    total = tokens.agg(F.sum("n")).scalar()
    shares = tokens.withColumn("prob", F.col("n") / total)
    top = shares.orderBy(F.desc("prob"), "token").limit(k)
    listed = top.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("neg"), "token", "prob"))).alias("l")
    )
    entropy = shares.agg(F.sum(-F.col("prob") * F.log(F.col("prob") + EPSILON))).scalar()
    known = shares.select(F.col("token").alias("label"), F.col("prob").alias("label_prob"))
    return lookup(labels, known, ["label"]).select(
        F.lit(name).alias("model"),
        *labels.columns,
        listed.select("l.token").scalar().alias("top_tokens"),
        listed.select("l.prob").scalar().alias("top_probs"),
        "label_prob",
        entropy.alias("entropy"),
    )


NOWHERE = "<NOWHERE>"


def chain_moves(model: Transitions) -> DataFrame:
    """The moves of the chain, as ``(prev, next, prob)``.

    Tokens without a successor go to a state of its own, which moves on to every token
    alike. Leaving that state out of the stationary vector gives the vector of the chain
    in which such tokens spread their mass evenly, without a dense row for each of them.
    """
    table = model.table.select("prev", "next", "prob")
    tokens = model.tokens.select("token")
    dead_ends = tokens.join(
        table.select(F.col("prev").alias("token")).distinct(), "token", "left_anti"
    )
    nowhere = F.lit(NOWHERE)
    return table.unionByName(
        dead_ends.select(F.col("token").alias("prev"), nowhere.alias("next"), F.lit(1.0).alias("prob"))
    ).unionByName(
        tokens.select(nowhere.alias("prev"), F.col("token").alias("next"), F.lit(1.0 / model.size).alias("prob"))
    )


class NotConverged(RuntimeError):
    """The iteration did not settle within the steps allowed."""


def mixing_weights(products: np.ndarray) -> np.ndarray:
    """Weights, of sum 1, that make the weighted sum of residuals the shortest.

    ``products`` holds the inner products of the residuals, the newest last. The others enter
    by their difference to the newest, scaled to one length, so that old and large ones do
    not drown it.
    """
    k = len(products) - 1
    if not k:
        return np.ones(1)
    own, across = products[:k, :k], products[:k, k]
    apart = own - across[:, None] - across[None, :] + products[k, k]
    scale = np.sqrt(np.maximum(np.diag(apart), np.finfo(float).tiny))
    gain = np.linalg.lstsq(apart / np.outer(scale, scale), (products[k, k] - across) / scale, rcond=1e-13)[0] / scale
    return np.append(gain, 1.0 - gain.sum())


def entropy_rate(
    model: Transitions, *, tolerance: float = 1e-10, max_steps: int = 10_000, memory: int = 6
) -> tuple[DataFrame, DataFrame]:
    """Stationary distribution of the chain and its entropy rate and perplexity.

    Anderson's accelerated iteration from the uniform vector: a step sends the vector once
    through the sparse chain, and the next vector is that mixture of the last ``memory``
    images whose residual (image less vector) is the shortest. Every vector is a polynomial
    of the chain applied to the uniform one, with weights of sum 1, so the limit is that of
    plain averaging, also for chains that are periodic or fall into parts. A step is one
    stored table of a row per token; inner products and the residual are observed while it is
    written. Ends when the absolute residuals add up to at most ``tolerance``; the rate tells
    that sum and the number of steps. Raises ``NotConverged`` after ``max_steps``.
    """
    chain = cut(chain_moves(model))
    state = model.tokens.select("token", F.lit(1.0 / model.size).alias("x0"))
    state = state.unionByName(model.tokens.agg(F.lit(NOWHERE).alias("token"), F.lit(0.0).alias("x0")))
    kept: list[int] = []  # Numbers of the vectors whose images are stored beside them.
    for step in range(max_steps):
        new = f"x{step}"
        flows = state.join(chain, F.col("token") == F.col("prev")).select(
            F.col("next").alias("token"), (F.col(new) * F.col("prob")).alias(f"y{step}")
        )
        columns = [f"{c}{i}" for i in kept for c in "xy"] + [new, f"y{step}"]
        image = (
            state.unionByName(flows, allowMissingColumns=True)
            .groupBy("token")
            .agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns])
        )
        kept.append(step)
        residual = {i: F.col(f"y{i}") - F.col(f"x{i}") for i in kept}
        seen = Observation()
        products = [F.sum(residual[i] * residual[j]).alias(f"p{i}_{j}") for i in kept for j in kept if i <= j]
        state = cut(image.observe(seen, F.sum(F.abs(residual[step])).alias("left"), *products))
        told = seen.get
        left = told["left"] or 0.0
        if left <= tolerance:
            break
        matrix = np.array([[told[f"p{min(i, j)}_{max(i, j)}"] for j in kept] for i in kept])
        mixture = sum(F.lit(float(w)) * F.col(f"y{i}") for w, i in zip(mixing_weights(matrix), kept, strict=True))
        kept = kept[-memory:]
        state = state.select("token", *[f"{c}{i}" for i in kept for c in "xy"], mixture.alias(f"x{step + 1}"))
    else:
        raise NotConverged(f"residual {left} after {max_steps} steps")
    real = state.filter(F.col("token") != NOWHERE).select("token", F.col(f"y{step}").alias("p"))
    pi = real.withColumn("p", F.col("p") / real.agg(F.sum("p")).scalar())
    rate = (
        pi.join(model.table, F.col("token") == F.col("prev"))
        .agg(F.sum(-F.col("p") * F.col("prob") * F.log(F.col("prob") + EPSILON)).alias("entropy_rate"))
        .withColumn("perplexity", F.exp("entropy_rate"))
        .withColumns({"residual": F.lit(left), "steps": F.lit(step + 1)})
    )
    return pi, rate
