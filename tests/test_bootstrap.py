"""Draws against their distributions, and the bootstraps built on them."""

import math

import numpy as np
import pytest
from helpers import plan
from pyspark.sql import functions as F

from seqtrail.functions import draws
from seqtrail.operators import bootstrap

SCORES = "model string, seq_id long, pos long, correct int, topk_correct int, ce double, entropy double, confidence double"


@pytest.mark.parametrize("mean", [1, 3, 40, 1000, 250_000])
def test_poisson_draws_follow_their_distribution(mean):
    u = draws.uniforms(draws.replicate_coefficients(5, 20_000), "key")
    drawn = draws.poisson(mean, u)
    assert abs(drawn.mean() - mean) < 5 * math.sqrt(mean / len(u))
    assert drawn.var() / mean == pytest.approx(1.0, abs=0.06)
    # Inversion is exact: the share of values up to k is that of uniform values below P(X <= k).
    for k in {0, mean // 2, mean, mean + int(2 * math.sqrt(mean))}:
        below = math.fsum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(max(0, k - int(40 * math.sqrt(mean)) - 40), k + 1))
        assert abs((drawn <= k).sum() - (u < below).sum()) <= 1


@pytest.mark.parametrize("trials, part, whole", [(1, 1, 2), (7, 1, 3), (300, 150, 299), (100_000, 3, 5)])
def test_binomial_draws_follow_their_distribution(trials, part, whole):
    u = draws.uniforms(draws.replicate_coefficients(6, 20_000), "node")
    drawn = draws.binomial(np.full(len(u), trials), part, whole, u)
    p = part / whole
    assert drawn.min() >= 0 and drawn.max() <= trials
    assert abs(drawn.mean() - trials * p) < 5 * math.sqrt(trials * p * (1 - p) / len(u))
    assert drawn.var() / (trials * p * (1 - p)) == pytest.approx(1.0, abs=0.06)
    assert (draws.binomial(np.zeros(4, np.int64), part, whole, u[:4]) == 0).all()


def test_keys_and_replicates_are_uncorrelated():
    coefficients = draws.replicate_coefficients(1, 4000)
    values = np.array([draws.uniforms(coefficients, f"k{i}") for i in range(30)])
    near = np.corrcoef(values)
    assert np.abs(near - np.eye(30)).max() < 0.08 and abs(values.mean() - 0.5) < 0.01


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1024, 1025, 2500])
def test_each_replicate_draws_exactly_as_many_as_there_are(n):
    coefficients = draws.replicate_coefficients(9, 40)
    blocks = [bootstrap.multinomial(n, low, min(low + bootstrap.BLOCK, n), coefficients, 9) for low in range(0, n, bootstrap.BLOCK)]
    drawn = np.concatenate(blocks, axis=1)
    assert drawn.shape == (40, n) and (drawn.sum(1) == n).all() and (drawn >= 0).all()
    if n > 1000:  # counts of a place are binomial(n, 1 / n): mean 1, variance 1 - 1 / n
        assert drawn.var() == pytest.approx(1.0, abs=0.05)


def test_partitions_do_not_change_the_draws(spark):
    df = spark.createDataFrame([(i, i % 5, 4) for i in range(1500)], "seq_id long, hits long, n long")
    one, six = (bootstrap.cluster_bootstrap(df.repartition(p), "seq_id", ["hits"], "n", n_replicates=60, seed=4).first() for p in (1, 6))
    assert [one[c] for c in ("bootstrap_mean", "ci_low", "ci_high")] == pytest.approx([six[c] for c in ("bootstrap_mean", "ci_low", "ci_high")])


def test_nothing_is_shuffled_by_replicate_and_sequence(spark):
    df = spark.createDataFrame([(i, i % 3, 3) for i in range(50)], "seq_id long, hits long, n long")
    text = plan(bootstrap.cluster_bootstrap(df, "seq_id", ["hits"], "n", n_replicates=20))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("b#" in line and "_key" in line for line in exchanges)
    assert "Generate" not in text[text.index("FlatMapGroupsInArrow"):]


def positions(spark, n=900):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        for model, values in (("one", 3), ("two", 5)):
            v = int(rng.integers(values))
            rows.append((model, i // 9, i % 9, int(v == 0), int(v < 2), None if v == 2 else 0.25 * v, 0.5 * v, 0.1 * (v + 1)))
    return spark.createDataFrame(rows, SCORES)


def test_positions_are_counted_by_their_values(spark):
    single = bootstrap.value_counts(positions(spark), ["model"])
    joint = bootstrap.value_counts(positions(spark), ["model"], ["seq_id", "pos"])
    assert (single.count(), single.agg(F.sum("n")).first()[0]) == (8, 1800)
    assert (joint.count(), joint.agg(F.sum("n")).first()[0]) == (15, 900)


def test_spread_of_counted_positions_matches_theory(spark):
    df = positions(spark)
    for paired in (False, True):
        stats = bootstrap.replicate_statistics(df, ["seq_id", "pos"], n_replicates=600, seed=8, paired=paired)
        for model, p in (("one", 1 / 3), ("two", 1 / 5)):
            got = stats.filter(F.col("model") == model).agg(F.avg("accuracy"), F.stddev("accuracy"), F.count("nn_accuracy")).first()
            raw = df.filter(F.col("model") == model).agg(F.avg("correct")).first()[0]
            assert got[0] == pytest.approx(raw, abs=0.004) and abs(raw - p) < 0.1
            assert got[1] == pytest.approx(math.sqrt(raw * (1 - raw) / 900), rel=0.12) and got[2] == 0


def test_pairs_share_their_weights(spark):
    df = positions(spark).filter("model = 'one'")
    both = df.unionByName(df.withColumn("model", F.lit("copy")))
    stats = bootstrap.replicate_statistics(both, ["seq_id", "pos"], n_replicates=50, seed=8, paired=True)
    wide = stats.groupBy("b").agg(F.min("perplexity").alias("x"), F.max("perplexity").alias("y"), F.min("ece").alias("z"), F.max("ece").alias("w"))
    assert wide.filter("abs(x - y) > 1e-12 or abs(z - w) > 1e-12").count() == 0


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCORES)
    assert bootstrap.replicate_statistics(empty, ["seq_id", "pos"], n_replicates=5).count() == 0
    none = spark.createDataFrame([], "seq_id long, hits long, n long")
    got = bootstrap.cluster_bootstrap(none, "seq_id", ["hits"], "n", n_replicates=5).collect()
    assert all(r.bootstrap_mean is None for r in got)


def test_single_weights_are_those_of_the_uniform_values():
    coefficients = draws.replicate_coefficients(3, 300)
    keys = [f"3|{i // 9}|{i % 9}" for i in range(700)]
    points = np.array([draws._points(k) for k in keys])
    got = draws.poisson_weights(coefficients, points[:, 0], points[:, 1])
    want = [np.searchsorted(draws.poisson_cdf(), draws.uniforms(coefficients, k), side="right") for k in keys]
    assert (got == np.array(want)).all() and got.mean() == pytest.approx(1.0, abs=0.01)


def test_every_position_has_a_weight_of_its_own(spark):
    df = positions(spark, 120).filter("model = 'one'")
    got = {r.b: r.accuracy for r in bootstrap.replicate_statistics(df, ["seq_id", "pos"], n_replicates=30, seed=8).collect()}
    coefficients = draws.replicate_coefficients(8, 30)
    rows = df.select("seq_id", "pos", "correct").collect()
    weights = np.array([np.searchsorted(draws.poisson_cdf(), draws.uniforms(coefficients, f"8|{r.seq_id}|{r.pos}"), side="right") for r in rows])
    want = (weights * np.array([[r.correct] for r in rows])).sum(0) / weights.sum(0)
    assert [got[b] for b in range(30)] == pytest.approx(list(want), abs=1e-12)
