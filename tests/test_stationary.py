"""The accelerated iteration against plain averaging with dense matrices."""

import numpy as np
import pytest

import __spark_entry__ as entry_points
from seqtrail.operators import markov

ORDER = "seq_id long, pos long, token string"


def model_of(spark, sequences):
    data = [(s, i, t) for s, ts in enumerate(sequences) for i, t in enumerate(ts)]
    return markov.fit(markov.with_previous(spark.createDataFrame(data, ORDER), ["seq_id"]))


def plain(model, steps=20_000):
    """The vector that averaging with the lazy dense chain ends in."""
    rows = markov.chain_moves(model).collect()
    tokens = [r.token for r in model.tokens.collect()]
    at = {t: i for i, t in enumerate([*tokens, markov.NOWHERE])}
    p = np.zeros((len(at), len(at)))
    for r in rows:
        p[at[r.prev], at[r.next]] += r.prob
    lazy = 0.5 * (p + np.eye(len(at)))
    x = np.append(np.full(len(tokens), 1 / len(tokens)), 0.0)
    lazy = np.linalg.matrix_power(lazy, steps)
    x = (x @ lazy)[:-1]
    return dict(zip(tokens, x / x.sum(), strict=True))


@pytest.mark.parametrize("sequences", [
    ["ababababa", "cabab"],  # periodic, entered from c
    ["aabba", "ccddc", "eac"],  # two closed parts: the uniform start decides
    ["abc", "abd"],  # dead ends
    ["aaaa"],
])
def test_limit_of_special_chains(spark, sequences):
    model = model_of(spark, sequences)
    pi, rate = markov.entropy_rate(model)
    want = plain(model)
    got = {r.token: r.p for r in pi.collect()}
    assert [got[t] for t in sorted(want)] == pytest.approx([want[t] for t in sorted(want)], abs=1e-8)
    assert rate.first()["residual"] <= 1e-10


def test_a_slow_chain_needs_few_steps(spark):
    rng = np.random.default_rng(5)
    # Two halves of forty tokens that are seldom left: plain averaging needs some hundred steps.
    sequences = []
    for half in (0, 40):
        for _ in range(40):
            at, walk = half, []
            for _ in range(60):
                walk.append(f"t{at}")
                side = half if rng.random() > 0.02 else 40 - half
                at = side + int(rng.integers(40))
            sequences.append(walk)
    model = model_of(spark, sequences)
    pi, rate = markov.entropy_rate(model)
    want = plain(model)
    got = {r.token: r.p for r in pi.collect()}
    assert max(abs(got[t] - want[t]) for t in want) < 1e-8 and rate.first()["steps"] <= 25


def test_the_query_tells_that_the_iteration_settled(spark, folder):
    got = entry_points.queries()["entropy_rate"](spark, folder)
    assert got.columns == ["entropy_rate", "perplexity", "converged"] and got.first()["converged"]
