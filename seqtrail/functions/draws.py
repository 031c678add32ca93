"""Seeded random draws inside tasks: their values follow from seed, key and replicate alone.

A draw is made by inverting the exact distribution function at a uniform value, and the
uniform values of a key in all replicates come from a polynomial hash of degree 3 over a
Mersenne prime (Carter-Wegman). Keys enter with 62 bits of their MD5: draws at keys that
share the first 31 are still independent two by two, others four by four. Uniform values
have 31 bits, so what is less likely than 5e-10 is not told apart.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np

PRIME = 2**31 - 1
#: Standard deviations, and some more, on both sides of the mean that a distribution's table covers.
WIDE, MORE = 9, 30


def _points(text: str) -> tuple[int, int]:
    digest = hashlib.md5(text.encode()).hexdigest()
    return int(digest[:8], 16) % PRIME, int(digest[8:16], 16) % PRIME


def replicate_coefficients(seed: int, n: int) -> np.ndarray:
    """Four polynomial coefficients of each of ``n`` replicates."""
    return np.array([[_points(f"{seed}|{b}|{j}")[0] for j in range(4)] for b in range(n)], np.int64).reshape(n, 4)


def uniforms(coefficients: np.ndarray, text: str) -> np.ndarray:
    """A value in [0, 1) for the key ``text`` in every replicate."""
    point, second = _points(text)
    a0, a1, a2, a3 = coefficients.T
    value = (a3 * point + a2) % PRIME
    value = (value * point + a1) % PRIME
    value = (value * point + a0) % PRIME
    return ((value + a2 * second % PRIME) % PRIME) / float(PRIME)


@lru_cache(maxsize=4096)
def _poisson_table(mean: int) -> tuple[int, np.ndarray]:
    """Least value covered, and the distribution function from there on."""
    reach = WIDE * math.sqrt(mean) + MORE
    low, high = max(0, math.floor(mean - reach)), math.ceil(mean + reach)
    first = low * math.log(mean) - mean - math.lgamma(low + 1)
    steps = math.log(mean) - np.log(np.arange(low + 1, high + 1))
    return low, np.cumsum(np.exp(first + np.concatenate(([0.0], np.cumsum(steps)))))


def poisson(mean: int, u: np.ndarray) -> np.ndarray:
    """Poisson draws of a whole mean of at least 1: the sum of so many draws of mean 1."""
    low, table = _poisson_table(mean)
    return low + np.searchsorted(table, u, side="right")


def poisson_cdf(terms: int = 12) -> list[float]:
    """Cumulative probabilities of a Poisson variable of mean 1."""
    total, out = 0.0, []
    for k in range(terms):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
    return out


@lru_cache(maxsize=1)
def _weight_table() -> tuple[np.ndarray, np.ndarray]:
    """Least numerators whose uniform value reaches each edge, and the weight of each run of 2**15 numerators (255: several)."""
    edges = np.array([next(v for v in range(max(0, int(e * PRIME) - 2), PRIME + 2) if v / float(PRIME) >= e) for e in poisson_cdf()])
    first, last = (np.searchsorted(edges, np.arange(1 << 16) * (1 << 15) + d, side="right") for d in (0, (1 << 15) - 1))
    return edges, np.where(first == last, first, 255).astype(np.uint8)


def poisson_weights(coefficients: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """Poisson(1) weight of each key, told by its two points, in every replicate: (keys, replicates).

    By inversion of the uniform value that ``uniforms`` gives for the key.
    """
    x, y, prime = p1.astype(np.uint64)[:, None], p2.astype(np.uint64)[:, None], np.uint64(PRIME)
    square = x * x % prime
    a0, a1, a2, a3 = coefficients.astype(np.uint64).T
    # Three products below 2**62 and a summand below 2**31 fit into 64 bits.
    value = (square * x % prime) * a3
    value += ((square + y) % prime) * a2
    value += x * a1
    value += a0
    # 2**31 is 1 modulo the prime, so the upper bits are added to the lower ones.
    for _ in range(2):
        upper = value >> np.uint64(31)
        value &= prime
        value += upper
    value = value.astype(np.int64)
    value[value >= PRIME] -= PRIME
    edges, table = _weight_table()
    weights = table[value >> 15]
    open_runs = weights == 255
    weights[open_runs] = np.searchsorted(edges, value[open_runs], side="right")
    return weights


@lru_cache(maxsize=65536)
def _binomial_table(trials: int, part: int, whole: int) -> tuple[int, np.ndarray]:
    p = part / whole
    reach = WIDE * math.sqrt(trials * p * (1 - p)) + MORE
    low, high = max(0, math.floor(trials * p - reach)), min(trials, math.ceil(trials * p + reach))
    first = math.lgamma(trials + 1) - math.lgamma(low + 1) - math.lgamma(trials - low + 1)
    first += low * math.log(p) + (trials - low) * math.log1p(-p)
    k = np.arange(low, high)
    steps = np.log((trials - k) / (k + 1.0)) + math.log(part / (whole - part))
    return low, np.cumsum(np.exp(first + np.concatenate(([0.0], np.cumsum(steps)))))


def binomial(trials: np.ndarray, part: int, whole: int, u: np.ndarray) -> np.ndarray:
    """Binomial draws with chance part / whole, which lies strictly between 0 and 1."""
    out = np.zeros(len(trials), np.int64)
    for n in np.unique(trials):
        at = np.flatnonzero(trials == n)
        low, table = _binomial_table(int(n), part, whole)
        out[at] = np.minimum(low + np.searchsorted(table, u[at], side="right"), n)
    return out
