"""Sketches of shingle sets: registers of exponentially spaced, truncated minima, and their joint likelihood.

Every element of a set sends out points at random times, each to a random register; a register keeps the first
time that any element reaches it.  These minima are exponential with the set's size as rate, those of a union are the smaller of
two sketches' registers, and two registers are equal about as often as the sets are alike.  Times are stored as powers of
``BASE`` in 16 bits.  An element stops once its next point comes after all registers' times, so a
set of n elements takes about n + m log m points instead of n times m.
"""

from __future__ import annotations

import numpy as np

REGISTERS = 140
BASE = 1.001
_ZERO = 20_000  # the stored value of time 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed random-looking permutation of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def sketches(elements: np.ndarray, counts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers (sets, m) of sets given one after another; an empty set has all zeros."""
    sets = len(counts)
    owner = np.repeat(np.arange(sets), counts)
    first = np.full(sets * m, np.inf)
    time = np.zeros(len(elements))
    live, turn, points = np.arange(len(elements)), 0, 1
    while len(live):
        with np.errstate(over="ignore"):
            at = elements[live][:, None] + _GOLD * np.arange(turn + 1, turn + points + 1, dtype=np.uint64)[None]
            draw = mix(at)
        wait = -np.log(((draw >> np.uint64(24)).astype(np.float64) + 0.5) / 2.0**40) / m
        when = time[live][:, None] + np.cumsum(wait, axis=1)
        slot = (draw & np.uint64(0xFFFFFF)).astype(np.int64) % m
        np.minimum.at(first, (owner[live][:, None] * m + slot).ravel(), when.ravel())
        time[live] = when[:, -1]
        limit = first.reshape(sets, m).max(1)
        live = live[time[live] < limit[owner[live]]]
        turn += points
        points = min(32, points * 2) if turn > 2 else points
    with np.errstate(divide="ignore"):
        level = np.floor(_ZERO - np.log(first) / np.log(BASE))
    level[~np.isfinite(level)] = 0
    return np.clip(level, 0, 65535).astype(np.uint16).reshape(sets, m)


def log_likelihood(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, jaccard: np.ndarray, m: int) -> np.ndarray:
    """Of a similarity, given how many registers of a are above and below those of b, and the sets' sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    j = np.minimum(jaccard, np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    above, below = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    return more * np.log(above) + less * np.log(below) + (m - more - less) * np.log(np.maximum(1 - above - below, 1e-12))


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float, margin: float = 10.0) -> np.ndarray:
    """Whether pairs of sketches (rows of a and b) may be of sets with ``similarity`` or more.

    A pair is ruled out if its sizes do not allow it, or if its likeliest similarity explains the registers better than
    the nearest one at the threshold or above by ``margin`` in log-likelihood, about 4.5 standard deviations.
    """
    m = a.shape[1]
    more, less = (a > b).sum(1), (a < b).sum(1)
    size_a, size_b = n_a.astype(float), n_b.astype(float)
    likeliest = 1 - (more + less) / m  # the share of equal registers; BASE is close to 1
    best = log_likelihood(more, less, size_a, size_b, likeliest, m)
    above = log_likelihood(more, less, size_a, size_b, np.maximum(likeliest, similarity - 0.01), m)
    return (best - above <= margin) & (np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b))
