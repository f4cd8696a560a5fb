"""Softmax probabilities, entropies and their derivatives, as Columns and in numpy.

Scores below the best by more than ``FLOOR`` count as that; a row's entropy is at most ``CAP``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lowest score relative to the best, and highest entropy of a row.
FLOOR, CAP = -30.0, 14.0


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def probabilities(scores: Sequence[Column]) -> list[Column]:
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    raw = [F.exp(F.greatest(F.lit(FLOOR), s - best)) for s in scores]
    return [r / total(raw) for r in raw]


def entropy(p: Column) -> Column:
    """-ln p, at most CAP; unreachable outcomes (p null or 0) have the cap."""
    return F.when(p > math.exp(-CAP), -F.log(p)).otherwise(F.lit(CAP))


def chosen(p: Sequence[Column], actual: Column, same: Sequence[Sequence[int]]) -> Column:
    """Probability of the statuses that can't be told from the actual one; 0 for an unknown one."""
    out = F.lit(0.0)
    for k in range(len(p) - 1, -1, -1):
        out = F.when(actual == k, total([p[i] for i in same[k]])).otherwise(out)
    return out


def logit(x: Column) -> Column:
    return F.log(x / (1 - x))


def multi_logit(p: Sequence[Column], base: int) -> list[Column]:
    """Scores relative to a base case: the inverse of the softmax."""
    return [F.log(x / p[base]) for x in p]


def multi_logistic_entropy(p: Sequence[Column], actual: int) -> Column:
    return -F.log(p[actual])


def score_gradient(p: Sequence[Column], actual: Column) -> list[Column]:
    return [x - F.when(actual == k, 1.0).otherwise(0.0) for k, x in enumerate(p)]


def score_hessian(p: Sequence[Column]) -> list[list[Column]]:
    return [[(p[i] if i == j else F.lit(0.0)) - p[i] * p[j] for j in range(len(p))] for i in range(len(p))]


def choose(p: Sequence[Column], u: Column) -> Column:
    """The first status at which the cumulated probability reaches u."""
    out, upto = F.lit(len(p) - 1), None
    cums = []
    for x in p:
        upto = x if upto is None else upto + x
        cums.append(upto)
    for k in range(len(p) - 2, -1, -1):
        out = F.when(u <= cums[k], F.lit(k)).otherwise(out)
    return out


def np_probabilities(scores: np.ndarray) -> np.ndarray:
    """[statuses, rows] to the same."""
    raw = np.exp(np.maximum(FLOOR, scores - scores.max(axis=0)))
    return raw / raw.sum(axis=0)


def np_entropy(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > math.exp(-CAP), -np.log(p), CAP)
