"""Second-order jets: arrays [3, ...] of the coefficients of 1, e and e^2 of a function along a line.

Arithmetic on them is forward-mode differentiation: what goes in as a point plus e times a
direction comes out with its first derivative and half its second one along it.
"""

from __future__ import annotations

import numpy as np


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack((a[0] * b[0], a[0] * b[1] + a[1] * b[0], a[0] * b[2] + a[1] * b[1] + a[2] * b[0]))


def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b; where b is 0 the result means nothing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        first = a[0] / b[0]
        second = (a[1] - first * b[1]) / b[0]
        return np.stack((first, second, (a[2] - first * b[2] - second * b[1]) / b[0]))


def softmax(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The jets of probabilities whose values are p [statuses, n], from those of their scores s [3, statuses, n]."""
    mean = (p * s[1]).sum(axis=0)
    one = s[1] - mean
    two = s[2] - ((p * (s[2] + s[1] ** 2 / 2)).sum(axis=0) - mean**2 / 2)
    return np.stack((p, p * one, p * (two + one**2 / 2)))


def curve(value: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, third: np.ndarray, da: float, db: float) -> tuple[np.ndarray, np.ndarray]:
    """Jets of a two-parameter function [3, n] and of its gradient [2, 3, n] along a direction of its parameters."""
    (g1, g2), (h11, h12, h22), (t111, t112, t122, t222) = gradient, hessian, third
    first, second = h11 * da + h12 * db, h12 * da + h22 * db
    own = np.stack((value, g1 * da + g2 * db, (first * da + second * db) / 2))
    bend = lambda a, b, c: (a * da * da + 2 * b * da * db + c * db * db) / 2
    return own, np.stack((np.stack((g1, first, bend(t111, t112, t122))), np.stack((g2, second, bend(t112, t122, t222)))))
