"""Curve types: each maps a number to a weight, as a Column and as numpy arrays.

Register further types with ``register``; the built-in fitted family is LOGISTIC and
GAUSSIAN. STEP and BASIS splines can be evaluated but aren't proposed by the fitter.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Square root of the spacing of doubles at 4: the least width of a gaussian, relative and absolute.
ROOT_EPS = math.sqrt(math.ulp(4.0))


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class CurveType:
    """A curve family: parameters (centre, width), value, first and second derivatives.

    ``gradient`` returns [2, n]; ``hessian`` returns [3, n]: 11, 12, 22; ``third``, where given, [4, n]: 111, 112, 122, 222
    (else differences of the second ones stand in). ``canonical``
    brings parameters that mean the same curve to one form.
    """

    name: str
    build: Callable[[Column, float, float], Column]
    value: Callable[[np.ndarray, float, float], np.ndarray]
    gradient: Callable[[np.ndarray, float, float], np.ndarray]
    hessian: Callable[[np.ndarray, float, float], np.ndarray]
    canonical: Callable[[float, float], tuple[float, float]] = lambda a, b: (a, b)
    fitted: bool = True
    third: Callable[[np.ndarray, float, float], np.ndarray] | None = None


def _sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-z))


def _logistic_gradient(x: np.ndarray, c: float, s: float) -> np.ndarray:
    v = _sigmoid(s * s * (x - c))
    w = v * (1 - v)
    return np.stack((-s * s * w, 2 * s * (x - c) * w))


def _logistic_hessian(x: np.ndarray, c: float, s: float) -> np.ndarray:
    v = _sigmoid(s * s * (x - c))
    w, slope = v * (1 - v), 1 - 2 * v
    d = x - c
    return np.stack((s**4 * w * slope, -2 * s * w - 2 * s**3 * d * w * slope, 2 * d * w + 4 * s * s * d * d * w * slope))


def gaussian_width(m: float, s: float) -> float:
    return max(abs(s), ROOT_EPS * max(abs(m), ROOT_EPS))


def _gaussian(x: np.ndarray, m: float, s: float) -> np.ndarray:
    return np.exp(-((x - m) ** 2) / (2 * gaussian_width(m, s) ** 2))


def _gaussian_gradient(x: np.ndarray, m: float, s: float) -> np.ndarray:
    w = gaussian_width(m, s)
    z, f, sign = (x - m) / w, _gaussian(x, m, s), -1.0 if s < 0 else 1.0
    return np.stack((z / w * f, sign * z * z / w * f))


def _gaussian_hessian(x: np.ndarray, m: float, s: float) -> np.ndarray:
    w = gaussian_width(m, s)
    z, f, sign = (x - m) / w, _gaussian(x, m, s), -1.0 if s < 0 else 1.0
    return np.stack(((z * z - 1) * f, sign * z * (z * z - 2) * f, (z**4 - 3 * z * z) * f)) / (w * w)


def _logistic_third(x: np.ndarray, c: float, s: float) -> np.ndarray:
    v, d = _sigmoid(s * s * (x - c)), x - c
    w = v * (1 - v)
    w2, w3 = w * (1 - 2 * v), w * (1 - 6 * w)
    return np.stack((-(s**6) * w3, 2 * s**5 * d * w3 + 4 * s**3 * w2, -4 * s**4 * d * d * w3 - 10 * s * s * d * w2 - 2 * w, 8 * s**3 * d**3 * w3 + 12 * s * d * d * w2))


def _gaussian_third(x: np.ndarray, m: float, s: float) -> np.ndarray:
    w = gaussian_width(m, s)
    z, f, sign = (x - m) / w, _gaussian(x, m, s), -1.0 if s < 0 else 1.0
    return np.stack(((z**3 - 3 * z) * f, sign * (z**4 - 5 * z * z + 2) * f, (z**5 - 7 * z**3 + 6 * z) * f, sign * (z**6 - 9 * z**4 + 12 * z * z) * f)) / w**3


def _step_gradient(x: np.ndarray, a: float, w: float) -> np.ndarray:
    inside = (x > a) & (x < a + w)
    return np.stack((np.where(inside, -1 / w, 0.0), np.where(inside, -(x - a) / (w * w), 0.0)))


def _basis_gradient(x: np.ndarray, c: float, r: float) -> np.ndarray:
    d = x - c
    inside = np.abs(d) < r
    return np.stack((np.where(inside, np.sign(d) / r, 0.0), np.where(inside, np.abs(d) / (r * r), 0.0)))


def _flat(x: np.ndarray, a: float, b: float) -> np.ndarray:
    return np.zeros((3, len(x)))


TYPES: dict[str, CurveType] = {}


def register(kind: CurveType) -> CurveType:
    """Add a curve type, by name; replaces one of that name."""
    TYPES[kind.name] = kind
    return kind


LOGISTIC = register(
    CurveType(
        "LOGISTIC", lambda x, c, s: 1 / (1 + F.exp(F.lit(-(s * s)) * (x - c))), lambda x, c, s: _sigmoid(s * s * (x - c)), _logistic_gradient, _logistic_hessian, lambda c, s: (c, abs(s)), third=_logistic_third
    )
)
GAUSSIAN = register(
    CurveType("GAUSSIAN", lambda x, m, s: F.exp(-F.pow(x - m, F.lit(2.0)) / (2 * gaussian_width(m, s) ** 2)), _gaussian, _gaussian_gradient, _gaussian_hessian, lambda m, s: (m, abs(s)), third=_gaussian_third)
)
STEP = register(
    CurveType(
        "STEP", lambda x, a, w: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / w)), lambda x, a, w: np.clip((x - a) / w, 0.0, 1.0), _step_gradient, _flat, fitted=False
    )
)
BASIS = register(
    CurveType(
        "BASIS", lambda x, c, r: 1 - F.least(F.abs(x - c), F.lit(r)) / r, lambda x, c, r: 1 - np.minimum(np.abs(x - c), r) / r, _basis_gradient, _flat, fitted=False
    )
)


@dataclass(frozen=True, order=True)
class Curve:
    """A curve of a type; ordered and compared by type, then parameters."""

    type: str
    params: tuple[float, float]

    def __call__(self, x: Column | str) -> Column:
        return TYPES[self.type].build(column(x), *self.params)

    def value(self, x: np.ndarray) -> np.ndarray:
        return TYPES[self.type].value(x, *self.params)

    def gradient(self, x: np.ndarray) -> np.ndarray:
        return TYPES[self.type].gradient(x, *self.params)

    def hessian(self, x: np.ndarray) -> np.ndarray:
        return TYPES[self.type].hessian(x, *self.params)

    def third(self, x: np.ndarray) -> np.ndarray:
        """Third derivatives [4, n]: 111, 112, 122, 222."""
        kind, (a, b) = TYPES[self.type], self.params
        if kind.third:
            return kind.third(x, a, b)
        step = 1e-5 * max(1.0, abs(a), abs(b))
        by_a = (kind.hessian(x, a + step, b) - kind.hessian(x, a - step, b)) / (2 * step)
        by_b = (kind.hessian(x, a, b + step) - kind.hessian(x, a, b - step)) / (2 * step)
        return np.stack((by_a[0], by_a[1], by_a[2], by_b[2]))

    def canonical(self) -> Curve:
        return Curve(self.type, tuple(float(p) for p in TYPES[self.type].canonical(*self.params)))


def logistic(x: Column | str, centre: float, slope: float) -> Column:
    return Curve("LOGISTIC", (centre, slope))(x)


def gaussian(x: Column | str, mean: float, width: float) -> Column:
    return Curve("GAUSSIAN", (mean, width))(x)


def logistic_derivatives(x: Column | str, c: float, s: float) -> tuple[Column, Column]:
    """By centre and by slope, as Columns."""
    v = logistic(x, c, s)
    return -(s * s) * v * (1 - v), 2 * s * (column(x) - c) * v * (1 - v)


def gaussian_derivatives(x: Column | str, m: float, s: float) -> tuple[Column, Column]:
    """By mean and by width, as Columns."""
    w = gaussian_width(m, s)
    z, f = (column(x) - m) / w, gaussian(x, m, s)
    return z / w * f, z * z / w * f
