"""Interpolation of a table x -> y: flat beyond its ends, NaN for NaN."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Interpolated:
    """Linear or natural cubic interpolation through points with strictly increasing x."""

    def __init__(self, x: Sequence[float], y: Sequence[float], cubic: bool = False):
        self.x, self.y, self.cubic = np.asarray(x, float), np.asarray(y, float), cubic
        if len(self.x) != len(self.y) or not len(self.x) or not np.isfinite(self.x).all() or (np.diff(self.x) <= 0).any():
            raise ValueError("x must be finite and strictly increasing, y as long")
        self.second = self._natural() if cubic and len(self.x) > 2 else np.zeros(len(self.x))

    def _natural(self) -> np.ndarray:
        """Second derivatives at the points, zero at both ends."""
        h, n = np.diff(self.x), len(self.x)
        a = np.zeros((n, n))
        b = np.zeros(n)
        a[0, 0] = a[-1, -1] = 1
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            b[i] = 6 * ((self.y[i + 1] - self.y[i]) / h[i] - (self.y[i] - self.y[i - 1]) / h[i - 1])
        return np.linalg.solve(a, b)

    def __call__(self, v: np.ndarray | float) -> np.ndarray:
        v = np.asarray(v, float)
        if len(self.x) == 1:
            return np.where(np.isnan(v), np.nan, self.y[0])
        i = np.clip(np.searchsorted(self.x, v, "right") - 1, 0, len(self.x) - 2)
        u = np.clip(v, self.x[0], self.x[-1])
        h = self.x[i + 1] - self.x[i]
        a, b = (self.x[i + 1] - u) / h, (u - self.x[i]) / h
        bend = ((a**3 - a) * self.second[i] + (b**3 - b) * self.second[i + 1]) * h * h / 6
        return a * self.y[i] + b * self.y[i + 1] + bend

    def column(self, v: Column) -> Column:
        """The same as a Column: a balanced tree of comparisons over the points."""
        x, y, m = self.x.tolist(), self.y.tolist(), self.second.tolist()
        if len(x) == 1:
            return F.when(F.isnan(v), v).otherwise(F.lit(y[0]))

        def piece(i: int) -> Column:
            h = x[i + 1] - x[i]
            b = (v - x[i]) / h
            line = F.lit(y[i]) + b * (y[i + 1] - y[i])
            if not (m[i] or m[i + 1]):
                return line
            a = 1 - b
            return line + ((a * a * a - a) * m[i] + (b * b * b - b) * m[i + 1]) * (h * h / 6)

        def tree(lo: int, hi: int) -> Column:
            if hi - lo == 1:
                return piece(lo)
            mid = (lo + hi) // 2
            return F.when(v >= x[mid], tree(mid, hi)).otherwise(tree(lo, mid))

        return F.when(F.isnan(v), v).when(v <= x[0], F.lit(y[0])).when(v >= x[-1], F.lit(y[-1])).otherwise(tree(0, len(x) - 1))
