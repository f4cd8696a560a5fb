"""Vector, matrix and hash functions: over array columns, and in numpy for the driver."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 1 if either is zero."""
    below = magnitude(a) * magnitude(b)
    return F.when(below == 0, 1.0).otherwise(dot(a, b) / below)


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def scale(a: Column | str, by: float) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def axpy(a: Column | str, b: Column | str, by: float) -> Column:
    """a + by * b."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double") * by)


def max_abs(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))


def well_defined(a: Column | str) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))


def matrix_scale(m: Column | str, by: float) -> Column:
    """A matrix is an array of rows."""
    return F.transform(m, lambda r: scale(r, by))


def matrix_add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, add)


def matrix_subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, subtract)


def matrix_axpy(a: Column | str, b: Column | str, by: float) -> Column:
    """a + by * b."""
    return F.zip_with(a, b, lambda x, y: axpy(x, y, by))


def matrix_multiply(m: Column | str, v: Column | str) -> Column:
    """The matrix times a vector."""
    return F.transform(m, lambda r: dot(r, v))


def to_dense(entries: Column | str, rows: int, columns: int) -> Column:
    """A matrix from an array of structs (row, column, value): places not named are 0, those named twice are added."""
    at = lambda i, j: F.aggregate(F.filter(entries, lambda e: (e["row"] == i) & (e["column"] == j)), F.lit(0.0), lambda s, e: s + e["value"].cast("double"))
    return F.array(*[F.array(*[at(i, j) for j in range(columns)]) for i in range(rows)])


def sha256(*columns: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *columns), 256)


def hash_long(*columns: Column | str) -> Column:
    """The first eight bytes of the digest, big-endian and signed."""
    h = F.substring(sha256(*columns), 1, 16)
    high, low = F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def py_hash_long(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big", signed=True)


def np_cosine(a: np.ndarray, b: np.ndarray) -> float:
    below = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / below) if below else 1.0


def matrix_norm(m: np.ndarray) -> float:
    """The largest singular value."""
    return float(np.linalg.svd(m, compute_uv=False)[0]) if m.size else 0.0


def estimate_dot(a: np.ndarray, b: np.ndarray, samples: int, seed: int = 0) -> float:
    """A dot product estimated from randomly drawn places."""
    at = np.random.default_rng(seed).integers(0, len(a), samples)
    return float(a[at] @ b[at] * len(a) / samples)
