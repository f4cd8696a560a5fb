"""Whitening against a plain eigendecomposition, and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from transcurve.llm import whitening
from transcurve.llm.whitening import State

ROWS = "vec_id long, embedding array<float>, label int, x string, id int"


def plain(vectors, k=4):
    """n, deviation and whitened by vector, explained shares: the definition, by a covariance matrix."""
    x = np.floor(256 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    d = n * x - sums
    return n, (d * d).sum(axis=1), (x - sums / n) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "clash", 1) for i, v in rows], ROWS).repartition(parts)


def test_table_equals_eigendecomposition(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, deviation, white, explained = plain(np.stack(table.embedding))
    got = whitening.query(spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 4 * len(table) and (got.n == n).all()
    assert (got.deviation.to_numpy().reshape(-1, 4) == deviation[:, None]).all()
    mine = got.whitened.to_numpy().reshape(-1, 4)
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-9
    assert np.allclose(got.explained.to_numpy().reshape(-1, 4), explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_merging_loses_nothing():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (1000, 12)) + rng.integers(0, 9000, 12)
    cuts = [0, 1, 3, 4, 300, 301, 990, 1000]  # states of fewer rows than dimensions too
    states = [State.of(x[a:b], True) for a, b in zip(cuts, cuts[1:], strict=False)]
    left, pairs = states[0], [states[i].merged(states[i + 1]) if i + 1 < len(states) else states[i] for i in range(0, len(states), 2)]
    for s in states[1:]:
        left = left.merged(s)
    tree = pairs[0].merged(pairs[1]).merged(pairs[2].merged(pairs[3]))
    c = x - x.mean(axis=0)
    for s in (left, tree):
        assert s.n == 1000 and s.sums == x.sum(axis=0).tolist() and len(s.s) == 12
        assert np.allclose((s.vt.T * s.s**2) @ s.vt, c.T @ c, rtol=0, atol=1e-10 * (c.T @ c).max())


@pytest.mark.parametrize("parts", [1, 100])
def test_any_tree(spark, parts):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(300, 6)).round(3).tolist()
    rows = whitening.whole(frame(spark, enumerate(vectors), parts)).select("vec_id", "x")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        fitted = whitening.fit(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    n, _, white, explained = plain(vectors)
    mine = fitted.whiten(np.floor(256 * np.asarray(vectors, np.float32).astype(float)))
    assert fitted.n == n and np.allclose(np.abs(mine), np.abs(white), atol=1e-9) and np.allclose(fitted.explained, explained)


def test_copies_weigh_once(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(50, 5)).tolist()
    vectors += [vectors[0]] * 400
    n, deviation, white, _ = plain(vectors)
    got = whitening.whole(frame(spark, enumerate(vectors)))
    got = whitening.whiten(got, whitening.fit(got)).toPandas().sort_values(["vec_id", "component"])
    assert n == 50 and (got.n == 50).all() and len(got) == 4 * 450
    assert np.allclose(np.abs(got.whitened.to_numpy().reshape(-1, 4)), np.abs(white), atol=1e-9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [0.1 * i, 1.0 - 0.3 * i * i]) for i in range(5)]
    odd = [(10, None), (11, [nan, 1.0]), (12, [inf, 1.0]), (13, [None, 1.0]), (14, [1e38, 1.0]), (None, [0.1, 0.7]), (0, [0.0, 1.0]), (15, [1.0, 2.0, 3.0]), (16, [])]
    rows = whitening.whole(frame(spark, good + odd)).select("vec_id", "x")
    got = whitening.whiten(rows, whitening.fit(rows)).collect()
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == [0, 1, 2, 3, 4, 15, 16]
    assert len(got) == 2 * (5 + 1 + 1 + 2)  # two components of two dimensions; the repeated and the null id stay
    assert all((r.whitened is None) == (r.vec_id in (15, 16)) == (r.deviation is None) for r in got)
    # no variance in one direction, in none, and no rows
    flat = whitening.whole(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 2.0])]))
    assert {(r.component, r.whitened is None, r.explained) for r in whitening.whiten(flat, whitening.fit(flat)).collect()} == {(1, False, 1.0), (2, True, 0.0)}
    one = whitening.whole(frame(spark, [(1, [0.5, 1.0])]))
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(one, whitening.fit(one)).collect()} == {(0, None, 0.0, None)}
    assert whitening.fit(rows.limit(0)) is None
    assert whitening.fit(rows.where(F.col("vec_id") == 16)) is None


def test_deviation_beyond_64_bits():
    fitted = whitening.Fit(10, (0, 0), np.eye(2), np.ones(2), np.ones(2) / 2)
    assert fitted.deviation(np.array([[1 << 40, 1], [3, 4]])) == [None, 2500]
    wide = whitening.Fit(1 << 20, (5, -5), np.eye(2), np.ones(2), np.ones(2) / 2)
    x = np.array([[1 << 10, 1], [3, -4]])
    want = [sum(((1 << 20) * int(v) - s) ** 2 for v, s in zip(r, wide.sums, strict=True)) for r in x]
    assert wide.deviation(x) == want
