"""Permutations, grids read by group, contests that stop early, convergence over growing samples, gradients alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from transcurve.functions.curves import Curve
from transcurve.functions.permutation import Permutation
from transcurve.operators import blocked, evaluate, grid, kernel, quantile, score
from transcurve.operators.blocked import BlockedGrid, BlockPoint
from transcurve.plans import optimize
from transcurve.plans.fit import Fitter
from transcurve.plans.optimize import minimise, minimise_by_gradient
from transcurve.settings import Settings
from transcurve.spec import Entry, Model, StatusFamily

FAMILY = StatusFamily.simple(["C", "P", "D"])
TRUE = Model.create(FAMILY, "C").with_betas([[0.0], [-1.0], [-2.0]]).add_entry(Entry((("y", Curve("LOGISTIC", (0.5, 2.0))),), 1), 1.5)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 1000, 4096, 9_999])
def test_permutations_are_bijections(n):
    p = Permutation(n, 3)
    assert sorted(p.places(np.arange(n))) == list(range(n))
    assert n < 90 or (p.places(np.arange(n)) != Permutation(n, 4).places(np.arange(n))).mean() > 0.9


def test_permuted_columns_equal_numpy(spark):
    for n in (1, 7, 1000, (1 << 61) + 12345):
        p = Permutation(n, 5)
        values = sorted({0, n - 1, n // 2, *range(min(n, 300))})
        got = spark.createDataFrame([(v,) for v in values], "v long").select("v", p.column(F.col("v")).alias("at")).collect()
        assert {r.v: r["at"] for r in got} == dict(zip(values, p.places(np.array(values)).tolist(), strict=True))
    # few numbers lie beyond n, and none walks for long
    assert max(Permutation(n, 1).walks for n in (10, 1000, 10**6 + 3, 10**9 + 7)) < 12


def test_permuted_rows_are_random_samples(spark):
    n, size = 20_000, 500
    df = spark.range(n).select("id", (F.col("id") / n).alias("x"))  # sorted: contiguous blocks would differ
    rows = grid.permuted(df, ["id"], 9)
    assert rows.select("place").distinct().count() == n and rows.agg(F.max("place")).first()[0] == n - 1
    means = np.array([r.m for r in rows.groupBy(F.floor(F.col("place") / size)).agg(F.avg("x").alias("m")).collect()])
    z = (means - 0.5) / np.sqrt(1 / 12 / size)
    assert np.abs(z).max() < 4.5 and 0.6 < z.std() < 1.4
    assert [tuple(r) for r in grid.permuted(df.repartition(7), ["id"], 9).orderBy("id").collect()] == [tuple(r) for r in rows.orderBy("id").collect()]
    assert grid.permuted(df.limit(0), ["id"]).count() == 0


@pytest.fixture(scope="module")
def sampled(spark):
    return score.sample(spark.range(40_000).selectExpr("id", "rand(1) x", "randn(2) y", "'C' status"), TRUE, 5, "id", "nxt").cache()


@pytest.fixture(scope="module")
def bound(sampled):
    return sampled.withColumn("next_offset", grid.encode(F.col("nxt"), TRUE.reachable)).select("id", "x", "y", "next_offset").cache()


@pytest.fixture(scope="module")
def blocks(bound):
    return BlockedGrid.lay_out(bound, groups=32, keep=["x", "y", "next_offset"])


def test_groups_are_pruned_and_whole(bound, blocks):
    assert blocks.rows.count() == bound.count() and "id" not in blocks.rows.columns
    part = blocks.slice(3, 5)
    assert "PartitionFilters: [isnotnull(block_group" in part._jdf.queryExecution().executedPlan().toString()
    sizes = [r["count"] for r in blocks.rows.groupBy("block_group").count().collect()]
    assert len(sizes) == 32 and max(sizes) < 1.2 * min(sizes)
    assert blocks.ends() == [2, 4, 8, 16, 32]


def test_rows_with_maps_are_laid_out(spark):
    df = spark.range(50).select("id", F.create_map(F.lit("a"), F.col("id")).alias("m"), (F.col("id") / 7).alias("x"), F.lit("C").alias("s"), F.when(F.col("id") % 3 == 0, "P").otherwise("C").alias("t"))
    assert BlockedGrid.lay_out(df, groups=4, keep=["x"]).rows.count() == 50
    fitter = Fitter(df, FAMILY, "C", "s", "t", ["x"])
    assert fitter.grid.count() == 50
    fitter.close()


def test_points_go_on_where_they_stopped(bound, blocks):
    before, point = blocks.rows_read, BlockPoint(blocks, TRUE, kernel.FIRST)
    first = point.until(4)
    assert blocks.rows_read - before == first.n < bound.count() / 6
    whole = point.until(32)
    assert blocks.rows_read - before == whole.n == bound.count()
    plain = evaluate.evaluate(bound, TRUE, kernel.FIRST)
    assert whole.entropy == pytest.approx(plain.entropy) and np.allclose(whole.gradient, plain.gradient)
    assert point.until(32).entropy == whole.entropy and blocks.rows_read - before == bound.count()
    up = BlockPoint(blocks, TRUE).upgraded(kernel.SECOND)
    assert up.level == kernel.SECOND and np.allclose(up.until(32).hessian, evaluate.evaluate(bound, TRUE, kernel.SECOND).hessian)
    with pytest.raises(ValueError):
        point.until(3)


def test_comparisons_stop_when_decided(bound, blocks):
    far = TRUE.with_betas([[0.0, 0.0], [-1.0, -1.5], [-2.0, 0.0]])
    out = blocked.compare(blocks, TRUE, far)
    assert out.groups < 32 and out.winner == 0 and out.z >= blocked.DECIDED and out.n < bound.count() / 2
    back = blocked.compare(blocks, far, TRUE)
    assert (back.groups, back.winner, back.z) == (out.groups, 1, pytest.approx(-out.z))
    near = TRUE.with_betas([[0.0, 0.0], [-1.0, 1.5001], [-2.0, 0.0]])
    out = blocked.compare(blocks, TRUE, near)
    d = evaluate.evaluate(bound, near).entropy - evaluate.evaluate(bound, TRUE).entropy
    assert out.groups == 32 and out.n == bound.count() and out.difference == pytest.approx(d, abs=1e-12)
    assert blocked.compare(blocks, TRUE, TRUE).z == 0.0


def test_a_race_finds_the_best(bound, blocks):
    models = [TRUE.with_betas([[0.0, 0.0], [-1.0, b], [-2.0, 0.0]]) for b in (0.0, 3.0, 1.5, 1.2, -1.0)]
    full = [p.entropy for p in evaluate.evaluate_many(bound, models)]
    before = blocks.rows_read
    pair = [4, 2]
    one, two = blocked.race(blocks, [models, [models[i] for i in pair]])
    assert one.winner == int(np.argmin(full)) and two.winner == int(np.argmin([full[i] for i in pair]))
    assert two.groups < 32 and blocks.rows_read - before <= bound.count()
    # an offset decides between equals; a model that can't be evaluated never wins
    assert blocked.race(blocks, [[TRUE, TRUE]], offsets=[[0.0, -1e-9]])[0].winner == 1
    assert blocked.race(blocks, [[TRUE, TRUE.with_betas([[0.0, 0.0], [float("nan"), 0.0], [0.0, 0.0]])]])[0].winner == 0


def test_blocked_fits_reach_the_optimum(bound, blocks):
    start = TRUE.with_betas([[0.0, 0.0], [0.0, 0.3], [0.0, 0.0]]).add_beta("x")
    settings = Settings(z_score_cutoff=1e-4)
    plain = minimise(bound, start, settings)
    before = blocks.rows_read
    found = minimise(blocks, start, settings)
    trials = blocks.rows_read - before
    assert found.point.entropy == pytest.approx(plain.point.entropy, abs=1e-9) and found.point.n == bound.count()
    assert 0 < trials < 0.5 * found.steps * bound.count()  # what the trial steps of the plain fit read, and more
    l2 = Settings(target="L2", l2_lambda=1e-3)
    assert minimise(blocks, start, l2, lambda p: p[2] < 0).point.objective("L2", 1e-3) == pytest.approx(minimise(bound, start, l2, lambda p: p[2] < 0).point.objective("L2", 1e-3), abs=1e-10)


def test_fitter_over_groups(sampled):
    plain = Fitter(sampled, FAMILY, "C", "status", "nxt", ["x", "y"], Settings(polish_start_points=3))
    parts = Fitter(sampled, FAMILY, "C", "status", "nxt", ["x", "y"], Settings(polish_start_points=3, block_groups=16))
    assert parts.chain.last.entropy == pytest.approx(plain.chain.last.entropy) and parts.grid.count() == plain.grid.count()
    for f in (plain, parts):
        f.expand(["x", "y"], 3)
    assert parts.chain.last.entropy == pytest.approx(plain.chain.last.entropy, abs=2e-4) and parts.blocks.rows_read > 0
    assert parts.chain.model.entries[1].depth[0][0] == "y"
    plain.close(), parts.close()


# -- growing samples
def plain_stop(batches, buckets):
    """The batches that a loop over rows reads until its test passes."""
    seen = [[] for _ in range(buckets)]
    for i, rows in enumerate(batches, 1):
        for b, y in rows:
            seen[b].append(y)
        mean = [np.mean(s) if s else 0.0 for s in seen]
        var = [np.var(s, ddof=1) / len(s) if len(s) > 1 else 0.0 for s in seen]
        g = np.mean([y for s in seen for y in s])
        fails = [abs(mean[b]) <= 100 * np.sqrt(var[b]) and (mean[b] - mean[b + 1]) ** 2 < 9 * min(var[b], var[b + 1]) and (mean[b] - g) ** 2 < 9 * var[b] for b in range(buckets - 1)]
        if not any(fails):
            break
    return i, seen


@pytest.mark.parametrize("noise", [0.5, 3.0, 50.0])
def test_convergence_stops_where_a_loop_does(spark, noise):
    rng = np.random.default_rng(4)
    rows = [(i, int(b), float(b + noise * e)) for i, (b, e) in enumerate(zip(rng.integers(0, 5, 8000), rng.standard_normal(8000), strict=True))]
    df = spark.createDataFrame([*rows, (8000, None, 1.0), (8001, 2, None), (8002, 2, float("nan"))], "id long, b int, y double")
    laid = BlockedGrid.lay_out(df, groups=40, by=F.col("id") % 40)
    batches = [[(b, y) for i, b, y in rows if i % 40 == k] for k in range(40)]
    stop, seen = plain_stop(batches, 5)
    found, end = quantile.until_converged(laid.slice, range(1, 41), "b", F.col("y"), 5)
    assert end == stop and found.n.tolist() == [len(s) for s in seen]
    assert np.allclose(found.mean, [np.mean(s) for s in seen]) and np.allclose(found.mean_variance, [np.var(s, ddof=1) / len(s) for s in seen])
    assert (noise > 10) == (stop == 40)
    assert [r.n for r in quantile.moments_frame(spark, found).orderBy("bucket").collect()] == found.n.tolist()


def test_no_rows_converge_to_nothing(spark):
    laid = BlockedGrid.lay_out(spark.createDataFrame([(1, 0, None)], "id long, b int, y double"), groups=2)
    found, end = quantile.until_converged(laid.slice, [1, 2], "b", F.col("y"), 3)
    assert end == 2 and found.n.sum() == 0 and quantile.moments_frame(spark, found).count() == 0


# -- gradients alone
def test_gradients_alone_reach_the_newton_optimum_of_200_parameters(spark, monkeypatch):
    family = StatusFamily.simple(["A", "B", "C", "D", "E"])
    fields = [f"r{i}" for i in range(49)]
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 49)).round(3)
    truth = 0.3 * rng.standard_normal((5, 49))
    scores = x @ truth.T + rng.gumbel(size=(6000, 5))
    rows = [(*map(float, r), int(k)) for r, k in zip(x, scores.argmax(axis=1), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in fields) + ", next_offset int").repartition(4).cache()
    model = Model.create(family, "A")
    for f in fields:
        model = model.add_beta(f)
    assert len(model.places()) == 200
    newton = optimize.minimise_many(df, [model])[0]
    levels = []
    real = evaluate.sums
    monkeypatch.setattr(evaluate, "sums", lambda grid, models, level=0, *a: levels.append(level) or real(grid, models, level, *a))
    found = minimise(df, model)  # more than Settings.newton_params
    assert set(levels) == {kernel.VALUE, kernel.FIRST}
    assert found.point.entropy == pytest.approx(newton.point.entropy, abs=1e-9) and found.converged
    assert np.abs(found.point.model.pack() - newton.point.model.pack()).max() < 1e-3


def test_gradients_alone_on_curves_and_l2(bound):
    start = TRUE.unpack(TRUE.pack() + 0.2)
    for settings in (Settings(z_score_cutoff=1e-4), Settings(target="L2", l2_lambda=1e-3, z_score_cutoff=1e-4)):
        newton = optimize.minimise_many(bound, [start], settings)[0].point
        found = minimise_by_gradient(bound, start, settings).point
        assert found.objective(settings.target, settings.l2_lambda) <= newton.objective(settings.target, settings.l2_lambda) + 1e-7
    assert minimise_by_gradient(bound, start, wanted=lambda p: False).steps == 0
    with pytest.raises(ValueError):
        minimise_by_gradient(bound, start, Settings(target="ICE"))
    with pytest.raises(optimize.FitError):
        minimise_by_gradient(bound.limit(0), start)


def test_sums_are_added_by_model_before_the_driver(bound, monkeypatch):
    models = [TRUE, TRUE.add_beta("x")]
    plain = evaluate.evaluate_many(bound.repartition(6), models, kernel.SECOND)
    for name, value in (("GATHERED", 0), ("TREE", 3)):
        monkeypatch.setattr(evaluate, name, value)
        for a, b in zip(plain, evaluate.evaluate_many(bound.repartition(6), models, kernel.SECOND), strict=True):
            assert a.n == b.n and np.allclose(a.hessian, b.hessian) and a.entropy == pytest.approx(b.entropy)
