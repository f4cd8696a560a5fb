import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from transcurve.functions.curves import Curve
from transcurve.operators import evaluate, grid, kernel, quantile, score
from transcurve.plans import diagnose, optimize
from transcurve.plans.fit import Fitter, load, save
from transcurve.plans.optimize import FitError, minimise
from transcurve.settings import Settings
from transcurve.sources import economic_series, grids
from transcurve.spec import Entry, Model, StatusFamily
from transcurve.streaming.score import write_scores

FAMILY = StatusFamily.simple(["C", "P", "D"])


def test_exact_quantiles(spark):
    rng = np.random.default_rng(8)
    for x in (rng.standard_normal(5000), rng.integers(0, 7, 3000).astype(float), np.array([3.0]), np.array([1.0, 2.0]), np.concatenate((np.zeros(900), rng.random(100)))):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
        for p in ([0.0, 0.1, 0.5, 0.99, 1.0], [i / 100 for i in range(100)]):
            assert quantile.exact_quantiles(df, "x", p, accuracy=200) == pytest.approx(np.quantile(x, p).tolist())
    assert quantile.exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == []


def test_guarded_fits_and_knobs(spark):
    rows = [(i, "F", "O" if (i * 7919) % 100 < 30 + 20 * (i % 2) else "F", float(i % 2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, status string, next_status string, f double")
    fitter = Fitter(df, StatusFamily(("F", "O")), "F", "status", "next_status", ["f"], Settings(complex_results=True), forbidden=lambda to, regressor, kind: kind == "GAUSSIAN")
    before = fitter.chain.last
    assert before.point.level == 2 and before.point.tic > 0  # all derivatives
    assert fitter.add_coefficients(["f"]) and fitter.chain.last.entropy < before.entropy and fitter.chain.last.aic_difference < -5
    model = fitter.chain.model
    worse = fitter.guarded("worse", Model.create(StatusFamily(("F", "O")), "F"), lambda p: False)
    assert worse.point is fitter.chain.last.point and fitter.chain.skipped == ["worse"] and fitter.chain.model == model
    assert {c.model.entries[-1].depth[0][1].type for c in fitter.candidates(model, ["f"])} <= {"LOGISTIC"}
    wrong = fitter.chain.last.point
    broken = type(wrong)(wrong.model, wrong.level, wrong.sums | {"h": wrong.sums["h"] * 0.5})
    with pytest.raises(FitError):
        fitter.chain.force("validated", broken)
    fitter.close()


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(3000).selectExpr("id", "rand(1) x", "randn(2) y", "cast(rand(3) * 3 as int) next_offset").cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def model():
    m = Model.create(FAMILY, "C").add_beta("x").add_entry(Entry((("y", Curve("LOGISTIC", (0.5, 2.0))),), 1), 0.7, -0.2)
    m = m.add_entry(Entry((("x", Curve("GAUSSIAN", (0.3, 0.5))), ("y", None)), 2), 0.4)
    return m.unpack(m.pack() + 0.1 * np.random.default_rng(0).standard_normal(len(m.places())))


def test_derivatives_are_differences(rows, model):
    p = evaluate.evaluate(rows, model, kernel.SECOND)
    assert np.allclose(p.gradient, evaluate.gradient_difference(rows, model), atol=1e-8)
    theta, eye = model.pack(), np.eye(len(model.places()))
    for i in (0, 3, 6):
        g = [evaluate.evaluate(rows, model.unpack(theta + s * 1e-5 * eye[i]), kernel.FIRST).gradient for s in (1, -1)]
        assert np.allclose((g[0] - g[1]) / 2e-5, p.hessian[i], atol=1e-7)
    assert np.allclose(p.hessian, p.hessian.T) and np.allclose(np.diag(p.hessian), p.mean("j")) and np.allclose(np.diag(p.fisher), p.mean("g2"))


def test_kernel_equals_columns(rows, model):
    r = evaluate.entropy_frame(rows, model).first()
    p = evaluate.evaluate(rows, model)
    assert r.mean_h == pytest.approx(p.entropy, rel=1e-12) and r.dev_h == pytest.approx(p.entropy_dev, rel=1e-9)


def test_unreachable_outcome_has_the_cap_and_no_gradient(spark, model):
    df = spark.createDataFrame([(0.1, 0.2, None)], "x double, y double, next_offset int")
    p = evaluate.evaluate(df, model, kernel.FIRST)
    assert p.entropy == 14 and not p.gradient.any()
    assert score.with_entropy(df, model).first().entropy == 14


def test_empty_grid(spark, rows, model):
    assert evaluate.evaluate(rows.limit(0), model).n == 0
    with pytest.raises(FitError):
        minimise(rows.where("false"), model)


@pytest.mark.parametrize("n", [1, 999, 1000, 1999, 2000, 2500])
def test_blocks(spark, n):
    found = {r.block_id: r["count"] for r in grid.blocks(spark.range(n), ["id"]).groupBy("block_id").count().collect()}
    full = max(1, n // 1000)
    assert found == {b: 1000 if b < full - 1 else n - 1000 * (full - 1) for b in range(full)}


def test_ranged_transitions_of_a_hot_entity(spark):
    rows = spark.range(5000).selectExpr("cast(if(id % 3 = 0, id % 7, 9) as int) e", "id t", "cast(id * id % 11 as string) s")
    a, b = grid.transitions(rows, "e", ["t"], "s"), grid.transitions_ranged(rows, "e", ["t"], "s")
    assert sorted(map(str, a.select("e", "t", "s", "next_status").collect())) == sorted(map(str, b.select("e", "t", "s", "next_status").collect()))


def test_quantiles_with_odd_values(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, float("nan"), float("inf"), None, -3.0)], "x double")
    e = quantile.edges(df, ["x"], 4, approximate=False)["x"]
    assert e.count == 3 and e.values == (-3.0, -1.0, 1.0, 1.5)
    found = [r[0] for r in df.select(quantile.bucket(F.col("x"), e.values)).collect()]
    assert found == [2, 3, None, None, None, 0]
    r = df.agg(*quantile.variance_stats(F.col("x"))).first()
    assert (r.n, r.mean) == (3, 0.0) and r.variance == pytest.approx(7.0)
    one = df.limit(1).agg(*quantile.variance_stats(F.col("x"))).first()
    assert one.variance == 0 and quantile.trimmed(100, 0.05) == (5, 95)
    with pytest.raises(ValueError):
        quantile.trimmed(100, 0.5)


def test_ties_take_the_last_edge(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(quantile.bucket(F.col("x"), [1.0, 1.0, 2.0, 2.0])).collect()] == [1, 3]


def test_welford_stream(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 1.0, 4.0, 1.8, 0.3, 9.9, 0.01)], "x double")
    r = df.agg(*quantile.variance_stats(F.col("x"))).first()
    assert r.mean == pytest.approx(2.572857142857143) and r.variance == pytest.approx(12.167157142857144)


TRUE = Model.create(FAMILY, "C").with_betas([[0.0], [-1.0], [-2.0]]).add_entry(Entry((("y", Curve("LOGISTIC", (0.5, 2.0))),), 1), 1.5)


@pytest.fixture(scope="module")
def fitter(spark):
    df = score.sample(spark.range(20000).selectExpr("id", "rand(1) x", "randn(2) y", "'C' status"), TRUE, 5, "id", "nxt")
    f = Fitter(df, FAMILY, "C", "status", "nxt", ["x", "y"], Settings(polish_start_points=5))
    f.expand(["x", "y"], 3)
    return f


def test_fit_recovers_the_curve(fitter):
    entry = fitter.chain.model.entries[1]
    assert entry.depth[0][0] == "y" and entry.restrict == 1
    aics = [r.aic for r in fitter.chain.results]
    assert aics == sorted(aics, reverse=True)
    theta, dev = fitter.chain.model.pack(), fitter.detail().param_std()
    if entry.depth[0][1].type == "LOGISTIC":
        assert (np.abs(theta - TRUE.pack()) < 5 * dev + 0.05).all()


def test_starts_to_refit(fitter):
    found = fitter.candidates(Model.create(FAMILY, "C"), ["x", "y"])
    order, settings = list(range(len(found))), fitter.settings
    kinds = {(c.regressor, c.status, c.model.entries[-1].depth[0][1].type) for c in found}
    try:
        for starts, want in ((1, len(kinds)), (2, 2 * len(kinds)), (0, len(found))):
            fitter.settings = Settings(refit_starts=starts)
            assert len(fitter._varied(order, found)) == want
    finally:
        fitter.settings = settings


def test_noise_is_trimmed(fitter):
    before = fitter.chain.last
    fitter.chain.force("noise", fitter._fit(before.model.add_beta("x")))
    assert fitter.trim() >= 1 and "x" not in fitter.chain.model.regressors


def test_a_bad_curve_is_calibrated(fitter):
    best = fitter.chain.last
    entry = best.model.entries[1]
    bad = Entry(((entry.depth[0][0], Curve("LOGISTIC", (2.5, 0.7))),), entry.restrict)
    fitter.chain.force("bad", evaluate.evaluate(fitter.grid, best.model.drop(1).add_entry(bad, 0.3)))
    assert fitter.calibrate() == 1 and fitter.chain.last.aic < best.aic + 20
    fitter.chain.force("bad", evaluate.evaluate(fitter.grid, best.model.drop(1).add_entry(bad, 0.3)))
    assert fitter.calibrate(anew=True) == 1 and fitter.chain.last.aic < best.aic + 5


def test_targets(fitter):
    for target in ("L2", "ICE_RAW", "ICE_SIMPLE", "ICE2", "ICE", "ICE_B", "ICE_STABLE_B"):
        settings = Settings(target=target, l2_lambda=1e-3, max_steps=4)
        p = minimise(fitter.grid, Model.create(FAMILY, "C"), settings).point
        assert p.entropy < math.log(3) and p.objective(target, 1e-3) >= p.entropy - 1e-12


ICE = ["ICE_RAW", "ICE_SIMPLE", "ICE2", "ICE", "ICE_B", "ICE_STABLE_B"]


def by_differences(grid, model, target, step=1e-4):
    """The penalty's gradient by central differences of fourth order, all shifts in one pass."""
    theta, eye = model.pack(), np.eye(len(model.places()))
    points = iter(evaluate.evaluate_many(grid, [model.unpack(theta + k * step * e) for e in eye for k in (1, -1, 2, -2)], kernel.SECOND))
    out = []
    for _ in eye:
        a, b, c, d = (p.objective(target) - p.entropy for p in (next(points) for _ in range(4)))
        out.append((8 * (a - b) - (c - d)) / (12 * step))
    return np.array(out)


@pytest.mark.parametrize("target", ICE)
def test_penalty_gradients_are_differences(rows, model, target):
    point = evaluate.evaluate_many(rows, [model], kernel.SECOND)[0]
    found = evaluate.exact_penalty_gradients(rows, [point], target)[0]
    want = by_differences(rows, model, target)
    assert np.abs(found - want).max() < 1e-6 * max(1.0, np.abs(want).max())


def test_third_derivatives_are_differences():
    x = np.linspace(-3, 4, 50)
    for kind, a, b in (("LOGISTIC", 0.5, 1.3), ("LOGISTIC", 0.2, -0.8), ("GAUSSIAN", 0.4, 0.9), ("GAUSSIAN", 0.4, -1.1)):
        h = 1e-4
        by_a = (Curve(kind, (a + h, b)).hessian(x) - Curve(kind, (a - h, b)).hessian(x)) / (2 * h)
        by_b = (Curve(kind, (a, b + h)).hessian(x) - Curve(kind, (a, b - h)).hessian(x)) / (2 * h)
        found = Curve(kind, (a, b)).third(x)
        assert np.allclose(found, np.stack((by_a[0], by_a[1], by_a[2], by_b[2])), atol=1e-5) and np.allclose(found[1], by_b[0], atol=1e-5) and np.allclose(found[2], by_b[1], atol=1e-5)


@pytest.mark.parametrize("target", ICE)
def test_targets_reach_the_optimum_of_differences(fitter, target, monkeypatch):
    settings, model = Settings(target=target), Model.create(FAMILY, "C").add_beta("x")
    found = minimise(fitter.grid, model, settings)
    monkeypatch.setattr(optimize, "exact_penalty_gradients", lambda grid, points, target: [by_differences(grid, p.model, target) for p in points])
    plain = minimise(fitter.grid, model, settings)
    assert found.converged and found.point.objective(target) == pytest.approx(plain.point.objective(target), abs=1e-9)


def test_points_are_kept_for_a_cached_grid(fitter, rows, model, monkeypatch):
    passes = []
    monkeypatch.setattr(evaluate, "sums", lambda grid, models, *a: passes.append(len(models)) or real(grid, models, *a))
    m = Model.create(FAMILY, "C").add_beta("x").with_betas([[0, 0], [0.123, 0], [0, 0.321]])
    first = evaluate.evaluate_many(fitter.grid, [m], kernel.FIRST)[0]
    again, other = evaluate.evaluate_many(fitter.grid, [m, m.with_betas([[0, 0], [0.124, 0], [0, 0.321]])])
    assert again is first and other.entropy != first.entropy and passes == [1, 1]
    assert evaluate.evaluate_many(fitter.grid, [m], kernel.SECOND)[0].level == kernel.SECOND and passes == [1, 1, 1]
    evaluate.evaluate_many(rows.where("x < 2"), [m])
    evaluate.evaluate_many(rows.where("x < 2"), [m])
    assert passes == [1] * 5


real = evaluate.sums


def test_results_and_models_are_stored(spark, fitter, tmp_path):
    save(fitter.chain.last, str(tmp_path / "r"), spark)
    model, d = load(str(tmp_path / "r"), spark)
    assert model == fitter.chain.model and d["entropy"] == fitter.chain.last.entropy
    grids.write_model(spark, model, str(tmp_path / "m"))
    assert grids.read_model(spark, str(tmp_path / "m")) == model


def test_reports(spark, fitter, tmp_path):
    edges = quantile.edges(fitter.grid, ["x", "y"], 20)
    rows = diagnose.report(fitter.grid, fitter.chain.model, edges)
    assert rows.columns == ["from_status", "to_status", "regressor", "value", "mass", "observed", "model", "theoretical"]
    assert diagnose.graph(rows, "P", "y", "MODEL")(0.0) > 0
    buckets = diagnose.bucket_report(fitter.grid, fitter.chain.model, edges)
    assert buckets.groupBy("to_status", "regressor").agg(F.sum("mass").alias("m")).where("abs(m - 1) > 1e-9").count() == 0
    assert len(diagnose.qq_plot(buckets, "P", "y")) == 20
    diagnose.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == rows.count()


def test_grids_are_checked_and_stored(spark, rows, tmp_path):
    grids.write(rows, str(tmp_path / "g"), ["x"])
    assert dict(grids.read(spark, str(tmp_path / "g"), ["x", "y"]).dtypes)["x"] == "float"
    with pytest.raises(grids.SchemaError):
        grids.check(rows, ["z"])
    assert grids.from_arrays(spark, {"a": [1, 2]}).count() == 2


def test_stream(spark, rows, model, tmp_path):
    rows.select("x", "y").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, y double").parquet(str(tmp_path / "in"))
    write_scores(stream, model, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == rows.count() and out.where("abs(p_C + p_P + p_D - 1) > 1e-9").count() == 0


def test_series_files(spark, tmp_path):
    for kind, key, text in (
        ("series", "S", '<seriess><series id="S" title="T" realtime_start="2024-01-01" last_updated="2024-01-02 07:01:02-06" popularity="7"/></seriess>'),
        ("observations", "S", '<observations><observation date="2020-01-01" value="."/><observation date="2020-02-01" value="2"/></observations>'),
        ("children", "1", '<categories><category id="2" name="B" parent_id="1"/><category id="1" name="A" parent_id="1"/></categories>'),
        ("series", "E", '<all><error code="400" message="Bad request"/></all>'),
    ):
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / f"{key}.xml").write_text(text)
    store = economic_series.Store(spark, str(tmp_path))
    meta, values = store.series("S")
    r = meta.first()
    assert (r.series_id, str(r.realtime_start), str(r.last_updated), r.popularity) == ("S", "2024-01-01", "2024-01-02 13:01:02", 7)
    assert [x.value for x in values.collect()] == [2.0]
    assert [x.id for x in store.children(1).collect()] == [2]
    tree = economic_series.categories(spark, str(tmp_path / "children" / "1.xml"))
    assert {(x.id, x.depth) for x in economic_series.descendants(tree, 1).collect()} == {(1, 0), (2, 1)}
    for _ in range(2):
        with pytest.raises(economic_series.SeriesError):
            store.series("E")
    with pytest.raises(economic_series.SeriesError):
        store.series("none")
