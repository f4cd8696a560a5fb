import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from transcurve.functions import criteria, curves, random, softmax, vectors
from transcurve.functions.curves import Curve
from transcurve.operators.interpolate import Interpolated
from transcurve.spec import Entry, Model, ModelError, StatusFamily

X = np.linspace(-3, 4, 41)


def test_known_curve_points():
    assert Curve("GAUSSIAN", (0.5, 3.0)).value(np.array([2.2]))[0] == pytest.approx(0.8516705072294409, abs=1e-15)
    assert Curve("LOGISTIC", (0.5, 3.0)).value(np.array([0.7]))[0] == pytest.approx(0.8581489350995121, abs=1e-15)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["LOGISTIC", "GAUSSIAN"]), st.floats(-2, 2), st.floats(0.2, 3))
def test_curve_derivatives_are_differences(kind, a, b):
    step = 1e-5
    curve = lambda da, db: Curve(kind, (a + da, b + db))
    g = curve(0, 0).gradient(X)
    h = curve(0, 0).hessian(X)
    for i, (da, db) in enumerate(((step, 0), (0, step))):
        assert np.allclose((curve(da, db).value(X) - curve(-da, -db).value(X)) / (2 * step), g[i], atol=1e-6)
        d = (curve(da, db).gradient(X) - curve(-da, -db).gradient(X)) / (2 * step)
        assert np.allclose(d[i], h[2 * i], atol=1e-5) and np.allclose(d[1 - i], h[1], atol=1e-5)


def test_columns_equal_numpy(spark):
    df = spark.createDataFrame([(float(x),) for x in X], "x double")
    for kind, params in (("LOGISTIC", (0.3, 1.4)), ("GAUSSIAN", (0.3, 1.4)), ("GAUSSIAN", (0.3, 0.0)), ("STEP", (-1.0, 2.0)), ("BASIS", (0.5, 2.0))):
        curve = Curve(kind, params)
        found = [r[0] for r in df.select(curve("x")).collect()]
        assert np.allclose(found, curve.value(X), atol=1e-14)


def test_softmax_floor_and_cap():
    p = softmax.np_probabilities(np.array([[100.0], [44.3], [21.6], [94.7]]))[:, 0]
    assert p == pytest.approx([0.9950331983497579, 9.311145511636196e-14, 9.311145511636196e-14, 0.00496680165005605])
    assert softmax.np_entropy(np.array([0.0, math.exp(-15), 0.5])).tolist() == [14.0, 14.0, math.log(2)]


def test_criteria():
    assert criteria.aic(0.5, 100, 3) == 106
    assert criteria.aic_difference(2, 4, 0.5, 0.4, 100) == pytest.approx(-16)
    assert criteria.compare_rounded(1.0, 2.0) == -1 and criteria.compare_rounded(2.0, 1.0) == 1 and criteria.compare_rounded(1.0, 1.0 + 1e-12) == 0
    with pytest.raises(ValueError):
        criteria.compare_rounded(-1.0, 1.0)
    g2, j = np.array([0.2, 0.3]), np.array([0.2, 0.3])
    for f in (criteria.ice_sum, criteria.ice3_sum):
        assert f(g2, j) == pytest.approx(2)
    assert criteria.ice2_sum(g2, j, 1000) == pytest.approx(2)
    eye = np.eye(2)
    assert criteria.tic(0.5, 100, eye, eye) == pytest.approx(criteria.aic(0.5, 100, 2))
    assert criteria.param_std(4 * eye, 100).tolist() == [0.05, 0.05]
    assert criteria.inverse_condition(np.diag([1.0, 4.0])) == 0.25


def test_interpolation():
    line = Interpolated([0, 1, 3], [0, 2, 0])
    assert line(np.array([-1, 0.5, 2, 9])).tolist() == [0, 1, 1, 0] and math.isnan(line(math.nan))
    cubic = Interpolated([0, 1, 2, 3], [0, 1, 0, 1], cubic=True)
    assert np.allclose(cubic(np.array([0, 1, 2, 3.0])), [0, 1, 0, 1])
    for x in ([0, 0], [1, 0], [0, math.inf]):
        with pytest.raises(ValueError):
            Interpolated(x, [0, 1])


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(vectors.dot("a", "b"), vectors.cosine("a", "b"), vectors.cosine("a", "z"), vectors.distance("a", "b"), vectors.axpy("a", "b", 2.0), vectors.max_abs("a"), vectors.well_defined("a")).first()
    assert (r[0], round(r[1], 6), r[2], round(r[3], 6), r[4], r[5], r[6]) == (24.0, 0.96, 1.0, round(2**0.5, 6), [11.0, 10.0], 4.0, True)
    h = spark.createDataFrame([("abc",)], "s string").select(vectors.hash_long("s")).first()[0]
    assert h == vectors.py_hash_long("abc")
    assert vectors.matrix_norm(np.diag([1.0, 3.0])) == 3 and vectors.np_cosine(np.zeros(2), np.ones(2)) == 1.0


def test_model_edits_and_documents():
    family = StatusFamily.simple(["A", "B", "C"])
    m = Model.create(family, "A").add_beta("x").add_beta("x")
    assert len(m.entries) == 2 and m.parameter_count == 4 and len(m.places()) == 4
    m = m.add_entry(Entry((("y", Curve("LOGISTIC", (0.0, 1.0))),), 1), 0.5, 0.25)
    assert m.betas[1][0] == 0.25 and m.parameter_count == 7 and len(m.places()) == 7
    assert np.allclose(m.unpack(m.pack()).pack(), m.pack())
    assert Model.from_json(m.to_json()) == m and m.flag_set() == ("x",)
    assert m.drop_regressor("y").regressors == ("x",)
    assert m.with_filters(lambda model, k, e: e == 1).frozen(2, 1)
    with pytest.raises(ModelError):
        m.drop(0)
    with pytest.raises(ModelError):
        m.add_entry(Entry((("y", Curve("LOGISTIC", (0.0, 1.0))),), 0))
    with pytest.raises(ModelError):
        StatusFamily.simple(["A", "A"])
    assert family.restrict(["A", "B"]).from_("A") == ("A", "B") and family.fingerprint() != StatusFamily.binary().fingerprint()


def test_ice_derivatives():
    g2, shift, j, n = np.array([0.2, 0.3, 0.1, 1e-30]), np.array([0.04, -0.1, 0.05, 0.2]), np.array([0.25, 0.3, -0.1, 0.4]), 1000.0
    b = 1 / (n * math.log(3))
    balanced = [0.04 / (0.25 * (1 - b) + 0.2 * b) / n, 0, 0.05 / (0.1 * b) / n, 0]
    assert criteria.ice_derivative(g2, shift, j, n) == pytest.approx(balanced)
    w = math.exp(-criteria.TOLERANCE * 0.4 / 0.25)
    assert criteria.ice_stable_derivative(g2, shift, j, n) == pytest.approx([0.04 / (0.25 * w + 0.2 * (1 - w)) / n, 0, 0.05 / 0.1 / n, 0])
    for f in (criteria.ice_derivative, criteria.ice_stable_derivative):
        assert not f(g2, shift, j, 0).any() and not f(0 * g2, shift, j, n).any() and not len(f(g2[:0], shift[:0], j[:0], n))
    theta = np.array([1.0, -2.0])
    assert criteria.penalty_gradient("L2", n, theta, l2=0.5).tolist() == [1.0, -2.0] and not criteria.penalty_gradient("ENTROPY", n, theta).any()
    assert criteria.penalty_gradient("ICE", n, theta, scaled=theta, scaled2=-theta).tolist() == [0.001, -0.002]
    assert criteria.penalty_gradient("ICE_B", n, theta, scaled=theta, scaled2=-theta).tolist() == [-0.001, 0.002]
    with pytest.raises(ValueError):
        criteria.penalty_gradient("none", n, theta)


def test_matrices(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0], [7.0, 8.0]], [(0, 1, 2.5), (0, 1, 1.0)])], "a array<array<double>>, b array<array<double>>, e array<struct<row:int,column:int,value:double>>")
    r = df.select(
        vectors.matrix_scale("a", 2.0).alias("scale"), vectors.matrix_add("a", "b").alias("add"), vectors.matrix_subtract("b", "a").alias("subtract"),
        vectors.matrix_axpy("a", "b", 0.5).alias("axpy"), vectors.to_dense("e", 2, 2).alias("dense"),
    ).first()
    a, b = np.array([[1.0, 2.0], [3.0, 4.0]]), np.array([[5.0, 6.0], [7.0, 8.0]])
    for found, wanted in ((r.scale, 2 * a), (r.add, a + b), (r.subtract, b - a), (r.axpy, a + b / 2), (r.dense, [[0, 3.5], [0, 0]])):
        assert np.array_equal(found, wanted)


def test_generators():
    assert random.Rc4(b"Key").bytes(10).hex() == "eb9f7781b734ca72a719"  # a published key stream
    for kind in random.KINDS:
        x = random.generator(kind, 7).random(4000)
        assert np.array_equal(x, random.generator(kind, 7).random(4000)) and not np.array_equal(x, random.generator(kind, -7).random(4000))
        assert 0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.03 and random.generator(kind).random(1)[0] >= 0
    with pytest.raises(ValueError):
        random.generator("none")
