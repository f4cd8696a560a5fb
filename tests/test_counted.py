import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from transcurve import queries, sampled_queries
from transcurve.functions.curves import Curve
from transcurve.operators import counted as counts
from transcurve.operators import evaluate, kernel, quantile
from transcurve.operators.counted import ROWS, Tables, counted, tables
from transcurve.plans.fit import Fitter
from transcurve.spec import Entry, Model, StatusFamily

FAMILY = StatusFamily.simple(["C", "P", "D"])


@pytest.fixture(scope="module")
def rows(spark):
    """Rows of few values, with nulls and NaN, and of one column without equals."""
    x = "case when id % 97 = 0 then null when id % 89 = 0 then cast('nan' as double) else cast(id * 7919 % 11 as double) / 10 end x"
    return spark.range(4000).selectExpr(x, "cast(id * 104729 % 7 as double) - 3 y", "rand(4) z", "cast(rand(3) * 3 as int) next_offset").cache()


@pytest.fixture(scope="module")
def model():
    m = Model.create(FAMILY, "C").add_beta("y").add_entry(Entry((("y", Curve("LOGISTIC", (0.5, 2.0))),), 1), 0.7, -0.2).add_entry(Entry((("y", Curve("GAUSSIAN", (0.3, 0.5))),), 2), 0.4)
    return m.unpack(m.pack() + 0.1 * np.random.default_rng(0).standard_normal(len(m.places())))


def test_counted_rows_give_the_sums_of_all(rows, model):
    few = counted(rows, ["x", "y"])
    assert few.count() < rows.count() / 10 and few.agg(F.sum(ROWS)).first()[0] == 4000
    again = counted(few, ["y"])
    assert again.count() == 21 and again.agg(F.sum(ROWS)).first()[0] == 4000
    for level in (kernel.VALUE, kernel.FIRST, kernel.SECOND):
        previous = None if level == kernel.VALUE else np.linspace(-0.1, 0.2, len(model.places()))
        a, b = (evaluate.evaluate(g, model, level, previous) for g in (rows, again))
        assert a.n == b.n and all(np.allclose(a.sums[name], b.sums[name]) for name in a.sums)
    (a,), (b,) = (evaluate.differences(g, [[model, model.add_beta("y")]], [model.drop(1)]) for g in (rows, again))
    assert np.allclose(a, b)
    point = evaluate.evaluate(rows, model, kernel.SECOND)
    for target in ("ICE", "ICE_RAW"):
        assert np.allclose(*(evaluate.exact_penalty_gradients(g, [point], target)[0] for g in (rows, again)))
    edges = {"x": [0.0, 0.25, 0.5], "y": [-3.0, 0.0]}
    for find in (evaluate.ratio_sums, evaluate.bucket_sums):
        a, b = (find(g, model, edges) for g in (rows, few))
        assert a.keys() == b.keys() and all(np.allclose(a[key], b[key]) for key in a)


def test_tables_are_made_where_rows_repeat(rows, model):
    grid = Tables.attach(rows.select("*").cache(), ["x", "y", "z"])
    kinds = [("y",), ("z",), (), ("y", "z")]
    found = {tuple(kinds[i] for i in at): table for table, at in tables(grid, kinds)}
    assert {key for key in found} == {(("y",), ()), (("z",), ("y", "z"))}  # what has few rows serves its own columns too
    assert found[("z",), ("y", "z")] is grid and found[("y",), ()].count() == 21
    models = [model, model.drop(1, 2, 3), model.add_beta("z"), model.drop(2)]
    plain, own = (evaluate.evaluate_many(g, models, kernel.SECOND) for g in (rows, grid))
    for a, b in zip(plain, own, strict=True):
        assert b.model == a.model and a.n == b.n and a.entropy == pytest.approx(b.entropy) and np.allclose(a.hessian, b.hessian)
    edges = {"z": [0.0, 0.5], "y": [-3.0, 0.0]}
    a, b = (evaluate.ratio_sums(g, model, edges) for g in (rows, grid))
    assert list(a) == list(b) and all(np.allclose(a[key], b[key]) for key in a)
    grid.__dict__["_tables"].unpersist()
    assert not found[("y",), ()].is_cached


def passes(monkeypatch):
    """The rows that the passes of a query read, and the most that one reads."""
    read, real = [], evaluate._added
    monkeypatch.setattr(evaluate, "_added", lambda grid, *a: read.append(grid.count()) or real(grid, *a))
    return read


# a copy of a table holds the same distinct rows: what passes read mustn't grow with it
@pytest.mark.parametrize(
    "query, most",
    [
        (sampled_queries.fit_annealed_saturated, 4),
        (queries.trim_model, 1200),
        (sampled_queries.fit_calibrated_saturated, 4),
        (sampled_queries.fit_interaction_saturated, 8),
        (sampled_queries.fit_gradient_saturated, 60),
    ],
)
def test_passes_of_closed_fits_read_distinct_rows(spark, monkeypatch, query, most):
    read = passes(monkeypatch)
    assert query(spark, SF).count() > 0 and read and max(read) <= most


@pytest.mark.parametrize("query, most", [("fit_model_curves", 1 << 14), ("anneal_model", 1 << 14)])
def test_passes_of_fits_read_distinct_rows(spark, monkeypatch, tmp_path, query, most):
    """Ten copies of the lines: 60,000 rows, of which 12,000 are distinct at most."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    keys = F.max("l_orderkey").alias("n")
    shift = lines.agg(keys).first().n + 1
    lines.crossJoin(spark.range(10)).withColumn("l_orderkey", F.col("l_orderkey") + shift * F.col("id")).drop("id").write.parquet(f"{tmp_path}/lineitem.parquet")
    read = passes(monkeypatch)
    found = queries.QUERIES[query](spark, str(tmp_path)).collect()
    assert len(found) > 2 and [r.aic for r in found] == sorted((r.aic for r in found), reverse=True) and max(read) <= most


def test_edges_of_counted_rows_are_those_of_all(spark, rows):
    few = counted(rows, ["x", "y"])
    for names, table in ((["x", "y"], few), (["z"], counted(rows, ["z"]))):
        for approximate, buckets in ((True, 3), (True, 100), (False, 100)):
            a, b = (quantile.edges(g, names, buckets, approximate=approximate) for g in (rows, table))
            for c in a:
                assert a[c].count == b[c].count and a[c].values == pytest.approx(b[c].values, abs=1e-15) and (a[c].mean, a[c].mean_dev) == pytest.approx((b[c].mean, b[c].mean_dev))
    one = few.where("x = 0.1").limit(1).withColumn(ROWS, F.lit(1.0))
    assert quantile.edges(one, ["x"], 4)["x"] == quantile.Edges("x", (0.1,) * 4, 1, 0.1, 0.0)
    assert quantile.edges(one.where("false"), ["x"])["x"] == quantile.Edges("x", (), 0, 0.0, 0.0)


def test_a_fit_counts_rows_that_can_be_reached(spark):
    """Unknown and missing next statuses, and other rows' statuses, aren't counted; what is mostly distinct still serves its parts."""
    df = spark.range(3000).selectExpr("case when id % 5 = 4 then 'P' else 'C' end s", "case id % 7 when 0 then null when 1 then 'other' when 2 then 'D' else 'C' end t", "rand(1) x", "cast(id % 3 as double) y")
    fitter = Fitter(df, FAMILY, "C", "s", "t", ["x", "y"])
    want = df.where("s = 'C' and t in ('C', 'P', 'D')")
    assert fitter.chain.last.point.n == want.count() == fitter.grid.count()
    betas = fitter.chain.model.betas
    assert betas[2][0] == pytest.approx(np.log(want.where("t = 'D'").count() / want.where("t = 'C'").count())) and fitter.edges["y"].count == want.count()
    found = {tuple(at): table.count() for table, at in tables(fitter.grid, [("x", "y"), ("y",)])}
    assert found[(0,)] == want.count() and found[(1,)] == 6
    fitter.close()


class Begun(Exception):
    """A fit has begun."""


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Ten copies of the lines: 60,000 rows, of which 12,000 are distinct at most."""
    path, lines = str(tmp_path_factory.mktemp("copies")), spark.read.parquet(f"{SF}/lineitem.parquet")
    shift = lines.agg(F.max("l_orderkey")).first()[0] + 1
    lines.crossJoin(spark.range(10)).withColumn("l_orderkey", F.col("l_orderkey") + shift * F.col("id")).drop("id").write.parquet(f"{path}/lineitem.parquet")
    return path


# a fit reads a table once, to count its rows: what it begins with has the distinct ones
@pytest.mark.parametrize(
    "query, most",
    [
        ("anneal_model", 12_000),
        ("fit_annealed_saturated", 4),
        ("trim_model", 12_000),
        ("fit_calibrated_saturated", 4),
        ("fit_interaction_saturated", 8),
    ],
)
def test_fits_begin_with_distinct_rows(spark, copies, monkeypatch, query, most):
    begun = []

    def edges(grid, *a):
        begun.append((grid.count(), grid.agg(F.sum(ROWS)).first()[0] if ROWS in grid.columns else None))
        raise Begun

    monkeypatch.setattr(quantile, "edges", edges)
    with pytest.raises(Begun):
        queries.QUERIES[query](spark, copies)
    assert begun[0][0] <= most and begun[0][1] == 60_000


@pytest.fixture(scope="module")
def unlike(spark, copies, tmp_path_factory):
    """The copies with prices that don't repeat."""
    path = str(tmp_path_factory.mktemp("unlike"))
    spark.read.parquet(f"{copies}/lineitem.parquet").withColumn("l_extendedprice", 900 + F.rand(1) * 100_000).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_prices_that_do_not_repeat_are_counted_when_asked_for(spark, unlike, monkeypatch):
    """A model of discounts and quantities reads at most 1,100 rows, and nothing is counted by price."""
    by, real = [], counted
    monkeypatch.setattr(counts, "LARGE", 5_000)
    monkeypatch.setattr(counts, "counted", lambda grid, names: by.append(list(names)) or real(grid, names))
    read = passes(monkeypatch)
    assert len(queries.trim_model(spark, unlike).collect()) > 2
    assert by[0] == ["d", "q"] and not any("x" in names for names in by) and max(read) <= 1_100
    fitter = queries._fitter(spark, unlike)
    assert sorted(fitter.edges) == ["d", "q"] and fitter.chain.last.point.n == 60_000
    plain = fitter.grid.select("*")
    for c in ("q", "x"):
        assert fitter.edges[c].count == 60_000 and fitter.edges[c].values == quantile.edges(real(plain, [c]), [c])[c].values
    base = fitter.chain.model
    models = [base, base.add_beta("d"), base.add_beta("x"), base.add_beta("d").add_beta("x").add_beta("q")]
    for a, b in zip(*(evaluate.evaluate_many(g, models, kernel.SECOND) for g in (plain, fitter.grid)), strict=True):
        assert a.n == b.n and a.entropy == pytest.approx(b.entropy) and np.allclose(a.hessian, b.hessian)
    fitter.close()


def test_many_values_that_repeat_are_counted_alone(spark, monkeypatch):
    """Rows that are mostly distinct, of a column whose values repeat: it is counted by itself, not by all columns."""
    by, real = [], counted
    monkeypatch.setattr(counts, "LARGE", 100)
    monkeypatch.setattr(counts, "counted", lambda grid, names: by.append(list(names)) or real(grid, names))
    df = spark.range(4000).selectExpr("'C' s", "case id % 3 when 0 then 'D' when 1 then null else 'C' end t", "cast(id % 500 as double) x", "cast(id % 7 as double) y", "rand(1) z")
    fitter = Fitter(df, FAMILY, "C", "s", "t", ["x", "y", "z"])
    assert by == [["y"]] and fitter.chain.last.point.n == fitter.grid.count() == df.where("t is not null").count()
    assert tables(fitter.grid, [("x",)])[0][0].count() == 1000 and by[1:] == [["x"]]
    (table, _), = tables(fitter.grid, [("x", "z")])
    assert table.agg(F.sum(ROWS)).first()[0] == fitter.chain.last.point.n and by[2:] == [["x", "y", "z"]]
    fitter.close()
