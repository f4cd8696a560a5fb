"""As-of joins against loops, kept sketches against whole ones, ratios against rows."""

import bisect

import numpy as np
import pytest
from pyspark.sql import functions as F

from transcurve.functions import softmax
from transcurve.functions.curves import Curve
from transcurve.operators import asof, evaluate, quantile, score, sketch
from transcurve.plans.fit import RatioBucket
from transcurve.spec import Entry, Model, StatusFamily


def plain(left, right, strict):
    out = []
    for i, k, t in left:
        hits = sorted(((rt, v) for rk, rt, v in right if k is not None and t is not None and rk == k and rt is not None and (rt < t if strict else rt <= t)), key=lambda h: (h[0], h[1] is not None, h[1] or 0))
        out.append((i, k, t, hits[-1][1] if hits else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("hot", [False, True])
def test_asof_equals_a_loop(spark, strict, hot):
    rng = np.random.default_rng(3)
    key = lambda: None if rng.random() < 0.05 else "hot" if hot and rng.random() < 0.8 else str(rng.integers(0, 6))
    time = lambda: None if rng.random() < 0.05 else int(rng.integers(0, 60))
    left = [(i, key(), time()) for i in range(600)] + [(600, "alone", 5), (1, "0", 7), (1, "0", 7)]
    right = [(key(), time(), int(rng.integers(0, 9))) for _ in range(300)] + [("unmet", 1, 1), ("3", 30, 5), ("3", 30, 5), ("3", 30, 99)]
    a = spark.createDataFrame(left, "id long, k string, t int")
    b = spark.createDataFrame([(*r, "x") for r in right], "k string, t int, v int, id string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = asof.asof_join(a, b, ["k"], "t", ["v"], strict)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sorted([tuple(r) for r in got.collect()], key=str) == plain(left, right, strict)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert max(sizes) < 250  # a hot key's rows are spread
    with pytest.raises(ValueError):
        asof.asof_join(a, b, ["k"], "t", ["id"])


def test_asof_of_empty_tables_and_no_keys(spark):
    a, b = spark.createDataFrame([(1, 5), (2, None), (3, 0)], "id int, t int"), spark.createDataFrame([(1, "p"), (4, "q")], "t int, v string")
    assert sorted(map(tuple, asof.asof_join(a, b, [], "t", ["v"]).collect()), key=str) == [(1, 5, "q"), (2, None, None), (3, 0, None)]
    assert [r.v for r in asof.asof_join(a, b.limit(0), [], "t", ["v"]).collect()] == [None] * 3
    assert asof.asof_join(a.limit(0), b, [], "t", ["v"]).count() == 0


def test_buckets_by_group(spark):
    edges = {"a": [0.0, 1.0, 1.0, 2.0], "b": [5.0], "c": []}
    rows = [(i, g, x) for i, (g, x) in enumerate((g, x) for g in ("a", "b", "c", None) for x in (-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 9.0, float("nan"), float("inf"), None))]
    e = spark.createDataFrame([(g, i, v) for g, vs in edges.items() for i, v in enumerate(vs)], "g string, bucket int, edge double")
    got = {r.id: r.bucket for r in asof.bucket_by_group(spark.createDataFrame(rows, "id int, g string, x double"), ["g"], "x", e).collect()}
    want = {i: max(0, bisect.bisect_right(edges[g], x) - 1) if edges.get(g) and x is not None and np.isfinite(x) else None for i, g, x in rows}
    assert got == want


# -- sketches
def ranks_within(values, edges, error):
    values = np.sort(values)
    lo, hi = np.searchsorted(values, edges, "left") / len(values), np.searchsorted(values, edges, "right") / len(values)
    p = np.arange(len(edges)) / len(edges)
    return ((lo - error <= p) & (p <= hi + error)).all()


def test_edges_after_appends_read_no_old_row(spark, tmp_path):
    rng = np.random.default_rng(8)
    path, seen = str(tmp_path / "sketches"), []
    for day in range(4):
        x = rng.standard_normal(5000) * (day + 1) + day
        seen.append(x)
        rows = [(day, float(v), float(round(v))) for v in x] + [(day, None, None), (day, float("nan"), float("inf"))]
        sketch.append(spark.createDataFrame(rows, "day int, x double, y double"), path, ["x", "y"], ["day"])
    states = sketch.load(spark, path)
    assert states.count() == 8 and str(tmp_path) in str(states.inputFiles())  # the only files read
    x = np.concatenate(seen)
    found, fresh = sketch.edges(states), sketch.edges(sketch.sketches(spark.createDataFrame([(float(v), float(round(v))) for v in x], "x double, y double"), ["x", "y"]))
    for e in (found, fresh):
        assert ranks_within(x, e["x"].values, sketch.rank_error()) and ranks_within(np.round(x), e["y"].values, sketch.rank_error())
        assert e["x"].count == 20_000 and e["x"].mean == pytest.approx(x.mean()) and e["x"].mean_dev == pytest.approx(x.std(ddof=1) / np.sqrt(len(x)))
    late = sketch.edges_frame(states.where("day >= 2"), 10).where("regressor = 'x'").orderBy("bucket").collect()
    assert ranks_within(np.concatenate(seen[2:]), [r.edge for r in late], sketch.rank_error())
    by_day = sketch.edges_frame(states, 10, ["day"])
    assert by_day.count() == 4 * 2 * 10


def test_sketches_of_nothing(spark):
    states = sketch.sketches(spark.createDataFrame([(1, None)], "p int, x double"), ["x"], ["p"])
    assert [r.n for r in states.collect()] == [0] and sketch.edges(states) == {} and sketch.edges_frame(states).count() == 0


# -- ratios
def test_ratio_sums_equal_rows(spark):
    family = StatusFamily.simple(["C", "P", "D"])
    model = Model.create(family, "C").with_betas([[0.0], [-1.0], [-2.0]]).add_entry(Entry((("y", Curve("LOGISTIC", (0.5, 2.0))),), 1), 1.5)
    df = spark.range(3000).selectExpr("id", "rand(1) x", "if(id % 50 = 0, cast('nan' as double), randn(2)) y", "cast(rand(3) * 3 as int) next_offset", "if(id % 70 = 0, null, cast(id % 4 as double)) z").cache()
    edges = {"z": [0.0, 1.0, 2.0], "x": [0.1, 0.5, 0.9]}
    sums = evaluate.ratio_sums(df, model, edges)
    rows = score.with_probabilities(df, model)
    for (status, field), found in sums.items():
        p = softmax.total([F.col(f"`p_{model.reachable[i]}`") for i in model.same[status]])
        y = F.when(F.col("next_offset").isin(*model.same[status]), 1.0).otherwise(0.0) / p
        want = {r.b: r for r in quantile.log_adjusted(quantile.bucket_stats(rows.withColumn("b", quantile.bucket(F.col(field), edges[field])), "b", y)).collect()}
        got = [RatioBucket.of(i, *s) for i, s in enumerate(found) if s[0]]
        assert {b.bucket for b in got} == {b for b, r in want.items() if r.n}
        for b in got:
            r = want[b.bucket]
            assert b.n == r.n and (b.mean_y, b.mean_dev_y, b.adj_y, b.adj_dev) == pytest.approx((r.mean_y, r.mean_dev_y, r.adj_y, r.adj_dev))
    assert "Exchange" not in str(df.select("x").mapInArrow(lambda b: b, "x double")._jdf.queryExecution().executedPlan().toString())


def test_bucket_sums_equal_rows(spark):
    family = StatusFamily.simple(["C", "P", "D"])
    model = Model.create(family, "C").with_betas([[0.0], [-1.0], [-2.0]]).add_entry(Entry((("y", Curve("LOGISTIC", (0.5, 2.0))),), 1), 1.5)
    df = spark.range(2000).selectExpr("id", "if(id % 30 = 0, cast('nan' as double), rand(1)) x", "if(id % 50 = 0, cast('nan' as double), randn(2)) y", "if(id % 40 = 0, null, cast(rand(3) * 3 as int)) next_offset").cache()
    at = [0.0, 0.25, 0.5, 0.75]
    sums = evaluate.bucket_sums(df, model, {"x": at})["x"]
    rows = score.with_probabilities(df, model).withColumn("b", quantile.bucket(F.col("x"), at)).where("b is not null")
    known = F.col("p_P").isNotNull() & ~F.isnan("p_P")
    want = rows.groupBy("b").agg(F.count("*").alias("n"), F.count_if(known).alias("known"), *[F.count_if(F.col("next_offset") == k).alias(f"y{k}") for k in range(3)], *[F.sum(F.when(known, F.col(f"p_{s}"))).alias(f"p{s}") for s in model.reachable]).orderBy("b").collect()
    assert [list(r)[1:] for r in want] == [pytest.approx(list(s)) for s in sums.tolist()]
