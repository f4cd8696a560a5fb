"""The engine's queries over the synthetic tables, and the SQL that checks them.

Each entry applies an operator to a whole table. Computed doubles are rounded to six
places on both sides, since sums depend on the order of their terms.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.functions import criteria, curves, softmax, vectors
from transcurve.functions.curves import Curve, gaussian_width
from transcurve.operators import evaluate, grid, kernel, quantile, score
from transcurve.operators.interpolate import Interpolated
from transcurve.plans import diagnose
from transcurve.plans.fit import Fitter
from transcurve.settings import Settings
from transcurve.sources import economic_series, grids
from transcurve.spec import Entry, Model, StatusFamily

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a query, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


# -- models and rows that several queries share ------------------------------------------------
EVENTS = StatusFamily.simple(["click", "error", "purchase", "signup", "view"])
#: A fixed five-status model out of "view": a raw regressor and one curve of each kind.
EVENT_MODEL = (
    Model.create(EVENTS, "view")
    .with_betas([[0.2], [-0.3], [0.1], [-0.1], [0.0]])
    .add_beta("v")
    .add_entry(Entry((("v", Curve("LOGISTIC", (2.0, 1.1))),), 2), 0.5)
    .add_entry(Entry((("v", Curve("GAUSSIAN", (2.5, 0.8))),), 3), 0.7)
)
EVENT_MODEL = EVENT_MODEL.with_betas([(b[0], 0.1 if k == 0 else 0.0, *b[2:]) for k, b in enumerate(EVENT_MODEL.betas)])
#: The same without its curves.
PLAIN_MODEL = EVENT_MODEL.drop(2, 3)

FLAGS = StatusFamily.simple(["A", "N", "R"])
LINE_MODEL = (
    Model.create(FLAGS, "N").with_betas([[-0.4], [0.0], [0.3]]).add_beta("q").add_entry(Entry((("q", Curve("LOGISTIC", (25.0, 0.4))), ("d", None)), 0), 0.9).add_entry(Entry((("q", Curve("GAUSSIAN", (30.0, 9.0))),), 2), -0.6)
)
LINE_MODEL = LINE_MODEL.with_betas([(b[0], 0.02 * (k - 1), *b[2:]) for k, b in enumerate(LINE_MODEL.betas)])

#: Two statuses from one: the return status "O" against the origin "F", by discount.
LOGIT_FAMILY = StatusFamily(("F", "O"))
LOGIT_MODEL = Model.create(LOGIT_FAMILY, "F").with_betas([[0.0], [0.1]]).add_beta("d")
LOGIT_MODEL = LOGIT_MODEL.with_betas([(0.0, 0.0), (0.1, -0.5)])
LOGIT_CURVE = Model.create(LOGIT_FAMILY, "F").with_betas([[0.0], [0.1]]).add_entry(Entry((("q", Curve("LOGISTIC", (25.0, 0.4))),), 1), 0.8)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.transitions(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def _views(spark: SparkSession, sf_dir: str, model: Model = EVENT_MODEL) -> DataFrame:
    rows = grid.fitting_rows(_events(spark, sf_dir), "event_type", "next_status", EVENTS, "view").withColumn("v", F.col("value") / 100)
    return grid.bind(model, rows, "next_status", ["event_id", "value", "v"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_extendedprice").alias("x"), "l_returnflag", "l_linestatus")


def _logit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("next_offset", grid.encode(F.col("l_linestatus"), LOGIT_FAMILY.names)).select("q", "d", "next_offset")


def _sql_scores(model: Model) -> list[str]:
    """The model's scores as SQL text."""

    def part(r: str, c: Curve | None) -> str:
        if c is None:
            return r
        a, b = c.params
        return f"1 / (1 + exp(-({b * b!r}) * ({r} - {a!r})))" if c.type == "LOGISTIC" else f"exp(-(({r} - {a!r}) * ({r} - {a!r})) / {2 * gaussian_width(a, b) ** 2!r})"

    weights = [" * ".join(f"({part(r, c)})" for r, c in e.depth) or "1" for e in model.entries]
    return [" + ".join(f"({b!r}) * {w}" for b, w in zip(row, weights, strict=True) if b) or "0.0" for row in model.betas]


def _sql_probabilities(model: Model, source: str, keep: str, prefix: str = "p") -> str:
    """A query with the columns ``keep`` of a source and p0, p1... of the model."""
    n = range(len(model.reachable))
    scores = ", ".join(f"{s} AS s{k}" for k, s in enumerate(_sql_scores(model)))
    best = "greatest(" + ", ".join(f"s{k}" for k in n) + ")"
    raw = ", ".join(f"exp(greatest(-30, s{k} - {best})) AS e{k}" for k in n)
    total = " + ".join(f"e{k}" for k in n)
    return f"SELECT {keep}, {', '.join(f'e{k} / ({total}) AS {prefix}{k}' for k in n)} FROM (SELECT *, {raw} FROM (SELECT *, {scores} FROM {source}))"


_EV = """ev AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
vw AS (SELECT event_id, value, value / 100 AS v, nxt, CASE nxt WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS o
       FROM ev WHERE event_type = 'view' AND nxt IS NOT NULL)"""
_HIT = "CASE o WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE p4 END"
_CAP = f"CASE WHEN hit > {math.exp(-14)!r} THEN -ln(hit) ELSE 14 END"
_H = f"h AS (SELECT *, {_CAP} AS h FROM (SELECT *, {_HIT} AS hit FROM ({_sql_probabilities(EVENT_MODEL, 'vw', 'event_id, value, v, nxt, o')})))"
_LI = "li AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_extendedprice AS x, l_returnflag, l_linestatus FROM lineitem)"


# -- flagship -------------------------------------------------------------------------------------
@query(f"WITH {_EV}, {_H} SELECT nxt AS next_status, count(*) AS n, round(avg(hit), 6) AS mean_p, round(avg(h), 6) AS mean_entropy FROM h GROUP BY nxt")
def transition_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed next statuses after a view: count, mean modelled probability, mean entropy."""
    rows = score.with_entropy(_views(spark, sf_dir), EVENT_MODEL)
    hit = softmax.chosen([F.col(f"`p_{s}`") for s in EVENT_MODEL.reachable], F.col("next_offset"), EVENT_MODEL.same)
    return rows.groupBy(grid.decode(F.col("next_offset"), EVENT_MODEL.reachable).alias("next_status")).agg(F.count("*").alias("n"), _r(F.avg(hit)).alias("mean_p"), _r(F.avg("entropy")).alias("mean_entropy"))


# -- rows ------------------------------------------------------------------------------------------
@query("SELECT event_id, user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_status FROM events")
def transition_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "user_id", "event_type", "next_status")


@query(ORACLES["transition_lead"])
def transition_lead_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.transitions_ranged(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return out.select("event_id", "user_id", "event_type", "next_status")


@query("WITH ev AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_status FROM events) SELECT event_id, value, next_status FROM ev WHERE event_type = 'view' AND next_status IN ('click', 'purchase', 'signup', 'view')")
def status_filter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = EVENTS.restrict(["click", "purchase", "signup", "view"])
    return grid.fitting_rows(_events(spark, sf_dir), "event_type", "next_status", family, "view").select("event_id", "value", "next_status")


@query("WITH ev AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), c AS (SELECT event_type, nxt AS next_status, count(*) AS n FROM ev WHERE nxt IS NOT NULL GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM c")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _events(spark, sf_dir).where("next_status is not null").groupBy("event_type", "next_status").agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col("event_type").alias("e")).agg(F.sum("n").alias("all_"))
    return counts.join(F.broadcast(totals), F.col("event_type") == F.col("e")).select("event_type", "next_status", "n", _r(F.col("n") / F.col("all_")).alias("share"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS x, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS d FROM lineitem")
def float32_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.float32(_lines(spark, sf_dir), ["x", "d"]).select("l_orderkey", "l_linenumber", "x", "d")


_BLOCK = "CAST(least((row_number() OVER (ORDER BY {0}) - 1) // 1000, greatest(count(*) OVER () // 1000 - 1, 0)) AS BIGINT)"


@query(f"SELECT o_orderkey, {_BLOCK.format('o_orderkey')} AS block_id FROM orders")
def block_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.blocks(_t(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query(f"SELECT * FROM (SELECT o_orderkey, {_BLOCK.format('o_orderkey')} AS block_id FROM orders) WHERE block_id BETWEEN 3 AND 5")
def block_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.shard(block_assignment(spark, sf_dir), 3, 5)


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS code, l_returnflag AS name FROM lineitem")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("code", grid.encode(F.col("l_returnflag"), FLAGS.names))
    return rows.select("l_orderkey", "l_linenumber", "code", grid.decode(F.col("code"), FLAGS.names).alias("name"))


@query("SELECT c_custkey, isfinite(x) AS kept FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NaN'::DOUBLE WHEN c_custkey % 7 = 1 THEN 'Infinity'::DOUBLE ELSE c_acctbal END AS x FROM customer)")
def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 7
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(F.col("c_acctbal"))
    return _t(spark, sf_dir, "customer").select("c_custkey", grid.finite(x).alias("kept"))


# -- functions of a value --------------------------------------------------------------------------
def _per_line(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", *[_r(c).alias(n) for n, c in columns.items()])


def _line_sql(**columns: str) -> str:
    return f"WITH {_LI} SELECT l_orderkey, l_linenumber, {', '.join(f'round({c}, 6) AS {n}' for n, c in columns.items())} FROM li"


_LG, _GS = "(1 / (1 + exp(-0.16 * (q - 25))))", "exp(-(q - 30) * (q - 30) / 162)"


@query(_line_sql(y=_LG))
def curve_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_line(spark, sf_dir, y=curves.logistic("q", 25.0, 0.4))


@query(_line_sql(by_centre=f"-0.16 * {_LG} * (1 - {_LG})", by_slope=f"0.8 * (q - 25) * {_LG} * (1 - {_LG})"))
def curve_logistic_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = curves.logistic_derivatives("q", 25.0, 0.4)
    return _per_line(spark, sf_dir, by_centre=a, by_slope=b)


@query(_line_sql(y=_GS))
def curve_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_line(spark, sf_dir, y=curves.gaussian("q", 30.0, 9.0))


@query(_line_sql(by_mean=f"(q - 30) / 81 * {_GS}", by_width=f"(q - 30) * (q - 30) / 729 * {_GS}"))
def curve_gaussian_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = curves.gaussian_derivatives("q", 30.0, 9.0)
    return _per_line(spark, sf_dir, by_mean=a, by_width=b)


@query(_line_sql(y="greatest(0, least(1, (q - 10) / 20))"))
def spline_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_line(spark, sf_dir, y=Curve("STEP", (10.0, 20.0))("q"))


@query(_line_sql(y="1 - least(abs(q - 25), 12) / 12"))
def spline_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_line(spark, sf_dir, y=Curve("BASIS", (25.0, 12.0))("q"))


@query(_line_sql(w=f"{_LG} * d"))
def entry_interaction_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_line(spark, sf_dir, w=score.weight(LINE_MODEL.entries[2]))


@query(_line_sql(**{f"s_{s}": x for s, x in zip(LINE_MODEL.reachable, _sql_scores(LINE_MODEL), strict=True)}))
def power_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_line(spark, sf_dir, **{f"s_{s}": c for s, c in zip(LINE_MODEL.reachable, score.power_scores(LINE_MODEL), strict=True)})


@query(f"WITH {_LI} SELECT l_orderkey, l_linenumber, round(p0, 6) AS p_A, round(p1, 6) AS p_N, round(p2, 6) AS p_R FROM ({_sql_probabilities(LINE_MODEL, 'li', 'l_orderkey, l_linenumber')})")
def softmax_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score.with_probabilities(_lines(spark, sf_dir), LINE_MODEL)
    return rows.select("l_orderkey", "l_linenumber", *[_r(f"p_{s}").alias(f"p_{s}") for s in LINE_MODEL.reachable])


@query(_line_sql(y="ln((d + 0.05) / (1 - (d + 0.05)))"))
def logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_line(spark, sf_dir, y=softmax.logit(F.col("d") + 0.05))


@query(f"WITH {_LI} SELECT l_orderkey, l_linenumber, round(ln(p0 / p1), 6) AS s_A, round(ln(p2 / p1), 6) AS s_R FROM ({_sql_probabilities(LINE_MODEL, 'li', 'l_orderkey, l_linenumber')})")
def multi_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score.with_probabilities(_lines(spark, sf_dir), LINE_MODEL)
    s = softmax.multi_logit([F.col(f"p_{x}") for x in LINE_MODEL.reachable], 1)
    return rows.select("l_orderkey", "l_linenumber", _r(s[0]).alias("s_A"), _r(s[2]).alias("s_R"))


@query(f"WITH {_EV}, {_H} SELECT event_id, round(h, 6) AS entropy FROM h")
def row_entropy_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.with_entropy(_views(spark, sf_dir), EVENT_MODEL).select("event_id", _r("entropy").alias("entropy"))


_SAME = StatusFamily(EVENTS.names, same={"click": ("click", "purchase"), "purchase": ("click", "purchase")})


@query(f"WITH {_EV}, s AS ({_sql_probabilities(EVENT_MODEL, 'vw', 'event_id, o')}), hit AS (SELECT event_id, CASE WHEN o IN (0, 2) THEN p0 + p2 WHEN o = 1 THEN p1 WHEN o = 3 THEN p3 ELSE p4 END AS hit FROM s) SELECT event_id, round({_CAP}, 6) AS entropy FROM hit")
def entropy_indistinguishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = Model.create(_SAME, "view").same
    model = Model(EVENT_MODEL.status, EVENT_MODEL.reachable, EVENT_MODEL.entries, EVENT_MODEL.betas, same)
    return score.with_entropy(_views(spark, sf_dir), model).select("event_id", _r("entropy").alias("entropy"))


# -- sums of entropies and derivatives ---------------------------------------------------------------
_BLOCKED = f"b AS (SELECT *, {_BLOCK.format('event_id')} AS block_id FROM h)"


@query(f"WITH {_EV}, {_H}, {_BLOCKED} SELECT block_id, count(*) AS n, round(avg(h), 6) AS mean_h, round(greatest(0, avg(h * h) - avg(h) * avg(h)), 6) AS var_h, round(sqrt(greatest(0, avg(h * h) - avg(h) * avg(h)) / count(*)), 6) AS dev_h FROM b GROUP BY block_id")
def entropy_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.blocks(_views(spark, sf_dir), ["event_id"])
    out = evaluate.entropy_frame(rows, EVENT_MODEL, ["block_id"])
    return out.select("block_id", "n", *[_r(c).alias(c) for c in ("mean_h", "var_h", "dev_h")])


@query(
    f"WITH {_EV}, {_H}, g AS (SELECT event_id, {_CAP} AS h2 FROM (SELECT event_id, {_HIT} AS hit FROM ({_sql_probabilities(PLAIN_MODEL, 'vw', 'event_id, o')}))), "
    f"b AS (SELECT h.h AS ha, g.h2 AS hb, {_BLOCK.format('h.event_id')} AS block_id FROM h JOIN g ON h.event_id = g.event_id), "
    "k AS (SELECT block_id, (sum(ha) - sum(hb)) / count(*) AS d FROM b GROUP BY block_id), s AS (SELECT count(*) AS blocks, coalesce(stddev_samp(d), 0) / sqrt(count(*)) AS dev FROM k), "
    "m AS (SELECT count(*) AS n, (sum(ha) - sum(hb)) / count(*) AS difference FROM b) "
    "SELECT n, blocks, round(difference, 6) AS difference, round(dev, 6) AS dev, round(CASE WHEN dev > 0 THEN difference / dev ELSE 0 END, 4) AS z FROM m, s"
)
def model_compare_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.blocks(_views(spark, sf_dir), ["event_id"])
    out = evaluate.compare(rows, EVENT_MODEL, PLAIN_MODEL)
    return out.select("n", "blocks", _r("difference").alias("difference"), _r("dev").alias("dev"), _r("z", 4).alias("z"))


_LOGIT = f"WITH {_LI}, r AS (SELECT *, CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS y, 1 / (1 + exp(-(0.1 - 0.5 * d))) AS p FROM li)"


@query(f"{_LOGIT} SELECT count(*) AS n, round(avg(p - y), 6) AS g_0, round(avg((p - y) * d), 6) AS g_1 FROM r")
def softmax_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gradient_frame(_logit_grid(spark, sf_dir), LOGIT_MODEL).select("n", _r("g_0").alias("g_0"), _r("g_1").alias("g_1"))


@query(f"{_LOGIT} SELECT round(avg(p * (1 - p)), 6) AS h_00, round(avg(p * (1 - p) * d), 6) AS h_01, round(avg(p * (1 - p) * d * d), 6) AS h_11 FROM r")
def softmax_hessian(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.gradient_frame(_logit_grid(spark, sf_dir), LOGIT_MODEL)
    return rows.select(*[_r(f"hessian_{i}_{j}").alias(f"h_{i}{j}") for i, j in ((0, 0), (0, 1), (1, 1))])


@query(f"{_LOGIT} SELECT round(avg((p - y) * (p - y)), 6) AS i_00, round(avg((p - y) * (p - y) * d), 6) AS i_01, round(avg((p - y) * (p - y) * d * d), 6) AS i_11 FROM r")
def fisher_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.gradient_frame(_logit_grid(spark, sf_dir), LOGIT_MODEL)
    return rows.select(*[_r(f"fisher_{i}_{j}").alias(f"i_{i}{j}") for i, j in ((0, 0), (0, 1), (1, 1))])


def _row(spark: SparkSession, **values: float) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values)).select(*[_r(k).alias(k) for k in values])


@query(
    f"WITH {_LI}, c AS (SELECT *, {_LG} AS f, CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS y FROM li), r AS (SELECT *, 1 / (1 + exp(-(0.1 + 0.8 * f))) AS p FROM c) "
    "SELECT round(avg(p - y), 6) AS intercept, round(avg((p - y) * f), 6) AS beta, round(avg((p - y) * 0.8 * -0.16 * f * (1 - f)), 6) AS centre, round(avg((p - y) * 0.8 * 0.8 * (q - 25) * f * (1 - f)), 6) AS slope FROM r"
)
def curve_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel's gradient of a curve model: intercept, beta, centre, slope."""
    g = evaluate.evaluate(_logit_grid(spark, sf_dir), LOGIT_CURVE, kernel.FIRST).gradient
    return _row(spark, **dict(zip(("intercept", "beta", "centre", "slope"), g, strict=True)))


@query(f"{_LOGIT} SELECT round(avg(p * (1 - p) * (p - y) * (1 + d * d)), 6) AS s_0, round(avg(p * (1 - p) * (p - y) * (d + d * d * d)), 6) AS s_1 FROM r")
def shift_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.evaluate(_logit_grid(spark, sf_dir), LOGIT_MODEL, kernel.SECOND).mean("shift")
    return _row(spark, s_0=s[0], s_1=s[1])


_PREVIOUS = (0.25, 0.001)
_CUT = criteria.TOLERANCE * 0.25


@query(
    f"{_LOGIT}, w AS (SELECT *, (p - y) * (p - y) AS a, (p - y) * (p - y) * d * d AS b, exp(-{_CUT!r} / 0.25) AS w0, exp(-{_CUT!r} / 0.001) AS w1 FROM r), "
    "t AS (SELECT *, a / (0.25 * w0 + a * (1 - w0)) + coalesce(b / (0.001 * w1 + b * (1 - w1)), 0) AS s FROM w) "
    f"SELECT round(avg(2 * (p - y) * s), 6) AS scaled_0, round(avg(2 * (p - y) * d * s), 6) AS scaled_1, round(avg(2 * (p - y) * p * (1 - p) / 0.25), 6) AS scaled2_0, round(avg(2 * (p - y) * d * p * (1 - p) * d * d / 0.001), 6) AS scaled2_1, round(avg(s), 6) AS mass FROM t"
)
def scaled_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evaluate.evaluate(_logit_grid(spark, sf_dir), LOGIT_MODEL, kernel.SECOND, np.array(_PREVIOUS))
    a, b = p.mean("scaled"), p.mean("scaled2")
    return _row(spark, scaled_0=a[0], scaled_1=a[1], scaled2_0=b[0], scaled2_1=b[1], mass=float(p.mean("mass")))


@query(
    f"{_LOGIT}, m AS (SELECT count(*) AS n, avg(-ln(CASE y WHEN 1 THEN p ELSE 1 - p END)) AS h, avg((p - y) * (p - y)) AS a, avg((p - y) * (p - y) * d * d) AS b, avg(p * (1 - p)) AS j, avg(p * (1 - p) * d * d) AS k FROM r) "
    "SELECT n, round(h, 6) AS entropy, round(2 * (n * h + 2), 2) AS aic, round(a / j + b / k, 6) AS ice FROM m"
)
def aic_ice_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logit_grid(spark, sf_dir)
    sums = evaluate.gradient_frame(rows, LOGIT_MODEL)
    h = evaluate.entropy_frame(rows, LOGIT_MODEL).select(F.col("mean_h").alias("h"))
    ice = criteria.ice_column([F.col("g2_0"), F.col("g2_1")], [F.col("hessian_0_0"), F.col("hessian_1_1")])
    both = sums.crossJoin(h)  # one row each
    return both.select("n", _r("h").alias("entropy"), _r(criteria.aic(F.col("h"), F.col("n"), 2), 2).alias("aic"), _r(ice).alias("ice"))


# -- variances and quantiles ---------------------------------------------------------------------------
@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(coalesce(var_samp(l_quantity), 0), 6) AS variance, round(coalesce(var_samp(l_quantity), 0) / count(*), 6) AS mean_variance, round(sqrt(coalesce(var_samp(l_quantity), 0) / count(*)), 6) AS mean_dev FROM lineitem GROUP BY l_returnflag")
def welford_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _lines(spark, sf_dir).groupBy("l_returnflag").agg(*quantile.variance_stats(F.col("q")))
    return out.select("l_returnflag", "n", *[_r(c).alias(c) for c in ("mean", "variance", "mean_variance", "mean_dev")])


@query("SELECT round(greatest((avg(c_acctbal * c_acctbal) - avg(c_acctbal) * avg(c_acctbal)) / count(*), 0), 4) AS mean_variance FROM customer")
def population_mean_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").agg(_r(quantile.population_mean_variance(F.col("c_acctbal")), 4).alias("mean_variance"))


def _edges_sql(table: str, column: str, buckets: int) -> str:
    p = ", ".join(repr(i / buckets) for i in range(buckets))
    return f"SELECT CAST(unnest(range({buckets})) AS INT) AS bucket, round(unnest(q), 6) AS edge FROM (SELECT quantile_cont({column}, [{p}]) AS q FROM {table})"


def _edges(spark: SparkSession, sf_dir: str, table: str, column: str, buckets: int = 100) -> DataFrame:
    return quantile.edges_frame(_t(spark, sf_dir, table), column, buckets).select("bucket", _r("edge").alias("edge"))


for _name, _table, _column, _n in (("quantile_edges", "lineitem", "l_extendedprice", 100), ("quantile_edges_negative", "customer", "c_acctbal", 100), ("quantile_edges_tied", "lineitem", "l_quantity", 100), ("quantile_rebucket", "lineitem", "l_extendedprice", 20)):
    query(_edges_sql(_table, _column, _n), _name)(lambda spark, sf_dir, t=_table, c=_column, n=_n: _edges(spark, sf_dir, t, c, n))


def _value_edges(spark: SparkSession, sf_dir: str) -> quantile.Edges:
    return quantile.edges(_t(spark, sf_dir, "events"), ["value"], approximate=False)["value"]


_Q = ", ".join(repr(i / 100) for i in range(100))
_EDGES = f"eg AS (SELECT quantile_cont(value, [{_Q}]) AS q FROM events)"
_BUCKET = "greatest(len(list_filter(q, lambda e: e <= value)) - 1, 0)"


@query(f"WITH {_EDGES} SELECT event_id, CAST({_BUCKET} AS INT) AS bucket FROM events, eg")
def bucket_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _value_edges(spark, sf_dir).values
    return _t(spark, sf_dir, "events").select("event_id", quantile.bucket(F.col("value"), at).alias("bucket"))


@query(f"WITH {_EDGES} SELECT event_id, CAST({_BUCKET} AS INT) AS bucket FROM events, eg")
def bucket_lookup_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same look-up with the edges as a broadcast row, for edges that stay distributed."""
    rows = _t(spark, sf_dir, "events")
    return quantile.bucket_by_frame(rows, "value", quantile.edges_frame(rows, "value")).select("event_id", "bucket")


_STATS = f"st AS (SELECT CAST({_BUCKET} AS INT) AS bucket, count(*) AS n, avg(y) AS mean_y, coalesce(stddev_samp(y), 0) AS dev_y, coalesce(stddev_samp(y), 0) / sqrt(count(*)) AS mean_dev_y FROM (SELECT value, CASE event_type WHEN 'purchase' THEN 1.0 ELSE 0.0 END AS y FROM events), eg GROUP BY 1)"


def _purchase_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _value_edges(spark, sf_dir).values
    rows = _t(spark, sf_dir, "events").withColumn("bucket", quantile.bucket(F.col("value"), at))
    return quantile.bucket_stats(rows, "bucket", F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0))


@query(f"WITH {_EDGES}, {_STATS} SELECT bucket, n, round(mean_y, 6) AS mean_y, round(dev_y, 6) AS dev_y, round(mean_dev_y, 6) AS mean_dev_y FROM st")
def quantile_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _purchase_stats(spark, sf_dir).select("bucket", "n", *[_r(c).alias(c) for c in ("mean_y", "dev_y", "mean_dev_y")])


@query(
    f"WITH {_EDGES}, {_STATS}, g AS (SELECT avg(CASE event_type WHEN 'purchase' THEN 1.0 ELSE 0.0 END) AS g FROM events), "
    "w AS (SELECT *, lead(mean_y) OVER o AS yb, power(mean_dev_y, 2) AS va, power(lead(mean_dev_y) OVER o, 2) AS vb FROM st, g WINDOW o AS (ORDER BY bucket)) "
    "SELECT bucket, coalesce(abs(mean_y) > 100 * sqrt(va) OR NOT (power(mean_y - yb, 2) < 9 * va AND power(mean_y - yb, 2) < 9 * vb AND power(mean_y - g, 2) < 9 * va), true) AS passed FROM w"
)
def bucket_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = _t(spark, sf_dir, "events").agg(F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0))).first()[0]
    return quantile.convergence(_purchase_stats(spark, sf_dir), F.lit(mean)).select("bucket", "passed")


_RATIO = (
    f"rt AS (SELECT value, CASE WHEN o = 2 THEN 1.0 ELSE 0.0 END / p2 AS y FROM ({_sql_probabilities(EVENT_MODEL, 'vw', 'value, o')})), "
    f"rs AS (SELECT CAST({_BUCKET} AS INT) AS bucket, count(*) AS n, avg(y) AS mean_y, coalesce(stddev_samp(y), 0) / sqrt(count(*)) AS mean_dev_y FROM rt, eg GROUP BY 1)"
)


def _ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score.with_probabilities(_views(spark, sf_dir), EVENT_MODEL)
    at = _value_edges(spark, sf_dir).values
    y = F.when(F.col("next_offset") == 2, 1.0).otherwise(0.0) / F.col("p_purchase")
    return quantile.bucket_stats(rows.withColumn("bucket", quantile.bucket(F.col("value"), at)), "bucket", y)


@query(f"WITH {_EV}, {_EDGES}, {_RATIO} SELECT bucket, n, round(mean_y, 6) AS mean_y, round(mean_dev_y, 6) AS mean_dev_y FROM rs")
def ratio_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratio(spark, sf_dir).select("bucket", "n", _r("mean_y").alias("mean_y"), _r("mean_dev_y").alias("mean_dev_y"))


@query(f"WITH {_EV}, {_EDGES}, {_RATIO}, bd AS (SELECT *, greatest(least(mean_y, 2.0 * n), 0.5 / n) AS b FROM rs) SELECT bucket, n, round(ln(b), 6) AS adj_y, round(ln(mean_dev_y + b) - ln(b), 6) AS adj_dev FROM bd")
def log_adjusted_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile.log_adjusted(_ratio(spark, sf_dir)).select("bucket", "n", _r("adj_y").alias("adj_y"), _r("adj_dev").alias("adj_dev"))


@query(f"WITH {_EDGES}, {_STATS} SELECT bucket, round(q[bucket + 1], 6) AS edge, round(mean_y, 6) AS mean_y FROM st, eg WHERE bucket BETWEEN 5 AND 94")
def alpha_trimmed_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _value_edges(spark, sf_dir)
    first, last = e.trim(0.05)
    rows = _purchase_stats(spark, sf_dir).where((F.col("bucket") >= first) & (F.col("bucket") < last))
    return rows.select("bucket", _r(F.get(F.array(*map(F.lit, e.values)), F.col("bucket"))).alias("edge"), _r("mean_y").alias("mean_y"))


_POINTS = ((10.0, 1.0), (100.0, 4.0), (250.0, -2.0), (400.0, 3.0))
_PIECES = " ".join(f"WHEN value < {b[0]} THEN {a[1]} + (value - {a[0]}) / {b[0] - a[0]} * ({b[1] - a[1]})" for a, b in zip(_POINTS, _POINTS[1:], strict=False))


@query(f"SELECT event_id, round(CASE WHEN value <= 10 THEN 1.0 {_PIECES} ELSE 3.0 END, 6) AS y FROM events")
def interpolate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = Interpolated(*zip(*_POINTS, strict=True))
    return _t(spark, sf_dir, "events").select("event_id", _r(curve.column(F.col("value"))).alias("y"))


def _cubic_sql() -> str:
    """The natural cubic through _POINTS as polynomials, from the continuity of value, slope and bend at the inner points."""
    n = len(_POINTS) - 1
    rows, right = [], []

    def row(i: int, x: float, order: int, sign: float = 1.0) -> list[float]:
        out = [0.0] * (4 * n)
        out[4 * i : 4 * i + 4] = [sign * c for c in ((1, x, x**2, x**3), (0, 1, 2 * x, 3 * x**2), (0, 0, 2, 6 * x))[order]]
        return out

    for i in range(n):
        for x, y in _POINTS[i : i + 2]:
            rows.append(row(i, x / 100, 0))
            right.append(y)
    for i in range(1, n):
        for order in (1, 2):
            rows.append([a + b for a, b in zip(row(i - 1, _POINTS[i][0] / 100, order), row(i, _POINTS[i][0] / 100, order, -1.0), strict=True)])
            right.append(0.0)
    rows += [row(0, _POINTS[0][0] / 100, 2), row(n - 1, _POINTS[-1][0] / 100, 2)]
    c = np.linalg.solve(np.array(rows), np.array([*right, 0.0, 0.0])).reshape(n, 4).tolist()
    pieces = " ".join(f"WHEN u < {_POINTS[i + 1][0] / 100!r} THEN {p[0]!r} + u * ({p[1]!r} + u * ({p[2]!r} + u * ({p[3]!r})))" for i, p in enumerate(c))
    return f"SELECT event_id, round(CASE WHEN u <= {_POINTS[0][0] / 100!r} THEN {_POINTS[0][1]!r} {pieces} ELSE {_POINTS[-1][1]!r} END, 4) AS y FROM (SELECT event_id, value / 100 AS u FROM events)"


@query(_cubic_sql())
def interpolate_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = Interpolated(*zip(*_POINTS, strict=True), cubic=True)
    return _t(spark, sf_dir, "events").select("event_id", _r(curve.column(F.col("value")), 4).alias("y"))


# -- diagnostics ----------------------------------------------------------------------------------------
@query(
    f"WITH {_EV}, eg AS (SELECT list_sort(list_distinct(quantile_cont(v, [{_Q}]))) AS q FROM vw), "
    f"s AS ({_sql_probabilities(EVENT_MODEL, 'vw', 'v, o')}), b AS (SELECT *, CAST(greatest(len(list_filter(q, lambda e: e <= v)) - 1, 0) AS INT) AS bucket FROM s, eg), "
    "u AS (" + " UNION ALL ".join(f"SELECT '{name}' AS to_status, bucket, q[bucket + 1] AS value, CASE o WHEN {k} THEN 1.0 ELSE 0.0 END AS y, p{k} AS p FROM b" for k, name in enumerate(EVENTS.names)) + ") "
    "SELECT to_status, 'v' AS regressor, bucket, round(value, 6) AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM vw), 6) AS mass, round(avg(y), 6) AS observed, round(avg(p), 6) AS model FROM u GROUP BY to_status, bucket, value"
)
def visualizer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _views(spark, sf_dir)
    out = diagnose.bucket_report(rows, EVENT_MODEL, quantile.edges(rows, ["v"], approximate=False))
    return out.select("to_status", "regressor", "bucket", _r("value").alias("value"), "n", *[_r(c).alias(c) for c in ("mass", "observed", "model")])


_BUCKETS = (
    f"{_EV}, eg AS (SELECT list_sort(list_distinct(quantile_cont(v, [{_Q}]))) AS q FROM vw), s AS ({_sql_probabilities(EVENT_MODEL, 'vw', 'v, o')}), "
    "b AS (SELECT *, CAST(greatest(len(list_filter(q, lambda e: e <= v)) - 1, 0) AS INT) AS bucket FROM s, eg), "
    "u AS (" + " UNION ALL ".join(f"SELECT '{name}' AS to_status, {k} AS k, bucket, q[bucket + 1] AS value, len(q) AS m, CASE o WHEN {k} THEN 1.0 ELSE 0.0 END AS y, p{k} AS p FROM b" for k, name in enumerate(EVENTS.names)) + "), "
    "g AS (SELECT to_status, k, bucket, value, m, count(*) AS n, avg(y) AS observed, avg(p) AS model FROM u GROUP BY to_status, k, bucket, value, m)"
)


@query(
    f"WITH {_BUCKETS}, t AS ({_sql_probabilities(EVENT_MODEL, '(SELECT DISTINCT bucket, value AS v FROM g)', 'bucket', 't')}) "
    "SELECT 'view' AS from_status, to_status, 'v' AS regressor, round(value, 6) AS value, round(n / (SELECT count(*) FROM vw), 6) AS mass, round(observed, 6) AS observed, round(model, 6) AS model, "
    "round(CASE k WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 WHEN 3 THEN t3 ELSE t4 END, 6) AS theoretical FROM g JOIN t USING (bucket) WHERE bucket >= floor(0.05 * m + 0.5) AND bucket < m - floor(0.05 * m + 0.5)"
)
def visualizer_theoretical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full report, trimmed, with the theoretical probability."""
    rows = _views(spark, sf_dir)
    out = diagnose.report(rows, EVENT_MODEL, quantile.edges(rows, ["v"], approximate=False))
    return out.select("from_status", "to_status", "regressor", *[_r(c).alias(c) for c in ("value", "mass", "observed", "model", "theoretical")])


@query(f"SELECT id, round(v, 6) AS value, round(p2, 6) AS theoretical FROM ({_sql_probabilities(EVENT_MODEL, '(SELECT range AS id, 0.1 + range * (4.8 / 49) AS v FROM range(50))', 'id, v')})")
def what_if_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnose.what_if(spark, EVENT_MODEL, "purchase", "v", {}, 0.1, 4.9, 50)
    return rows.select("id", _r("value").alias("value"), _r("theoretical").alias("theoretical"))


@query(
    f"WITH {_BUCKETS}, c AS (SELECT *, row_number() OVER (ORDER BY bucket) - 1 AS place, count(*) OVER () AS m2 FROM g WHERE to_status = 'purchase'), "
    "d AS (SELECT observed - model AS r FROM c WHERE place >= floor(0.01 * m2 + 0.5) AND place < m2 - floor(0.01 * m2 + 0.5)) "
    "SELECT CAST(row_number() OVER (ORDER BY r) - 1 AS INT) AS place, round((row_number() OVER (ORDER BY r) - 1 + 0.01) / (count(*) OVER () * 1.02), 6) AS probability, round(r, 6) AS residual FROM d"
)
def qq_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a QQ plot; the expected residuals as the probabilities that they stand for under their normal distribution."""
    rows = _views(spark, sf_dir)
    points = diagnose.qq_plot(diagnose.bucket_report(rows, EVENT_MODEL, quantile.edges(rows, ["v"], approximate=False)), "purchase", "v")
    dev = (sum(r * r for _, r in points) / max(1, len(points))) ** 0.5
    found = [(i, 0.5 * (1 + math.erf(e / dev / math.sqrt(2))), r) for i, (e, r) in enumerate(points)]
    return spark.createDataFrame(found, "place int, probability double, residual double").select("place", _r("probability").alias("probability"), _r("residual").alias("residual"))


# -- fits ---------------------------------------------------------------------------------------------------
@query("WITH ev AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), c AS (SELECT nxt AS to_status, count(*) AS n FROM ev WHERE event_type = 'view' AND nxt IS NOT NULL GROUP BY 1) SELECT to_status, round(ln(n / (SELECT n FROM c WHERE to_status = 'view')), 6) AS intercept, round((SELECT -sum(n / t * ln(n / t)) FROM c, (SELECT sum(n) AS t FROM c)), 6) AS entropy FROM c")
def fit_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitter = Fitter(_events(spark, sf_dir), EVENTS, "view", "event_type", "next_status", ["value"])
    last = fitter.chain.last
    fitter.close()
    return spark.createDataFrame([(s, b[0], last.entropy) for s, b in zip(last.model.reachable, last.model.betas, strict=True)], "to_status string, intercept double, entropy double").select("to_status", _r("intercept").alias("intercept"), _r("entropy").alias("entropy"))


@query(
    f"WITH {_LI}, c AS (SELECT CASE WHEN d > 0.05 THEN 1 ELSE 0 END AS f, sum(CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) AS a, sum(CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END) AS b FROM li GROUP BY 1), w AS (SELECT max(CASE f WHEN 0 THEN ln(a / b) END) AS l0, max(CASE f WHEN 1 THEN ln(a / b) END) AS l1, -sum(a * ln(a / (a + b)) + b * ln(b / (a + b))) / sum(a + b) AS h FROM c) "
    "SELECT round(l0, 5) AS intercept, round(l1 - l0, 5) AS beta, round(h, 6) AS entropy FROM w"
)
def fit_flag_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transcurve.plans.optimize import minimise

    rows = _logit_grid(spark, sf_dir).withColumn("f", F.when(F.col("d") > 0.05, 1.0).otherwise(0.0)).cache()
    p = minimise(rows, Model.create(LOGIT_FAMILY, "F").add_beta("f")).point
    rows.unpersist()
    b = p.model.betas[1]
    return spark.createDataFrame([(b[0], b[1], p.entropy)], "intercept double, beta double, entropy double").select(_r("intercept", 5).alias("intercept"), _r("beta", 5).alias("beta"), _r("entropy").alias("entropy"))


#: What the synthetic outcomes of the fits follow: a curve of the price and the discount by itself.
TRUE_MODEL = Model.create(LOGIT_FAMILY, "F").with_betas([[0.0], [-1.0]]).add_entry(Entry((("x", Curve("LOGISTIC", (5.0, 1.2))),), 1), 2.0).add_beta("d")
TRUE_MODEL = TRUE_MODEL.with_betas([(0.0, 0.0, 0.0), (-1.0, 2.0, 4.0)])


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with an outcome drawn from TRUE_MODEL by a hash of the line."""
    rows = _lines(spark, sf_dir).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("x") / 10_000).alias("x"), "d", "q", F.lit("F").alias("status"))
    return score.sample(rows, TRUE_MODEL, 3, "id", "next_status")


def _fitter(spark: SparkSession, sf_dir: str, **settings) -> Fitter:
    return Fitter(synthetic(spark, sf_dir), LOGIT_FAMILY, "F", "status", "next_status", ["x", "d", "q"], Settings(**settings))


def _chain(fitter: Fitter, spark: SparkSession) -> DataFrame:
    out = fitter.chain.frame(spark)
    fitter.close()
    return out


@query(
    f"WITH {_LI}, s AS (SELECT *, ('0x' || substr(md5((l_orderkey * 8 + l_linenumber) || ':3'), 1, 13))::BIGINT AS h, exp(-1 + 2 / (1 + exp(-1.2 * 1.2 * (x / 10000 - 5))) + 4 * d) AS e FROM li) "
    "SELECT CASE WHEN (h + 0.5::DOUBLE) / 4503599627370496 <= 1 / (1 + e) THEN 'F' ELSE 'O' END AS next_status, count(*) AS n FROM s GROUP BY 1"
)
def sampled_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic(spark, sf_dir).groupBy("next_status").agg(F.count("*").alias("n"))


@query()
def fit_model_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fitter(spark, sf_dir)
    f.fit(["d"], ["x", "q"], 3)
    return _chain(f, spark)


@query()
def curve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fitter(spark, sf_dir)
    out = f.candidate_frame(spark, ["x", "q"])
    f.close()
    return out


@query()
def trim_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fitter(spark, sf_dir)
    f.chain.force("with noise", f._fit(f.chain.model.add_beta("d").add_beta("q")))
    f.trim()
    return _chain(f, spark)


@query()
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fitter(spark, sf_dir)
    f.add_coefficients(["d", "x"])
    f.interactions()
    return _chain(f, spark)


@query()
def anneal_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fitter(spark, sf_dir)
    f.add_coefficients(["x"])
    f.anneal(["x"])
    return _chain(f, spark)


_SECOND = (
    f"{_LOGIT}, m AS (SELECT count(*) AS n, avg(-ln(CASE y WHEN 1 THEN p ELSE 1 - p END)) AS h, avg(p * (1 - p)) AS j0, avg(p * (1 - p) * d) AS j1, avg(p * (1 - p) * d * d) AS j2, "
    "avg((p - y) * (p - y)) AS i0, avg((p - y) * (p - y) * d) AS i1, avg((p - y) * (p - y) * d * d) AS i2 FROM r)"
)


def _condition_sql(a: str, b: str, c: str) -> str:
    """The ratio of the eigenvalues of a symmetric matrix of two rows."""
    root = f"sqrt(({a} - {c}) * ({a} - {c}) + 4 * {b} * {b})"
    return f"(({a} + {c} - {root}) / ({a} + {c} + {root}))"


@query(
    f"{_SECOND}, t AS (SELECT *, {_condition_sql('j0', 'j1', 'j2')} AS cj, {_condition_sql('i0', 'i1', 'i2')} AS ci, (j2 * i0 - 2 * j1 * i1 + j0 * i2) / (j0 * j2 - j1 * j1) AS tr FROM m) "
    "SELECT round(2 * (n * h + 2), 2) AS aic, round(2 * (n * h + tr), 2) AS tic, round(cj, 6) AS condition_j, round(ci, 6) AS condition_i, round(least(cj, ci), 6) AS condition FROM t"
)
def tic_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evaluate.evaluate(_logit_grid(spark, sf_dir), LOGIT_MODEL, kernel.SECOND)
    j, i, least = p.inverse_conditions()
    rows = spark.createDataFrame([(p.aic, p.tic, j, i, least)], "aic double, tic double, condition_j double, condition_i double, condition double")
    return rows.select(_r("aic", 2).alias("aic"), _r("tic", 2).alias("tic"), *[_r(c).alias(c) for c in ("condition_j", "condition_i", "condition")])


@query(
    f"{_SECOND}, t AS (SELECT *, i0 * i2 - i1 * i1 AS det FROM m) SELECT 0 AS param, 0.1::DOUBLE AS value, round(sqrt(i2 / det / n), 6) AS std FROM t UNION ALL SELECT 1, -0.5::DOUBLE, round(sqrt(i0 / det / n), 6) FROM t"
)
def param_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evaluate.evaluate(_logit_grid(spark, sf_dir), LOGIT_MODEL, kernel.SECOND)
    return spark.createDataFrame([(i, float(t), float(s)) for i, (t, s) in enumerate(zip(p.model.pack(), p.param_std(), strict=True))], "param int, value double, std double").withColumn("std", _r("std"))


# -- vectors, hashes, sources -----------------------------------------------------------------------------
@query("SELECT vec_id, round(list_dot_product(e, e), 4) AS dot, round(sqrt(list_dot_product(e, e)), 4) AS magnitude, round(list_max(list_transform(e, lambda x: abs(x))), 6) AS max_abs FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings")
    return rows.select("vec_id", _r(vectors.dot("embedding", "embedding"), 4).alias("dot"), _r(vectors.magnitude("embedding"), 4).alias("magnitude"), _r(vectors.max_abs("embedding")).alias("max_abs"))


@query(
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), m AS (SELECT vec_id, e[1] AS a, e[2] AS b, e[3] AS c, e[4] AS d FROM e) "
    "SELECT vec_id, round(a + 2 * (a + 3), 6) AS m00, round(b + 2 * c, 6) AS m01, round(c + 2 * b, 6) AS m10, round(d + 2 * d, 6) AS m11, round(a * a + b * b, 6) AS v0, round(c * a + d * b, 6) AS v1 FROM m"
)
def matrix_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of each embedding, added to twice its transpose with 3 at the corner, and the matrix times its first row."""
    x = [F.get("embedding", i).cast("double") for i in range(4)]
    entry = lambda i, j, v: F.struct(F.lit(i).alias("row"), F.lit(j).alias("column"), v.alias("value"))
    sparse = F.array(entry(0, 0, x[0]), entry(0, 0, F.lit(3.0)), entry(0, 1, x[2]), entry(1, 0, x[1]), entry(1, 1, x[3]))
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.array(F.array(x[0], x[1]), F.array(x[2], x[3])).alias("m"), vectors.to_dense(sparse, 2, 2).alias("t"))
    rows = rows.withColumns({"sum": vectors.matrix_axpy("m", "t", 2.0), "v": vectors.matrix_multiply("m", F.get("m", 0))})
    cells = {f"m{i}{j}": _r(F.get(F.get("sum", i), j)) for i in range(2) for j in range(2)}
    return rows.select("vec_id", *[c.alias(n) for n, c in cells.items()], *[_r(F.get("v", i)).alias(f"v{i}") for i in range(2)])


@query("SELECT c_custkey, sha256(concat_ws(chr(31), c_name, c_mktsegment)) AS digest FROM customer")
def hash_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", vectors.sha256("c_name", "c_mktsegment").alias("digest"))


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, round(sum(o_totalprice), 2) AS value FROM orders WHERE day(o_orderdate) <> 13 GROUP BY 1")
def series_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily totals of orders, written as the service's XML and read back: "." goes."""
    days = _t(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(_r(F.sum("o_totalprice"), 2).alias("total"))
    value = F.when(F.dayofmonth("day") == 13, ".").otherwise(F.col("total").cast("string"))
    # written by Spark, to where its executors can read it
    path = f"{grid.shared_folder(spark)}/series-{os.urandom(6).hex()}"
    rows = days.select(F.lit("2024-01-01").alias("_realtime_start"), F.col("day").cast("string").alias("_date"), value.alias("_value"))
    rows.write.format("xml").option("rootTag", "observations").option("rowTag", "observation").save(path)
    return economic_series.observations(spark, path).select(F.col("date").cast("string").alias("date"), "value")


@query("SELECT range AS id, round(lo + range * 0.25, 6) AS x FROM (SELECT min(o_totalprice) AS lo, count(*) AS n FROM orders), range((SELECT count(*) FROM orders))")
def stepped_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many steps as there are orders, from the least price on."""
    low, n = _t(spark, sf_dir, "orders").agg(F.min("o_totalprice"), F.count("*")).first()
    return grids.stepped(spark, "x", low, 0.25, n).select("id", _r("x").alias("x"))
