"""Queries over permutations, grids read by group, as-of joins, kept sketches, and fits whose optimum has a closed form.

They are registered with those of ``queries``, and rounded as they are.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcurve.functions import permutation
from transcurve.functions.permutation import Permutation
from transcurve.operators import asof, blocked, evaluate, grid, kernel, quantile, sketch
from transcurve.operators.blocked import BlockedGrid
from transcurve.operators.counted import ROWS
from transcurve.plans.fit import Fitter
from transcurve.plans.optimize import minimise, minimise_by_gradient
from transcurve.queries import _LI, LOGIT_CURVE, LOGIT_FAMILY, LOGIT_MODEL, ORACLES, _lines, _logit_grid, _r, _sql_probabilities, _t, query
from transcurve.settings import Settings
from transcurve.spec import Model, StatusFamily

# -- permutations --------------------------------------------------------------------------------
#: Rows of a block, and the seed of the permutation whose keys the SQL states.
PLACES, SEED = 50, 17
_KEYS = ", ".join(f"({j}, {a}, {b}, {c})" for j, (a, b, c) in enumerate(Permutation(1, SEED).keys))


@query(
    f"""WITH RECURSIVE k(j, k1, k2, k3) AS (VALUES {_KEYS}),
s AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM documents)),
t(doc_id, v, j) AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1, 0 FROM documents
  UNION ALL
  SELECT doc_id, CASE WHEN t.j % 2 = 1 THEN (v // b) * b + (v % b + u) % b ELSE (v // b + u) % a * b + v % b END, t.j + 1
  FROM (SELECT doc_id, v, t.j, a, b, n, (w * w + k3) % {permutation.PRIME} AS u FROM (
    SELECT t.*, k3, a, b, n, (z * z + k2) % {permutation.PRIME} AS w FROM (
      SELECT t.*, k2, k3, a, b, n, (CASE WHEN t.j % 2 = 1 THEN v // b ELSE v % b END + k1) % {permutation.PRIME} AS z FROM t, s, k WHERE k.j = t.j % {permutation.ROUNDS}) t) t) t
  WHERE t.j = 0 OR t.j % {permutation.ROUNDS} <> 0 OR v >= n),
p AS (SELECT doc_id, v AS place FROM t, s WHERE t.j > 0 AND t.j % {permutation.ROUNDS} = 0 AND v < n)
SELECT place // {PLACES} AS block, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM p JOIN documents USING (doc_id) GROUP BY 1"""
)
def permuted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents in a random permutation of the table, and their mean lengths."""
    rows = grid.permuted(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], SEED)
    return rows.groupBy(F.floor(F.col("place") / PLACES).alias("block")).agg(F.count("*").alias("n"), _r(F.avg("n_chars")).alias("mean_chars"))


# -- groups of rows ------------------------------------------------------------------------------
GROUPS = 64
_SQL_GROUP = f"(l_orderkey * 8 + l_linenumber) % {GROUPS}"
_ENDS = ", ".join(f"({e})" for e in [*(2**i for i in range(1, 6)), GROUPS])


def _line_blocks(spark: SparkSession, sf_dir: str) -> BlockedGrid:
    rows = _lines(spark, sf_dir).withColumn("next_offset", grid.encode(F.col("l_linestatus"), LOGIT_FAMILY.names)).withColumn("f", F.when(F.col("d") > 0.05, 1.0).otherwise(0.0))
    return BlockedGrid.lay_out(rows.select("q", "d", "x", "f", "next_offset", "l_orderkey", "l_linenumber"), groups=GROUPS, by=F.expr(_SQL_GROUP), keep=["q", "d", "x", "f", "next_offset"])


_FAR = LOGIT_CURVE.with_betas([(0.0, 0.0), (0.1, 2.5)])


@query(
    f"""WITH {_LI}, o AS (SELECT *, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS o, {_SQL_GROUP} AS g FROM li),
a AS ({_sql_probabilities(LOGIT_MODEL, 'o', 'l_orderkey, l_linenumber, q, d, g, o')}), b AS ({_sql_probabilities(_FAR, 'a', 'g, o, p0, p1', 'r')}),
d AS (SELECT g, CASE o WHEN 0 THEN ln(p0 / r0) ELSE ln(p1 / r1) END AS d FROM b),
e(e) AS (VALUES {_ENDS}), c AS (SELECT e, count(*) AS n, avg(d) AS mean, sqrt(greatest(avg(d * d) - avg(d) * avg(d), 0) / count(*)) AS dev FROM d JOIN e ON g < e GROUP BY e),
w AS (SELECT min(e) AS e FROM c WHERE e = {GROUPS} OR n >= {blocked.LEAST} AND abs(mean) >= {blocked.DECIDED} * dev)
SELECT e AS groups, n, round(mean, 6) AS difference, round(mean / dev, 4) AS z FROM c JOIN w USING (e)"""
)
def decided_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models compared on as many groups of rows as it takes to tell them apart."""
    out = blocked.compare(_line_blocks(spark, sf_dir), LOGIT_MODEL, _FAR)
    row = (out.groups, int(out.n), float(out.difference), float(out.z))
    return spark.createDataFrame([row], "groups int, n long, difference double, z double").select("groups", "n", _r("difference").alias("difference"), _r("z", 4).alias("z"))


@query(ORACLES["fit_flag_saturated"])
def fit_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saturated fit of one flag on a grid whose trial steps read groups: the optimum of all rows."""
    p = minimise(_line_blocks(spark, sf_dir), Model.create(LOGIT_FAMILY, "F").add_beta("f")).point
    b = p.model.betas[1]
    return spark.createDataFrame([(b[0], b[1], p.entropy)], "intercept double, beta double, entropy double").select(_r("intercept", 5).alias("intercept"), _r("beta", 5).alias("beta"), _r("entropy").alias("entropy"))


@query(
    f"""WITH r AS (SELECT {_SQL_GROUP} AS g, CAST(least(floor(l_quantity / 5), 9) AS INT) AS bucket, l_extendedprice AS y FROM lineitem),
c AS (SELECT e AS e, bucket, count(y) AS n, avg(y) AS m, coalesce(var_samp(y), 0) / count(y) AS v FROM r JOIN (SELECT range AS e FROM range(1, {GROUPS + 1})) ON g < e GROUP BY e, bucket),
w AS (SELECT *, lead(m) OVER o AS mb, lead(v) OVER o AS vb, sum(n * m) OVER (PARTITION BY e) / sum(n) OVER (PARTITION BY e) AS gm FROM c WINDOW o AS (PARTITION BY e ORDER BY bucket)),
f AS (SELECT e, bool_or(coalesce(abs(m) <= 100 * sqrt(v) AND power(m - mb, 2) < 9 * v AND power(m - mb, 2) < 9 * vb AND power(m - gm, 2) < 9 * v, false)) AS fails FROM w GROUP BY e),
s AS (SELECT min(e) AS e FROM f WHERE NOT fails OR e = {GROUPS})
SELECT CAST(e AS INT) AS groups, bucket, n, round(m, 4) AS mean_y, round(sqrt(v), 4) AS mean_dev_y FROM c JOIN s USING (e)"""
)
def early_stop_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by bucket of quantity over a growing sample, which ends when adjacent buckets stand apart."""
    rows = _lines(spark, sf_dir).withColumn("bucket", quantile.bucket(F.col("q"), [5.0 * i for i in range(10)]))
    laid = BlockedGrid.lay_out(rows.select("x", "bucket", "l_orderkey", "l_linenumber"), groups=GROUPS, by=F.expr(_SQL_GROUP), keep=["x", "bucket"])
    found, end = quantile.until_converged(laid.slice, range(1, GROUPS + 1), "bucket", F.col("x"), 10)
    return quantile.moments_frame(spark, found).select(F.lit(end).alias("groups"), "bucket", "n", _r("mean_y", 4).alias("mean_y"), _r("mean_dev_y", 4).alias("mean_dev_y"))


# -- as-of joins -----------------------------------------------------------------------------------
@query("SELECT e.event_id, coalesce(p.event_id, -1) AS purchase_id, coalesce(p.value, -1) AS purchase_value FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last purchase up to then."""
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    return asof.asof_join(events, bought, ["user_id"], "ts", ["purchase_id", "purchase_value"]).select("event_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("purchase_id", "purchase_value")])


@query("SELECT a.doc_id, coalesce(max(b.doc_id), -1) AS before_id, coalesce(max_by(b.n_chars, b.doc_id), -1) AS before_chars FROM documents a LEFT JOIN documents b ON a.source = b.source AND b.doc_id < a.doc_id GROUP BY a.doc_id")
def asof_join_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one before it of its source, of which one may hold a third of all."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    before = docs.select("source", "doc_id", F.col("doc_id").alias("before_id"), F.col("n_chars").alias("before_chars"))
    return asof.asof_join(docs, before, ["source"], "doc_id", ["before_id", "before_chars"], strict=True).select("doc_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("before_id", "before_chars")])


_TENTHS = ", ".join(str(i / 10) for i in range(10))


@query(f"WITH q AS (SELECT event_type, quantile_cont(value, [{_TENTHS}]) AS q FROM events GROUP BY event_type) SELECT event_id, CAST(greatest(len(list_filter(q, lambda e: e <= value)) - 1, 0) AS INT) AS bucket FROM events JOIN q USING (event_type)")
def bucket_lookup_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth of its type's values that each event's value lies in: edges by group, found by an as-of join."""
    events = _t(spark, sf_dir, "events").select("event_id", "event_type", "value")
    q = F.percentile("value", F.array(*[F.lit(i / 10) for i in range(10)]))
    edges = events.groupBy("event_type").agg(q.alias("q")).select("event_type", F.posexplode("q").alias("bucket", "edge"))
    return asof.bucket_by_group(events, ["event_type"], "value", edges).select("event_id", "bucket")


# -- sketches --------------------------------------------------------------------------------------
@query("SELECT CAST(range AS INT) AS bucket, count(*) OVER () > 0 AND (SELECT count(*) FROM documents) > 0 AS within FROM range(20)")
def sketched_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of document lengths from sketches kept for each source, appended in two loads: whether each lies within the rank error."""
    docs = _t(spark, sf_dir, "documents").select("source", F.col("n_chars").cast("double").alias("x"))
    path = f"{grid.shared_folder(spark).rstrip('/')}/sketches-{os.urandom(6).hex()}"
    for load in (0, 1):
        sketch.append(docs.where(F.pmod(F.xxhash64("source"), F.lit(2)) == load), path, ["x"], ["source"])
    edges = sketch.edges_frame(sketch.load(spark, path), 20)
    values = [r.edge for r in edges.orderBy("bucket").collect()]
    at = docs.where("x is not null").agg(F.count("*").alias("n"), *[F.count_if(F.col("x") < v).alias(f"b{i}") for i, v in enumerate(values)], *[F.count_if(F.col("x") <= v).alias(f"u{i}") for i, v in enumerate(values)]).first()
    error = sketch.rank_error()
    rows = [(i, at[f"b{i}"] / at.n - error <= i / 20 <= at[f"u{i}"] / at.n + error) for i in range(len(values))]
    return spark.createDataFrame(rows, "bucket int, within boolean")


# -- gradients and fits with a closed form ---------------------------------------------------------
_G = [LOGIT_MODEL.betas[1][i] for i in range(2)]


@query(
    f"""WITH {_LI}, p AS (SELECT 1.0 AS x0, d AS x1, CASE l_linestatus WHEN 'O' THEN 1.0 ELSE 0.0 END AS y, 1 / (1 + exp(-({_G[0]!r} + {_G[1]!r} * d))) AS p FROM li),
m AS (SELECT count(*) AS n, {', '.join(f"avg(power((p - y) * x{i}, 2)) AS g{i}, avg(p * (1 - p) * x{i} * x{i}) AS j{i}" for i in (0, 1))},
  {', '.join(f"avg(2 * (p - y) * x{i} * p * (1 - p) * x{i} * x{k}) AS dg{i}{k}, avg(p * (1 - p) * (1 - 2 * p) * x{i} * x{i} * x{k}) AS dj{i}{k}" for i in (0, 1) for k in (0, 1))} FROM p)
SELECT {', '.join(f"round(dg0{k} / j0 - g0 * dj0{k} / (j0 * j0) + dg1{k} / j1 - g1 * dj1{k} / (j1 * j1), 6) AS d{k}" for k in (0, 1))} FROM m"""
)
def ice_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the penalty of ICE, times the rows, moves with intercept and slope, third derivatives included."""
    rows = _logit_grid(spark, sf_dir)
    point = evaluate.evaluate(rows, LOGIT_MODEL, kernel.FIRST)
    found = evaluate.exact_penalty_gradients(rows, [point], "ICE_SIMPLE")[0] * point.n
    return spark.createDataFrame([tuple(map(float, found))], "d0 double, d1 double").select(_r("d0").alias("d0"), _r("d1").alias("d1"))


PRIORITIES = StatusFamily.simple(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("WITH c AS (SELECT month(o_orderdate) AS month, o_orderpriority AS to_status, count(*) AS n FROM orders GROUP BY 1, 2) SELECT CAST(month AS INT) AS month, to_status, n, true AS fitted FROM c")
def fit_gradient_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities by month, a flag a month, fitted by gradients alone: whether the observed shares come out, to five places."""
    orders = _t(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("month"), "o_orderpriority")
    flags = {f"m{i}": F.when(F.col("month") == i, 1.0).otherwise(0.0) for i in range(2, 13)}
    counts = orders.groupBy("month", F.col("o_orderpriority").alias("to_status")).agg(F.count("*").alias("n")).cache()
    # a row for each month and priority, with the number of its orders: what the many passes of a fit by gradients read
    rows = counts.select(*[c.alias(k) for k, c in flags.items()], grid.encode(F.col("to_status"), PRIORITIES.names).alias("next_offset"), F.col("n").cast("double").alias(ROWS)).coalesce(1).cache()
    model = Model.create(PRIORITIES, PRIORITIES.names[0])
    for f in flags:
        model = model.add_beta(f)
    found = minimise_by_gradient(rows, model).point.model
    rows.unpersist()
    fitted = []
    for i in range(1, 13):
        x = {f: np.array([1.0 if f == f"m{i}" else 0.0]) for f in flags}
        scores = kernel.Kernel(found).scores(x, 1)[:, 0]
        p = np.exp(scores - scores.max())
        fitted += [(i, s, float(v)) for s, v in zip(PRIORITIES.names, p / p.sum(), strict=True)]
    shares = spark.createDataFrame(fitted, "month int, to_status string, p double")
    both = counts.join(shares, ["month", "to_status"])
    total = F.sum("n").over(Window.partitionBy("month"))  # five rows
    return both.select("month", "to_status", "n", (F.abs(F.col("n") / total - F.col("p")) < 1e-5).alias("fitted"))


#: Outcomes that depend on two flags and their product, by the line's number: shares in thousandths for (f, g).
_SHARES = {(0, 0): 200, (1, 0): 400, (0, 1): 350, (1, 1): 850}
_DRAW = "(l_orderkey * 7919 + l_linenumber * 104729) % 1000"
_CELLS = f"cells AS (SELECT CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS f, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS g, {_DRAW} AS u FROM lineitem), ys AS (SELECT f, g, CASE WHEN u < CASE " + " ".join(f"WHEN f = {f} AND g = {g} THEN {s}" for (f, g), s in _SHARES.items()) + " END THEN 1.0 ELSE 0.0 END AS y FROM cells)"


def _drawn(spark: SparkSession, sf_dir: str, shares: dict[tuple[int, int], int]) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0).alias("f"), F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("g"), F.expr(_DRAW).alias("u"))
    share = F.lit(0)
    for (f, g), s in shares.items():
        share = F.when((F.col("f") == f) & (F.col("g") == g), s).otherwise(share)
    return rows.withColumn("status", F.lit("F")).withColumn("next_status", F.when(F.col("u") < share, "O").otherwise("F"))


@query(f"WITH {_CELLS} SELECT f, g, round(avg(y), 4) AS probability FROM ys GROUP BY f, g")
def fit_interaction_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of two flags, then their product, as a fit adds them: the observed share of each cell."""
    fitter = Fitter(_drawn(spark, sf_dir, _SHARES), LOGIT_FAMILY, "F", "status", "next_status", ["f", "g"], Settings(validate=False))
    fitter.add_coefficients(["f", "g"])
    fitter.interactions()
    model = fitter.chain.model
    fitter.close()
    out = []
    for f in (0, 1):
        for g in (0, 1):
            s = kernel.Kernel(model).scores({"f": np.array([float(f)]), "g": np.array([float(g)])}, 1)[:, 0]
            out.append((f, g, float(1 / (1 + np.exp(s[0] - s[1])))))
    return spark.createDataFrame(out, "f int, g int, probability double").select("f", "g", _r("probability", 4).alias("probability"))


@query(
    f"WITH {_CELLS.replace('850', '400').replace('350', '200')}, c AS (SELECT f, avg(y) AS p, count(*) AS n FROM ys GROUP BY f), "
    "t AS (SELECT ln(max(CASE f WHEN 0 THEN p / (1 - p) END)) AS l0, ln(max(CASE f WHEN 1 THEN p / (1 - p) END)) AS l1, -sum(n * (p * ln(p) + (1 - p) * ln(1 - p))) / sum(n) AS h FROM c) SELECT 'f' AS kept, round(l0, 4) AS intercept, round(l1 - l0, 4) AS beta, round(h, 6) AS entropy FROM t"
)
def fit_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of two flags of which one says nothing, trimmed: the fit of the other, all parameters refitted."""
    shares = {k: {850: 400, 350: 200}.get(s, s) for k, s in _SHARES.items()}
    fitter = Fitter(_drawn(spark, sf_dir, shares), LOGIT_FAMILY, "F", "status", "next_status", ["f", "g"], Settings(validate=False))
    both = fitter.chain.model.add_beta("f").add_beta("g")
    fitter.chain.force("both", minimise(fitter.grid, both).point)
    fitter.trim()
    fitter.fit_all()
    last = fitter.chain.last
    fitter.close()
    row = (",".join(last.model.flag_set()), *last.model.betas[1][:2], last.entropy)
    return spark.createDataFrame([row], "kept string, intercept double, beta double, entropy double").select("kept", _r("intercept", 4).alias("intercept"), _r("beta", 4).alias("beta"), _r("entropy").alias("entropy"))


# a curve of a regressor that takes two values has as much freedom as a flag: its optimum is the observed shares
_TWO = f"WITH {_CELLS.replace('850', '400').replace('350', '200')} SELECT f, round(avg(y), 4) AS probability FROM ys GROUP BY f"
_EXACT = Settings(validate=False, z_score_cutoff=1e-6, polish_start_points=4)


def _two_fitter(spark: SparkSession, sf_dir: str) -> Fitter:
    shares = {k: {850: 400, 350: 200}.get(s, s) for k, s in _SHARES.items()}
    return Fitter(_drawn(spark, sf_dir, shares), LOGIT_FAMILY, "F", "status", "next_status", ["f"], _EXACT)


def _two_shares(spark: SparkSession, fitter: Fitter) -> DataFrame:
    model = fitter.chain.model
    fitter.close()
    s = kernel.Kernel(model).scores({"f": np.array([0.0, 1.0])}, 2)
    out = [(i, float(1 / (1 + np.exp(s[0, i] - s[1, i])))) for i in (0, 1)]
    return spark.createDataFrame(out, "f int, probability double").select("f", _r("probability", 4).alias("probability"))


@query(_TWO)
def fit_expansion_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model grown by the best curve of a regressor with two values: statistics by bucket, candidates, a screen, refits."""
    fitter = _two_fitter(spark, sf_dir)
    fitter.expand(["f"], 3)
    return _two_shares(spark, fitter)


@query(_TWO)
def fit_calibrated_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve put in the wrong place, refitted in the sweep over all entries."""
    fitter = _two_fitter(spark, sf_dir)
    fitter.expand(["f"], 3)
    model = fitter.chain.model
    wrong = model.unpack(model.pack() + np.where([d >= 0 for _, _, d, _ in model.places()], 0.2, -0.4))
    fitter.chain.force("wrong", evaluate.evaluate(fitter.grid, wrong))
    fitter.calibrate()
    return _two_shares(spark, fitter)


@query(_TWO)
def fit_annealed_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poor curve and its regressor dropped and built anew by annealing."""
    fitter = _two_fitter(spark, sf_dir)
    fitter.expand(["f"], 3)
    poor = fitter.chain.model
    poor = poor.with_betas([[b * 0.3 for b in row] for row in poor.betas])
    fitter.chain.force("poor", evaluate.evaluate(fitter.grid, poor))
    fitter.anneal(["f"])
    return _two_shares(spark, fitter)
