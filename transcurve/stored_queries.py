"""Queries over what is stored and read back: grids, models, reports, series, categories, chains and journals.

They are registered with those of ``queries``; what they write lies in the session's shared folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.operators import grid, quantile, score
from transcurve.plans import diagnose
from transcurve.plans.fit import Fitter, load, save
from transcurve.plans.optimize import minimise
from transcurve.queries import _EV, _LI, EVENT_MODEL, EVENTS, LINE_MODEL, LOGIT_FAMILY, ORACLES, _events, _lines, _logit_grid, _r, _sql_probabilities, _t, _views, query
from transcurve.sampled_queries import _CELLS, _SHARES, _drawn
from transcurve.settings import Settings
from transcurve.sources import economic_series, grids
from transcurve.spec import Model


def _folder(spark: SparkSession, what: str) -> str:
    return f"{grid.shared_folder(spark).rstrip('/')}/{what}-{os.urandom(6).hex()}"


@query(f"WITH {_EV} SELECT o AS next_offset, count(*) AS n, round(avg(CAST(v AS FLOAT)::DOUBLE), 6) AS mean_v, round(min(CAST(v AS FLOAT)::DOUBLE), 6) AS least_v FROM vw GROUP BY o")
def grid_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitting grid written in single precision, read, checked and kept."""
    path = _folder(spark, "grid")
    grids.write(_views(spark, sf_dir), path, ["v"])
    rows = grids.read(spark, path, ["v"], next_status="next_offset").withColumn("v", F.col("v").cast("double"))
    return rows.groupBy("next_offset").agg(F.count("*").alias("n"), _r(F.avg("v")).alias("mean_v"), _r(F.min("v")).alias("least_v"))


@query(f"WITH {_LI} SELECT l_returnflag, round(avg(p0), 6) AS p_A, round(avg(p1), 6) AS p_N, round(avg(p2), 6) AS p_R FROM ({_sql_probabilities(LINE_MODEL, 'li', 'l_returnflag')}) GROUP BY l_returnflag")
def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model written as a document, read, and scored."""
    path = _folder(spark, "model")
    grids.write_model(spark, LINE_MODEL, path)
    rows = score.with_probabilities(_lines(spark, sf_dir), grids.read_model(spark, path))
    return rows.groupBy("l_returnflag").agg(*[_r(F.avg(f"p_{s}")).alias(f"p_{s}") for s in LINE_MODEL.reachable])


@query(f"SELECT \"from_status\" AS \"From\", to_status AS \"To\", count(*) AS points, round(sum(mass), 4) AS mass, round(sum(theoretical), 3) AS theoretical FROM ({ORACLES['visualizer_theoretical']}) GROUP BY 1, 2")
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report written as CSV under its fixed header, read and added up."""
    rows, path = _views(spark, sf_dir), _folder(spark, "report")
    diagnose.write_csv(diagnose.report(rows, EVENT_MODEL, quantile.edges(rows, ["v"], approximate=False)), path)
    found = spark.read.csv(path, header=True, inferSchema=True)
    return found.groupBy("From", "To").agg(F.count("*").alias("points"), _r(F.sum("Mass"), 4).alias("mass"), _r(F.sum("Theoretical"), 3).alias("theoretical"))


@query(
    "SELECT 0 AS id, 'all' AS name, 0 AS depth UNION ALL SELECT 100 + r_regionkey, r_name, 1 FROM region UNION ALL SELECT 1000 + n_nationkey, n_name, 2 FROM nation "
    "UNION ALL SELECT 1000000 + c_custkey, c_name, 3 FROM customer"
)
def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as the service's categories in XML, walked down from the root."""
    region, nation, customer = (_t(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    rows = spark.range(1).select(F.lit(0).alias("_id"), F.lit("all").alias("_name"), F.lit(0).alias("_parent_id"))  # the root is its own parent
    rows = rows.unionByName(region.select((100 + F.col("r_regionkey")).alias("_id"), F.col("r_name").alias("_name"), F.lit(0).alias("_parent_id")))
    rows = rows.unionByName(nation.select((1000 + F.col("n_nationkey")).alias("_id"), F.col("n_name").alias("_name"), (100 + F.col("n_regionkey")).alias("_parent_id")))
    rows = rows.unionByName(customer.select((1_000_000 + F.col("c_custkey")).alias("_id"), F.col("c_name").alias("_name"), (1000 + F.col("c_nationkey")).alias("_parent_id")))
    path = _folder(spark, "categories")
    rows.write.format("xml").option("rootTag", "categories").option("rowTag", "category").save(path)
    return economic_series.descendants(economic_series.categories(spark, path), 0).select("id", "name", "depth")


@query("SELECT c_custkey::VARCHAR AS series_id, c_name AS title, c_mktsegment AS units, '2020-01-05' AS observation_start, (c_custkey % 90)::INTEGER AS popularity, '2024-01-02 13:01:02' AS last_updated FROM customer")
def series_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the service's series in XML, and their metadata read back."""
    path = _folder(spark, "series")
    rows = _t(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("_id"), F.col("c_name").alias("_title"), F.col("c_mktsegment").alias("_units"), F.lit("2020-01-05").alias("_observation_start"), (F.col("c_custkey") % 90).alias("_popularity"),
        F.lit("2024-01-02 07:01:02-06").alias("_last_updated"),
    )
    rows.write.format("xml").option("rootTag", "seriess").option("rowTag", "series").save(path)
    found = economic_series.series(spark, path)
    return found.select("series_id", "title", "units", F.col("observation_start").cast("string").alias("observation_start"), "popularity", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"))


_MERGED = EVENTS.restrict(["click", "purchase", "view"])


@query("WITH ev AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), k AS (SELECT nxt, count(*) AS n FROM ev WHERE event_type = 'view' AND nxt IN ('click', 'purchase', 'view') GROUP BY nxt) SELECT nxt AS to_status, round(n / sum(n) OVER (), 6) AS probability FROM k")
def fit_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family of which only some statuses can be reached: rows that went elsewhere leave, the intercept fits the rest."""
    fitter = Fitter(_events(spark, sf_dir), _MERGED, "view", "event_type", "next_status", ["value"], Settings(validate=False))
    model = fitter.chain.model
    fitter.close()
    rows = score.with_probabilities(spark.range(1), model)
    return rows.select(F.explode(F.array(*[F.struct(F.lit(s).alias("to_status"), _r(f"p_{s}").alias("probability")) for s in model.reachable])).alias("x")).select("x.*")


@query(f"WITH {_LI}, c AS (SELECT CAST(l_linestatus = 'O' AS INT) AS y FROM li), m AS (SELECT avg(y) AS p FROM c) SELECT round(ln(p / (1 - p)), 5) AS intercept, 0.25::DOUBLE AS frozen, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 6) AS entropy FROM m")
def fit_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter freezes a beta on a column of zeros at what it was: the rest is fitted around it."""
    rows = _logit_grid(spark, sf_dir).withColumn("zero", F.lit(0.0)).cache()
    model = Model.create(LOGIT_FAMILY, "F").add_beta("zero").with_betas([(0.0, 0.0), (0.0, 0.25)]).with_filters(lambda m, k, e: e == 1)
    p = minimise(rows, model).point
    rows.unpersist()
    return spark.createDataFrame([(*p.model.betas[1], p.entropy)], "intercept double, frozen double, entropy double").select(_r("intercept", 5).alias("intercept"), "frozen", _r("entropy").alias("entropy"))


_CHAIN = (
    f"WITH {_CELLS.replace('850', '400').replace('350', '200')}, a AS (SELECT count(*) AS n, avg(y) AS p FROM ys), f AS (SELECT count(*) AS n, avg(y) AS p FROM ys GROUP BY f), "
    "h AS (SELECT n, ln(2) AS h0, -(p * ln(p) + (1 - p) * ln(1 - p)) AS h1, (SELECT -sum(n * (p * ln(p) + (1 - p) * ln(1 - p))) / sum(n) FROM f) AS h2 FROM a) "
    "SELECT 0 AS step, 'start' AS frame, 1 AS k, round(h0, 6) AS entropy, round(2 * (n * h0 + 1), 3) AS aic FROM h UNION ALL SELECT 1, 'intercept', 1, round(h1, 6), round(2 * (n * h1 + 1), 3) FROM h "
    "UNION ALL SELECT 2, 'coefficients', 2, round(h2, 6), round(2 * (n * h2 + 2), 3) FROM h"
)


def _chain(spark: SparkSession, sf_dir: str, journal: str | None) -> Fitter:
    shares = {k: {850: 400, 350: 200}.get(s, s) for k, s in _SHARES.items()}
    fitter = Fitter(_drawn(spark, sf_dir, shares), LOGIT_FAMILY, "F", "status", "next_status", ["f"], Settings(), journal=journal)
    fitter.add_coefficients(["f"])
    return fitter


def _chain_frame(spark: SparkSession, fitter: Fitter) -> DataFrame:
    fitter.close()
    return fitter.chain.frame(spark).select("step", "frame", "k", _r("entropy").alias("entropy"), _r("aic", 3).alias("aic"))


@query(_CHAIN)
def fit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted results of a fit, each validated: entropy and AIC of the start, the intercept and a coefficient."""
    return _chain_frame(spark, _chain(spark, sf_dir, None))


@query(_CHAIN)
def fit_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a journal that an earlier fit of the same rows has left."""
    path = _folder(spark, "journal")
    _chain(spark, sf_dir, path).close()
    fitter = _chain(spark, sf_dir, path)
    if fitter.journal.replayed != fitter.journal.at:
        raise RuntimeError("the fit asked what its journal should have answered")
    return _chain_frame(spark, fitter)


@query(_CHAIN.replace("SELECT 0 AS step", "SELECT frame, k, entropy FROM (SELECT 0 AS step") + ") WHERE step = 2")
def result_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit's result written as a document and read."""
    fitter, path = _chain(spark, sf_dir, None), _folder(spark, "result")
    save(fitter.chain.last, path, spark)
    fitter.close()
    model, found = load(path, spark)
    return spark.createDataFrame([(found["name"], model.parameter_count, found["entropy"])], "frame string, k int, entropy double").select("frame", "k", _r("entropy").alias("entropy"))
