"""Quantile sketches that are kept: a row of state for each part of a table, merged on demand.

A table that grows by parts (days, loads) is read once: each part's sketches are appended, and
the edges of the whole, or of any choice of parts, come from the sketches alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.operators.grid import finite
from transcurve.operators.quantile import BUCKETS, Edges, edge_probabilities

#: Size of a sketch: the rank error of a quantile is below 1.7 / K ** 0.9 or so with 99 %.
K = 4096


def rank_error(k: int = K) -> float:
    """The share of all rows by which a quantile's rank may be off, for a pair of edges at once."""
    return 2.446 / k**0.9433


def sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = K) -> DataFrame:
    """by..., regressor, n, mean, m2 and sketch of each column's finite values in each part, in one pass."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.when(finite(F.col(c).cast("double")), F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), (F.var_pop(x) * F.count(x)).alias(f"m2{i}"), F.kll_sketch_agg_double(x, F.lit(k)).alias(f"s{i}")]
    rows = df.groupBy(*by).agg(*aggs)
    states = [F.struct(F.lit(c).alias("regressor"), F.col(f"n{i}").alias("n"), F.coalesce(f"mean{i}", F.lit(0.0)).alias("mean"), F.coalesce(f"m2{i}", F.lit(0.0)).alias("m2"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)]
    return rows.select(*by, F.explode(F.array(*states)).alias("s")).select(*by, "s.*")


def append(df: DataFrame, path: str, columns: Sequence[str], by: Sequence[str] = (), k: int = K) -> None:
    """Add the sketches of new rows to those at ``path``; of a part that is there already both count."""
    sketches(df, columns, by, k).write.mode("append").parquet(path)


def merged(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state for each regressor (and ``by``) from those of its parts."""
    live = states.where("n > 0")
    rows = live.groupBy(*by, "regressor").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("inner"), F.sum(F.col("n") * F.col("mean") ** 2).alias("square"), F.kll_merge_agg_double("sketch").alias("sketch"))
    between = F.greatest(F.col("square") - F.col("n") * F.col("mean") ** 2, F.lit(0.0))
    return rows.select(*by, "regressor", "n", "mean", (F.col("inner") + between).alias("m2"), "sketch")


def quantiles(sketch: Column | str, probabilities: Sequence[float]) -> Column:
    """The quantiles of a sketch, an array."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(p)) for p in probabilities]))


def edges_frame(states: DataFrame, buckets: int = BUCKETS, by: Sequence[str] = ()) -> DataFrame:
    """by..., regressor, bucket, edge of the merged states."""
    return merged(states, by).select(*by, "regressor", F.posexplode(quantiles("sketch", edge_probabilities(buckets))).alias("bucket", "edge"))


def edges(states: DataFrame, buckets: int = BUCKETS) -> dict[str, Edges]:
    """Breakdowns of all regressors; only edges reach the driver."""
    out = {}
    for r in merged(states).select("regressor", "n", "mean", "m2", quantiles("sketch", edge_probabilities(buckets)).alias("q")).collect():
        variance = r.m2 / (r.n - 1) if r.n > 1 else 0.0
        out[r.regressor] = Edges(r.regressor, tuple(r.q), r.n, r["mean"], (variance / r.n) ** 0.5)
    return out


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
