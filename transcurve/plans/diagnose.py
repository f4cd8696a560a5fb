"""Diagnostics: observed against modelled transitions by bucket, what-if curves, residual plots.

The grid is scored once; all regressors' buckets are added in one pass, and only they reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.operators import evaluate, quantile, score
from transcurve.operators.interpolate import Interpolated
from transcurve.spec import Model, ModelError

KINDS = ("THEORETICAL", "ACTUAL", "MODEL", "MASS")


def bucket_report(grid: DataFrame, model: Model, edges: dict[str, quantile.Edges]) -> DataFrame:
    """to_status, regressor, bucket, value (left edge), n, mass, observed, model: one pass over the grid."""
    if len(model.reachable) < 2:
        raise ModelError("a status that leads nowhere can't be shown")
    at, k, rows = {r: e.distinct() for r, e in edges.items()}, len(model.reachable), []
    for r, sums in evaluate.bucket_sums(grid, model, at).items():
        total = float(sums[:, 0].sum())
        for bucket, (n, known, *rest) in enumerate(sums.tolist()):
            if n:
                rows += [(s, r, bucket, at[r][bucket], int(n), n / total, rest[i] / n, rest[k + i] / known if known else None) for i, s in enumerate(model.reachable)]
    return grid.sparkSession.createDataFrame(rows, "to_status string, regressor string, bucket int, value double, n long, mass double, observed double, model double")


def constant_grid(spark: SparkSession, fixed: dict[str, float], regressor: str, low: float, high: float, steps: int) -> DataFrame:
    """Rows in which one regressor goes from low to high in equal steps and the others stay."""
    step = (high - low) / (steps - 1) if steps > 1 else 0.0
    rows = spark.range(steps)
    others = [F.lit(float(v)).alias(r) for r, v in fixed.items() if r != regressor]
    return rows.select("id", (F.lit(float(low)) + F.col("id") * step).alias(regressor), *others)


def what_if(spark: SparkSession, model: Model, status: str, regressor: str, fixed: dict[str, float], low: float, high: float, steps: int) -> DataFrame:
    """value, theoretical: the probability of a status as one regressor moves."""
    rows = score.with_probabilities(constant_grid(spark, fixed, regressor, low, high, steps), model)
    return rows.select("id", F.col(regressor).alias("value"), F.col(f"`p_{status}`").alias("theoretical"))


def report(grid: DataFrame, model: Model, edges: dict[str, quantile.Edges], alpha: float = 0.05) -> DataFrame:
    """from_status, to_status, regressor, value, mass, observed, model, theoretical of the trimmed buckets.

    The theoretical probability has the other regressors at their means.
    """
    rows = bucket_report(grid, model, edges)
    keep = F.lit(False)
    for r, e in edges.items():
        first, last = quantile.trimmed(len(e.distinct()), alpha)
        keep = F.when(F.col("regressor") == r, (F.col("bucket") >= first) & (F.col("bucket") < last)).otherwise(keep)
    rows = rows.where(keep)
    others = {r: F.when(F.col("regressor") == r, F.col("value")).otherwise(F.lit(e.mean)) for r, e in edges.items()}
    scored = score.with_probabilities(rows.withColumns(others), model, "__t_")
    theory = F.lit(None).cast("double")
    for s in model.reachable:
        theory = F.when(F.col("to_status") == s, F.col(f"`__t_{s}`")).otherwise(theory)
    return scored.select(F.lit(model.status).alias("from_status"), "to_status", "regressor", "value", "mass", "observed", "model", theory.alias("theoretical"))


def graph(rows: DataFrame, status: str, regressor: str, kind: str) -> Interpolated:
    """A curve of a report, by its kind."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    column = {"THEORETICAL": "theoretical", "ACTUAL": "observed", "MODEL": "model", "MASS": "mass"}[kind]
    found = rows.where((F.col("to_status") == status) & (F.col("regressor") == regressor)).select("value", column).orderBy("value").collect()
    return Interpolated([r[0] for r in found], [r[1] for r in found])


def qq_plot(rows: DataFrame, status: str, regressor: str, alpha: float = 0.01) -> list[tuple[float, float]]:
    """Expected normal and actual residuals of a bucket report, sorted: a point for each bucket but a share alpha at both ends."""
    found = rows.where((F.col("to_status") == status) & (F.col("regressor") == regressor)).select("bucket", (F.col("observed") - F.col("model")).alias("r")).orderBy("bucket").collect()
    first, last = quantile.trimmed(len(found), alpha)
    residuals = sorted(r.r for r in found[first:last])
    dev = (sum(r * r for r in residuals) / len(residuals)) ** 0.5 if residuals else 0.0
    if not dev:
        return [(0.0, r) for r in residuals]
    dist = NormalDist(0, dev)
    return [(dist.inv_cdf((i + 0.01) / (len(residuals) * 1.02)), r) for i, r in enumerate(residuals)]


def write_csv(rows: DataFrame, path: str) -> None:
    """The report as one CSV folder with a header, whose names are fixed: readers of such reports look for them."""
    names = {"from_status": "From", "to_status": "To", "regressor": "RegressorName"}
    rows.select(*[F.col(c).alias(names.get(c, c.capitalize())) for c in rows.columns]).write.mode("overwrite").option("header", True).csv(path)


def regressors_of(model: Model, extra: Sequence[str] = ()) -> list[str]:
    return sorted({*model.regressors, *extra})
