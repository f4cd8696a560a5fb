"""Quantile buckets: edges, look-up, and statistics of a response by bucket."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Sequence
from itertools import accumulate
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcurve.operators.counted import ROWS
from transcurve.operators.grid import finite

#: Buckets of a breakdown.
BUCKETS = 100
#: Ranges of a counted column's values, each of which one task ranks.
RANGES = 200


@dataclass(frozen=True)
class Edges:
    """Left edges of the buckets of a column, in order, and its count, mean and mean's deviation."""

    column: str
    values: tuple[float, ...]
    count: int
    mean: float
    mean_dev: float

    def distinct(self) -> tuple[float, ...]:
        return tuple(sorted(set(self.values)))

    def trim(self, alpha: float) -> tuple[int, int]:
        return trimmed(len(self.values), alpha)


def trimmed(buckets: int, alpha: float) -> tuple[int, int]:
    """First and last bucket (exclusive) when a share alpha is cut at both ends."""
    if not 0 <= alpha < 0.5:
        raise ValueError("alpha must be in [0, 0.5)")
    first = int(alpha * buckets + 0.5)
    return first, buckets - first


def edge_probabilities(buckets: int = BUCKETS) -> list[float]:
    return [i / buckets for i in range(buckets)]


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], accuracy: int | None = None) -> list[float]:
    """Quantiles of a column's finite values, interpolated between neighbours, without a buffer of all values.

    A mergeable sketch of bounded size brackets every quantile; one pass counts what lies
    between the brackets' bounds; then only the values inside brackets, a share of about
    4 * len(probabilities) / accuracy, are counted by value and ranked, a bracket a task. The accuracy
    grows with the table, so that a bracket of 10^12 rows holds some millions. The passes share
    the one column, which is kept for them, on disk where memory is short.
    """
    x = F.col(column).cast("double")
    rows = df.where(finite(x)).select(x.alias("x")).persist()
    try:
        return _exact_quantiles(rows, probabilities, accuracy)
    finally:
        rows.unpersist()


def _exact_quantiles(rows: DataFrame, probabilities: Sequence[float], accuracy: int | None) -> list[float]:
    found = rows.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not found.n:
        return []
    accuracy = accuracy or max(20_000, min(1_000_000, found.n // 1_000_000))
    aside = 2 / accuracy + 3 / found.n  # the sketch's error, and the neighbours to interpolate between
    near = [min(1.0, max(0.0, p + s * aside)) for p in probabilities for s in (-1, 1)]
    at_near = rows.agg(F.percentile_approx("x", near, accuracy).alias("q")).first().q
    brackets: list[list[float]] = []
    pairs = [(found.lo if p <= aside else a, found.hi if p >= 1 - aside else b) for p, a, b in zip(probabilities, at_near[::2], at_near[1::2], strict=True)]
    for a, b in sorted(pairs):
        if brackets and a <= brackets[-1][1]:
            brackets[-1][1] = max(b, brackets[-1][1])
        else:
            brackets.append([a, b])
    # the last bracket that begins at or below a value, -1 below all
    begins = [a for a, _ in brackets]
    at = F.when(F.col("x") < begins[0], -1).otherwise(bucket(F.col("x"), begins))
    placed = rows.withColumn("at", at)
    ends = F.get(F.array(*[F.lit(float(b)) for _, b in brackets]), F.greatest("at", F.lit(0)))
    placed = placed.withColumn("inside", (F.col("at") >= 0) & (F.col("x") <= ends))
    counts = {(r["at"], r["inside"]): r["n"] for r in placed.groupBy("at", "inside").agg(F.count("*").alias("n")).collect()}  # two rows a bracket
    before, total = [], counts.get((-1, False), 0)
    for i in range(len(brackets)):
        before.append(total)
        total += counts.get((i, True), 0) + counts.get((i, False), 0)
    ranks = [p * (found.n - 1) for p in probabilities]
    wanted = sorted({int(r) for r in ranks} | {min(int(r) + 1, found.n - 1) for r in ranks})
    inside = placed.where("inside").groupBy("at", "x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("at").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    start = F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("at"))
    ranked = inside.withColumn("upto", upto + start)
    hits = F.filter(F.array(*[F.lit(w).cast("long") for w in wanted]), lambda w: (w < F.col("upto")) & (w >= F.col("upto") - F.col("n")))
    value = {r.w: r.x for r in ranked.where(F.size(hits) > 0).select("x", F.explode(hits).alias("w")).collect()}  # two ranks a quantile
    out = []
    for r in ranks:
        lo, hi = value[int(r)], value[min(int(r) + 1, found.n - 1)]
        out.append(lo + (r - int(r)) * (hi - lo) if hi != lo else lo)
    return out


def edges_frame(df: DataFrame, column: str, buckets: int = BUCKETS, approximate: bool = False, accuracy: int = 200_000) -> DataFrame:
    """bucket, edge: the column's quantiles i / buckets over its finite values.

    Exact quantiles interpolate (``exact_quantiles``); approximate ones are a mergeable
    sketch's, whose size is bounded by the accuracy. Only edges reach the driver.
    """
    if not approximate:
        found = exact_quantiles(df, column, edge_probabilities(buckets))
        return df.sparkSession.createDataFrame(list(enumerate(found)), "bucket int, edge double")
    x = F.col(column).cast("double")
    q = F.percentile_approx(x, edge_probabilities(buckets), accuracy)
    return df.where(finite(x)).agg(q.alias("q")).where("q is not null").select(F.posexplode("q").alias("bucket", "edge"))


def edges(df: DataFrame, columns: Sequence[str], buckets: int = BUCKETS, approximate: bool = True, accuracy: int = 200_000) -> dict[str, Edges]:
    """Breakdowns of several columns, approximate ones in one pass; only the edges reach the driver.

    Those of a counted grid are of the rows that it stands for, and exact: approximate ones are values of the column.
    """
    if ROWS in df.columns:
        return {c: _counted_edges(df, c, buckets, approximate) for c in columns}
    out, aggs = {}, []
    for i, c in enumerate(columns):
        x = F.when(finite(F.col(c).cast("double")), F.col(c).cast("double"))
        aggs += [F.percentile_approx(x, edge_probabilities(buckets), accuracy).alias(f"q{i}")] if approximate else []
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias(f"v{i}")]
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        values = row[f"q{i}"] or () if approximate else exact_quantiles(df, c, edge_probabilities(buckets))
        out[c] = Edges(c, tuple(values), n, row[f"m{i}"] or 0.0, (row[f"v{i}"] / n) ** 0.5 if n else 0.0)
    return out


def _counted_edges(df: DataFrame, column: str, buckets: int, approximate: bool) -> Edges:
    """The breakdown of one column of a counted grid, from its distinct values with their numbers.

    The values are dealt into ranges of about as many distinct ones, whose rows are counted; a range in which
    a wanted rank falls is ranked by a task.
    """
    x = F.col(column).cast("double")
    values = df.where(finite(x)).groupBy(x.alias("x")).agg(F.sum(ROWS).cast("long").alias("n")).persist()
    try:
        found = values.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("sum"), F.percentile_approx("x", edge_probabilities(RANGES), 20_000).alias("q")).first()
        if not found.n:
            return Edges(column, (), 0, 0.0, 0.0)
        n, mean = found.n, found["sum"] / found.n
        placed = values.withColumn("at", bucket(F.col("x"), sorted(set(found.q))))
        parts = placed.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("x") - mean) * (F.col("x") - mean)).alias("square")).orderBy("at").collect()  # a row a range
        before = list(accumulate((r.n for r in parts), initial=0))
        ranks = [max(math.ceil(p * n) - 1, 0) if approximate else p * (n - 1) for p in edge_probabilities(buckets)]
        wanted = sorted({int(r) for r in ranks} | {min(math.ceil(r), n - 1) for r in ranks})
        places = [(w, bisect_right(before, w) - 1) for w in wanted]
        # each wanted rank, its range, and its place there
        ranges = df.sparkSession.createDataFrame([(w, parts[i]["at"], w - before[i]) for w, i in places], "w long, at int, place long")
        upto = F.sum("n").over(Window.partitionBy("at").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
        ranked = placed.where(F.col("at").isin(sorted({parts[i]["at"] for _, i in places}))).withColumn("upto", upto)
        hits = ranked.join(F.broadcast(ranges), "at").where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
        value = {r.w: r.x for r in hits.select("w", "x").collect()}  # two ranks a quantile
    finally:
        values.unpersist()
    out = []
    for r in ranks:
        lo, hi = value[int(r)], value[min(math.ceil(r), n - 1)]
        out.append(lo + (r - int(r)) * (hi - lo) if hi != lo else lo)
    variance = math.fsum(r.square for r in parts) / (n - 1) if n > 1 else 0.0
    return Edges(column, tuple(out), n, mean, (variance / n) ** 0.5)


def bucket(x: Column, at: Sequence[float]) -> Column:
    """Index of the greatest edge not above x, at least 0; the last of equal edges.

    A balanced tree of comparisons: a look-up costs the logarithm of the edges and stays
    in generated code.
    """
    if not at:
        return F.when(x.isNotNull(), F.lit(0))

    def tree(lo: int, hi: int) -> Column:  # the answer is in [lo, hi)
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x >= F.lit(float(at[mid])), tree(mid, hi)).otherwise(tree(lo, mid))

    return F.when(finite(x), tree(0, len(at)))


def bucket_by_frame(df: DataFrame, x: str, edge_rows: DataFrame, name: str = "bucket") -> DataFrame:
    """The same look-up against an edges frame, broadcast as one array of ``BUCKETS`` doubles or so."""
    packed = edge_rows.agg(F.array_sort(F.collect_list("edge")).alias("__edges"))
    found = F.greatest(F.size(F.filter("__edges", lambda e: e <= F.col(x))) - 1, F.lit(0))
    return df.crossJoin(F.broadcast(packed)).withColumn(name, F.when(finite(F.col(x)), found)).drop("__edges")


def variance_stats(y: Column, prefix: str = "") -> list[Column]:
    """Count, mean, variance (0 up to one row), variance and deviation of the mean, of finite values."""
    v = F.when(finite(y), y)
    var = F.coalesce(F.var_samp(v), F.lit(0.0))
    n = F.count(v)
    return [n.alias(prefix + "n"), F.avg(v).alias(prefix + "mean"), var.alias(prefix + "variance"), (var / n).alias(prefix + "mean_variance"), F.sqrt(var / n).alias(prefix + "mean_dev")]


def population_mean_variance(x: Column) -> Column:
    """(E[x^2] - E[x]^2) / n, at least 0."""
    return F.greatest((F.avg(x * x) - F.avg(x) * F.avg(x)) / F.count(x), F.lit(0.0))


def bucket_stats(df: DataFrame, bucket_column: str, y: Column, by: Sequence[str] = ()) -> DataFrame:
    """n, mean_y, dev_y (sample) and mean_dev_y of y in each bucket."""
    v = F.when(finite(y), y)
    dev = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    return df.where(F.col(bucket_column).isNotNull()).groupBy(*by, bucket_column).agg(F.count(v).alias("n"), F.avg(v).alias("mean_y"), dev.alias("dev_y"), (dev / F.sqrt(F.count(v))).alias("mean_dev_y"))


def convergence(stats: DataFrame, global_mean: Column | str) -> DataFrame:
    """``stats`` with ``passed``: whether a bucket's mean stands apart from its neighbour's or the global one.

    A pair of adjacent buckets fails if its means are within three deviations of each
    other by both buckets' measure and the first is within three of the global mean;
    pairs whose first mean is beyond a hundred deviations are not tested.
    """
    w = Window.orderBy("bucket")  # a row for each bucket
    ya, yb = F.col("mean_y"), F.lead("mean_y").over(w)
    va, vb = F.pow("mean_dev_y", F.lit(2.0)), F.pow(F.lead("mean_dev_y").over(w), F.lit(2.0))
    g = F.col(global_mean) if isinstance(global_mean, str) else global_mean
    near = (F.pow(ya - yb, F.lit(2.0)) < 9 * va) & (F.pow(ya - yb, F.lit(2.0)) < 9 * vb) & (F.pow(ya - g, F.lit(2.0)) < 9 * va)
    return stats.withColumn("passed", F.coalesce((F.abs(ya) > 100 * F.sqrt(va)) | ~near, F.lit(True)))


def log_adjusted(stats: DataFrame) -> DataFrame:
    """``stats`` with adj_y, the logarithm of the mean kept within [.5 / n, 2 n], and its deviation adj_dev."""
    n = F.col("n").cast("double")
    bounded = F.greatest(F.least(F.col("mean_y"), 2 * n), 0.5 / n)
    adj = F.log(bounded)
    empty = F.col("n") == 0
    return stats.withColumn("adj_y", F.when(empty, 0.0).otherwise(adj)).withColumn("adj_dev", F.when(empty, 0.0).otherwise(F.log(F.col("mean_dev_y") + bounded) - adj))


@dataclass(frozen=True)
class Moments:
    """Count, mean and sum of squared deviations of a response in each bucket; parts of a table merge to the whole's."""

    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def none(cls, buckets: int) -> Moments:
        return cls(*np.zeros((3, buckets)))

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        share = np.divide(other.n, n, out=np.zeros(len(n)), where=n > 0)
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * share, self.m2 + other.m2 + gap * gap * self.n * share)

    @property
    def mean_variance(self) -> np.ndarray:
        """Sample variance of each bucket's mean, 0 up to one row."""
        variance = np.divide(self.m2, self.n - 1, out=np.zeros(len(self.n)), where=self.n > 1)
        return np.divide(variance, self.n, out=np.zeros(len(self.n)), where=self.n > 0)

    @property
    def global_mean(self) -> float:
        return float((self.n * self.mean).sum() / self.n.sum()) if self.n.sum() else 0.0

    def converged(self) -> bool:
        """Whether ``convergence`` passes for every bucket; buckets without rows have mean and variance 0."""
        a, b = np.where(self.n > 0, self.mean, 0.0)[:-1], np.where(self.n > 0, self.mean, 0.0)[1:]
        va, vb = self.mean_variance[:-1], self.mean_variance[1:]
        near = ((a - b) ** 2 < 9 * va) & ((a - b) ** 2 < 9 * vb) & ((a - self.global_mean) ** 2 < 9 * va)
        return not (near & (np.abs(a) <= 100 * np.sqrt(va))).any()


def moments(df: DataFrame, bucket_column: str, y: Column, buckets: int) -> Moments:
    """The moments of the finite y in each bucket: a row a bucket reaches the driver."""
    v = F.when(finite(y), y)
    rows = df.where(F.col(bucket_column).isNotNull()).groupBy(F.col(bucket_column).alias("b")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")).collect()
    out = Moments.none(buckets)
    for r in rows:
        if r.n:
            out.n[r.b], out.mean[r.b], out.m2[r.b] = r.n, r.mean, r.m2
    return out


def until_converged(part: Callable[[int, int], DataFrame], ends: Sequence[int], bucket_column: str, y: Column, buckets: int) -> tuple[Moments, int]:
    """Moments of a growing sample, and where it ended: at the first of ``ends`` at which all buckets stand apart, else the last.

    ``part(first, end)`` gives the rows between two ends and reads no others (a blocked grid's
    ``slice``); parts must be random samples of the table. What was read is merged, never read again.
    """
    total, done = Moments.none(buckets), 0
    for end in ends:
        total, done = total.merged(moments(part(done, end), bucket_column, y, buckets)), end
        if total.n.sum() and total.converged():
            break
    return total, done


def moments_frame(spark: SparkSession, found: Moments) -> DataFrame:
    """bucket, n, mean_y, mean_dev_y of the buckets that have rows."""
    dev = np.sqrt(found.mean_variance)
    rows = [(i, int(found.n[i]), float(found.mean[i]), float(dev[i])) for i in range(len(found.n)) if found.n[i]]
    return spark.createDataFrame(rows, "bucket int, n long, mean_y double, mean_dev_y double")
