"""Distributed evaluation of models: sums of entropies and their derivatives.

Values go through Catalyst expressions where one model is scored; derivatives and whole
batches of models go through one Arrow pass with the numpy kernel, whose partial sums
are added up by Spark, so the driver gets one vector a model however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcurve.functions import criteria, softmax
from transcurve.operators import kernel as k
from transcurve.operators import score
from transcurve.operators.counted import ROWS, tables
from transcurve.spec import Model

#: Tasks from which on partial sums are added in an intermediate step.
TREE = 256
#: Bytes of partial sums that the driver adds itself; beyond, tasks add all of a model first.
GATHERED = 8 << 20
#: Points kept of a cached grid, so that no model is evaluated twice at a level in a row of steps.
KEPT = 64


@dataclass
class Point:
    """A model evaluated on a grid: sums over its rows, and what follows from them."""

    model: Model
    level: int
    sums: dict[str, np.ndarray]

    @property
    def n(self) -> float:
        return float(self.sums["n"])

    def mean(self, name: str) -> np.ndarray:
        return self.sums[name] / max(self.n, 1.0)

    @property
    def entropy(self) -> float:
        return float(self.mean("h"))

    @property
    def entropy_variance(self) -> float:
        return max(0.0, float(self.mean("h2")) - self.entropy**2)

    @property
    def entropy_dev(self) -> float:
        """Deviation of the mean entropy."""
        return (self.entropy_variance / max(self.n, 1.0)) ** 0.5

    @property
    def gradient(self) -> np.ndarray:
        return self.mean("g")

    @property
    def hessian(self) -> np.ndarray:
        return self.mean("hessian")

    @property
    def fisher(self) -> np.ndarray:
        return self.mean("fisher")

    @property
    def aic(self) -> float:
        return criteria.aic(self.entropy, self.n, self.model.parameter_count)

    @property
    def tic(self) -> float:
        return criteria.tic(self.entropy, self.n, self.hessian, self.fisher)

    def param_std(self) -> np.ndarray:
        return criteria.param_std(self.fisher, self.n)

    def inverse_conditions(self) -> tuple[float, float, float]:
        j, i = criteria.inverse_condition(self.hessian), criteria.inverse_condition(self.fisher)
        return j, i, min(j, i)

    def penalty_gradient(self, target: str = "ENTROPY", l2: float = 0.0) -> np.ndarray:
        get = lambda name: self.mean(name) if name in self.sums else None
        return criteria.penalty_gradient(target, self.n, self.model.pack(), *map(get, ("g2", "j", "shift", "scaled", "scaled2")), l2)

    def objective(self, target: str = "ENTROPY", l2: float = 0.0) -> float:
        get = lambda name: self.mean(name) if name in self.sums else None
        return criteria.objective(target, self.n, self.entropy, self.model.pack(), get("g2"), get("j"), get("fisher"), get("hessian"), l2)


def _tasks(grid: DataFrame) -> int:
    """Tasks of a pass over a grid, planned once for all the passes of a fit."""
    if "_tasks" not in grid.__dict__:
        grid.__dict__["_tasks"] = grid.rdd.getNumPartitions()
    return grid.__dict__["_tasks"]


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> dict[str, np.ndarray]:
    return {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in names}


def sums(grid: DataFrame, models: Sequence[Model], level: int = k.VALUE, previous: Sequence[np.ndarray] | None = None) -> list[np.ndarray]:
    """Packed sums of each model over the grid (regressors and next_offset), in one pass, or one over each table of
    counted rows that the models need (``counted.Tables``).

    ``previous`` adds the scaled gradients against earlier Hessian diagonals, a model each.
    """
    def of(at: Sequence[int]) -> Callable:
        def own(x: dict[str, np.ndarray], actual: np.ndarray, kernels: list[k.Kernel], counts: np.ndarray | None) -> list[np.ndarray]:
            return [k.sums(kernel, x, actual, level, previous[i] if previous else None, counts) for i, kernel in zip(at, kernels, strict=True)]

        return own

    zero = lambda m: sum(int(np.prod(s)) for _, s in k.shape(len(m.places()), level)) + (2 * len(m.places()) + 1 if previous else 0)
    out: dict[int, np.ndarray] = {}
    for table, at in tables(grid, [m.regressors for m in models]):
        out.update(zip(at, _added(table, [models[i] for i in at], of(at), [zero(models[i]) for i in at]), strict=True))
    return [out[i] for i in range(len(models))]


def differences(grid: DataFrame, contests: Sequence[Sequence[Model]], bases: Sequence[Model]) -> list[np.ndarray]:
    """For each contest n, the sums of its models' entropies less its base's, and of their products, in one pass."""
    models = list(dict.fromkeys([*bases, *(m for ms in contests for m in ms)]))
    at = {m: i for i, m in enumerate(models)}
    places = [(at[base], [at[m] for m in ms]) for base, ms in zip(bases, contests, strict=True)]

    def of(x: dict[str, np.ndarray], actual: np.ndarray, kernels: list[k.Kernel], counts: np.ndarray | None) -> list[np.ndarray]:
        counts = np.ones(len(actual)) if counts is None else counts
        h = np.stack([kernel.entropy(x, actual) for kernel in kernels])
        out = []
        for base, own in places:
            d = h[own] - h[base]
            out.append(np.concatenate(([counts.sum()], d @ counts, ((d * counts) @ d.T).ravel())))
        return out

    return _added(grid, models, of, [1 + len(ms) + len(ms) ** 2 for ms in contests])


def directional(grid: DataFrame, models: Sequence[Model], directions: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Means over the grid of (g u) H u and t(u, u, .) for each model's directions u (``Kernel.directional``), in one pass."""

    def of(at: Sequence[int]) -> Callable:
        def own(x: dict[str, np.ndarray], actual: np.ndarray, kernels: list[k.Kernel], counts: np.ndarray | None) -> list[np.ndarray]:
            n = len(actual) if counts is None else counts.sum()
            return [np.concatenate(([n], *map(np.ravel, kernel.directional(x, actual, directions[i], counts)))) for i, kernel in zip(at, kernels, strict=True)]

        return own

    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for table, at in tables(grid, [m.regressors for m in models]):
        for i, packed in zip(at, _added(table, [models[i] for i in at], of(at), [1 + 2 * directions[i].size for i in at]), strict=True):
            cross, third = packed[1:].reshape(2, *directions[i].shape) / max(packed[0], 1.0)
            out[i] = cross, third
    return [out[i] for i in range(len(models))]


def exact_penalty_gradients(grid: DataFrame, points: Sequence[Point], target: str) -> list[np.ndarray]:
    """How an ICE target's penalty moves with each parameter, third derivatives included; one pass for all points.

    The points hold what the target's value needs.
    """
    directions, traces = [], []
    for p in points:
        if target == "ICE_RAW":
            inverse = criteria.pseudo_inverse(p.hessian)
            (a, v), (b, w) = np.linalg.eigh((inverse + inverse.T) / 2), np.linalg.eigh(inverse @ p.fisher @ inverse.T)
            directions.append(np.vstack((v.T, w.T)))
            traces.append((a, b))
        else:
            directions.append(np.eye(len(p.model.places())))
    out = []
    for i, (p, (cross, third)) in enumerate(zip(points, directional(grid, [p.model for p in points], directions) if points else [], strict=True)):
        if target == "ICE_RAW":
            (a, b), k = traces[i], len(cross) // 2
            out.append((2 * a @ cross[:k] - b @ third[k:]) / p.n)
        else:
            out.append(criteria.exact_penalty_gradient(target, p.n, p.mean("g2"), p.mean("j"), 2 * cross, third))
    return out


def ratio_sums(grid: DataFrame, model: Model, edges: dict[str, Sequence[float]]) -> dict[tuple[int, str], np.ndarray]:
    """By status and regressor: [buckets, 3] of the count, sum and sum of squares of observed to expected.

    The ratio of a row is 1 / p if it went to the status, else 0; rows fall into the bucket of the
    last edge not above their value. One pass over the grid for all, whose tasks add into dense arrays.
    """
    at = {r: np.asarray(edges[r], float) for r in edges}
    statuses = [i for i in range(len(model.reachable)) if i != model.origin]

    def of(fields: Sequence[str]) -> Callable:
        def own(x: dict[str, np.ndarray], actual: np.ndarray, kernels: list[k.Kernel], counts: np.ndarray | None) -> list[np.ndarray]:
            counts = np.ones(len(actual)) if counts is None else counts
            p = softmax.np_probabilities(kernels[0].scores(x, len(actual)))
            ratios = [np.isin(actual, model.same[i]) / p[list(model.same[i])].sum(axis=0) for i in statuses]
            out = []
            for r in fields:
                place = np.maximum(np.searchsorted(at[r], x[r], side="right") - 1, 0)
                sums = []
                for y in ratios:
                    ok = np.isfinite(x[r]) & np.isfinite(y)
                    sums.append([np.bincount(place[ok], w * counts[ok], len(at[r])) for w in (np.ones(ok.sum()), y[ok], y[ok] ** 2)])
                out.append(np.array(sums, float).ravel())
            return out

        return own

    found = _by_field(grid, model, of, {r: len(statuses) * 3 * len(at[r]) for r in edges})
    return {(i, r): sums.reshape(len(statuses), 3, -1)[n].T for r, sums in found.items() for n, i in enumerate(statuses)}


def bucket_sums(grid: DataFrame, model: Model, edges: dict[str, Sequence[float]]) -> dict[str, np.ndarray]:
    """By regressor: [buckets, 2 + 2 statuses] of the count, the count of rows with probabilities, what happened, and the probabilities.

    Rows fall into buckets as in ``ratio_sums``, in one pass whose tasks add into dense arrays.
    """
    statuses = len(model.reachable)
    at = {r: np.asarray(edges[r], float) for r in edges}

    def of(fields: Sequence[str]) -> Callable:
        def own(x: dict[str, np.ndarray], actual: np.ndarray, kernels: list[k.Kernel], counts: np.ndarray | None) -> list[np.ndarray]:
            p = softmax.np_probabilities(kernels[0].scores(x, len(actual)))
            known = np.isfinite(p).all(axis=0)
            weights = np.vstack((np.ones(len(actual)), known, actual == np.arange(statuses)[:, None], np.where(known, p, 0.0)))
            weights = weights if counts is None else weights * counts
            out = []
            for r in fields:
                ok = np.isfinite(x[r])
                place = np.maximum(np.searchsorted(at[r], x[r][ok], side="right") - 1, 0)
                out.append(np.stack([np.bincount(place, w[ok], len(at[r])) for w in weights], axis=1).ravel())
            return out

        return own

    found = _by_field(grid, model, of, {r: (2 + 2 * statuses) * len(at[r]) for r in edges})
    return {r: sums.reshape(len(at[r]), -1) for r, sums in found.items()}


def _by_field(grid: DataFrame, model: Model, of: Callable[[Sequence[str]], Callable], sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """The arrays of each field that ``of`` some fields makes, added over the tables that have the model's columns and the fields."""
    fields, out = list(sizes), {}
    for table, at in tables(grid, [{*model.regressors, r} for r in fields]):
        own = [fields[i] for i in at]
        out.update(zip(own, _added(table, [model], of(own), [sizes[r] for r in own], own), strict=True))
    return {r: out[r] for r in fields}


def _added(grid: DataFrame, models: Sequence[Model], of: Callable[[dict[str, np.ndarray], np.ndarray, list[k.Kernel], np.ndarray | None], list[np.ndarray]], sizes: Sequence[int], columns: Sequence[str] = ()) -> list[np.ndarray]:
    """The arrays that ``of`` makes of each slice of rows, added over the grid: each task adds its own, Spark the tasks'.

    The driver gets a row for each task and array, or, where those would be many or large, a row for each array.
    A counted grid's rows come with the numbers that they stand for.
    """
    names = sorted({*columns, *(r for m in models for r in m.regressors)})
    own = [ROWS] if ROWS in grid.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels = [k.Kernel(m) for m in models]
        total: list[np.ndarray] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):  # arrays of a slice stay in cache
                part = batch.slice(start, 4000)
                actual = part.column("next_offset").fill_null(-1).to_numpy(zero_copy_only=False).astype(int)
                new = of(_columns(part, names), actual, kernels, _columns(part, own)[ROWS] if own else None)
                total = [t + n for t, n in zip(total, new, strict=True)] if total else new
        yield from packed(dict(enumerate(total)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("model").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                t = np.frombuffer(raw)
                total[i] = total[i] + t if i in total else t
        yield from packed(total)

    def packed(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"model": pa.array(list(total), pa.int32()), "sums": pa.array([t.tobytes() for t in total.values()], pa.binary())})

    schema, tasks = "model int, sums binary", _tasks(grid)
    partial = grid.select(*names, "next_offset", *own).mapInArrow(run, schema)
    if tasks > TREE:  # tasks that add some of the tasks' rows of a model
        partial = partial.repartition(max(1, int(tasks**0.5)), "model", F.pmod(F.spark_partition_id(), F.lit(max(1, int(tasks**0.5) // len(sizes))))).mapInArrow(add, schema)
    if min(tasks, TREE) * 8 * sum(sizes) > GATHERED:  # then one that adds all of a model's
        partial = partial.repartition(min(len(sizes), TREE), "model").mapInArrow(add, schema)
    out: list[np.ndarray] = [np.zeros(n) for n in sizes]
    for r in partial.collect():
        out[r.model] = out[r.model] + np.frombuffer(r.sums)
    return out


def unpack(packed: np.ndarray, model: Model, level: int, previous: bool = False) -> dict[str, np.ndarray]:
    out, at, params = {}, 0, len(model.places())
    shapes = k.shape(params, level) + ([("scaled", (params,)), ("scaled2", (params,)), ("mass", ())] if previous else [])
    for name, shape in shapes:
        n = int(np.prod(shape))
        out[name] = packed[at : at + n].reshape(shape)
        at += n
    return out


def evaluate(grid: DataFrame, model: Model, level: int = k.VALUE, previous: np.ndarray | None = None) -> Point:
    return Point(model, level, unpack(sums(grid, [model], level, None if previous is None else [previous])[0], model, level, previous is not None))


def evaluate_many(grid: DataFrame, models: Sequence[Model], level: int = k.VALUE, previous: Sequence[np.ndarray] | None = None) -> list[Point]:
    """Many models in one pass: a line search, or all candidates of a step.

    Of a cached grid, whose rows stay, the last ``KEPT`` points are remembered on the driver:
    a model met again at the same level or a lower one costs no pass. ``evaluate`` always passes.
    """
    if previous is not None:
        return [Point(m, level, unpack(t, m, level, True)) for m, t in zip(models, sums(grid, models, level, previous), strict=True)]
    kept = grid.__dict__.setdefault("_points", {}) if grid.is_cached else {}
    keys = [(m, m.filters) for m in models]
    found = [kept[key] if key in kept and kept[key].level >= level else None for key in keys]
    new = [m for m, p in zip(models, found, strict=True) if p is None]
    passed = iter([Point(m, level, unpack(t, m, level)) for m, t in zip(new, sums(grid, new, level), strict=True)] if new else [])
    out = [p or next(passed) for p in found]
    for key, p in zip(keys, out, strict=True):
        kept.pop(key, None)
        kept[key] = p
    while len(kept) > KEPT:
        kept.pop(next(iter(kept)))
    return out


def entropy_frame(grid: DataFrame, model: Model, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, variance and deviation of the mean of the entropy, in each group, as Catalyst sums."""
    rows = score.with_entropy(grid, model)
    agg = rows.groupBy(*by).agg(F.count("entropy").alias("n"), F.sum("entropy").alias("sum_h"), F.sum(F.col("entropy") * F.col("entropy")).alias("sum_h2"))
    mean = F.col("sum_h") / F.col("n")
    variance = F.greatest(F.lit(0.0), F.col("sum_h2") / F.col("n") - mean * mean)
    return agg.select(*by, "n", mean.alias("mean_h"), variance.alias("var_h"), F.sqrt(variance / F.col("n")).alias("dev_h"))


def compare(grid: DataFrame, a: Model, b: Model, block: str = "block_id", min_dev: float = 0.0) -> DataFrame:
    """One row: mean difference of the models' entropies, its deviation over blocks, and z."""
    blocks = (
        score.with_entropy(score.with_entropy(grid, a, "__a_", "__ha"), b, "__b_", "__hb").groupBy(block).agg(F.count("*").alias("n"), F.sum("__ha").alias("ha"), F.sum("__hb").alias("hb"))
    )
    d = (F.col("ha") - F.col("hb")) / F.col("n")
    out = blocks.agg(F.sum("ha").alias("ha"), F.sum("hb").alias("hb"), F.sum("n").alias("n"), F.count("*").alias("blocks"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"))
    mean = (F.col("ha") - F.col("hb")) / F.col("n")
    dev = F.greatest(F.col("sd") / F.sqrt("blocks"), F.lit(min_dev))
    return out.select("n", "blocks", mean.alias("difference"), dev.alias("dev"), F.when(dev > 0, mean / dev).otherwise(F.lit(0.0)).alias("z"))


def gradient_frame(grid: DataFrame, model: Model) -> DataFrame:
    """One row of means over the grid of the gradient, its square and products, by Catalyst.

    For models without curves: columns g_i, g2_i, fisher_i_j and hessian_i_j.
    """
    if any(e.curves for e in model.entries):
        raise ValueError("curves are evaluated by the kernel")
    p = [F.col(f"`p_{s}`") for s in model.reachable]
    rows = score.with_probabilities(grid, model)
    weights = [score.weight(e) for e in model.entries]
    residual = softmax.score_gradient(p, F.col("next_offset"))
    places = model.places()
    rows = rows.withColumns({f"d{i}": residual[kk] * weights[e] for i, (kk, e, _, _) in enumerate(places)})
    hess = softmax.score_hessian(p)
    aggs = [F.count("*").alias("n")]
    for i, (ki, ei, _, _) in enumerate(places):
        aggs += [F.avg(f"d{i}").alias(f"g_{i}"), F.avg(F.col(f"d{i}") * F.col(f"d{i}")).alias(f"g2_{i}")]
        for j, (kj, ej, _, _) in enumerate(places[i:], i):
            aggs += [F.avg(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"fisher_{i}_{j}"), F.avg(hess[ki][kj] * weights[ei] * weights[ej]).alias(f"hessian_{i}_{j}")]
    return rows.agg(*aggs)


def gradient_difference(grid: DataFrame, model: Model, step: float = 1e-5) -> np.ndarray:
    """The gradient by central differences, all shifted models in one pass: a check of the analytic one."""
    theta = model.pack()
    shifted = [model.unpack(theta + s * step * np.eye(len(theta))[i]) for i in range(len(theta)) for s in (1, -1)]
    h = [p.entropy for p in evaluate_many(grid, shifted)]
    return np.array([(h[2 * i] - h[2 * i + 1]) / (2 * step) for i in range(len(theta))])


