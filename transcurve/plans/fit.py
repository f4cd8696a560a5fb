"""Model building: greedy growth by curves, calibration, interactions, annealing and trimming.

The grid is bound once, and its equal rows are counted as it is read (``counted.Tables``). Every question to it is
a distributed pass that returns bucket statistics or sums of derivatives; candidates of a step share passes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.functions.curves import TYPES, Curve
from transcurve.operators import grid as grids
from transcurve.operators import kernel, quantile
from transcurve.operators.blocked import BlockedGrid
from transcurve.operators.counted import ROWS, Tables, counted
from transcurve.operators.evaluate import Point, evaluate, evaluate_many, ratio_sums
from transcurve.plans.journal import Journal
from transcurve.plans.optimize import FitError, minimise, minimise_many
from transcurve.settings import Settings
from transcurve.spec import Entry, Model, StatusFamily

#: A drop is kept while it costs less AIC; an intercept is compensated for betas larger than this.
TRIM_GAIN, LARGE_BETA = 5.0, 8.0
#: A fit that is worse by so much AIC isn't considered: the result is the one before it.
WORSE = 5.0


@dataclass
class Result:
    """A model as it was judged."""

    name: str
    point: Point
    previous: Result | None = field(default=None, repr=False)

    @property
    def model(self) -> Model:
        return self.point.model

    @property
    def entropy(self) -> float:
        return self.point.entropy

    @property
    def aic(self) -> float:
        return self.point.aic

    @property
    def aic_difference(self) -> float:
        """AIC less that of the result before it."""
        return self.aic - self.previous.aic if self.previous else 0.0

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "n": self.point.n, "entropy": self.entropy, "aic": self.aic, "params": self.model.parameter_count, "model": json.loads(self.model.to_json())})


class Chain:
    """The accepted results of a fit, each better than the one before.

    ``judge`` evaluates a model anew at a level: for results with all derivatives, and to
    validate what is accepted.
    """

    def __init__(self, first: Result, settings: Settings, judge: Callable[[Model, int], Point] | None = None):
        self.results, self.settings, self.judge, self.skipped = [first], settings, judge, []

    @property
    def last(self) -> Result:
        return self.results[-1]

    @property
    def model(self) -> Model:
        return self.last.model

    def push(self, name: str, point: Point) -> bool:
        """Accept a point whose AIC is better by more than the cut-off."""
        if not math.isfinite(point.entropy):
            raise FitError("entropy is not finite")
        if point.aic - self.last.aic >= min(0.0, self.settings.aic_cutoff):
            return False
        self.force(name, point)
        return True

    def force(self, name: str, point: Point) -> None:
        if self.judge and (self.settings.validate or self.settings.complex_results):
            again = self.judge(point.model, kernel.SECOND if self.settings.complex_results else kernel.VALUE)
            if self.settings.validate and not math.isclose(again.entropy, point.entropy, rel_tol=1e-9, abs_tol=1e-12):
                raise FitError(f"{name}: entropy {point.entropy} comes out as {again.entropy}")
            point = again if again.level > point.level else point
        self.results.append(Result(name, point, self.last))

    def vacuous(self, name: str) -> Result:
        """The result of a step that failed or was much worse: the one before it, unchanged. It is noted in ``skipped``."""
        self.skipped.append(name)
        return Result(name, self.last.point, self.last)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r.name, r.entropy, r.model.parameter_count, r.aic, r.aic_difference) for i, r in enumerate(self.results)]
        return spark.createDataFrame(rows, "step int, frame string, entropy double, k int, aic double, aic_diff double")


def save(result: Result, path: str, spark: SparkSession) -> None:
    """Write a result as JSON, to any file system that Spark writes."""
    spark.createDataFrame([(result.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(path: str, spark: SparkSession) -> tuple[Model, dict]:
    d = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    return Model.from_json(json.dumps(d["model"])), d


@dataclass(frozen=True)
class RatioBucket:
    """A bucket's rows, the mean ratio of observed to expected and its deviation, and their logarithms."""

    bucket: int
    n: int
    mean_y: float
    mean_dev_y: float
    adj_y: float
    adj_dev: float

    @classmethod
    def of(cls, bucket: int, n: float, total: float, square: float) -> RatioBucket:
        mean = total / n
        dev = math.sqrt(max(0.0, (square - n * mean * mean) / (n - 1)) / n) if n > 1 else 0.0
        bounded = max(min(mean, 2 * n), 0.5 / n)
        return cls(bucket, int(n), mean, dev, math.log(bounded), math.log(dev + bounded) - math.log(bounded))


class Breakdowns(dict):
    """The edges of regressors: those of the first table at once, others when they are first asked for."""

    def __init__(self, tables: Tables, first: DataFrame, columns: Sequence[str]):
        super().__init__(quantile.edges(first, columns))
        self.tables = tables

    def __missing__(self, column: str) -> quantile.Edges:
        self.update(quantile.edges(self.tables.of((column,)), [column]))
        return self[column]


@dataclass
class Candidate:
    """A curve to add: the model with it, and where it came from."""

    regressor: str
    status: int
    model: Model


class Fitter:
    """A fit of one from-status over a status grid.

    ``forbidden`` says which curves may not be added, by to-status, regressor and type. With a
    ``journal``, a folder that outlives the driver, a fit that is begun anew with the same rows
    and settings goes on where it was lost.
    """

    def __init__(self, df: DataFrame, family: StatusFamily, origin: str, status: str, next_status: str, regressors: Sequence[str], settings: Settings | None = None, float32: bool = True, forbidden: Callable[[str, str, str], bool] | None = None, journal: str | None = None):
        self.settings, self.family, self.origin = settings or Settings(), family, origin
        self.journal = Journal(df.sparkSession, journal) if journal else None
        self.regressors, self.forbidden = tuple(regressors), forbidden
        model = Model.create(family, origin)

        def bound(rows: DataFrame) -> DataFrame:
            # a row's hash tells it apart from others with the same regressors
            rows = rows.select(*[F.col(r).cast("double").alias(r) for r in self.regressors], F.col(next_status).alias("__next"), grids.row_hash(rows).alias("__id"))
            rows = grids.float32(rows, self.regressors) if float32 else rows
            return rows.withColumn("next_offset", grids.encode(F.col("__next"), model.reachable)).drop("__next")

        rows = bound(grids.fitting_rows(df, status, next_status, family, origin))
        if self.settings.random_shuffle:  # by a hash of the row, inside each part: nothing moves between machines
            rows = rows.sortWithinPartitions(F.xxhash64("__id", F.lit(self.settings.seed)))
        self.blocks = None
        if self.settings.block_groups:
            # rows are told apart by all columns of the table, of which only the grid's are written
            names = (*self.regressors, "next_offset")
            keyed = rows.select(*names, "__id")
            self.blocks = BlockedGrid.lay_out(keyed, groups=self.settings.block_groups, keep=names, seed=self.settings.seed)
            rows = self.blocks.rows = grids.materialise(self.blocks.rows)
        self.grid = Tables.attach(rows if self.blocks else grids.materialise(rows.drop("__id")), self.regressors)
        tables = self.grid.__dict__["_tables"]
        self.edges = Breakdowns(tables, *((self.grid, self.regressors) if self.blocks else tables.begin(bound(df.where(F.col(status) == origin)))))
        judge = lambda m, level: self._asked("judge", m, level, lambda: evaluate(self.grid, m, level))
        self.chain = Chain(Result("start", judge(model, kernel.VALUE)), self.settings, judge)
        if not self.chain.last.point.n:
            raise FitError("no rows to fit")
        self.chain.force("intercept", self._asked("intercept", model, kernel.VALUE, lambda: self.intercept(model)))

    def _asked(self, what: str, model: Model, level: int, compute: Callable[[], Point | None]) -> Point | None:
        return self.journal.point(what, model, level, compute) if self.journal else compute()

    # -- parameters ------------------------------------------------------------------------------
    def intercept(self, model: Model) -> Point:
        """The optimum of the intercepts alone, where no entry follows them, from counts."""
        if len(model.entries) > 1 or any(len(s) > 1 for s in model.same) or model.origin < 0:
            return minimise(self.blocks or self.grid, model, self.settings, lambda p: p[1] == 0 and p[2] < 0).point
        n = {r.next_offset: r[ROWS] for r in counted(self.grid.__dict__["_tables"].of(()), ()).collect()}
        base = n.get(model.origin, 0)
        if not base or self.settings.target != "ENTROPY":
            return minimise(self.blocks or self.grid, model, self.settings).point
        betas = [[0.0 if k == model.origin else math.log(max(n.get(k, 0), 0.5) / base)] for k in range(len(model.reachable))]
        return evaluate(self.grid, model.with_betas(betas))

    def _fit(self, model: Model, wanted=None) -> Point:
        free = "".join("01"[wanted is None or wanted(p)] for p in model.places())
        return self._asked(f"fit {free}", model, kernel.SECOND, lambda: minimise(self.blocks or self.grid, model, self.settings, wanted).point)

    def guarded(self, name: str, model: Model, wanted=None) -> Result:
        """A fit of a model as a result; one that fails or ends much worse than the last result is vacuous."""
        try:
            point = self._fit(model, wanted)
        except (FitError, np.linalg.LinAlgError):
            return self.chain.vacuous(name)
        if not math.isfinite(point.entropy) or point.aic >= self.chain.last.aic + WORSE:
            return self.chain.vacuous(name)
        return Result(name, point, self.chain.last)

    def _push(self, name: str, model: Model, wanted=None) -> bool:
        return self.chain.push(name, self.guarded(name, model, wanted).point)

    def fit_all(self, model: Model | None = None) -> bool:
        return self._push("all parameters", model or self.chain.model)

    def fit_betas(self, model: Model | None = None, name: str = "betas") -> bool:
        """The betas alone: a convex problem."""
        return self._push(name, model or self.chain.model, lambda p: p[2] < 0)

    def fit_entries(self, entries: Sequence[int], model: Model | None = None) -> bool:
        chosen = set(entries)
        return self._push("entries", model or self.chain.model, lambda p: p[1] in chosen)

    def add_coefficients(self, regressors: Sequence[str]) -> bool:
        model = self.chain.model
        for r in regressors:
            model = model.add_beta(r)
        return self.fit_betas(model, "coefficients")

    # -- curves ----------------------------------------------------------------------------------
    def ratio_stats(self, model: Model, fields: Sequence[str]) -> dict[tuple[int, str], list[RatioBucket]]:
        """Observed to expected by status, regressor and bucket, all in one pass; buckets without rows are left out."""
        sums = ratio_sums(self.grid, model, {r: self.edges[r].distinct() for r in fields})
        return {key: [RatioBucket.of(i, *row) for i, row in enumerate(found) if row[0]] for key, found in sums.items()}

    def starts(self, kind: str, regressor: str, stats: Sequence, rng: np.random.Generator) -> list[tuple[Curve, float]]:
        """Starting curves and betas from bucket statistics: raw, and polished against the buckets."""
        x = np.array([sorted(set(self.edges[regressor].values))[r.bucket] for r in stats])
        mass, y = np.array([r.n for r in stats], float), np.array([r.adj_y for r in stats], float)
        if len(x) < 2 or not mass.sum():
            return []
        sigma = math.sqrt(max(float(np.average((x - np.average(x, weights=mass)) ** 2, weights=mass)), 1e-300))
        out = []
        for spread in (sigma, self.edges[regressor].mean_dev or sigma):
            centre, u = float(rng.choice(x, p=mass / mass.sum())), rng.uniform(0.5, 1.5)
            if kind == "GAUSSIAN":
                out.append((Curve(kind, (centre, u * spread)), float(y[np.argmin(np.abs(x - centre))] - np.average(y, weights=mass))))
            else:
                above, below = y[x > centre].sum(), y[x <= centre].sum()
                out.append((Curve(kind, (centre, math.sqrt(u * math.sqrt(len(x)) / spread))), float((above - below) / len(x))))
        if self.settings.polish_starting_params:
            out.append(self._polish(kind, x, y, mass, sigma, rng))
        if self.settings.bound_centrality:
            out = [(Curve(c.type, (float(np.clip(c.params[0], x[0], x[-1])), c.params[1])), b) for c, b in out]
        return out

    def _polish(self, kind: str, x: np.ndarray, y: np.ndarray, mass: np.ndarray, sigma: float, rng: np.random.Generator) -> tuple[Curve, float]:
        """Least squares of intercept + beta * curve to the buckets, weighted by mass, from several starts."""
        best: tuple[float, Curve, float] | None = None
        for _ in range(self.settings.polish_start_points):
            centre = float(rng.choice(x, p=mass / mass.sum()))
            width = sigma * rng.uniform(0.1, 1.5)
            theta = np.array([centre, width if kind == "GAUSSIAN" else math.sqrt(2 / width)])
            loss, damp, kept, move = math.inf, 1e-2, theta, np.zeros(len(theta))
            for _ in range(40):  # Gauss-Newton on the curve; its scale and level are linear
                c = Curve(kind, (float(theta[0]), float(theta[1])))
                basis = np.stack((np.ones(len(x)), c.value(x)))
                w = basis * mass
                coef = np.linalg.lstsq(w @ basis.T + 1e-12 * np.eye(2), w @ y, rcond=None)[0]
                rest = y - coef @ basis
                now = float((mass * rest * rest).sum())
                if not math.isfinite(now):
                    break
                if now >= loss - 1e-10 * abs(loss):
                    if damp > 1e4:
                        break
                    damp, theta = damp * 10, kept + move / 10
                    move = move / 10
                    continue
                loss, kept = now, theta
                if best is None or loss < best[0]:
                    best = (loss, c.canonical(), float(coef[1]))
                jac = coef[1] * c.gradient(x)
                a = (jac * mass) @ jac.T
                move = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-300), (jac * mass) @ rest, rcond=None)[0]
                theta = theta + move
        return (best[1], best[2]) if best else (Curve(kind, (float(x[len(x) // 2]), sigma)), 0.0)

    def candidates(self, model: Model, fields: Sequence[str]) -> list[Candidate]:
        """A curve of every type on every regressor for every status, from bucket statistics."""
        rng = np.random.default_rng(self.settings.seed + len(model.entries))
        out = []
        for (k, regressor), stats in self.ratio_stats(model, fields).items():
            for kind in self.settings.curve_types:
                if not TYPES[kind].fitted or self.forbidden and self.forbidden(model.reachable[k], regressor, kind):
                    continue
                for curve, beta in self.starts(kind, regressor, stats, rng):
                    entry = Entry(((regressor, curve),), k)
                    if not model.frozen(k, 0) and model.index(entry.depth, k) < 0:
                        out.append(Candidate(regressor, k, model.add_entry(entry, beta, -beta / 2)))
        return out

    def best_addition(self, model: Model, fields: Sequence[str]) -> Point | None:
        """Screen all candidates in one pass, refit the best of each regressor, status and type together, return the best."""
        return self._asked(f"addition {','.join(fields)}", model, kernel.SECOND, lambda: self._best_addition(model, fields))

    def _best_addition(self, model: Model, fields: Sequence[str]) -> Point | None:
        found = self.candidates(model, fields)
        if not found:
            return None
        points = evaluate_many(self.grid, [c.model for c in found])
        order = sorted(range(len(found)), key=lambda i: (points[i].entropy, i))
        last = len(model.entries)
        chosen = [found[i].model for i in self._varied(order, found)]
        refit = [o.point for o in minimise_many(self.blocks or self.grid, chosen, self.settings, [lambda p: p[1] in (0, last)] * len(chosen))]
        refit = [p for p in refit if math.isfinite(p.entropy)]
        return min(refit, key=lambda p: p.aic) if refit else None

    def _varied(self, order: Sequence[int], found: Sequence[Candidate]) -> list[int]:
        """The best starts of each regressor, status and type, as many as the settings refit: most further ones lead to the same curve."""
        seen: dict[tuple, int] = {}
        chosen = []
        for i in order:
            key = (found[i].regressor, found[i].status, found[i].model.entries[-1].depth[0][1].type)
            seen[key] = seen.get(key, 0) + 1
            if not self.settings.refit_starts or seen[key] <= self.settings.refit_starts:
                chosen.append(i)
        return chosen

    def expand(self, fields: Sequence[str], params: int) -> int:
        """Add the best curve while the budget lasts and AIC accepts it; returns how many."""
        start, added = self.chain.model.parameter_count, 0
        while self.chain.model.parameter_count < start + params:
            point = self.best_addition(self.chain.model, fields)
            if point is None or point.model.parameter_count > start + params or not self.chain.push("curve", point):
                break
            added += 1
        return added

    def recalibrate(self, i: int) -> bool:
        """Drop a curve entry, find the best curve of its regressor anew, keep it if it is better."""
        model = self.chain.model
        smaller = self._fit(model.drop(i), lambda p: p[2] < 0).model
        point = self.best_addition(smaller, [model.entries[i].depth[0][0]])
        return point is not None and self._push("recalibrated", point.model)

    def calibrate(self, anew: bool = False) -> int:
        """Refit each curve entry in seeded random order, or find it anew; stop when that gains too little."""
        keys = [(tuple(r for r, _ in e.depth), e.restrict) for e in self.chain.model.entries if e.curves]
        kept, gains = 0, []
        for n, at in enumerate(np.random.default_rng(self.settings.seed).permutation(len(keys)).tolist()):
            before = self.chain.last.aic
            found = [i for i, e in enumerate(self.chain.model.entries) if e.curves and (tuple(r for r, _ in e.depth), e.restrict) == keys[at]]
            if found:
                kept += self.recalibrate(found[0]) if anew else self.fit_entries([0, found[0]])
            gains.append(before - self.chain.last.aic)
            if n + 1 >= self.settings.min_calibration_count and gains[0] > 0 and gains[-1] < self.settings.improvement_ratio * gains[0]:
                break
        return kept

    def interactions(self, fields: Sequence[str] = ()) -> int:
        """Products: of every two regressors that stand by themselves, and of curves with a regressor."""
        model, added = self.chain.model, 0
        flags = model.flag_set()
        trials = [Entry(((a, None), (b, None))) for i, a in enumerate(flags) for b in flags[i + 1 :]]
        if self.settings.allow_interaction_curves:
            trials += [Entry((*e.depth, (r, None)), e.restrict) for e in model.entries if e.curves for r in fields or flags if r not in [x for x, _ in e.depth]]
        for entry in trials:
            if self.chain.model.index(entry.depth, entry.restrict) < 0:
                last = len(self.chain.model.entries)
                added += self._push("interaction", self.chain.model.add_entry(entry), lambda p, last=last: p[2] < 0 or p[1] == last)
        return added

    def candidate_frame(self, spark: SparkSession, fields: Sequence[str]) -> DataFrame:
        """Every candidate curve with the AIC it would bring before a refit, the best first."""
        found = self.candidates(self.chain.model, fields)
        points = evaluate_many(self.grid, [c.model for c in found]) if found else []
        rows = [(c.regressor, c.model.reachable[c.status], c.model.entries[-1].depth[0][1].type, *map(float, c.model.entries[-1].depth[0][1].params), p.aic - self.chain.last.aic) for c, p in zip(found, points, strict=True)]
        return spark.createDataFrame(rows, "regressor string, to_status string, curve string, centre double, width double, aic_diff double").orderBy("aic_diff")

    def trim(self) -> int:
        """Drop entries, last first, while the refitted rest costs little AIC."""
        dropped = 0
        for i in range(len(self.chain.model.entries) - 1, 0, -1):
            model = self.chain.model
            smaller = model.drop(i)
            restrict = model.entries[i].restrict
            if restrict >= 0 and abs(model.betas[restrict][i]) > LARGE_BETA:  # a large beta acted as part of the intercept
                betas = [list(b) for b in smaller.betas]
                betas[restrict][0] += model.betas[restrict][i] / 2
                smaller = smaller.with_betas(betas)
            point = self._fit(smaller)
            if point.aic - self.chain.last.aic < TRIM_GAIN:
                self.chain.force("trim", point)
                dropped += 1
        return dropped

    def anneal(self, fields: Sequence[str], by_entry: bool = False) -> int:
        """Drop each regressor (or entry), rebuild with what it cost, keep what is better."""
        better = 0
        model = self.chain.model
        things = list(range(len(model.entries) - 1, 0, -1)) if by_entry else list(model.regressors)
        for thing in things:
            model = self.chain.model
            if by_entry and thing >= len(model.entries):
                continue
            smaller = model.drop(thing) if by_entry else model.drop_regressor(thing)
            budget = model.parameter_count - smaller.parameter_count
            if not budget:
                continue
            trial = Chain(Result("anneal", self._fit(smaller), self.chain.last), self.settings, self.chain.judge)
            main, self.chain = self.chain, trial
            try:
                flags = [r for r in model.flag_set() if r not in smaller.flag_set()]
                if flags:
                    self.add_coefficients(flags)
                self.expand(fields, budget)
                self.fit_all()
            finally:
                self.chain = main
            if self.chain.push("anneal", trial.last.point):
                better += 1
        return better

    def fit(self, flags: Sequence[str] = (), fields: Sequence[str] = (), params: int = 6, anneal: bool = False) -> Result:
        """Coefficients, curves, a refit of all, annealing if wanted, trimming."""
        if flags:
            self.add_coefficients(flags)
        self.expand(fields, params)
        self.fit_all()
        if anneal:
            self.anneal(fields)
        self.trim()
        return self.chain.last

    def detail(self) -> Point:
        """The last result with all derivatives: TIC, deviations, conditions."""
        return evaluate_many(self.grid, [self.chain.model], kernel.SECOND)[0]

    def close(self) -> None:
        self.grid.__dict__["_tables"].unpersist()
        self.grid.unpersist()
