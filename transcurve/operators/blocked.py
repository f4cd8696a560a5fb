"""Grids laid out in groups of rows that are random samples, and questions that read only as many groups as they need.

``lay_out`` writes a grid to Parquet, dealt by a hash of its rows to directories, one a group. A
pass over some groups prunes the others by their directory, so a trial step costs what it
reads. Sums of several passes add up: a point goes on where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.operators import evaluate, kernel
from transcurve.operators.evaluate import Point
from transcurve.operators.grid import row_hash, shared_folder
from transcurve.spec import Model

#: Groups of a grid; a scan starts with so many and doubles them.
GROUPS, FIRST = 64, 2
#: A candidate is out when it is worse than the best by so many deviations of their difference: far beyond chance, however often it is looked at.
DECIDED = 5.0
#: Share of the best's gain that another candidate may still have over it when a race ends.
LITTLE = 0.05
#: Rows from which on a difference is judged at all.
LEAST = 200
GROUP = "block_group"


class BlockedGrid:
    """A grid in Parquet by group. ``rows`` has all of it; ``rows_read`` counts what partial passes have read."""

    def __init__(self, spark: SparkSession, path: str, groups: int):
        self.path, self.groups, self.rows_read = path, groups, 0
        self.rows = spark.read.parquet(path)

    @classmethod
    def lay_out(cls, rows: DataFrame, path: str | None = None, groups: int = GROUPS, by: Column | None = None, keep: Sequence[str] | None = None, seed: int = 0) -> BlockedGrid:
        """``rows`` written by group: ``by`` numbers groups from 0, by default a hash of all columns, of which ``keep`` are written.

        The columns should tell rows apart: equal rows fall into one group.
        """
        spark = rows.sparkSession
        path = path or f"{shared_folder(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
        dealt = rows.withColumn("__h", row_hash(rows, F.lit(seed))).withColumn(GROUP, (F.pmod("__h", F.lit(groups)) if by is None else by).cast("int"))
        names = [F.col(f"`{c}`") for c in keep or rows.columns]
        dealt = dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), GROUP, "__h").select(*names, GROUP)
        dealt.write.mode("overwrite").partitionBy(GROUP).parquet(path)
        return cls(spark, path, groups)

    def slice(self, first: int, end: int) -> DataFrame:
        """Groups from ``first`` up to ``end``, read from their directories alone."""
        return self.rows.where((F.col(GROUP) >= first) & (F.col(GROUP) < end))

    def ends(self, first: int = FIRST) -> list[int]:
        """Where a scan stops to look: after ``first`` groups, then twice as many each time."""
        out = []
        while first < self.groups:
            out.append(first)
            first *= 2
        return [*out, self.groups]


@dataclass
class BlockPoint:
    """A model's sums up to a group, taken further on demand; what has been read isn't read again."""

    grid: BlockedGrid
    model: Model
    level: int = kernel.VALUE
    end: int = 0
    packed: np.ndarray | None = None

    def until(self, end: int) -> Point:
        """The point over the first ``end`` groups; to go back would need a point of its own."""
        if end < self.end:
            raise ValueError("a point doesn't go back")
        if end > self.end:
            new = evaluate.sums(self.grid.slice(self.end, end), [self.model], self.level)[0]
            self.grid.rows_read += int(new[0])
            self.packed, self.end = new if self.packed is None else self.packed + new, end
        if self.packed is None:
            raise ValueError("no groups")
        return Point(self.model, self.level, evaluate.unpack(self.packed, self.model, self.level))

    def upgraded(self, level: int) -> BlockPoint:
        """A point of a higher level over the same groups: its sums are taken anew."""
        out = BlockPoint(self.grid, self.model, max(level, self.level))
        if self.end:
            out.until(self.end)
        return out


@dataclass
class Outcome:
    """The winner of a contest (0: the base), its mean difference to the base, and what was read."""

    winner: int
    difference: float
    dev: float
    z: float
    groups: int
    n: float


@dataclass
class _Contest:
    """Sums of the models' differences to the base over the groups read: n, d, and d d'."""

    models: list[Model]
    offsets: np.ndarray
    alive: list[int] = field(default_factory=list)
    n: float = 0.0
    d: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dd: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def __post_init__(self) -> None:
        k = len(self.models)
        self.alive, self.d, self.dd = list(range(k)), np.zeros(k), np.zeros((k, k))

    def add(self, packed: np.ndarray) -> None:
        a, k = self.alive, len(self.alive)
        self.n += packed[0]
        self.d[a] += packed[1 : 1 + k]
        self.dd[np.ix_(a, a)] += packed[1 + k :].reshape(k, k)

    def mean(self, i: int) -> float:
        return self.d[i] / max(self.n, 1.0) + self.offsets[i]

    def against(self, i: int, j: int) -> tuple[float, float]:
        """Mean of i less j, and its deviation."""
        gap = (self.d[i] - self.d[j]) / max(self.n, 1.0)
        square = (self.dd[i, i] - 2 * self.dd[i, j] + self.dd[j, j]) / max(self.n, 1.0)
        return self.mean(i) - self.mean(j), (max(0.0, square - gap * gap) / max(self.n, 1.0)) ** 0.5

    def best(self) -> int:
        value = lambda i: self.mean(i) if np.isfinite(self.mean(i)) else np.inf
        return min(self.alive, key=lambda i: (value(i), i))

    def cut(self, z: float) -> None:
        """Drop what is clearly worse than the best, or can be better only by little of what the best gains over the base."""
        if self.n < LEAST:
            return
        best = self.best()
        little = LITTLE * max(0.0, -self.mean(best))

        def stays(i: int) -> bool:
            if i == best or not np.isfinite(self.mean(i)):
                return i == best
            gap, dev = self.against(i, best)
            return z * dev - gap > (little if i else 0.0) or (gap == dev == 0.0 and i == 0)

        self.alive = [i for i in self.alive if stays(i)]


def race(grid: BlockedGrid, contests: Sequence[Sequence[Model]], z: float = DECIDED, offsets: Sequence[Sequence[float]] | None = None) -> list[Outcome]:
    """The best of each contest's models by mean entropy (plus ``offsets``), the first of which is its base.

    Contests share passes. A pass reads the next groups for those that aren't decided, and drops
    models that are worse than the best by ``z`` deviations of the paired difference, or that
    can be better, by so many deviations, only by ``LITTLE`` of what the best gains over the base. Where
    nothing sets models apart from the base, all groups are read and the means decide.
    """
    runs = [_Contest(list(ms), np.asarray(offsets[i] if offsets else np.zeros(len(ms)), float)) for i, ms in enumerate(contests)]
    outcomes: list[Outcome | None] = [None] * len(runs)
    done = 0
    for end in grid.ends():
        live = [i for i, o in enumerate(outcomes) if o is None]
        if not live:
            break
        found = evaluate.differences(grid.slice(done, end), [[runs[i].models[j] for j in runs[i].alive] for i in live], [runs[i].models[0] for i in live])
        grid.rows_read += int(found[0][0])
        done = end
        for i, packed in zip(live, found, strict=True):
            run = runs[i]
            run.add(packed)
            run.cut(z)
            if run.alive == [run.best()] or end == grid.groups:
                best = run.best()
                gap, dev = run.against(best, 0)
                outcomes[i] = Outcome(best, gap, dev, gap / dev if dev else 0.0, end, run.n)
    return outcomes


def compare(grid: BlockedGrid, a: Model, b: Model, z: float = DECIDED) -> Outcome:
    """Mean entropy of b less a, read until it stands ``z`` deviations from 0 or all is read. The winner is 1 if b's is less."""
    run, done = _Contest([a, b], np.zeros(2)), 0
    for end in grid.ends():
        packed = evaluate.differences(grid.slice(done, end), [[a, b]], [a])[0]
        grid.rows_read += int(packed[0])
        run.add(packed)
        done = end
        gap, dev = run.against(1, 0)
        if run.n >= LEAST and dev > 0 and abs(gap) >= z * dev:
            break
    return Outcome(int(gap < 0), gap, dev, gap / dev if dev else 0.0, done, run.n)
