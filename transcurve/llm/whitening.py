"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Each partition decomposes its centred vectors, a block at a time, and keeps count, mean, all
singular values and all right vectors. Two such states merge by stacking their scaled
vectors and one more row, the difference of the means times sqrt(n1 n2 / (n1 + n2)), and
decomposing again: nothing of the whole table's covariance is lost, whatever the tree. A state
has d x d numbers; a merge holds ``FAN`` of them, so no task and no driver sees more.

Vectors are taken in steps of 1/256, as whole numbers x. The fit list is each distinct x
once, so copies, however many, weigh as one vector; every row is whitened. Null vectors and
those with null or non-finite entries, or entries beyond a 64-bit x, are left out. The
dimension is the commonest length (of equals the longest); vectors of other lengths aren't
fitted and come back with null deviation and whitened, as do components without variance.
Deviations are exact; one beyond 64 bits is null. Null and repeated ids stay as they are;
extra columns are ignored; an empty table gives no rows. Equal eigenvalues (ties) give any basis of
their space; each component's largest entry is made positive, the first of equals.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.llm import common

#: Steps of a unit; components returned; states that one merge takes.
STEPS, COMPONENTS, FAN = 256, 4, 8
#: Rows of a block that is decomposed at once: so many, or four times the dimension.
BLOCK = 1024

_STATE = "node int, n long, sums string, mean binary, s binary, vt binary"
_STATE_ARROW = pa.schema([("node", pa.int32()), ("n", pa.int64()), ("sums", pa.string()), ("mean", pa.binary()), ("s", pa.binary()), ("vt", pa.binary())])


@dataclass
class State:
    """Count, exact sums (of whole numbers, else None), mean, singular values and right vectors of centred rows."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    s: np.ndarray
    vt: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, exact: bool) -> State:
        sums = None
        if exact:
            small = not len(x) or int(np.abs(x).max()) < (1 << 62) // max(1, len(x))
            sums = [int(v) for v in (x if small else x.astype(object)).sum(axis=0)]
            mean = np.array([v / len(x) for v in sums])
        else:
            mean = x.mean(axis=0)
        _, s, vt = np.linalg.svd(x - mean, full_matrices=False)
        return cls(len(x), sums, mean, s, vt)

    def merged(self, other: State) -> State:
        n = self.n + other.n
        step = math.sqrt(self.n / n * other.n) * (other.mean - self.mean)
        _, s, vt = np.linalg.svd(np.vstack((self.s[:, None] * self.vt, other.s[:, None] * other.vt, step)), full_matrices=False)
        sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)] if self.sums is not None else None
        mean = np.array([v / n for v in sums]) if sums is not None else (self.n * self.mean + other.n * other.mean) / n
        return State(n, sums, mean, s, vt)

    def row(self, node: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"node": node, "n": self.n, "sums": json.dumps(self.sums), "mean": self.mean.tobytes(), "s": self.s.tobytes(), "vt": self.vt.tobytes()}], _STATE_ARROW)

    @classmethod
    def read(cls, r: dict) -> State:
        mean = np.frombuffer(r["mean"])
        return cls(r["n"], json.loads(r["sums"]), mean, np.frombuffer(r["s"]), np.frombuffer(r["vt"]).reshape(-1, len(mean)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def decompose(rows: DataFrame, size: int, parts: int, prepare: Callable[[np.ndarray], np.ndarray] | None = None) -> State | None:
    """The state of all rows (one array column of ``size`` whole numbers), merged by a tree; None of no rows.

    ``parts`` bounds the partitions of ``rows``; ``prepare`` maps a matrix to the one that is decomposed.
    """

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, step = None, max(BLOCK, 4 * size)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                x = _matrix(batch.column(0).slice(at, step), size)
                new = State.of(prepare(x), False) if prepare else State.of(x, True)
                state = state.merged(new) if state else new
        if state:
            yield state.row(TaskContext.get().partitionId() // FAN)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, node = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                state, node = (state.merged(State.read(r)) if state else State.read(r)), r["node"]
        yield state.row(node // FAN)

    states, width = rows.mapInArrow(leaves, _STATE), -(-parts // FAN)
    while True:
        states = states.groupBy("node").applyInArrow(merge, _STATE)
        if width <= 1:
            break
        width = -(-width // FAN)
    found = states.first()  # one row, d x d numbers
    return State.read(found.asDict()) if found else None


@dataclass(frozen=True)
class Fit:
    """What whitens a row: count and exact sums of the fit list, components [k, d], their eigenvalues (0: no variance)
    and shares of the trace, and the measured error of the whitened covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    error: float = math.nan

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """[rows, k], not a number where a component has no variance."""
        mean = np.array([s / self.n for s in self.sums])
        scale = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return (x - mean) @ self.components.T / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        top = max(int(np.abs(x).max(initial=0)), 0) * self.n + max(map(abs, self.sums), default=0)
        if len(self.sums) * top * top < 1 << 63:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in map(int, (d * d).sum(axis=1))]


def whole(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``df`` with x, the vector in steps; rows without one are left out."""
    entry = F.transform(F.col(vector), lambda c: c.cast("double") * STEPS)
    # null entries make the test null, not-a-numbers are larger than any number
    fine = F.forall("__e", lambda c: F.coalesce(F.abs(c) < float(1 << 63), F.lit(False)))
    return df.withColumn("__e", entry).where(F.col("__e").isNotNull() & fine).withColumn("x", F.transform("__e", lambda c: F.floor(c).cast("long"))).drop("__e")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """A fit of the distinct x of ``rows``; None if there is nothing to fit."""
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if not sizes or not sizes["size"]:
        return None
    size, parts = sizes["size"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = common.cut(rows.where(F.size("x") == size).select("x").distinct())
    parts = max(parts, distinct.rdd.getNumPartitions())
    state = decompose(distinct, size, parts)
    e = state.s**2 / state.n
    e[state.s <= state.s.max(initial=0) * max(state.n, size) * np.finfo(float).eps] = 0.0
    trace, k = float((state.s**2).sum() / state.n), min(components, size)
    vt = np.zeros((k, size))  # fewer vectors than components leave the rest without variance
    vt[: min(k, len(e))] = state.vt[:k]
    largest = np.take_along_axis(vt, np.abs(vt).argmax(axis=1)[:, None], axis=1)
    vt *= np.where(largest < 0, -1.0, 1.0)
    values = np.zeros(k)
    values[: min(k, len(e))] = e[:k]
    plain = Fit(state.n, tuple(state.sums), vt, values, values / trace if trace else np.zeros(k))
    live = int((values > 0).sum())
    if not live:
        return plain
    measured = decompose(distinct, size, parts, lambda x: plain.whiten(x)[:, :live])
    covariance = (measured.vt.T * measured.s**2) @ measured.vt / measured.n
    return Fit(plain.n, plain.sums, vt, values, plain.explained, float(np.abs(covariance - np.eye(live)).max()))


def whiten(rows: DataFrame, fitted: Fit, ident: str = "vec_id") -> DataFrame:
    """The id of each of ``rows`` (with x), component, n, deviation, whitened, explained and identity_error, a row for each component."""
    k, size = fitted.components.shape
    schema = pa.schema([("id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                m, same = part.num_rows, np.array(part.column(1).value_lengths()) == size
                white, deviation = np.full((m, k), np.nan), np.full(m, None)
                if same.any():
                    x = _matrix(part.column(1).filter(pa.array(same)), size)
                    white[same] = fitted.whiten(x)
                    deviation[same] = fitted.deviation(x)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fitted.n)), pa.array(np.repeat(deviation, k).tolist(), pa.int64()),
                        pa.array(white.ravel(), mask=np.isnan(white.ravel())), pa.array(np.tile(fitted.explained, m)), pa.array(np.full(m * k, fitted.error), mask=np.full(m * k, math.isnan(fitted.error))),
                    ],
                    schema=schema,
                )

    out = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.select(F.col(ident).cast("long").alias("id"), "x").mapInArrow(run, out).withColumnRenamed("id", ident)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "x")
    fitted = fit(rows)
    none = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return whiten(rows, fitted) if fitted else spark.createDataFrame([], none)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_whitening": query}
ORACLES: dict[str, str] = {}
