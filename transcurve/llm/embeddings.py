"""Embedding near-duplicates by collision-counting projections.

Every distinct vector is projected on many random lines. The values on a line are sorted,
and around each vector's own value a window is laid that two vectors at the threshold
nearly always share; the vectors inside collide with it. Pairs that collide on so many
lines as a recall-calibrated count asks for are verified by their cosine in double
precision. A pair that reaches the count misses few lines, so it collides on one of the
first few; the others are only looked at for such pairs.

One line's window holds a constant share of all vectors, so the sorted lists are cut into
blocks first: by bands of signs of further projections, with as many signs as keep blocks
small while the table grows, and as many bands as let a pair at the threshold share a block
in one of them. Rows of a block carry an id and the projections in a byte each, no vectors.
Blocks of very many vectors are cut into chunks that meet two at a time. Nothing is capped.

Equal vectors are one class. Null, empty and zero vectors and vectors with null or
non-finite components link with nothing; vectors of different lengths never link. A null
vec_id links with nothing and has no component. Repeated ids with different vectors are
both compared, and each reports its own links; extra columns are ignored; an empty table
gives an empty result. There are no ties: every pair is judged alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.llm import common

#: Least cosine of a link; recall, at that cosine, of the blocks and of the count.
THRESHOLD, BLOCK_RECALL, COUNT_RECALL = 0.95, 0.985, 0.99
#: Lines whose collisions are counted, and half a window in deviations of the difference of a pair at the threshold.
LINES, WINDOW = 32, 2.0
#: Steps of a stored projection for each deviation of the projections over unit vectors.
STEPS = 14
#: Vectors of a block by which the number of signs is set.
CHANCE = 16
#: Vectors of a block from which on it is cut, and of a chunk.
HOT, CHUNK = 4096, 2048
#: Rows that the scan of a sorted partition holds together, and pairs that it looks at together.
HELD, AT_ONCE = 20_000, 200_000
SEED = 11


def _at_least(n: int, p: float, k: int) -> float:
    return 1 - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))


def calibrate(vectors: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Signs of a band and bands for a table of so many vectors: a pair at the threshold shares a block with BLOCK_RECALL."""
    signs = max(1, math.ceil(math.log2(max(vectors, 2) / CHANCE)))
    same = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(1 - BLOCK_RECALL) / math.log1p(-same)))


def window(threshold: float = THRESHOLD) -> tuple[int, int]:
    """Half a window in steps, and the collisions to ask for: a pair at the threshold has them with COUNT_RECALL.

    Rounding moves each of two values by half a step at most, so the window is a step wider.
    """
    share = math.erf(WINDOW / math.sqrt(2))
    count = max(k for k in range(1, LINES + 1) if _at_least(LINES, share, k) >= COUNT_RECALL)
    return math.floor(WINDOW * math.sqrt(2 - 2 * threshold) * STEPS) + 1, count


class Lines:
    """Block of each band, and stored projections, of unit vectors."""

    def __init__(self, signs: int, bands: int, seed: int = SEED):
        self.signs, self.bands, self.seed, self.made = signs, bands, seed, {}

    def _of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        if dim not in self.made:
            rng = np.random.default_rng([self.seed, dim])
            self.made[dim] = rng.standard_normal((dim, LINES)), rng.standard_normal((dim, self.signs * self.bands))
        return self.made[dim]

    def blocks(self, unit: np.ndarray) -> np.ndarray:
        sign = (unit @ self._of(unit.shape[1])[1] >= 0).reshape(len(unit), self.bands, self.signs)
        block = np.full((len(unit), self.bands), unit.shape[1], np.uint64) + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
        for i in range(0, self.signs, 32):
            part = sign[:, :, i : i + 32]
            block = (block ^ (part @ (np.uint64(1) << np.arange(part.shape[2], dtype=np.uint64)))) * np.uint64(0x9E3779B97F4A7C15)
            block ^= block >> np.uint64(31)
        return block.view(np.int64)

    def stored(self, unit: np.ndarray) -> np.ndarray:
        # values beyond a byte stay where bytes end: that can only bring two of them together
        return np.clip(np.rint(unit @ self._of(unit.shape[1])[0] * STEPS), -127, 127).astype(np.int8)


def _unit(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _by_length(raw: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    for n in np.unique(sizes):
        yield np.flatnonzero(sizes == n)


def _placed(classes: DataFrame, lines: Lines, with_values: bool) -> DataFrame:
    """A row for each vector and band: block and, if wanted, cid and the stored projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                raw = part.column("vector").to_pylist()
                for rows in _by_length(raw):
                    unit = _unit([raw[i] for i in rows])
                    out = {"block": pa.array(lines.blocks(unit).ravel())}
                    if with_values:
                        own = pa.array([x.tobytes() for x in lines.stored(unit)], pa.binary())
                        again = np.repeat(np.arange(len(rows)), lines.bands)
                        out |= {"cid": part.column("cid").take(pa.array(rows[again])), "lines": own.take(pa.array(again))}
                    yield pa.RecordBatch.from_pydict(out)

    return classes.mapInArrow(common.tidy(run), "block long, cid long, lines binary" if with_values else "block long")


def collide(group: np.ndarray, lines: np.ndarray, half: int, count: int, meet: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one group that collide on ``count`` lines or more, each once, a slice of pairs at a time.

    ``group`` numbers the groups from 0; rows need no order. On each of the first lines the
    rows are sorted by group and value, and every row's window is cut out of that order;
    a pair is judged on the first line on which it collides.
    """
    for line in range(lines.shape[1] - count + 1):
        value = group * np.int64(1024) + lines[:, line]
        order = np.argsort(value, kind="stable")
        value = value[order]
        n = np.searchsorted(value, value + half, "right") - np.arange(1, len(value) + 1)  # the window's upper half: each pair once
        ends = np.cumsum(n)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
            own = np.repeat(np.arange(lo, hi), n[lo:hi])
            step = np.arange(len(own)) - np.repeat(ends[lo:hi] - n[lo:hi] - (ends[lo - 1] if lo else 0), n[lo:hi]) + 1
            i, j = order[own], order[own + step]
            lo = hi
            if meet is not None:
                keep = meet(i, j)
                i, j = i[keep], j[keep]
            for before in range(line):
                new = np.abs(lines[i, before].astype(np.int16) - lines[j, before]) > half
                i, j = i[new], j[new]
            seen = np.ones(len(i), np.int16)
            for after in range(line + 1, lines.shape[1]):
                seen += np.abs(lines[i, after].astype(np.int16) - lines[j, after]) <= half
                if after % 8 == 7:  # those that can't reach the count any more
                    open_ = seen + (lines.shape[1] - 1 - after) >= count
                    i, j, seen = i[open_], j[open_], seen[open_]
            enough = seen >= count
            if enough.any():
                yield i[enough], j[enough]


def candidates(classes: DataFrame, lines: Lines, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of the classes (cid, vector) that reach the count in a block they share."""
    spread = _placed(classes, lines, True)
    crowd = common.cut(_placed(classes, lines, False).groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(F.col("block").alias("hot"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    spread = spread.join(crowd, F.col("block") == F.col("hot"), "left").drop("hot")
    chunk = F.coalesce(F.pmod(F.xxhash64("cid", F.lit(SEED)), F.col("chunks").cast("long")).cast("int"), F.lit(0))
    spread = spread.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)))
    spread = spread.withColumn("x", F.least("chunk", "other")).withColumn("y", F.greatest("chunk", "other")).withColumn("key", F.xxhash64("block", "x", "y")).withColumn("cut", F.col("x") < F.col("y"))
    half, count = window(threshold)

    def judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, cut, chunk, cid = (table.column(c).to_numpy() for c in ("key", "cut", "chunk", "cid"))
        own = np.frombuffer(b"".join(table.column("lines").to_pylist()), np.int8).reshape(len(key), LINES)
        group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        # chunks that meet only across judge no pair of their own
        for i, j in collide(group, own, half, count, lambda i, j: ~cut[i] | (chunk[i] != chunk[j])):
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(cid[i], cid[j])), "b": pa.array(np.maximum(cid[i], cid[j]))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= HELD:
                key = held.column("key").to_numpy()
                whole = int(np.searchsorted(key, key[-1]))  # the last block may go on in the next batch
                if whole:
                    yield from judge(held.slice(0, whole).combine_chunks())
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from judge(held.combine_chunks())

    rows = spread.select("key", "cut", "chunk", "cid", "lines").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(common.tidy(run), "a long, b long").distinct()


def verify(pairs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs whose cosine reaches the threshold in double precision: a, b and their classes' sizes n, m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = np.zeros(len(x), bool)
            for rows in _by_length(x):
                rows = np.array([i for i in rows if len(x[i]) == len(y[i])], np.int64)
                if len(rows):
                    keep[rows] = np.einsum("ij,ij->i", _unit([x[i] for i in rows]), _unit([y[i] for i in rows])) >= threshold
            yield batch.select(["a", "b", "n", "m"]).filter(pa.array(keep))

    left = classes.select(F.col("cid").alias("a"), F.col("vector").alias("x"), F.col("size").alias("n"))
    right = classes.select(F.col("cid").alias("b"), F.col("vector").alias("y"), F.col("size").alias("m"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(common.tidy(run), "a long, b long, n long, m long")


def _packed(values: DataFrame) -> DataFrame:
    """vec_id and the vector as the bytes of its doubles, null if it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                a = np.asarray(v if v and None not in v else [np.nan], np.float64)
                # extreme lengths are brought to where squares neither overflow nor vanish
                top = np.abs(a).max()
                out.append((a / top if top < 1e-100 or top > 1e100 else a).tobytes() if np.isfinite(a).all() and top > 0 else None)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "vector": pa.array(out, pa.binary())})

    return values.mapInArrow(common.tidy(run), "vec_id long, vector binary")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    packed = _packed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    packed = packed.withColumn("hash", F.when(F.col("vector").isNotNull() & F.col("vec_id").isNotNull(), F.sha2("vector", 256)))
    classes = packed.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("vector").alias("vector"))
    classes = common.cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    found = common.cut(verify(candidates(classes.select("cid", "vector"), Lines(*calibrate(classes.count(), threshold)), threshold), classes, threshold))
    ends = found.select(F.col("a").alias("lc"), F.col("m").alias("k")).unionByName(found.select(F.col("b").alias("lc"), F.col("n").alias("k")))
    totals = ends.groupBy("lc").agg(F.sum("k").alias("links"))
    parts = common.components(found.select("a", "b"))
    owned = common.cut(classes.select("hash", "rep", "size", "cid").join(totals, F.col("cid") == F.col("lc"), "left").join(parts, F.col("cid") == F.col("node"), "left").select("hash", "rep", "size", "links", F.coalesce("component", "cid").alias("part")))
    least = common.cut(owned.groupBy("part").agg(F.min("rep").alias("component_id")).select(F.col("part").alias("p"), "component_id"))
    known = owned.join(least, F.col("part") == F.col("p")).select(F.col("hash").alias("h"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = packed.select("vec_id", "hash").join(known, F.col("hash") == F.col("h"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_embedding_dedup": query}
ORACLES: dict[str, str] = {}
