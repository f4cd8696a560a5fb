"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every document is hashed into one of its source's blocks, whose order is permuted. A
source's quota is a number of blocks: as many whole passes over it as its target asks
for, then the first of its permuted blocks, the last of which is taken in part. A binary
tree whose nodes draw from the multivariate hypergeometric distribution splits the quotas
of all sources exactly among the output shards; a shard's leaf names the run of each
source's permuted blocks that it draws, and a row is taken as often as its block is
drawn. Rows are shuffled inside the shard by a seeded hash.

A node's generator is seeded by its place in the tree, so tasks grow the part of the tree
above their own shards. The block on a source's boundary is found digit by digit from
sums over block numbers, and only its rows, about ``BLOCK_DOCS``, meet in one task, which
picks those that fill what is left. The driver holds a row for each source.

Null text has size 0; a null source is a source of its own, last in order. Documents
of size 0 are never taken. Rows that repeat a doc_id and a size have equal decisions. An
empty table gives an empty mix. Extra columns are ignored (``rows`` passes them on).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcurve.llm import common

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source gives more than so many times its own size.
MAX_REPEATS = 3
#: Least mean of documents in a block. Blocks hold more where their number would reach what a draw can count.
BLOCK_DOCS, MOST_UNITS = 64, 900_000_000
#: Bits of a block's number that are looked at in one step on the way to the boundary.
DIGIT = 12
#: Words of an output shard and the least number of shards, unless a count of shards is given.
SHARD_WORDS, LEAST_SHARDS = 50_000_000, 16
#: Rows of the boundary block that the closing subset-sum may choose among.
CLOSING = 48


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, cap: float = MAX_REPEATS) -> list[float]:
    """Shares of the total by repeating weights; what a capped source can't give is reshared."""
    total, n = float(sum(sizes)), len(sizes)
    w = [weights[i % len(weights)] for i in range(n)]
    out, open_, rest = [0.0] * n, set(range(n)), total
    while open_:
        unit = rest / sum(w[i] for i in open_)
        over = {i for i in open_ if unit * w[i] > cap * sizes[i]}
        for i in over or open_:
            out[i] = float(cap * sizes[i]) if over else unit * w[i]
        if not over:
            break
        rest -= sum(out[i] for i in over)
        open_ -= over
    return out


def split_tree(quotas: Sequence[int], shards: int, seed: int, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard, first block and number of blocks of each source, for shards ``lo`` up to ``hi``.

    A node with k shards passes each child a draw without replacement whose total is the
    child's share of the node's blocks, so the shards' runs of a source follow each other,
    sum to its quota, and shard totals differ by one block at most. Each node's generator is
    seeded by its place in the tree: parts of it can grow apart from each other.
    """
    hi = shards if hi is None else hi

    def go(a: int, b: int, first: np.ndarray, have: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if b <= lo or a >= hi:
            return
        if b - a == 1:
            yield a, first, have
            return
        mid, total = (a + b) // 2, int(have.sum())
        take = total * (mid - a) // (b - a)
        left, rest, need = np.zeros_like(have), total, take
        rng = np.random.default_rng([seed, a, b])
        for i, h in enumerate(have.tolist()):  # one hypergeometric draw a source, conditioned on those before
            rest -= h
            if need:
                left[i] = need if not rest else rng.hypergeometric(h, rest, need)
                need -= int(left[i])
        yield from go(a, mid, first, left)
        yield from go(mid, b, first + left, have - left)

    have = np.asarray(quotas, np.int64)
    yield from go(0, shards, np.zeros_like(have), have)


def fill(rows: list[tuple[int, int]], want: int, times: int = 1) -> Counter[int]:
    """How often to take each key of (key, size) rows so that the sizes come nearest to ``want``.

    Rows are taken largest first while they fit, once each; the last places are refined by
    an exact subset-sum over the ``CLOSING`` smallest rows, each up to ``times`` times.
    """
    rows = sorted(rows, key=lambda r: -r[1])
    head, tail = rows[: max(0, len(rows) - CLOSING)], rows[max(0, len(rows) - CLOSING) :] * times
    chosen, left = Counter(), want
    for k, n in head:
        if n <= left:
            chosen[k] += 1
            left -= n
    most = 2 * left + 1  # sums further above than 0 is below can't be nearest
    mask, steps = (1 << most) - 1, [1]
    for _, n in tail:
        steps.append((steps[-1] | steps[-1] << n) & mask)
    below = (steps[-1] & ((1 << (left + 1)) - 1)).bit_length() - 1
    over = steps[-1] >> (left + 1)
    above = left + (over & -over).bit_length() if over else most
    at = below if left - below <= above - left else above
    for (k, n), before in zip(reversed(tail), reversed(steps[:-1]), strict=True):
        if not before >> at & 1:
            chosen[k] += 1
            at -= n
    return chosen


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """``row`` (the document), source, size and a hash that deals documents to blocks."""
    size = F.coalesce(F.regexp_count("row.text", F.lit(common.WORD)), F.lit(0)).cast("long")
    return docs.select(F.struct(*docs.columns).alias("row")).select("row", F.col("row.source").alias("source"), size.alias("size")).withColumn("key", F.xxhash64("row.doc_id", "size", F.lit(seed)))


def _small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """Broadcast a table of ``rows`` short rows if they are few; else leave the join to the planner."""
    return F.broadcast(df) if rows <= most else df


class Mix:
    """A mix of the sources of ``docs``: targets, quotas of blocks, boundary blocks and shards.

    Gathers one row per source on the driver (sizes, counts, the boundary block); block
    sums, the choice inside boundary blocks and the tree's leaves stay distributed.
    """

    def __init__(self, docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 7):
        self.spark, self.seed = docs.sparkSession, seed
        self.sized = common.cut(_sized(docs, seed).select(F.struct("row.doc_id").alias("row"), "source", "size", "key"))
        found = self.sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        goal = targets([r.words for r in found], weights, max_repeats)
        per_block = BLOCK_DOCS
        while sum(r.docs for r in found) * max_repeats // per_block > MOST_UNITS:
            per_block *= 2
        self.rows_ = []
        for i, (r, t) in enumerate(zip(found, goal, strict=True)):
            want = min(round(t), max_repeats * r.words)
            passes = want // r.words if r.words else 0
            bits = max(0, (r.docs // per_block).bit_length() - 1)
            self.rows_.append({"psource": r.source, "sid": i, "source_size": int(r.words), "target": float(t), "bits": bits, "passes": int(passes), "rest": int(want - passes * r.words), "most": max_repeats})
        self.words = sum(r["rest"] + r["passes"] * r["source_size"] for r in self.rows_)
        self._edges()

    def _plan(self) -> DataFrame:
        schema = "psource string, sid int, source_size long, target double, bits int, passes int, rest long, most int, edge long, left long"
        return F.broadcast(self.spark.createDataFrame([(*r.values(),) if "edge" in r else (*r.values(), None, None) for r in self.rows_], schema))  # a row a source, as on the driver

    def _placed(self, sized: DataFrame) -> DataFrame:
        """``sized`` with its source's plan and ``slot``, the place of the row's block among the source's permuted blocks."""
        placed = sized.join(self._plan(), F.col("source").eqNullSafe(F.col("psource"))).drop("psource")
        blocks = F.expr("shiftleft(1L, bits)")
        block = F.pmod(F.xxhash64("key", F.lit(self.seed + 1)), blocks)
        # an odd factor permutes the numbers below a power of two
        return placed.withColumn("slot", F.pmod(block * F.lit(0x9E3779B1) + F.lit(self.seed), blocks))

    def _edges(self) -> None:
        """The permuted block of each source that is taken in part, the words wanted from it, and its chosen rows."""
        placed = self._placed(self.sized).where("size > 0").select("sid", "bits", "slot", "key", "size")
        at = [(r["sid"], 0, r["rest"]) for r in self.rows_ if r["rest"] > 0]
        done, most = 0, max([0, *(r["bits"] for r in self.rows_)])
        upto = Window.partitionBy("sid").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # at most 2**DIGIT rows of a source
        while at and (done == 0 or done < most):
            here = F.broadcast(self.spark.createDataFrame(at, "es int, prefix long, rest long"))
            rows = placed.join(here, F.col("sid") == F.col("es")).where(f"shiftright(slot, greatest(bits - {done}, 0)) = prefix")
            done += DIGIT
            cells = rows.groupBy("sid", "rest", F.expr(f"shiftright(slot, greatest(bits - {done}, 0))").alias("cell")).agg(F.sum("size").alias("words"))
            first = cells.withColumn("upto", F.sum("words").over(upto)).where("upto > rest").groupBy("sid").agg(F.min(F.struct("cell", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))).alias("x"))
            at = [(r.sid, r.x.cell, r.x.left) for r in first.collect()]
        for r in self.rows_:
            r["edge"], r["left"] = next(((e, left) for i, e, left in at if i == r["sid"]), (0, 0))
        boundary = self._placed(self.sized).where("slot = edge and left > 0 and size > 0")
        self.chosen = common.cut(boundary.groupBy("sid", "key", "size", "left", "passes", "most").agg(F.count("*").alias("n")).groupBy("sid").applyInPandas(_fill_group, "fs int, fkey long, more int"))

    def taken(self, sized: DataFrame) -> DataFrame:
        """``sized`` with source_size, target and copies: how often the row's block is drawn for it."""
        chosen = _small(self.chosen.withColumnRenamed("more", "picked"), self.chosen.count())
        rows = self._placed(sized).join(chosen, (F.col("sid") == F.col("fs")) & (F.col("key") == F.col("fkey")) & (F.col("slot") == F.col("edge")), "left")
        more = F.when(F.col("slot") < F.col("edge"), 1).when(F.col("slot") == F.col("edge"), F.coalesce("picked", F.lit(0))).otherwise(0)
        return rows.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + more).cast("int")).drop("fs", "fkey", "picked")

    def _quotas(self) -> list[tuple[int, int, int, int]]:
        """Blocks that the mix draws of each source, by the numbers that the draws of a block have: whole passes, the rest, and the boundary block again."""
        out = []
        for r in self.rows_:
            blocks, part = 1 << r["bits"], _times(r["passes"], r["most"]) if r["left"] > 0 else 0
            out.append((r["passes"] * blocks + r["edge"] + part, blocks, r["passes"], r["edge"]))
        return out

    def leaves(self, shards: int | None = None) -> DataFrame:
        """sid, shard, first and n: the run of a source's drawn blocks that a leaf of the tree gives its shard."""
        shards = shards or max(LEAST_SHARDS, -(-self.words // SHARD_WORDS))
        quotas, seed = [q for q, *_ in self._quotas()], self.seed
        schema = pa.schema([("sid", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # consecutive shards
                if batch.num_rows:
                    ids = batch.column("id")
                    rows = [(i, shard, int(f), int(n)) for shard, first, have in split_tree(quotas, shards, seed, ids[0].as_py(), ids[-1].as_py() + 1) for i, (f, n) in enumerate(zip(first, have, strict=True)) if n]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        return self.spark.range(0, shards, 1, min(shards, 16 + shards // 1000)).mapInArrow(run, "sid int, shard int, first long, n long")

    def shards(self, sized: DataFrame, shards: int | None = None) -> DataFrame:
        """``taken(sized)`` with ``shards``: the shard of each of the row's copies, by the draws of its block."""
        drawn = self.leaves(shards).select("sid", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("unit"))
        known = F.broadcast(self.spark.createDataFrame([(i, *x[1:]) for i, x in enumerate(self._quotas())], "qs int, blocks long, qpasses long, qedge long"))
        drawn = drawn.join(known, F.col("sid") == F.col("qs"))
        again = F.col("unit") > F.col("qpasses") * F.col("blocks") + F.col("qedge")  # the boundary block's second draw beyond the passes
        slot = F.when(again, F.col("qedge")).otherwise(F.col("unit") % F.col("blocks"))
        copy = F.when(again, F.col("qpasses") + 1).otherwise(F.floor(F.col("unit") / F.col("blocks")))
        dealt = drawn.groupBy(F.col("sid").alias("us"), slot.alias("ub")).agg(F.array_sort(F.collect_list(F.struct(copy.alias("copy"), "shard"))).alias("units"))  # max_repeats at most
        rows = self.taken(sized).join(_small(dealt, sum(q for q, *_ in self._quotas())), (F.col("sid") == F.col("us")) & (F.col("slot") == F.col("ub")), "left")
        mine = F.when(F.col("copies") > 0, F.slice("units.shard", F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>"))
        return rows.withColumn("shards", mine).drop("us", "ub", "units")

    def rows(self, sized: DataFrame, shards: int | None = None) -> DataFrame:
        """One row per copy: row, copy, shard, place; ``place`` shuffles the shard."""
        dealt = self.shards(sized, shards).select("row", "key", F.posexplode("shards").alias("copy", "shard"))
        return dealt.withColumn("place", F.xxhash64("key", "copy", F.lit(self.seed + 3)))


def _times(passes: int, most: int) -> int:
    """How often a row of the boundary block may be taken beyond the passes."""
    return max(1, min(2, most - passes))


def _fill_group(group: pd.DataFrame) -> pd.DataFrame:
    """The rows of one source's boundary block that fill its remainder; equal keys go together."""
    group = group.sort_values("key")
    passes, left = int(group["passes"].iloc[0]), int(group["left"].iloc[0])
    times = _times(passes, int(group["most"].iloc[0]))
    chosen = sorted(fill([(int(k), int(s) * int(n)) for k, s, n in zip(group["key"], group["size"], group["n"], strict=True)], left, times).items())
    return pd.DataFrame({"fs": np.full(len(chosen), group["sid"].iloc[0], np.int32), "fkey": np.array([k for k, _ in chosen], np.int64), "more": np.array([n for _, n in chosen], np.int32)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mix(common.documents(spark, sf_dir))
    return m.shards(m.sized).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "shards")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: every document as often as it is taken, dealt to shards and shuffled inside."""
    m = Mix(docs)
    return m.rows(_sized(docs, m.seed)).repartition("shard").sortWithinPartitions("shard", "place").select("row.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_mix_sources": query}
ORACLES: dict[str, str] = {}
