"""Shared helpers of the training-data operators.

Nothing here keeps per-row state on the driver: tables are read lazily, lineage is
cut through the checkpoint folder the session names, and components are computed
with label propagation over distributed tables.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that more than one in so many rows carry is frequent; there are fewer such keys than this.
FREQUENT = 1000
#: White space of every word rule: the space and the six control characters 9-13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The folder is the one in ``spark.checkpoint.dir``, which all executors share. Where none is
    named, a session of one process (tests) gets a folder of its own, and a cluster an error:
    a machine's folder would lose rows there.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``cut``'s files."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def give_back() -> None:
    """Return memory that this process holds but doesn't use to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a task, after which the worker gives unused memory back: idle workers count for an executor."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def forget(df: DataFrame) -> DataFrame:
    """``cut`` without the size that Spark estimated for the frame, for loops.

    A checkpointed frame keeps the estimate of the plan it came from, and a join's estimate
    is the product of its inputs'. Through a loop of joins it becomes a number of millions
    of digits, whose multiplication takes longer than the work.
    """
    done = cut(df)
    session = df.sparkSession
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(session._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), session)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle and checkpoint files of frames that are gone.

    Its cleaner acts on what the driver's garbage collector has found, and a driver with
    little to do collects rarely: long chains of jobs would keep all their files until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Split a batch into slices holding about ``max_bytes`` of one string column.

    A single longer value makes a slice of its own; no value is cut.
    """
    start, held = 0, 0
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.binary_length(col).fill_null(0).to_pylist() if len(col) else []
    for i, n in enumerate(sizes):
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the least ``value`` among the rows of equal ``key`` (a string), null where the key is null.

    Only keys that occur twice are looked up. Rows of frequent keys meet theirs in a broadcast of
    fewer than ``FREQUENT`` keys and go on spread by the partition they came from; the others
    meet in a shuffle, so no task gets all rows of a hot key.
    """
    repeated = cut(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("__least"), F.count("*").alias("__rows")).where("__rows > 1"))
    often = F.col("__rows") * FREQUENT > rows.count()
    frequent = repeated.where(often).select(F.col(key).alias("__often"), F.col("__least").alias("__a"))
    seldom = repeated.where(~often).select(F.col(key).alias("__seldom"), F.col("__least").alias("__b"))
    met = rows.join(F.broadcast(frequent), F.col(key) == F.col("__often"), "left")
    spread = F.concat_ws(":", F.lit("met"), F.spark_partition_id(), F.xxhash64(value))
    met = met.withColumn("__at", F.when(F.col("__often").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spread))
    own = F.when(F.col(key).isNotNull(), F.col(value))
    return met.join(seldom, F.col("__at") == F.col("__seldom"), "left").withColumn(name, F.coalesce("__a", "__b", own)).drop("__often", "__a", "__at", "__seldom", "__b")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), the least node.

    Minimum-label propagation with pointer jumping. Each round joins the edges to the
    labels and takes a map-side minimum, then replaces every label by its label's
    label, so chains halve. All tables stay distributed; the edges and the labels they meet
    are materialised, so a node with very many edges is split by the skew-join rule.
    Self-loops are harmless; an empty input gives an empty result.
    """
    both = forget(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = forget(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:  # every round lowers a label: it ends, after about the logarithm of the longest path
        seen = both.join(labels, both.u == labels.node).groupBy(F.col("v").alias("node")).agg(F.min("label").alias("m"))
        hooked = labels.join(seen, "node", "left").select("node", "label", F.least("label", "m").alias("near"))
        parent = labels.select(F.col("node").alias("near"), F.col("label").alias("up"))
        moved = forget(hooked.join(parent, "near", "left").select("node", "label", F.least("near", F.coalesce("up", "near")).alias("next")))
        changed = moved.where("next <> label").limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
