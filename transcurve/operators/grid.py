"""Grids: from histories of statuses to the rows a model is fitted on."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcurve.functions.permutation import Permutation
from transcurve.spec import Model, StatusFamily

#: Rows of a block; the last block takes the remainder.
BLOCK = 1000


def transitions(df: DataFrame, entity: str, order: Sequence[str], status: str, next_status: str = "next_status") -> DataFrame:
    """Each row with the entity's next status, null on its last row."""
    return df.withColumn(next_status, F.lead(status).over(Window.partitionBy(entity).orderBy(*order)))


def transitions_ranged(df: DataFrame, entity: str, order: Sequence[str], status: str, next_status: str = "next_status") -> DataFrame:
    """The same where one entity may hold a large share of all rows.

    Rows are range-partitioned by entity and order, so an entity with very many rows is
    dealt to several tasks. A task's last row of an entity finds its successor in the
    first row of the next partition; those heads, one a partition, are broadcast.
    """
    keys = [entity, *order]
    parts = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("__part", F.spark_partition_id())
    inside = Window.partitionBy("__part", entity).orderBy(*order)
    # ranges are sampled: heads must come from the partitions that the rows are in
    placed = settled(parts.withColumn(next_status, F.lead(status).over(inside)).withColumn("__inner", F.lead(F.lit(True)).over(inside)))
    heads = placed.groupBy("__part").agg(F.min(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col(status).alias("s"))).alias("head"))
    before = Window.orderBy("__part")  # a row for each partition
    heads = heads.select(F.lag("__part").over(before).alias("__before"), F.col("head.k0").alias("__entity"), F.col("head.s").alias("__head"))
    rows = placed.join(F.broadcast(heads), (F.col("__part") == F.col("__before")) & F.col(entity).eqNullSafe(F.col("__entity")) & F.col("__inner").isNull(), "left")
    return rows.withColumn(next_status, F.when(F.col("__inner"), F.col(next_status)).otherwise(F.col("__head"))).drop("__part", "__inner", "__before", "__entity", "__head")


def fitting_rows(df: DataFrame, status: str, next_status: str, family: StatusFamily, origin: str) -> DataFrame:
    """Rows in one status whose next status is known and reachable."""
    return df.where((F.col(status) == origin) & F.col(next_status).isNotNull() & F.col(next_status).isin(*family.from_(origin)))


def float32(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Regressors as they are stored: rounded to single precision, read as double."""
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})


def finite(x: Column) -> Column:
    """Whether a value takes part in quantiles and variances: not null, NaN or infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def encode(column: Column, names: Sequence[str]) -> Column:
    """Ordinal of a name by a literal dictionary; null if unknown."""
    out = F.lit(None).cast("int")
    for i in range(len(names) - 1, -1, -1):
        out = F.when(column == names[i], i).otherwise(out)
    return out


def decode(column: Column, names: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), column)


def shuffle_key(row_id: Column | str, seed: int) -> Column:
    """A stable pseudo-random key of a row: sorting or cutting by it shuffles, on any number of machines."""
    return F.xxhash64(row_id, F.lit(seed))


def row_hash(df: DataFrame, *salt: Column) -> Column:
    """A hash of all columns that can be hashed: maps and ambiguous names can't."""
    names = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind and df.columns.count(c) == 1]
    return F.xxhash64(*[F.col(f"`{c}`") for c in names], *salt) if names or salt else F.lit(0).cast("long")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there, so that it can't come out differently.

    The folder is ``shared_folder``'s.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is named, a session of one process (tests) gets
    one of its own, and a cluster an error: a machine's folder would lose rows there."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return named
    if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="checkpoint-")


def _placed(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` with __place, its rows' places in ``order``, and __all, their number.

    Places are counted without gathering the table: rows are range-partitioned by the
    order, each partition is counted, and a row's place is its partition's offset plus
    its place inside. Only the counts, one a partition, are broadcast.
    """
    parts = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__part", F.spark_partition_id())
    inside = Window.partitionBy("__part").orderBy(*order)
    # ranges are sampled: what is counted must be what is numbered
    placed = settled(parts.withColumn("__at", F.row_number().over(inside) - 1))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    rows = placed.join(F.broadcast(offsets), F.col("__part") == F.col("__p"))
    return rows.withColumn("__place", F.col("__before") + F.col("__at")).drop("__part", "__p", "__at", "__before")


def blocks(df: DataFrame, order: Sequence[Column | str], size: int = BLOCK, name: str = "block_id") -> DataFrame:
    """Numbers contiguous blocks of ``size`` rows in ``order``; the last takes the remainder."""
    block = F.least(F.floor(F.col("__place") / size), F.greatest(F.floor(F.col("__all") / size) - 1, F.lit(0))).cast("long")
    return _placed(df, order).withColumn(name, block).drop("__place", "__all")


def permuted(df: DataFrame, order: Sequence[Column | str], seed: int = 0, name: str = "place") -> DataFrame:
    """``df`` with each row's place in a random permutation of the whole table.

    Rows are numbered in ``order``, which must not tie, and numbers go through a keyed bijection:
    the same permutation on any cluster, and no sort by random keys. Blocks of it are random samples.
    """
    rows = _placed(df, order)
    n = rows.count()
    return rows.withColumn(name, Permutation(n, seed).column(F.col("__place"))).drop("__place", "__all")


def hashed_blocks(df: DataFrame, row_id: str, count: int, seed: int = 0, name: str = "block_id") -> DataFrame:
    """Random blocks of about equal size, without a shuffle: for block statistics at scale."""
    return df.withColumn(name, F.pmod(shuffle_key(row_id, seed), F.lit(count)))


def shard(df: DataFrame, first: int, last: int, name: str = "block_id") -> DataFrame:
    """A contiguous range of blocks."""
    return df.where(F.col(name).between(first, last))


def restrict(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only these columns; unknown ones raise."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such regressors: {missing}")
    return df.select(*columns)


def bind(model: Model, df: DataFrame, next_status: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The columns a model reads, and ``next_offset``: the next status among the reachable ones."""
    missing = [r for r in model.regressors if r not in df.columns]
    if missing:
        raise ValueError(f"no such regressors: {missing}")
    out = df.select(*dict.fromkeys([*keep, *model.regressors]), *([F.col(next_status).alias("__next")] if next_status else []))
    return out.withColumn("next_offset", encode(F.col("__next"), model.reachable)).drop("__next") if next_status else out


def materialise(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Keep a grid for the passes of a fit; what is lost with an executor is computed again."""
    return df.persist(level)
