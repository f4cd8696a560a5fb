"""As-of joins of two large tables: each row with the latest row of another at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transcurve.operators.grid import finite, settled


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` with equal ``by`` whose ``at`` is not above (``strict``: below) the row's.

    Both tables are dealt once, together, by ranges of keys and ``at``, so a key with very many
    rows is spread over several tasks. Inside a task a running window finds the last right row; a
    task's first key goes on with the last right row before the task, one row a task, broadcast.

    Rows without such a row, and rows with a null in ``by`` or ``at``, get nulls; all rows stay. Of
    right rows at the same place the one with the greatest ``columns`` counts.
    """
    if clash := {*columns} & {*left.columns}:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    keys = [f"__k{i}" for i in range(len(by))]
    payload = F.struct(*[F.col(f"`{c}`") for c in columns])
    place = lambda: [*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], F.col(f"`{at}`").alias("__t")]
    known = lambda: F.lit(True) if not by else ~F.greatest(*[F.col(f"`{c}`").isNull() for c in (*by, at)])
    rights = right.where(known() & F.col(f"`{at}`").isNotNull()).select(*place(), F.lit(1 if strict else 0).alias("__side"), payload.alias("__r"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("__l"))
    lefts = left.select(*place(), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(rights.schema["__r"].dataType).alias("__r"), F.struct("*").alias("__l"))
    # rows of one place are dealt by a hash too: right ones of a tie may part, as what is before them is carried on
    dealt = lefts.unionByName(rights).withColumn("__h", F.xxhash64("__l"))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["__t", "__side", "__r", "__h"]
    parts = settled(dealt.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("__r").isNotNull(), F.struct(*keys, "__t", "__r")))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = parts.groupBy("__part").agg(last.alias("__last")).select(F.col("__part").alias("__p"), F.max("__last").over(earlier).alias("__last"))
    rows = parts.withColumn("__own", F.last("__r", True).over(inside)).where(F.col("__l").isNotNull()).join(F.broadcast(carried), F.col("__part") == F.col("__p"), "left")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__last.{k}"))
    usable = F.col("__t").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    before = F.col("__last.__t") < F.col("__t") if strict else F.col("__last.__t") <= F.col("__t")
    found = F.when(usable, F.coalesce("__own", F.when(same & before, F.col("__last.__r"))))
    return rows.select(F.col("__l"), found.alias("__found")).select("__l.*", *[F.col("__found").getField(c).alias(c) for c in columns])


def bucket_by_group(df: DataFrame, by: Sequence[str], x: str, edges: DataFrame, name: str = "bucket") -> DataFrame:
    """``df`` with the bucket of x among its group's edges: the last edge not above x, the first bucket below all.

    ``edges`` has the columns ``by``, bucket and edge, however many rows. Null where x isn't
    finite or the group has no edges.
    """
    floor = edges.where(F.col("edge").isNotNull()).groupBy(*by).agg(F.min("bucket").alias(name)).withColumn("__x", F.lit(float("-inf")))
    all_edges = edges.where(F.col("edge").isNotNull()).select(*by, F.col("bucket").alias(name), F.col("edge").cast("double").alias("__x")).unionByName(floor.select(*by, name, "__x"))
    value = F.col(x).cast("double")
    return asof_join(df.withColumn("__x", F.when(finite(value), value)), all_edges, by, "__x", [name]).drop("__x")
