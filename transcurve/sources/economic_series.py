"""Economic time series in the XML of the public FRED service, read from files.

A store's folder holds the service's answers: ``series/<id>.xml``, ``observations/<id>.xml``,
``category/<id>.xml``, ``children/<id>.xml`` and ``category_series/<id>.xml``. A ``fetch``
callable may fill it from elsewhere; its failures are remembered and raised again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcurve.operators.grid import settled

OBSERVATION = "_date string, _value string"
SERIES = ", ".join(
    f"_{a} string" for a in ("id", "title", "units", "notes", "realtime_start", "realtime_end", "observation_start", "observation_end", "last_updated", "frequency_short", "seasonal_adjustment_short", "popularity")
)
CATEGORY = "_id string, _name string, _parent_id string"
#: How the service writes the time of the last update.
UPDATED = "yyyy-MM-dd HH:mm:ssX"


class SeriesError(RuntimeError):
    """The service answered with an error, or a file can't be read."""


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def observations(spark: SparkSession, path: str) -> DataFrame:
    """date, value by date; "." is missing and goes, of repeated dates the last in the file wins."""
    rows = _rows(spark, path, "observation", OBSERVATION).withColumn("__at", F.monotonically_increasing_id())
    latest = Window.partitionBy("_date").orderBy(F.desc("__at"))
    known = rows.where("_value <> '.'").withColumn("__n", F.row_number().over(latest)).where("__n = 1")
    return known.select(F.to_date("_date", "yyyy-MM-dd").alias("date"), F.col("_value").cast("double").alias("value")).orderBy("date")


def series(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of each series in a file."""
    rows = _rows(spark, path, "series", SERIES)
    dates = [F.to_date(f"_{c}", "yyyy-MM-dd").alias(c) for c in ("realtime_start", "realtime_end", "observation_start", "observation_end")]
    return rows.select(
        F.col("_id").alias("series_id"), F.col("_title").alias("title"), F.col("_units").alias("units"), F.col("_notes").alias("notes"), *dates,
        F.to_timestamp("_last_updated", UPDATED).alias("last_updated"), F.col("_frequency_short").alias("frequency"),
        F.col("_seasonal_adjustment_short").alias("seasonal_adjustment"), F.coalesce(F.col("_popularity").cast("int"), F.lit(-1)).alias("popularity"),
    )


def categories(spark: SparkSession, path: str) -> DataFrame:
    """id, name, parent_id and is_root (its own parent) of each category in a file."""
    rows = _rows(spark, path, "category", CATEGORY)
    out = rows.select(F.col("_id").cast("int").alias("id"), F.col("_name").alias("name"), F.col("_parent_id").cast("int").alias("parent_id"))
    return out.withColumn("is_root", F.col("id") == F.col("parent_id"))


def descendants(tree: DataFrame, root: int) -> DataFrame:
    """A category and all below it, with their depth: one join a level, to the last level.

    A category is listed at its first level, so a tree that leads back to itself ends too.
    """
    level = tree.where(F.col("id") == root).select("id", "name", "parent_id", F.lit(0).alias("depth"))
    out, depth = level, 0
    while True:
        depth += 1
        up, known = level.select(F.col("id").alias("up")), out.select(F.col("id").alias("known"))
        below = tree.join(up, F.col("parent_id") == F.col("up")).join(known, F.col("id") == F.col("known"), "left_anti")
        level = settled(below.select("id", "name", "parent_id", F.lit(depth).alias("depth")))
        if not level.limit(1).count():
            return out
        out = out.unionByName(level)


class Store:
    """Files of a folder by kind and id, and a tree of categories over them."""

    def __init__(self, spark: SparkSession, folder: str, fetch: Callable[[str, str], None] | None = None):
        self.spark, self.folder, self.fetch = spark, folder.rstrip("/"), fetch
        self._failed: dict[tuple[str, str], SeriesError] = {}
        self._fetched: set[tuple[str, str]] = set()

    def path(self, kind: str, key: str) -> str:
        """The file of an answer, fetched once; a failure is raised each time."""
        if (kind, key) in self._failed:
            raise self._failed[kind, key]
        path = f"{self.folder}/{kind}/{key}.xml"
        try:
            if self.fetch and (kind, key) not in self._fetched:
                self.fetch(kind, key)
                self._fetched.add((kind, key))
            error = self.spark.read.format("xml").option("rowTag", "error").schema("_code string, _message string").load(path).first()
        except Exception as e:
            self._failed[kind, key] = SeriesError(f"{kind} {key}: {e}")
            raise self._failed[kind, key] from e
        if error:
            self._failed[kind, key] = SeriesError(f"{kind} {key}: {error['_code']} {error['_message']}")
            raise self._failed[kind, key]
        return path

    def series(self, key: str) -> tuple[DataFrame, DataFrame]:
        """Metadata and observations of a series."""
        return series(self.spark, self.path("series", key)), observations(self.spark, self.path("observations", key))

    def category(self, key: int) -> DataFrame:
        return categories(self.spark, self.path("category", str(key)))

    def children(self, key: int) -> DataFrame:
        """Sub-categories; the root lists itself, which is no child."""
        return categories(self.spark, self.path("children", str(key))).where(F.col("id") != key)

    def category_series(self, key: int) -> DataFrame:
        return series(self.spark, self.path("category_series", str(key)))
