"""Reading, checking and writing grids and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transcurve.spec import Model


class SchemaError(ValueError):
    """A grid without the columns or types that it should have."""


def check(df: DataFrame, regressors: Sequence[str], status: str | None = None, next_status: str | None = None) -> DataFrame:
    """``df`` itself if its regressors are numeric and its statuses there."""
    types = dict(zip(df.columns, (f.dataType for f in df.schema), strict=True))
    for r in regressors:
        if not isinstance(types.get(r), T.NumericType | T.BooleanType):
            raise SchemaError(f"{r} is missing or not a number")
    for s in (status, next_status):
        if s is not None and s not in types:
            raise SchemaError(f"{s} is missing")
    return df


def read(spark: SparkSession, path: str, regressors: Sequence[str], status: str | None = None, next_status: str | None = None) -> DataFrame:
    return check(spark.read.parquet(path), regressors, status, next_status)


def write(df: DataFrame, path: str, float32: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write as Parquet; the named regressors in single precision, half the space."""
    df.withColumns({c: F.col(c).cast("float") for c in float32}).write.mode(mode).parquet(path)


def from_arrays(spark: SparkSession, columns: dict[str, Sequence[float]]) -> DataFrame:
    """A grid of in-memory arrays."""
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({k: pd.Series(v, dtype=float) for k, v in columns.items()}))


def constant(value: float) -> F.Column:
    return F.lit(float(value))


def stepped(spark: SparkSession, name: str, start: float, step: float, steps: int) -> DataFrame:
    return spark.range(steps).select("id", (F.lit(float(start)) + F.col("id") * float(step)).alias(name))


def write_model(spark: SparkSession, model: Model, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_model(spark: SparkSession, path: str) -> Model:
    return Model.from_json("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
