"""Grids that a caller's own object provides, part by part, as a Spark data source.

Whatever holds the rows (a file format of its own, an archive, another service) says its schema,
how many parts it has, and gives the columns of a part as arrays; each part is read in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from transcurve.sources.grids import SchemaError, check

#: Rows of a batch that a part is handed on in.
BATCH = 10_000


class GridProvider(Protocol):
    """What a caller implements; it travels to the tasks, so it must be picklable."""

    def schema(self) -> str:
        """Columns and types, as Spark's DDL."""

    def parts(self) -> int:
        """How many parts there are; asked once, on the driver."""

    def read(self, part: int, columns: Sequence[str]) -> Mapping[str, Sequence[Any]]:
        """The named columns of a part, of equal length; a part may be read again after a task is lost."""


def provide(spark: SparkSession, provider: GridProvider, regressors: Sequence[str] = (), status: str | None = None, next_status: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A frame over a provider's parts, checked as a grid; ``columns``, by default all, are the ones that it's asked for."""
    whole = T.StructType.fromDDL(provider.schema())
    if unknown := {*(columns or [])} - {*whole.names}:
        raise SchemaError(f"no such columns: {sorted(unknown)}")
    wanted = T.StructType([f for f in whole.fields if columns is None or f.name in columns])
    name = f"grid_{re.sub('[^A-Za-z0-9]', '_', type(provider).__name__)}"
    arrow = to_arrow_schema(wanted)

    class Reader(DataSourceReader):
        def partitions(self) -> Sequence[InputPartition]:
            return [InputPartition(i) for i in range(provider.parts())] or [InputPartition(None)]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            if partition.value is None:
                return
            found = provider.read(partition.value, list(wanted.names))
            arrays = [pa.array(found[f.name], f.type) for f in arrow]
            if len({len(a) for a in arrays}) > 1:
                raise SchemaError(f"part {partition.value} has columns of unequal length")
            yield from pa.Table.from_arrays(arrays, schema=arrow).to_batches(max_chunksize=BATCH)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return wanted

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)
    return check(spark.read.format(name).load(), regressors, status, next_status)
