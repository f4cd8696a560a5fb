"""Grids whose equal rows are counted: sums over rows become weighted sums over distinct rows, with the same results.

A fit passes over its grid many times, and a model reads few columns of it, which often hold few
distinct rows: flags, quantities, prices in cents. Such columns are counted once, by a grouping
that Spark adds up map-side; what passes read then grows with the distinct rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import accumulate
from math import prod
from operator import mul

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column of a counted grid: how many rows a row stands for.
ROWS = "__rows"
#: Rows that fall on a distinct one, at least, where columns are counted: else passes read the rows.
SHARE = 2
#: Distinct rows that one task is given before there are more, and when all machines have tasks.
SMALL, LARGE = 20_000, 500_000
#: Rows that are sketched, about, to plan which columns are counted first.
PLANNED = 2_000_000


def counted(grid: DataFrame, names: Sequence[str]) -> DataFrame:
    """The distinct rows of these columns and next_offset, with the number of each. Nulls are equal, and NaN are."""
    rows = F.sum(ROWS) if ROWS in grid.columns else F.count("*").cast("double")
    return grid.groupBy(*names, "next_offset").agg(rows.alias(ROWS))


class Tables:
    """The counted grids of a kept grid, that of all ``columns`` first and others when a pass first needs them.

    Columns whose rows are mostly distinct (by a sketch) aren't counted. Columns of a table that is
    there are counted from it. A grid that isn't kept yet is counted as it is read (``begin``), by columns that hold
    few distinct rows; those that hold many are read when a pass needs them, and passes read what comes of that.
    """

    def __init__(self, grid: DataFrame, columns: Sequence[str]):
        self.grid, self.rows, self.columns, self._kept, self._made = grid, grid, frozenset(columns), {}, []
        self._source, self._n, self._distinct = None, 0, {}

    @classmethod
    def attach(cls, grid: DataFrame, columns: Sequence[str]) -> DataFrame:
        """``grid``, whose passes read counted rows from now on."""
        grid.__dict__["_tables"] = cls(grid, columns)
        return grid

    def begin(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        """The first counted grid and its columns, from ``rows``: the grid's, and others whose next_offset is null.

        It has all columns where their rows repeat or are few, by a sketch of some rows, else those of the fewest values, as many as
        keep it small: a model that never asks for prices doesn't pay for them.
        """
        names = sorted(self.columns)
        number = [F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(names)]
        n = rows.count()
        # sketches of all rows would cost more than their count; what is counted, and what comes of it, is always of all rows
        some = rows.select(*names).sample(PLANNED / n, seed=0) if n > PLANNED else rows
        found = some.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(F.lit(0), *names)).alias("distinct"), *number).first()
        self._source, self._n, self._distinct = rows, found.n, {c: found[f"n{i}"] + 1 for i, c in enumerate(names)}  # one for null
        first = self.columns
        if found.distinct > LARGE and found.distinct * SHARE > found.n:
            by = sorted(names, key=lambda c: self._distinct[c])
            first = frozenset(by[: sum(n <= LARGE for n in accumulate((self._distinct[c] for c in by), mul))])
        return self._read(first), sorted(first)

    def _read(self, key: frozenset[str]) -> DataFrame:
        """The counted grid of some columns, from one reading of the source.

        Rows whose next_offset is null leave after the count. A filter before it would compute once more what it
        filters by, and the grid itself is neither sorted nor kept unless something reads it.
        """
        made = counted(self._source, sorted(key)).persist()
        self._made.append(made)
        table = made.where(F.col("next_offset").isNotNull())
        found = table.agg(F.count("*").alias("distinct"), F.sum(ROWS).alias("n")).first()
        tasks = self._tasks(found.distinct)
        table = table.coalesce(tasks) if table.rdd.getNumPartitions() > tasks else table
        self._kept[key] = table, found.distinct
        if key == self.columns and found.distinct * SHARE > (found.n or 0):  # it takes the grid's place
            self.rows = table
        return table

    def _tasks(self, n: int) -> int:
        return min(max(1, n // SMALL), max(self.grid.sparkSession.sparkContext.defaultParallelism, n // LARGE))

    def of(self, names: Iterable[str]) -> DataFrame:
        """The least of what there is that has all rows of these columns: a counted grid, or the grid itself."""
        key = frozenset(names)
        if self._source is not None and not any(k >= key for k in self._kept):
            # these columns alone where their rows repeat for sure, else all, which serve what is asked later, too
            self._read(key if prod(self._distinct[c] for c in key) * SHARE <= self._n else self.columns)
        for new in (self.columns, key) if self._source is None else (key,):
            if new not in self._kept:
                self._kept[new] = self._table(sorted(new))
        return self._kept[key][0]

    def _table(self, names: list[str]) -> tuple[DataFrame, int]:
        wider = [t for key, t in self._kept.items() if key.issuperset(names) and t[0] is not self.rows]
        source, n = min(wider, key=lambda t: t[1], default=(self.rows, None))
        if n is not None and n <= SMALL:
            return source, n
        found = source.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*names, "next_offset")).alias("distinct")).first()
        if found.distinct * SHARE > found.n:
            return source, found.n
        table = counted(source, names).repartition(self._tasks(found.distinct)).persist()
        self._made.append(table)
        return table, found.distinct

    def unpersist(self) -> None:
        for table in self._made:
            table.unpersist()
        self._kept, self._made, self._source = {}, [], None


def tables(grid: DataFrame, wanted: Sequence[Iterable[str]]) -> list[tuple[DataFrame, list[int]]]:
    """What to read for each of these sets of columns: tables, and the sets' places that each serves."""
    own = grid.__dict__.get("_tables")
    if own is None:
        return [(grid, list(range(len(wanted))))]
    out: dict[int, tuple[DataFrame, list[int]]] = {}
    for i, names in enumerate(wanted):
        table = own.of(names)
        out.setdefault(id(table), (table, []))[1].append(i)
    return list(out.values())
