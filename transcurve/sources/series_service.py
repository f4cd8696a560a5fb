"""Observations of economic series from a service over HTTP, as a Spark data source.

``format("series_service")`` fetches a few series in each task: with a time limit, again after a
growing pause where the service is busy or away, and through a cache in a shared folder. What the
service says it doesn't have is remembered there too, and not asked for again.
"""

from __future__ import annotations

import json
import posixpath
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from transcurve.sources.economic_series import SeriesError

SCHEMA = "series_id string, date date, value double, error string"
#: Attempts of a request, the first pause between them in seconds (doubled each time), its time limit, and series of a task.
ATTEMPTS, PAUSE, TIMEOUT, SERIES_A_TASK = 4, 0.5, 30.0, 8
#: Answers that say that the service is busy or away for now.
PASSING = {408, 425, 429, 500, 502, 503, 504}


class Service:
    """One kind of question to the service: the observations of a series."""

    def __init__(self, base_url: str, api_key: str = "", attempts: int = ATTEMPTS, pause: float = PAUSE, timeout: float = TIMEOUT, cache: str = ""):
        self.base_url, self.api_key, self.attempts, self.pause, self.timeout, self.cache = base_url.rstrip("/"), api_key, attempts, pause, timeout, cache

    def fetch(self, key: str, start: date | None = None, end: date | None = None) -> bytes:
        """The answer for a series from ``start`` to ``end``; an error of the service raises SeriesError."""
        query = {"series_id": key, "api_key": self.api_key} | {f"observation_{k}": d.isoformat() for k, d in (("start", start), ("end", end)) if d}
        name = re.sub(r"[^A-Za-z0-9_.-]", lambda m: f"%{ord(m[0]):x}", "_".join(filter(None, (key, start and start.isoformat(), end and end.isoformat()))))
        if (failed := self._kept("errors", key)) is not None:
            raise SeriesError(json.loads(failed)["error"])
        if (found := self._kept("observations", name)) is not None:
            return found
        try:
            answer = self._asked(f"{self.base_url}/series/observations?{urllib.parse.urlencode(query)}", key)
        except SeriesError as e:
            self._keep("errors", key, json.dumps({"error": str(e)}).encode())
            raise
        self._keep("observations", name, answer)
        return answer

    def _asked(self, url: str, key: str) -> bytes:
        for attempt in range(self.attempts):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                    body = answer.read()
                root = ElementTree.fromstring(body)
                if root.tag == "error":
                    raise SeriesError(f"{key}: {root.get('code', '-1')} {root.get('message', '')}")
                return body
            except urllib.error.HTTPError as e:
                if e.code == 400:
                    raise SeriesError(f"{key}: 400 no such series") from e
                if e.code not in PASSING or attempt + 1 == self.attempts:
                    raise OSError(f"{key}: the service answers {e.code}") from e
            except (urllib.error.URLError, TimeoutError, ConnectionError, ElementTree.ParseError) as e:
                if attempt + 1 == self.attempts:
                    raise OSError(f"{key}: {e}") from e
            time.sleep(self.pause * 2**attempt)
        raise AssertionError

    # -- the cache: files that appear whole
    def _place(self, kind: str, name: str) -> tuple[fs.FileSystem, str]:
        system, inner = fs.FileSystem.from_uri(self.cache) if re.match(r"[a-z][a-z0-9+.-]*:", self.cache) else (fs.LocalFileSystem(), self.cache)
        return system, posixpath.join(inner, kind, urllib.parse.quote(name, safe=""))

    def _kept(self, kind: str, name: str) -> bytes | None:
        if not self.cache:
            return None
        system, path = self._place(kind, name)
        if system.get_file_info(path).type != fs.FileType.File:
            return None
        with system.open_input_stream(path, compression=None) as f:
            return f.read()

    def _keep(self, kind: str, name: str, content: bytes) -> None:
        if self.cache:
            system, path = self._place(kind, name)
            system.create_dir(posixpath.dirname(path), recursive=True)
            part = f"{path}.{uuid.uuid4().hex}"
            with system.open_output_stream(part, compression=None) as f:
                f.write(content)
            system.move(part, path)


def observations(answer: bytes) -> list[tuple[date, float]]:
    """(date, value) by date; "." is missing and goes, of repeated dates the last wins."""
    found = {o.get("date"): o.get("value") for o in ElementTree.fromstring(answer).iter("observation")}
    return sorted((date.fromisoformat(d), float(v)) for d, v in found.items() if v not in (None, "."))


@dataclass
class _Series(InputPartition):
    keys: list[str]


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns = schema.names
        self.keys = [k for k in json.loads(options["series"]) if k is not None]
        self.start, self.end = (date.fromisoformat(options[k]) if options.get(k) else None for k in ("start", "end"))
        self.a_task, self.errors = int(options.get("series_a_task", SERIES_A_TASK)), options.get("errors", "raise")
        kinds = {"api_key": str, "attempts": int, "pause": float, "timeout": float, "cache": str}
        self.service = Service(options["base_url"], **{k: kind(options[k]) for k, kind in kinds.items() if k in options})

    def partitions(self) -> Sequence[InputPartition]:
        keys = list(dict.fromkeys(self.keys))
        return [_Series(keys[i : i + self.a_task]) for i in range(0, len(keys), self.a_task)] or [_Series([])]

    def read(self, partition: _Series) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("series_id", pa.string()), ("date", pa.date32()), ("value", pa.float64()), ("error", pa.string())])
        for key in partition.keys:
            try:
                found = observations(self.service.fetch(key, self.start, self.end))
                rows = [(key, d, v, None) for d, v in found if (not self.start or d >= self.start) and (not self.end or d <= self.end)]
            except SeriesError as e:
                if self.errors != "row":
                    raise
                rows = [(key, None, None, str(e))]
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)
            yield batch.select(self.columns)


class _PushingReader(_Reader):
    """Also takes the predicates of a query: which series, and from when to when."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        name = getattr(f, "attribute", None)
        if name == ("series_id",) and isinstance(f, EqualTo | In):
            wanted = f.value if isinstance(f, In) else [f.value]
            self.keys = [k for k in self.keys if k in wanted]
            return True
        if name == ("series_id",) and isinstance(f, IsNotNull):
            return True
        # rows that tell an error have no date: they go as null does
        if name == ("date",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and self.errors != "row":
            if not isinstance(f, LessThan | LessThanOrEqual):
                first = f.value + timedelta(days=isinstance(f, GreaterThan))
                self.start = max(self.start or first, first)
            if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                last = f.value - timedelta(days=isinstance(f, LessThan))
                self.end = min(self.end or last, last)
            if self.start and self.end and self.start > self.end:
                self.keys = []
            return True
        return name == ("date",) and isinstance(f, IsNotNull) and self.errors != "row"


class SeriesSource(DataSource):
    """Options: base_url, series (a JSON list), api_key, start, end, errors (raise, or row: told in the column error), cache, attempts, pause, timeout, series_a_task, pushdown."""

    @classmethod
    def name(cls) -> str:
        return "series_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> _Reader:
        return (_PushingReader if self.options.get("pushdown") == "true" else _Reader)(schema, self.options)


def read(spark: SparkSession, base_url: str, series: Sequence[str], **options: str) -> DataFrame:
    """series_id, date, value and error of the named series.

    With ``pushdown="true"`` a query's own predicates go to the service. Spark 4.1 keeps
    pushed predicates by loaded frame, so then each query needs a load of its own.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SeriesSource)
    return spark.read.format("series_service").options(base_url=base_url, series=json.dumps(list(series)), **options).load()
