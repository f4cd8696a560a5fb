"""WARC archives as a Spark data source: ``format("warc")``, read and written.

A read plans partitions from whole files, packed up to ``partition_bytes``. Predicates on
record type and other headers are pushed down; of each record only the header is parsed
first, and a record that the predicates drop, or whose payload no column asks for, is
skipped: by its length in a plain archive, by the length its gzip member states in an
extra field in a compressed one (members without that field are inflated and thrown away). ``read`` asks
for payloads only if it is told to.

Predicates go down in two ways. ``read`` takes them as Spark's filter objects and gives them to
the source with the path, so they belong to one frame for good. With the option ``pushdown`` the
source also takes what the optimizer finds in a query's ``where``. Spark 4.1 keeps one such set for a
loaded frame, not for a query: a second query of the same frame can get the first one's
predicates. So that option is off unless asked for, and then each query needs a load of its own.

A write makes one archive or more for each task, of ``file_bytes`` at most but for one record, one gzip member a record. Files
have names of their own for each attempt, and the commit lists those that count in a
manifest; files of lost attempts are removed. Without a manifest all ``.warc`` and ``.warc.gz``
files of the folder (or the one file that the path names) are read.

Any file system that pyarrow knows serves the path, which driver and executors must share.
A record that isn't one raises an error that names file and offset.
Records without payload (null) have an empty one; null headers are left out; control
characters in header values are written as percent escapes. Records keep the order of their task.

The query's pages: a null html is empty. Of equal payloads the least page_id is the response,
with all rows that repeat it; the others revisit it. A null page_id is a
response if its payload has no other page, else a revisit. Extra columns are ignored; an
empty table makes an archive without records.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains,
    StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from transcurve.llm import common

#: Payloads of at least so many bytes may be revisited.
REVISIT_BYTES = 100
PARTITION_BYTES, FILE_BYTES, BATCH_BYTES, BATCH_ROWS = 128 << 20, 128 << 20, 8 << 20, 1000
#: Every record of an archive that is written has this date unless it brings its own, so that writes agree.
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "_manifest.json"

#: Columns that stand for a named header.
_HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
}
#: All columns; http_length is the payload's length by the HTTP header that precedes it.
SCHEMA = ", ".join(f"{c} string" for c in _HEADERS) + ", content_length long, headers map<string,string>, http_length long, payload binary, file string, offset long"
_ARROW = {"content_length": pa.int64(), "http_length": pa.int64(), "offset": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
#: Columns for which a record's block is read.
_BLOCK = {"payload", "http_length"}
#: The extra field of a gzip member: its own length, header and trailer included.
_EXTRA = b"tl"
_HTTP = "application/http;msgtype=response"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def _member(raw: bytes, level: int = 6) -> bytes:
    """A gzip member that states its own length."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    length = 10 + 2 + 12 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    if length >> 64:
        raise ValueError("record too long")
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHQ", 12, _EXTRA, 8, length) + body + tail


def record(row: dict, level: int | None = 6) -> bytes:
    """A record's bytes: a gzip member, or plain for no ``level``."""
    payload, length = row.get("payload") or b"", row.get("http_length")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(v))
    head = {_HEADERS[c]: row[c] for c in _HEADERS if row.get(c) is not None} | dict(row.get("headers") or {})
    head = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": _HTTP} | head
    block = http + payload if head["Content-Type"] == _HTTP else payload
    head["Content-Length"] = len(block)
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    return raw if level is None else _member(raw, level)


class _Plain:
    """A cursor over the records of an uncompressed archive."""

    def __init__(self, file: io.BufferedReader):
        self.file, self.at = file, 0

    def head(self) -> bytes | None:
        self.file.seek(self.at)
        lines, first = [], True
        while line := self.file.readline():
            if first and not line.strip():
                self.at += len(line)
                continue
            first = False
            if line in (b"\r\n", b"\n"):
                return b"".join(lines)
            lines.append(line)
        if lines:
            raise ValueError("the header has no end")
        return None

    def block(self, length: int) -> bytes:
        return self.file.read(length)

    def skip(self, head: bytes, length: int) -> None:
        self.at = self.file.tell() + length

    def passed(self, length: int) -> None:
        self.at = self.file.tell()


class _Members:
    """The same over gzip members, one for each record."""

    PIECE = 1 << 14

    def __init__(self, file: io.BufferedReader):
        self.file, self.at, self.length = file, 0, None
        self.skipped = self.inflated = 0

    def head(self) -> bytes | None:
        self.file.seek(self.at)
        start = self.file.read(24)
        if not start:
            return None
        if start[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        self.length = struct.unpack("<Q", start[16:24])[0] if len(start) == 24 and start[3] & 4 and start[12:16] == _EXTRA + b"\x08\x00" else None
        self.pack, self.raw = zlib.decompressobj(31), b""
        self._feed(start)
        while (end := self.raw.find(b"\r\n\r\n")) < 0 and self._more():
            pass
        if end < 0:
            raise ValueError("the header has no end")
        self.from_ = end + 4
        return self.raw[: end + 2]

    def _feed(self, piece: bytes) -> None:
        self.raw += self.pack.decompress(piece)

    def _more(self) -> bool:
        if self.pack.eof:
            return False
        if not (piece := self.file.read(self.PIECE)):
            raise ValueError("the gzip member has no end")
        self._feed(piece)
        return True

    def block(self, length: int) -> bytes:
        parts, have = [self.raw[self.from_ :]], len(self.raw) - self.from_
        while have < length and not self.pack.eof:
            self.raw = b""
            self._more()
            parts.append(self.raw)
            have += len(self.raw)
        self.raw, self.from_ = b"", 0
        return b"".join(parts)[:length]

    def passed(self, length: int) -> None:
        self.inflated += 1
        while not self.pack.eof:
            self.raw = b""
            self._more()
        self.at = self.file.tell() - len(self.pack.unused_data)

    def skip(self, head: bytes, length: int) -> None:
        if self.length:
            self.at += self.length
            self.skipped += 1
        else:
            self.passed(length)


def parse(head: bytes) -> dict[str, str]:
    """Header fields by name as written; folded lines are joined."""
    first, *lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines() or [""]
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}


def _value(column: str, fields: dict[str, str]) -> object:
    if column == "content_length":
        return int(fields.get("content-length", 0))
    return fields.get(_HEADERS[column].lower())


_TESTS: dict[type, Callable[[object, Filter], bool | None]] = {
    EqualTo: lambda v, f: v == f.value, EqualNullSafe: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value, StringStartsWith: lambda v, f: v.startswith(f.value), StringEndsWith: lambda v, f: v.endswith(f.value), StringContains: lambda v, f: f.value in v,
}


def pushable(f: Filter) -> bool:
    """Whether headers alone decide a predicate."""
    if isinstance(f, Not):
        return pushable(f.child)
    if type(f) in (EqualNullSafe, In) and None in (f.value if isinstance(f, In) else [f.value]):
        return False
    return (type(f) in _TESTS or isinstance(f, IsNull | IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in {*_HEADERS, "content_length"}


def holds(f: Filter, fields: dict[str, str]) -> bool | None:
    """A pushable predicate's value on header fields (lower-case names), None for SQL's unknown."""
    if isinstance(f, Not):
        inner = holds(f.child, fields)
        return None if inner is None else not inner
    v = _value(f.attribute[0], fields)
    if isinstance(f, IsNull | IsNotNull):
        return (v is None) == isinstance(f, IsNull)
    if v is None:
        return False if isinstance(f, EqualNullSafe) else None
    return _TESTS[type(f)](v, f)


def records(file: io.BufferedReader, compressed: bool, columns: Sequence[str], wanted: Callable[[dict[str, str]], bool] = lambda fields: True) -> Iterator[dict]:
    """The wanted records of an archive with the named columns; headers are parsed first, blocks read only if asked for."""
    cursor = (_Members if compressed else _Plain)(file)
    block = bool(_BLOCK & {*columns})
    while True:
        try:
            if (head := cursor.head()) is None:
                return
            at, fields = cursor.at, parse(head)
            low = {k.lower(): v for k, v in fields.items()}
            length = int(low.get("content-length", 0))
            row = None
            if wanted(low):
                row = {c: _value(c, low) for c in columns if c in _HEADERS or c == "content_length"} | {"headers": list(fields.items()), "offset": at}
            if row is None or not block:
                cursor.skip(head, length)
            else:
                raw = cursor.block(length)
                if len(raw) < length:
                    raise ValueError("the block is cut off")
                cursor.passed(length)
                http, mark, payload = raw.partition(b"\r\n\r\n") if low.get("content-type", "").replace(" ", "").startswith("application/http") else (b"", b"", raw)
                said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
                row |= {"payload": payload if mark or not http else raw, "http_length": int(said[1]) if said else None}
        except ValueError as e:
            raise ValueError(f"at {cursor.at}: {e}") from e
        if row is not None:
            yield row


@dataclass
class _Files(InputPartition):
    paths: list[str]


def packed(filters: Sequence[Filter]) -> str:
    """Pushable predicates as text."""

    def plain(f: Filter) -> list:
        if not pushable(f):
            raise ValueError(f"headers alone don't decide {f}")
        if isinstance(f, Not):
            return ["Not", plain(f.child)]
        return [type(f).__name__, f.attribute[0], *([list(f.value) if isinstance(f, In) else f.value] if hasattr(f, "value") else [])]

    return json.dumps([plain(f) for f in filters])


def unpacked(text: str) -> list[Filter]:
    kinds = {t.__name__: t for t in (*_TESTS, IsNull, IsNotNull)}

    def build(f: list) -> Filter:
        if f[0] == "Not":
            return Not(build(f[1]))
        return kinds[f[0]]((f[1],), *(tuple(v) if isinstance(v, list) else v for v in f[2:]))

    return [build(f) for f in json.loads(text)]


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns, self.path = schema.names, options["path"]
        self.target = int(options.get("partition_bytes", PARTITION_BYTES))
        self.filters = unpacked(options.get("where", "[]"))

    def partitions(self) -> Sequence[InputPartition]:
        out: list[_Files] = []
        room = 0
        for path, size in files(self.path):
            if not out or size > room:
                out.append(_Files([]))
                room = self.target
            out[-1].paths.append(path)
            room -= size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        wanted = lambda fields: all(holds(f, fields) for f in self.filters)
        schema = pa.schema([(c, _ARROW.get(c, pa.string())) for c in self.columns])
        rows, held = [], 0
        for path in partition.paths:
            system, inner = _system(path)
            with system.open_input_file(inner) as raw, io.BufferedReader(raw, 1 << 20) as file:
                try:
                    for row in records(file, file.peek(2)[:2] == b"\x1f\x8b", self.columns, wanted):
                        rows.append({c: path if c == "file" else row.get(c) for c in self.columns})
                        held += len(row.get("payload") or b"")
                        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                except ValueError as e:
                    raise ValueError(f"{path} {e}") from e
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class _PushingReader(_Reader):
    """Also takes the predicates of a query."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f


def files(path: str) -> list[tuple[str, int]]:
    """Archives of a folder and their sizes: the manifest's, else all; a file is its own."""
    system, inner = _system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if system.get_file_info(posixpath.join(inner, MANIFEST)).type == fs.FileType.File:
        with system.open_input_stream(posixpath.join(inner, MANIFEST)) as f:
            return [(posixpath.join(path, name), size) for name, size in json.loads(f.read())]
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted((posixpath.join(path, i.base_name), i.size) for i in found if i.type == fs.FileType.File and re.search(r"^[^._].*\.warc(\.gz)?$", i.base_name))


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level = None if options.get("compression", "gzip") == "none" else int(options.get("level", 6))
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, inner = _system(self.path)
        system.create_dir(inner, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        done: list[tuple[str, int]] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    raw = record(batch.slice(i, 1).to_pylist()[0], self.level)
                    if out is not None and size + len(raw) > self.file_bytes:
                        out.close()
                        out, done[-1] = None, (done[-1][0], size)
                    if out is None:
                        done.append((f"{name}-{len(done)}.warc{'' if self.level is None else '.gz'}", 0))
                        out, size = system.open_output_stream(posixpath.join(inner, done[-1][0]), compression=None), 0
                    out.write(raw)
                    size += len(raw)
        finally:
            if out is not None:
                out.close()
        if done:
            done[-1] = (done[-1][0], size)
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        system, inner = _system(self.path)
        system.create_dir(inner, recursive=True)
        before = [] if self.overwrite else [(posixpath.basename(p), n) for p, n in self._earlier()]
        kept = sorted([*before, *(f for m in messages if m for f in m.files)])
        with system.open_output_stream(posixpath.join(inner, MANIFEST)) as f:
            f.write(json.dumps(kept).encode())
        names = {n for n, _ in kept}
        for i in system.get_file_info(fs.FileSelector(inner)):
            if i.base_name.startswith("part-") and i.base_name not in names:
                system.delete_file(i.path)

    def _earlier(self) -> list[tuple[str, int]]:
        """What an append adds to: the manifest's files, not those this write has just made."""
        system, inner = _system(self.path)
        return files(self.path) if system.get_file_info(posixpath.join(inner, MANIFEST)).type == fs.FileType.File else []

    def abort(self, messages: list[_Written | None]) -> None:
        system, inner = _system(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                system.delete_file(posixpath.join(inner, name))


class WarcSource(DataSource):
    """``format("warc")``; options path, partition_bytes, where, pushdown, and for writes compression (gzip or none), level, file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> _Reader:
        return (_PushingReader if self.options.get("pushdown") == "true" else _Reader)(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known, and let sources take predicates where they ask for them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, columns: Sequence[str] = (), where: Sequence[Filter] = (), **options: str) -> DataFrame:
    """Records of an archive or a folder of them: the named columns, by default all but those that need a record's block.

    ``where`` are predicates of pyspark.sql.datasource on header columns, all of which must hold.
    """
    register(spark)
    kinds = dict(c.split(" ", 1) for c in SCHEMA.split(", "))
    columns = columns or [c for c in kinds if c not in _BLOCK]
    return spark.read.format("warc").options(where=packed(where), **options).schema(", ".join(f"{c} {kinds[c]}" for c in columns)).load(path)


def write(records: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    """Write records (columns of ``SCHEMA``, as many as there are) as archives."""
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode(mode).save(path)


def _urn(page: str) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(">"))


def _page(urn: str) -> F.Column:
    return F.nullif(F.regexp_extract(urn, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")


def page_records(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """A record for each page: its first payload as a response, equal ones of ``least_bytes`` or more as revisits.

    A revisit has no payload; its digest and HTTP header tell those of the page it refers to.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "http_length": F.octet_length("payload").cast("long")})
    rows = common.with_least(rows.withColumn("key", F.when(F.col("http_length") >= least_bytes, F.col("digest"))), "key", "page_id", "first")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), _urn("page_id").alias("record_id"), "target_uri", F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, _urn("first")).alias("refers_to"), F.when(again, F.map_from_arrays(F.array(F.lit("WARC-Profile")), F.array(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).alias("headers"),
        "http_length", F.when(~again, F.col("payload")).alias("payload"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the pages of an archive.

    Responses are measured on their payload; of revisits only headers are wanted, and the
    HTTP header in their block.
    """
    responses = read(spark, path, ["record_type", "record_id", "payload"], [EqualTo(("record_type",), "response")])
    revisits = read(spark, path, ["record_type", "record_id", "payload_digest", "refers_to", "http_length"], [EqualTo(("record_type",), "revisit")])
    first = responses.select(_page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = revisits.select(_page("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", _page("refers_to").alias("refers_to"))
    return first.unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(page_records(common.table(spark, sf_dir, "pages")), path)
    return read_pages(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_warc": query}
ORACLES: dict[str, str] = {
    "op13_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT page_id, payload, CASE WHEN octet_length(payload) >= 100 THEN min(page_id) OVER (PARTITION BY payload) ELSE page_id END AS earliest FROM p)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest,
  CASE WHEN earliest IS NULL OR page_id IS NOT DISTINCT FROM earliest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM earliest THEN earliest END AS refers_to FROM f
"""
}
