"""Archives: round trips, predicates that are pushed down, foreign and broken files."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, In, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith

from tests.conftest import SF
from transcurve.llm import common, warc

PAGES = "page_id long, url string, html string, key string, first int, payload string"
LONG = "the payload that stands here is at least a hundred bytes long, so it may be revisited by others äöü ...."


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], PAGES).repartition(3)


def plain(rows):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        first = min(same, default=None) if len(raw) >= 100 else i
        again = first is not None and i != first
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (None, "http://a/3", LONG), (2, "http://a/2", LONG), (1, "http://a/1", LONG), (3, None, None), (4, "http://a/\r\nWARC-Type: evil", ""), (5, "u", "short"), (6, "u", "short"), (-7, "u", LONG + "x")]
ROWS += [(None, "u", LONG + "y"), (8, "u", LONG + "\r\n\r\nWARC/1.1\r\n\r\n"), (9, "u", "z" * 3_000_000), (10, "u", "z" * 3_000_000), (11, "u", "x" * 99), (12, "u", "x" * 99), (13, "u", "ä" * 50), (14, "u", "ä" * 50)]


@pytest.mark.parametrize("options", [{}, {"compression": "none"}, {"file_bytes": "500", "level": "1"}])
def test_round_trip(spark, tmp_path, options):
    path = f"file://{tmp_path}/a"
    warc.write(warc.page_records(pages(spark, ROWS)), path, **options)
    assert sorted([tuple(r) for r in warc.read_pages(spark, path).collect()], key=str) == plain(ROWS)
    assert warc.read(spark, path).count() == len(ROWS)
    names = [n for n, _ in warc.files(path)]
    assert all(n.endswith(".warc" if options.get("compression") else ".warc.gz") for n in names) and (len(names) > 10) == ("file_bytes" in options)
    # an append keeps what is there, an overwrite doesn't; files of a lost attempt don't count and go
    (tmp_path / "a" / "part-00000-lost-0.warc").write_bytes(b"rubbish")
    warc.write(warc.page_records(pages(spark, ROWS[:2])), path, "append", **options)
    assert warc.read(spark, path).count() == len(ROWS) + 2 and not (tmp_path / "a" / "part-00000-lost-0.warc").exists()
    warc.write(warc.page_records(pages(spark, ROWS[:2])), path, **options)
    assert warc.read(spark, path).count() == 2


def test_frequent_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "FREQUENT", 4)
    rows = [(i, "u", LONG if i % 2 else LONG + str(i // 4)) for i in range(50, 0, -1)]
    warc.write(warc.page_records(pages(spark, rows)), f"{tmp_path}/a")
    assert sorted([tuple(r) for r in warc.read_pages(spark, f"{tmp_path}/a").collect()], key=str) == plain(rows)


def test_no_pages(spark, tmp_path):
    warc.write(warc.page_records(pages(spark, ROWS).limit(0)), f"{tmp_path}/a")
    assert warc.read_pages(spark, f"{tmp_path}/a").count() == 0


def test_the_query_equals_its_sql(spark, duck):
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({warc.ORACLES['op13_warc']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in warc.query(spark, SF).select(*columns).collect())


def test_predicates_are_pushed_and_hold(spark, tmp_path):
    path, columns = f"{tmp_path}/a", ["record_type", "record_id", "target_uri", "refers_to", "content_length"]
    warc.write(warc.page_records(pages(spark, ROWS)), path)
    rows = warc.read(spark, path, columns)
    local = spark.createDataFrame([tuple(r) for r in rows.collect()], rows.schema)
    tests = ["record_type = 'revisit'", "record_type <> 'revisit'", "target_uri like 'http://a/%'", "target_uri like '%2'", "target_uri like '%a/%'", "target_uri is null", "refers_to is not null", "content_length > 150"]
    tests += ["record_type in ('revisit', 'x')", "not (target_uri = 'u')", "target_uri <=> null", "record_type = 'revisit' and target_uri = 'http://a/2'", "length(target_uri) = 1"]
    filtered = lambda df: "Filter " in df._jdf.queryExecution().executedPlan().toString()
    for test in tests:
        want = sorted(map(str, local.where(test).collect()))
        pushed = warc.read(spark, path, columns, pushdown="true").where(test)  # a load for each query
        assert sorted(map(str, pushed.collect())) == want and filtered(pushed) == test.startswith("length"), test
        assert sorted(map(str, rows.where(test).collect())) == want and rows.count() == len(ROWS), test  # one frame, many queries
    where = [EqualTo(("record_type",), "revisit"), Not(StringContains(("target_uri",), "a/2")), In(("record_type",), ("revisit", "x")), IsNotNull(("refers_to",))]
    given = warc.read(spark, path, columns, where)
    assert sorted(map(str, given.collect())) == sorted(map(str, local.where("record_type = 'revisit' and target_uri not like '%a/2%'").collect()))
    assert given.where("target_uri = 'u'").unionByName(given).count() == given.where("target_uri = 'u'").count() + given.count()
    with pytest.raises(ValueError):
        warc.read(spark, path, where=[EqualTo(("payload",), b"x")])


def test_predicates_on_headers():
    fields = {"warc-type": "response", "content-length": "12"}
    cases = [
        (EqualTo(("record_type",), "response"), True), (In(("record_type",), ("a", "response")), True), (EqualTo(("target_uri",), "x"), None), (EqualNullSafe(("target_uri",), "x"), False), (IsNull(("target_uri",)), True),
        (IsNotNull(("record_type",)), True), (Not(EqualTo(("target_uri",), "x")), None), (Not(EqualTo(("record_type",), "x")), True), (GreaterThan(("content_length",), 11), True), (StringStartsWith(("record_type",), "resp"), True),
        (StringEndsWith(("record_type",), "x"), False), (StringContains(("record_type",), "pon"), True),
    ]
    for f, want in cases:
        assert warc.pushable(f) and warc.holds(f, fields) is want, f
    assert not warc.pushable(EqualTo(("payload",), b"x")) and not warc.pushable(EqualTo(("headers", "x"), "y")) and not warc.pushable(In(("record_type",), ("a", None)))


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    data = b"".join(warc.record({"record_type": t, "record_id": str(i), "payload": bytes(100_000)}) for i, t in enumerate(["response", "revisit", "response"] * 5))
    made = []
    new = warc._Members.__init__
    monkeypatch.setattr(warc._Members, "__init__", lambda self, file: (new(self, file), made.append(self))[0])
    rows = list(warc.records(io.BufferedReader(io.BytesIO(data)), True, ["record_id", "payload"], lambda f: f["warc-type"] == "revisit"))
    assert [r["record_id"] for r in rows] == ["1", "4", "7", "10", "13"] and (made[0].inflated, made[0].skipped) == (5, 10)
    assert len(list(warc.records(io.BufferedReader(io.BytesIO(data)), True, ["record_id"]))) == 15 and made[1].inflated == 0


FOREIGN = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n" + b"WARC/1.0\nwarc-type: resource\nX-Long: a\n b\nContent-Type: text/plain\nContent-Length: 4\n\nbody\r\n\r\n"


@pytest.mark.parametrize("name", ["x.warc", "x.warc.gz"])
def test_foreign_archives(spark, tmp_path, name):
    # members without a length of their own are inflated past; bare line feeds end header lines in plain files
    one, two = FOREIGN[: FOREIGN.index(b"WARC/1.0\nw")], FOREIGN[FOREIGN.index(b"WARC/1.0\nw") :].replace(b"\n", b"\r\n").replace(b"\r\r", b"\r")
    (tmp_path / name).write_bytes(FOREIGN if name == "x.warc" else gzip.compress(one) + gzip.compress(two))
    (tmp_path / "notes.txt").write_text("no archive")
    for path in (tmp_path, tmp_path / name):
        rows = warc.read(spark, str(path), ["record_type", "headers", "payload"]).collect()
        assert [(r.record_type, bytes(r.payload)) for r in rows] == [("warcinfo", b"a:b"), ("resource", b"body")]
        assert rows[1].headers["X-Long"] == "a b"
        assert warc.read(spark, str(path)).where("record_type = 'resource'").count() == 1


@pytest.mark.parametrize("data", [b"rubbish\r\n\r\n", FOREIGN[:20], FOREIGN[:-8], warc.record({"payload": b"x" * 5000})[:-40], warc.record({}) + b"rubbish"])
def test_broken_archives_name_the_place(tmp_path, data):
    with pytest.raises(ValueError, match="at [0-9]+: "):
        list(warc.records(io.BufferedReader(io.BytesIO(data)), data[:2] == b"\x1f\x8b", ["payload"]))


def test_files_are_packed(tmp_path):
    for i in range(7):
        (tmp_path / f"{i}.warc").write_bytes(b"x" * 40)
    from pyspark.sql.types import StructType

    parts = warc._Reader(StructType.fromDDL("record_type string"), {"path": str(tmp_path), "partition_bytes": "100"}).partitions()
    assert [len(p.paths) for p in parts] == [2, 2, 2, 1]


def test_pruned_columns_need_no_block(spark, tmp_path):
    warc.write(warc.page_records(pages(spark, ROWS)), f"{tmp_path}/a")
    assert "payload" not in warc.read(spark, f"{tmp_path}/a").columns
    assert warc.read(spark, f"{tmp_path}/a", ["payload"]).agg(F.sum(F.octet_length("payload"))).first()[0] > 3_000_000
