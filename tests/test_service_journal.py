"""Series served by a local server, and fits that go on after they were killed."""

import http.server
import threading
import urllib.parse
from collections import Counter

import pytest
from pyspark.sql import functions as F

from transcurve.functions.curves import Curve
from transcurve.operators import score
from transcurve.plans.fit import Fitter
from transcurve.plans.journal import Journal
from transcurve.settings import Settings
from transcurve.sources import series_service
from transcurve.sources.economic_series import SeriesError
from transcurve.spec import Entry, Model, StatusFamily

DAYS = {"A": [("2020-01-03", "3"), ("2020-01-01", "1.5"), ("2020-01-02", "."), ("2020-01-03", "3.5")], "B": [("2019-05-05", "-2")], "EMPTY": []}


@pytest.fixture
def service():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            url = urllib.parse.urlsplit(self.path)
            q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
            asked.append((q["series_id"], q.get("observation_start"), q.get("observation_end")))
            key, tries = q["series_id"], sum(a[0] == q["series_id"] for a in asked)
            code, body = 200, ""
            if url.path != "/fred/series/observations" or q.get("api_key") != "k":
                code = 403
            elif key == "BUSY" and tries < 3:
                code = 503
            elif key == "AWAY":
                code = 500
            elif key == "BAD":
                body = '<error code="404" message="it was &lt;deleted&gt;"/>'
            elif key == "CUT" and tries < 2:
                body = "<observations><observ"
            elif key not in DAYS and key not in ("BUSY", "CUT"):
                code = 400
            else:
                rows = [(d, v) for d, v in DAYS.get(key, DAYS["B"]) if q.get("observation_start", "") <= d <= q.get("observation_end", "9999")]
                body = "<observations>" + "".join(f'<observation date="{d}" value="{v}"/>' for d, v in rows) + "</observations>"
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/fred", asked
    server.shutdown()


def read(spark, service, series, **options):
    return series_service.read(spark, service[0], series, **({"api_key": "k", "pause": "0.01", "series_a_task": "2"} | options))


def test_series_are_read_in_parts_and_retried(spark, service):
    df = read(spark, service, ["A", "B", "A", "EMPTY", "BUSY", "CUT"])
    assert df.rdd.getNumPartitions() == 3
    rows = sorted((r.series_id, str(r.date), r.value, r.error) for r in df.collect())
    assert rows == [("A", "2020-01-01", 1.5, None), ("A", "2020-01-03", 3.5, None), ("B", "2019-05-05", -2.0, None), ("BUSY", "2019-05-05", -2.0, None), ("CUT", "2019-05-05", -2.0, None)]
    assert Counter(a[0] for a in service[1])["BUSY"] == 3 and Counter(a[0] for a in service[1])["CUT"] == 2
    assert read(spark, service, []).count() == 0


def test_failures_are_told_and_remembered(spark, service, tmp_path):
    df = read(spark, service, ["A", "NONE", "BAD"], errors="row", cache=str(tmp_path))
    for _ in range(2):
        rows = {(r.series_id, r.error) for r in df.collect()}
        assert rows == {("A", None), ("NONE", "NONE: 400 no such series"), ("BAD", "BAD: 404 it was <deleted>")}
    assert Counter(a[0] for a in service[1]) == {"A": 1, "NONE": 1, "BAD": 1}  # what was found, or wasn't there, isn't asked for again
    with pytest.raises(Exception, match="no such series"):
        read(spark, service, ["NONE"], cache=str(tmp_path)).collect()
    with pytest.raises(Exception, match="the service answers 500"):  # that may pass: it's not remembered
        read(spark, service, ["AWAY"], cache=str(tmp_path), attempts="2").collect()
    with pytest.raises(Exception, match="the service answers 403"):
        read(spark, service, ["A"], api_key="wrong").collect()
    with pytest.raises(SeriesError):
        series_service.Service(service[0], "k").fetch("NONE")


def test_predicates_reach_the_service(spark, service):
    days = read(spark, service, ["A", "B", "EMPTY"], pushdown="true").where("series_id in ('A', 'EMPTY') and date > '2020-01-01' and date <= '2020-02-01'")
    assert "Filter " not in days._jdf.queryExecution().executedPlan().toString()
    assert [(r.series_id, str(r.date), r.value) for r in days.collect()] == [("A", "2020-01-03", 3.5)]
    assert set(service[1]) == {("A", "2020-01-02", "2020-02-01"), ("EMPTY", "2020-01-02", "2020-02-01")}
    assert read(spark, service, ["A"], pushdown="true").where("date > '2020-01-01' and date < '2020-01-02'").count() == 0
    kept = read(spark, service, ["A", "B"], pushdown="true").where(F.col("value") > 0)  # Spark's own
    assert kept.count() == 2
    given = read(spark, service, ["A", "B"], start="2020-01-02", end="2020-12-31")
    assert given.count() == 1 and given.where("series_id = 'B'").count() == 0 and given.count() == 1


# -- journals
FAMILY = StatusFamily.simple(["C", "P", "D"])
TRUE = Model.create(FAMILY, "C").with_betas([[0.0], [-1.0], [-2.0]]).add_entry(Entry((("y", Curve("LOGISTIC", (0.5, 2.0))),), 1), 1.5)


class Killed(RuntimeError):
    pass


def test_a_killed_fit_ends_at_the_same_model(spark, tmp_path, monkeypatch):
    df = score.sample(spark.range(6000).selectExpr("id", "rand(1) x", "randn(2) y", "'C' status"), TRUE, 5, "id", "nxt").cache()

    def run(journal):
        fitter = Fitter(df, FAMILY, "C", "status", "nxt", ["x", "y"], Settings(polish_start_points=3), journal=journal)
        try:
            fitter.fit(["x"], ["y"], 3)
            return fitter
        finally:
            fitter.close()

    whole = run(None)
    path = str(tmp_path / "journal")
    ask = Journal.point
    for lost_at in (2, 5):  # the driver is lost twice, the second time later
        monkeypatch.setattr(Journal, "point", lambda self, *a, at=lost_at: (_ for _ in ()).throw(Killed()) if self.at == at else ask(self, *a))
        with pytest.raises(Killed):
            run(path)
    monkeypatch.setattr(Journal, "point", ask)
    last = run(path)
    assert last.journal.replayed == 5 < last.journal.at
    assert [(r.name, r.model) for r in last.chain.results] == [(r.name, r.model) for r in whole.chain.results] and last.chain.last.entropy == pytest.approx(whole.chain.last.entropy, abs=1e-12)
    again = run(path)
    assert again.journal.replayed == again.journal.at and again.chain.model == whole.chain.model


def test_other_questions_begin_anew(spark, tmp_path):
    from transcurve.operators.evaluate import evaluate

    rows = spark.createDataFrame([(0.0, 0), (1.0, 1)], "x double, next_offset int")
    path, m = str(tmp_path / "j"), Model.create(FAMILY, "C")
    first = Journal(spark, path)
    points = [first.point("judge", x, 0, lambda x=x: evaluate(rows, x)) for x in (m, m.add_beta("x"))]
    assert first.point("none", m, 0, lambda: None) is None
    second = Journal(spark, path)
    assert second.point("judge", m, 0, lambda: 1 / 0).entropy == points[0].entropy
    assert second.point("other", m, 0, lambda: points[1]) is points[1] and second.replayed == 1
    assert second.point("none", m, 0, lambda: None) is None and second.replayed == 1  # what came after isn't believed
    third = Journal(spark, path)
    assert third.point("judge", m, 0, lambda: 1 / 0).n == 2 and third.point("other", m, 0, lambda: 1 / 0).model == points[1].model
