import pytest

import __spark_entry__
from tests.conftest import SF
from transcurve import queries
from transcurve.sources import economic_series


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_the_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", ["visualizer_theoretical", "qq_residuals", "sampled_statuses", "tic_criterion", "param_stddev", "interpolate_cubic"])
def test_rows_only(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_observations(spark, tmp_path):
    """Missing values go, and of repeated dates the last wins."""
    found = [("2020-02-01", "."), ("2020-03-01", "2.5"), ("2020-01-01", "1.25"), ("2020-03-01", "2.75")]
    (tmp_path / "x.xml").write_text("<observations>\n" + "".join(f'<observation realtime_start="2024-01-01" date="{d}" value="{v}"/>\n' for d, v in found) + "</observations>")
    rows = [(str(r.date), r.value) for r in economic_series.observations(spark, str(tmp_path / "x.xml")).collect()]
    assert rows == [("2020-01-01", 1.25), ("2020-03-01", 2.75)]
