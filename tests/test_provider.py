"""Grids of a caller's own object."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from transcurve.plans.fit import Fitter
from transcurve.settings import Settings
from transcurve.sources.grids import SchemaError
from transcurve.sources.provider import provide
from transcurve.spec import StatusFamily


class Numbers:
    """Rows by arithmetic: part p has the ids p * size up to (p + 1) * size."""

    def __init__(self, count, size):
        self.count, self.size = count, size

    def schema(self):
        return "id long, x double, status string, next_status string, tags array<string>"

    def parts(self):
        return self.count

    def read(self, part, columns):
        ids = np.arange(part * self.size, (part + 1) * self.size)
        made = {"id": ids, "x": np.sqrt(ids), "status": ["F"] * len(ids), "next_status": ["O" if i % 5 == 0 else "F" for i in ids], "tags": [["a", None]] * len(ids)}
        if "wrong" in self.__dict__:
            made["x"] = made["x"][:-1]
        return {c: made[c] for c in columns}  # no more than was asked for


def test_parts_are_tasks(spark):
    df = provide(spark, Numbers(5, 12_000), ["x"], "status", "next_status")
    assert df.rdd.getNumPartitions() == 5 and df.count() == 60_000
    assert df.agg(F.sum("id"), F.countDistinct("id")).first()[:] == (60_000 * 59_999 // 2, 60_000)
    assert df.where("id = 17").select("x", "tags").first()[:] == (math.sqrt(17), ["a", None])
    assert provide(spark, Numbers(2, 10), columns=["id"]).columns == ["id"]
    assert provide(spark, Numbers(0, 10), ["x"]).count() == 0


def test_a_fit_over_a_provider(spark):
    fitter = Fitter(provide(spark, Numbers(3, 1000), ["x"], "status", "next_status"), StatusFamily(("F", "O")), "F", "status", "next_status", ["x"], Settings(block_groups=4))
    assert fitter.chain.model.betas[1][0] == pytest.approx(math.log(0.2 / 0.8))
    fitter.close()


def test_wrong_grids_are_told(spark):
    with pytest.raises(SchemaError):
        provide(spark, Numbers(1, 1), ["status"])
    with pytest.raises(SchemaError):
        provide(spark, Numbers(1, 1), columns=["none"])
    broken = Numbers(1, 3)
    broken.wrong = True
    with pytest.raises(Exception, match="unequal length"):
        provide(spark, broken).collect()
