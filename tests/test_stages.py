"""Running totals and maxima over partitions of any cut."""

import random

import pytest

from cairn.plans.stages import ranked, running_totals
from pyspark.sql import functions as F


@pytest.mark.parametrize("largest", [False, True])
def test_running(spark, largest):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", "b", None]), n, rng.randrange(-1, 50)) for n in range(500)] + [("z", 0, -1)]
    df = spark.createDataFrame(rows, "g string, n long, v long").repartition(5)
    order = [F.col("g").asc_nulls_last(), F.col("n").asc()]
    got = {(r.g, r.n): r.out for r in running_totals(df, ["g"], order, "v", "out", largest).collect()}
    want, so_far = {}, {}
    for g, n, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])):
        so_far[g] = (max if largest else lambda a, b: a + b)(so_far[g], v) if g in so_far else v
        want[g, n] = so_far[g]
    assert got == want


def test_ranks_of_nothing(spark):
    assert ranked(spark.createDataFrame([], "a long"), [F.col("a").asc()], "r").count() == 0
