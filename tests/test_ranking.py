"""The range-partitioned ranks and percentiles against brute force."""

import random

import numpy as np
import pytest

from cinderbook.operators.ranking import distributed_percentiles, with_global_rank, with_percentiles


def brute(values, descending):
    known = [v for v in values if v is not None]
    nulls = len(values) - len(known)
    n = len(values)
    result = []
    for v in values:
        below = len(known) if v is None else sum(x < v for x in known)
        ties = nulls if v is None else sum(x == v for x in known)
        rank = 1 + (n - below - ties if descending else below)
        result.append((rank, below / (n - 1) if n > 1 else 0.0))
    return result


def sets():
    rng = random.Random(5)
    hot = [7.5] * 700 + [rng.uniform(0, 100) for _ in range(1300)]
    return {
        "hot value": hot,
        "few values": [float(rng.randint(0, 3)) for _ in range(500)],
        "distinct": [float(i) for i in range(997)],
        "with nulls": [None] * 40 + [float(rng.randint(0, 50)) for _ in range(400)],
        "only nulls": [None] * 5,
        "one row": [3.0],
        "all equal": [1.0] * 300,
        "negative": [rng.gauss(0, 10) for _ in range(800)],
    }


@pytest.mark.parametrize("name", list(sets()))
@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("partitioned", [True, False])
def test_ranks(spark, name, descending, partitioned):
    values = sets()[name]
    df = spark.createDataFrame(list(enumerate(values)), "id INT, v DOUBLE").repartition(5)
    ranked = with_global_rank(
        df, "v", rank="r", descending=descending, percent_rank="p", total="n", partitioned=partitioned
    )
    got = {row.id: (row.r, row.p, row.n) for row in ranked.collect()}
    assert len(got) == len(values)
    for i, (rank, share) in enumerate(brute(values, descending)):
        assert got[i][0] == rank and got[i][1] == pytest.approx(share) and got[i][2] == len(values)


def test_ranks_of_decimals(spark):
    df = spark.range(300).selectExpr("id", "CAST(id % 100 AS DECIMAL(20,4)) / 4 AS v")
    plain = {r.id: r.r for r in with_global_rank(df, "v", rank="r").collect()}
    spread = {r.id: r.r for r in with_global_rank(df, "v", rank="r", partitioned=True).collect()}
    assert plain == spread


def test_no_rows(spark):
    df = spark.createDataFrame([], "id INT, v DOUBLE")
    assert with_global_rank(df, "v", rank="r").count() == 0
    assert distributed_percentiles(df, "v", [0.5]) == [None]


@pytest.mark.parametrize("name", ["hot value", "few values", "distinct", "with nulls", "one row", "negative"])
def test_percentiles(spark, name):
    values = sets()[name]
    df = spark.createDataFrame(list(enumerate(values)), "id INT, v DOUBLE").repartition(5)
    fractions = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    expected = np.percentile([v for v in values if v is not None], [100 * f for f in fractions])
    for partitioned in (True, False):
        got = with_percentiles(df, "v", fractions, "q", partitioned=partitioned).first().q
        assert got == pytest.approx(list(expected))
