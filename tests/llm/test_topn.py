"""The highest rows of every group against sorting in Python."""

import random

import pytest
from pyspark.sql import functions as F

from moraine.llm.topn import top_n


def brute(rows, n):
    out = set()
    for g in {r[0] for r in rows if r[0] is not None}:
        own = sorted({r for r in rows if r[0] == g and r[1] is not None}, key=lambda r: (-r[1], r[2], r[3]))
        out |= {(g, r[3], i + 1) for i, r in enumerate(own[:n])}
    return out


def run(spark, rows, n, **more):
    df = spark.createDataFrame(rows, "g string, s bigint, t int, id bigint")
    got = top_n(df, "g", "s", [F.col("t").asc(), F.col("id").asc()], n, ["t", "id"], **more)
    return [(r["g"], r["id"], r["place"]) for r in got.collect()]


@pytest.mark.parametrize("shares", [(0.98, 0.85), (0.5,), (0.9, 0.6, 0.3), ()])
def test_against_sorting(spark, shares):
    rng = random.Random(3)
    rows = [(f"g{min(int(rng.expovariate(0.1)), 60)}", rng.choice([1, 1, 1, 2, 3, 9, 40, 400]), rng.randint(0, 3), i) for i in range(3000)]
    rows += rng.sample(rows, 200)  # delivered twice
    got = run(spark, rows, 5, shares=shares)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5)


def test_one_group_of_equal_scores(spark):
    rows = [("hot", 7, 0, i) for i in range(5000)] + [("cold", 1, 0, 9000)]
    assert set(run(spark, rows, 3)) == {("hot", 0, 1), ("hot", 1, 2), ("hot", 2, 3), ("cold", 9000, 1)}


def test_nulls_empty_and_few(spark):
    assert run(spark, [], 5) == []
    assert set(run(spark, [(None, 3, 0, 1), ("a", None, 0, 2), ("a", 1, 0, 3), ("a", 1, 0, 3)], 5)) == {("a", 3, 1)}


def test_clashing_columns_are_ignored(spark):
    df = spark.createDataFrame([("a", 1, 0, 5, 9, 9)], "g string, s bigint, t int, id bigint, place int, taken int")
    got = top_n(df, "g", "s", [F.col("t"), F.col("id")], 1, ["t", "id"]).collect()
    assert [(r["g"], r["id"], r["place"]) for r in got] == [("a", 5, 1)]


def test_one_row_delivered_very_often(spark):
    """A third and more of all rows are one row: it is one row on each task before any shuffle."""
    rows = [("hot", 9, 0, 1)] * 20_000 + [("hot", 8, 0, 2), ("hot", 8, 0, 3), ("cold", 1, 0, 9)]
    assert set(run(spark, rows, 2)) == {("hot", 1, 1), ("hot", 2, 2), ("cold", 9, 1)}
