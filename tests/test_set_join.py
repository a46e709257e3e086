"""Similar sets against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from factgraph.operators import set_join


def sets(seed, n):
    rng = random.Random(seed)
    return [(i, [rng.choice("abc") if rng.random() < 0.4 else f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 9))]) for i in range(n)]


@pytest.mark.parametrize("least", [0.28, 0.5, 0.8, 1.0])
def test_no_pair_is_lost(spark, least):
    left, right = sets(1, 120), sets(2, 150)
    a, b = (spark.createDataFrame(x, "id int, members array<string>") for x in (left, right))
    got = sorted(map(tuple, set_join.similar(a, b, least).collect()))
    want = sorted((i, j, s) for i, x in left for j, y in right if x and y and (s := round(len({*x} & {*y}) / len({*x} | {*y}), 6)) >= least)
    assert [g[:2] for g in got] == [w[:2] for w in want] and got == want
    met = sum(bool({*x} & {*y}) for _, x in left for _, y in right)
    assert set_join.candidates(a, b, least).count() < met * (1.0 if least < 0.5 else 0.6)


def test_empty_sides(spark):
    some, none = spark.createDataFrame([(1, ["a"]), (2, None)], "id int, members array<string>"), spark.createDataFrame([], "id int, members array<string>")
    assert set_join.similar(some, none, 0.5).collect() == [] and [tuple(r) for r in set_join.similar(some, some, 0.5).select("a_id", "b_id", F.col("score")).collect()] == [(1, 1, 1.0)]
