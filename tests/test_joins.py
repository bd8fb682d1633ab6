import random

import pytest
from pyspark.sql import functions as F

from careflow.operators.joins import is_small, join_many, join_unique, key_summary
from tests.conftest import rows


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(2)
    many = [(i, None if i % 11 == 0 else 0 if rng.random() < 0.34 else rng.randrange(30), "g") for i in range(400)]
    left = spark.createDataFrame(many, "i int, k int, g string").repartition(4)
    right = spark.createDataFrame([(k, "g", k * 10) for k in range(0, 30, 2)], "k int, g string, v int")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "hot_rows": 20}])
def test_equals_a_plain_join(spark, sides, how, limits):
    left, right = sides
    got = join_unique(left, right, ["k", "g"], how, **limits)
    plain = left.join(right, ["k", "g"], how)
    columns = ["i", "k", "g", *(["v"] if how in ("inner", "left") else [])]
    assert got.columns == columns
    assert rows(got) == rows(plain, *columns)


def test_hot_keys_are_joined_apart(spark, sides):
    left, right = sides
    text = join_unique(left, right.drop("g"), ["k"], "left", broadcast_bytes=0, hot_rows=20)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in text and "Union" in text


@pytest.mark.parametrize("broadcast_bytes", [0, 100_000])
def test_key_summary(spark, sides, broadcast_bytes):
    left, right = sides
    got = key_summary(left, right, ["k"], F.count(F.lit(1)).alias("n"), broadcast_bytes=broadcast_bytes)
    expected = left.join(right.select("k"), "k").groupBy("k").count()
    assert rows(got) == rows(expected)
    keys = key_summary(left, right, ["k"], broadcast_bytes=broadcast_bytes)
    assert rows(keys) == rows(expected, "k")


def test_join_many_is_a_left_join(spark, sides):
    left, right = sides
    one = right.drop("g").unionByName(spark.createDataFrame([(77, 1)], "k int, v int"))
    got = join_many(one, left, ["k"])
    assert rows(got, "k", "v", "i") == rows(one.join(left, "k", "left"), "k", "v", "i")


def test_is_small(spark):
    assert is_small(spark.range(5), 5 * 24) and not is_small(spark.range(6), 5 * 24)
    texts = spark.createDataFrame([("x" * 1000, ("y" * 500, [1, 2]))], "t string, s struct<u: string, a: array<long>>")
    assert not is_small(texts, 1500) and is_small(texts, 2000) and is_small(texts.limit(0), 0)


def test_measuring_moves_one_row_per_task(spark):
    plan = spark.range(100).agg(F.sum(F.lit(8)))._jdf.queryExecution().toString()
    assert "Limit" not in plan
