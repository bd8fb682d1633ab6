import random
from itertools import accumulate

from pyspark.sql import functions as F

from careflow.operators import ordered
from tests.conftest import rows


def skewed(spark, seed, n=600):
    """A third of the rows belongs to one key."""
    rng = random.Random(seed)
    data = [(0 if rng.random() < 0.34 else rng.randrange(1, 40), i, rng.randrange(-9, 10)) for i in range(n)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k int, t int, amount bigint").repartition(4)


def test_running_sum_in_blocks_equals_window(spark):
    data, df = skewed(spark, 1)
    sums, expected = {}, []
    for k, t, a in sorted(data):
        sums[k] = sums.get(k, 0) + a
        expected.append((k, t, a, sums[k]))
    small = ordered.running_sum(df, ["k"], ["t"], "amount", "s")
    assert rows(small) == expected
    for hot_rows in (0, 50):
        cut = ordered.running_sum(df, ["k"], ["t"], "amount", "s", hot_rows=hot_rows, blocks=7)
        assert rows(cut) == expected


def test_one_key_over_all_blocks(spark):
    df = spark.range(500).select(F.lit("a").alias("k"), "id", F.lit(2).cast("bigint").alias("x"))
    cut = ordered.running_sum(df, ["k"], ["id"], "x", "s", hot_rows=0, blocks=5)
    assert [r[0] for r in rows(cut, "s")] == list(accumulate([2] * 500))
    assert rows(ordered.hot_keys(df, ["k"], 499)) == [("a",)]
    assert ordered.hot_keys(df, ["k"], 500).isEmpty()


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, i, 1) for i in range(40)] + [(1, i, 1) for i in range(40)], "k int, t int, x bigint")
    cut = ordered.running_sum(df, ["k"], ["t"], "x", "s", hot_rows=0, blocks=4)
    assert max(r[0] for r in rows(cut.where("k is null"), "s")) == 40


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(5)
    got = rows(ordered.number_rows(df, ["v"], "n", start=10, blocks=6), "v", "n")
    assert got == [(i, i + 11) for i in range(1000)]
    assert ordered.number_rows(df.where("v < 0"), ["v"], "n").count() == 0


def test_first_and_last_wins(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), (None, 1, "p"), (None, 2, None)], "k string, t int, v string"
    )
    assert rows(ordered.first_wins(df, ["k"], ["t"])) == [(None, 1, "p"), ("a", 1, "x")]
    assert rows(ordered.last_wins(df, ["k"], ["t"])) == [(None, 2, None), ("a", 3, "z")]
