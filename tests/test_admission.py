import random
from datetime import date

import pytest

from careflow.operators import admission
from careflow.operators.admission import admit_first_come
from careflow.plans import schedule
from tests.conftest import rows

RULES = {"a": ["g", "x"], "b": ["g", "y"]}


def brute(requests, taken):
    used = {"a": {(g, x) for g, x, _ in taken}, "b": {(g, y) for g, _, y in taken}}
    out = []
    for t, g, x, y in sorted(requests):
        keys = {"a": None if x is None else (g, x), "b": None if y is None else (g, y)}
        broken = [n for n, k in keys.items() if k is not None and k in used[n]]
        out.append((t, broken[0] if broken else "accepted"))
        if not broken:
            for n, k in keys.items():
                used[n].add(k)
    return out


@pytest.mark.parametrize("seed,slow_share", [(0, 0.75), (1, 0.0), (2, 0.0), (3, 1.0)])
def test_equals_brute_force(spark, seed, slow_share, monkeypatch):
    monkeypatch.setattr(admission, "SLOW_SHARE", slow_share)
    rng = random.Random(seed)

    def key(n):
        # One key is asked for by a third of the rows, some keys are NULL.
        return None if rng.random() < 0.05 else 0 if rng.random() < 0.33 else rng.randrange(n)

    requests = [(t, rng.randrange(3), key(15), key(25)) for t in range(250)]
    taken = [(rng.randrange(3), rng.randrange(15), rng.randrange(25)) for _ in range(8)]
    batch = spark.createDataFrame(requests, "t int, g int, x int, y int").repartition(4)
    state = spark.createDataFrame(taken, "g int, x int, y int")
    got = admit_first_come(batch, RULES, ["t"], {"a": state, "b": state})
    assert rows(got, "t", "verdict") == brute(requests, taken)


def counted_rounds(monkeypatch):
    """How often the open requests were stored anew."""
    names, plain = [], admission.stored
    monkeypatch.setattr(admission, "stored", lambda df, name: names.append(name) or plain(df, name))
    return lambda: names.count("requests-open") - 1


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Every request waits for the one before it only."""
    rounds, n = counted_rounds(monkeypatch), 100_000
    batch = spark.range(n).selectExpr("id AS t", "(id + 1) div 2 AS x", "id div 2 AS y").repartition(4, "x")
    got = admit_first_come(batch, {"a": ["x"], "b": ["y"]}, ["t"])
    wrong = got.where("verdict <> CASE WHEN t % 2 = 0 THEN 'accepted' ELSE 'b' END")
    assert (got.count(), wrong.count()) == (n, 0)
    assert rounds() <= 3


def test_chains_that_branch(spark, monkeypatch):
    """Three rules, chains of random links and requests that wait for several others."""
    monkeypatch.setattr(admission, "SLOW_SHARE", 0.0)
    rng = random.Random(11)
    data = []
    for t in range(400):
        x, y = (t + 1) // 2, t // 2
        data.append((t, None if rng.random() < 0.1 else x, y if rng.random() < 0.8 else rng.randrange(200), rng.randrange(3000)))
    rules, used, expected = {"a": ["x"], "b": ["y"], "c": ["z"]}, [set(), set(), set()], []
    for t, *keys in data:
        broken = [n for n, k, u in zip("abc", keys, used) if k is not None and k in u]
        expected.append((t, broken[0] if broken else "accepted"))
        if not broken:
            for k, u in zip(keys, used):
                u.add(k)
    batch = spark.createDataFrame(data, "t int, x int, y int, z int").repartition(3)
    assert rows(admit_first_come(batch, rules, ["t"]), "t", "verdict") == expected


def test_orders_of_several_columns_and_null(spark):
    data = [(None, 2, "k", "p"), (1, 1, "k", "q"), (1, 2, "l", "q"), (0, 9, "m", "p"), (0, 1, "m", None), (2, 0, None, None)]
    batch = spark.createDataFrame(data, "s int, t int, x string, y string")
    got = rows(admit_first_come(batch, {"a": ["x"], "b": ["y"]}, ["s", "t"]), "s", "t", "verdict")
    assert got == [(None, 2, "accepted"), (0, 1, "accepted"), (0, 9, "a"), (1, 1, "a"), (1, 2, "accepted"), (2, 0, "accepted")]
    assert admit_first_come(batch.limit(0), {"a": ["x"], "b": ["y"]}, ["s", "t"]).count() == 0


def test_many_rows_in_an_order_with_a_fraction(spark, monkeypatch):
    """Places follow an order of several columns over several files."""
    rng = random.Random(5)
    times = rng.sample(range(20_000), 4000)
    requests = [(t, rng.randrange(20), rng.choice([None, *range(150)]), rng.randrange(300)) for t in times]
    taken = [(rng.randrange(20), rng.randrange(150), rng.randrange(300)) for _ in range(200)]
    ordered = [(t // 10, t % 10 / 8, g, x, y) for t, g, x, y in requests]
    batch = spark.createDataFrame(ordered, "s int, p double, g int, x int, y int").repartition(7)
    state = spark.createDataFrame(taken, "g int, x int, y int")
    got = admit_first_come(batch, RULES, ["s", "p"], {"a": state, "b": state})
    assert rows(got.selectExpr("CAST(s * 10 + p * 8 AS INT) AS t", "verdict"), "t", "verdict") == brute(requests, taken)


def test_what_the_first_round_settles_takes_no_other(spark, monkeypatch):
    names, plain = [], admission.stored
    monkeypatch.setattr(admission, "stored", lambda df, name: names.append(name) or plain(df, name))
    batch = spark.range(300).selectExpr("id AS t", "id div 3 AS x", "id AS y")
    got = admit_first_come(batch, {"a": ["x"], "b": ["y"]}, ["t"])
    assert got.where("verdict = 'accepted'").count() == 100
    assert "requests-open" not in names


def test_single_rule(spark):
    batch = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None), (5, "old")], "t int, k string")
    state = spark.createDataFrame([("old",)], "k string")
    got = admit_first_come(batch, {"k": ["k"]}, ["t"], {"k": state})
    assert rows(got, "t", "verdict") == [(1, "accepted"), (2, "k"), (3, "accepted"), (4, "accepted"), (5, "k")]


SLOT = "id bigint, patient_id bigint, machine_id bigint, schedule_date date, shift string, status string"


def test_booking_order_and_reasons(spark):
    d = date(2025, 1, 1)
    asked = [(1, 1, 1, d, "s1"), (2, 2, 1, d, "s1"), (3, 1, 2, d, "s2"), (4, 2, 2, d, "s2"), (5, None, 3, d, "s1")]
    requests = spark.createDataFrame(asked, "t int, patient_id bigint, machine_id bigint, schedule_date date, shift string")
    booked = spark.createDataFrame([(7, 9, 9, d, "s1", "Done")], SLOT)
    state, log = schedule.book_slots(booked, requests, ["t"])
    assert rows(log, "t", "verdict") == [
        (1, "accepted"), (2, "machine taken"), (3, "patient booked"), (4, "accepted"), (5, "missing patient_id"),
    ]
    assert rows(state, "id", "patient_id", "status") == [(7, 9, "Done"), (8, 1, "Scheduled"), (9, 2, "Scheduled")]
    slots = rows(state, "machine_id", "schedule_date", "shift")
    assert len(slots) == len(set(slots))


def test_booking_reads_its_requests_few_times(spark):
    """Twice to place them (ranges, rows) and once for the refused of the log."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    kind = "o int, t int, patient_id bigint, machine_id bigint, schedule_date date, shift string"
    asked = [(n // 5, n, n % 70 or None, n % 30, date(2025, 1, 1 + n % 2), "s1") for n in range(400)]
    requests = spark.createDataFrame(asked, kind).mapInPandas(counted, kind)
    booked = spark.createDataFrame([(7, 9, 9, date(2025, 1, 1), "s1", "Done")], SLOT)
    state, log = schedule.book_slots(booked, requests, ["o", "t"])
    assert (log.count(), log.where("verdict = 'accepted'").count()) == (400, state.count() - 1)
    # Both counts of the log read the refused again.
    assert read.value <= 4 * 400
