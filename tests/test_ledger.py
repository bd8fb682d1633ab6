import random

import pytest

from careflow.plans import inventory
from tests.conftest import rows


def brute(stock, moves):
    out, stock = [], dict(stock)
    for key, t, amount in sorted(moves):
        if stock[key] + amount < 0:
            out.append((key, t, amount, "negative", None))
        else:
            stock[key] += amount
            out.append((key, t, amount, "accepted", stock[key]))
    return out, stock


def frames(spark, stock, moves):
    supplies = spark.createDataFrame([(k, f"s{k}", q) for k, q in stock.items()], "id bigint, name string, quantity bigint")
    return supplies, spark.createDataFrame(moves, "supply_id bigint, t int, change_amount bigint").repartition(3)


def test_rejection_affects_later_movements(spark):
    supplies, moves = frames(spark, {1: 5}, [(1, 1, -3), (1, 2, -4), (1, 3, 2), (1, 4, -4)])
    after, log = inventory.stock_ledger(supplies, moves, ["t"])
    assert rows(log, "t", "status", "new_quantity") == [
        (1, "accepted", 2), (2, "negative", None), (3, "accepted", 4), (4, "accepted", 0),
    ]
    assert rows(after, "id", "quantity") == [(1, 0)]


@pytest.mark.parametrize(
    "seed,hot_rows,blocks", [(0, None, None), (1, 0, 3), (2, 0, 9), (3, 100, 5), (4, 0, 4), (5, 100, 7)]
)
def test_hot_key_over_blocks_equals_brute_force(spark, seed, hot_rows, blocks):
    rng = random.Random(seed)
    stock = {k: rng.randrange(0, 30) for k in range(8)}
    drift = rng.choice([-4, 0, 3])
    moves = [
        (0 if rng.random() < 0.4 else rng.randrange(8), i, rng.randrange(-20, 21) + drift) for i in range(900)
    ]
    supplies, batch = frames(spark, stock, moves)
    hot = {} if blocks is None else {"hot_rows": hot_rows, "blocks": blocks}
    after, log = inventory.stock_ledger(supplies, batch, ["t"], **hot)
    expected, closing = brute(stock, moves)
    assert rows(log, "supply_id", "t", "change_amount", "status", "new_quantity") == expected
    assert dict(rows(after, "id", "quantity")) == closing
    assert min(q for *_, q in expected if q is not None) >= 0


def test_blocks_that_must_be_walked_again(spark):
    # Every block closes at another stock than a plain sum foretells.
    moves = [(1, i, -7 if i % 2 else 5) for i in range(200)]
    supplies, batch = frames(spark, {1: 3}, moves)
    _, log = inventory.stock_ledger(supplies, batch, ["t"], hot_rows=0, blocks=8)
    assert rows(log, "supply_id", "t", "change_amount", "status", "new_quantity") == brute({1: 3}, moves)[0]


def test_unknown_supply_and_bad_amount(spark):
    supplies = spark.createDataFrame([(1, "a", 5)], "id bigint, name string, quantity bigint")
    moves = spark.createDataFrame([(1, 1, "2.9"), (1, 2, "x"), (9, 3, "1")], "supply_id bigint, t int, change_amount string")
    _, log = inventory.stock_ledger(supplies, moves, ["t"])
    assert rows(log, "t", "change_amount", "status", "new_quantity") == [
        (1, 2, "accepted", 7), (2, None, "bad amount", None), (3, 1, "unknown supply", None),
    ]


def test_reconcile(spark):
    supplies = spark.createDataFrame([(1, 7), (2, 4), (3, 0)], "id bigint, quantity bigint")
    log = spark.createDataFrame(
        [(1, 1, 5, 5), (1, 2, 2, 7), (2, 1, 3, 3), (2, 2, 2, 4), (9, 1, 1, 1)],
        "supply_id bigint, t int, change_amount bigint, new_quantity bigint",
    )
    for hot in ({}, {"hot_rows": 0, "blocks": 3}):
        got = inventory.reconcile_ledger(supplies, log, ["t"], **hot)
        assert rows(got, "supply_id", "gap_free", "matches_stock") == [(1, True, True), (2, False, True), (9, True, False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_reconcile_over_blocks_equals_row_by_row(spark, seed):
    rng, log, stock = random.Random(seed), [], {}
    for t in range(400):
        key = 0 if rng.random() < 0.4 else rng.randrange(1, 40)
        change = rng.randrange(-5, 9)
        stock[key] = stock.get(key, 3) + change + (1 if rng.random() < 0.004 else 0)
        log.append((key, t, change, stock[key]))
    expected = []
    for key in sorted(stock):
        own = [r for r in log if r[0] == key]
        joined = all(b[3] == a[3] + b[2] for a, b in zip(own, own[1:]))
        expected.append((key, len(own), own[-1][3], joined, own[-1][3] == stock[key] and key % 2 == 0))
    supplies = spark.createDataFrame([(k, q if k % 2 == 0 else q + 1) for k, q in stock.items()], "id bigint, quantity bigint")
    table = spark.createDataFrame(log, "supply_id bigint, t int, change_amount bigint, new_quantity bigint").repartition(3)
    for hot in ({}, {"hot_rows": 20, "blocks": 7}, {"hot_rows": 0, "blocks": 5}):
        got = inventory.reconcile_ledger(supplies, table, ["t"], **hot)
        assert rows(got, "supply_id", "entries", "last_logged", "gap_free", "matches_stock") == expected


def test_usage_is_withdrawn_and_logged_negative(spark):
    supplies = spark.createDataFrame([(1, 5), (2, 1)], "id bigint, quantity bigint")
    usage = [(1, 1, "3"), (1, 2, "-5"), (1, 3, "0"), (1, 4, "2.9"), (1, 5, "1"), (2, 6, "x"), (2, 7, None), (9, 8, "1"), (2, 9, "0.4")]
    after, log = inventory.use_supplies(supplies, spark.createDataFrame(usage, "supply_id bigint, t int, quantity_used string"), ["t"])
    assert rows(log, "t", "change_amount", "status", "new_quantity") == [
        (1, -3, "accepted", 2), (2, None, "bad quantity", None), (3, None, "bad quantity", None), (4, -2, "accepted", 0),
        (5, -1, "negative", None), (6, None, "bad quantity", None), (7, None, "bad quantity", None),
        (8, -1, "unknown supply", None), (9, 0, "accepted", 1),
    ]
    assert rows(after, "id", "quantity") == [(1, 0), (2, 1)]


def purchase(spark):
    orders = spark.createDataFrame([(1, "Pending"), (2, "Completed"), (3, "Pending"), (4, "Pending")], "id bigint, status string")
    items = spark.createDataFrame(
        [(1, 1, 3, 4), (2, 1, 3, 6), (3, 2, 3, 1), (4, 4, 3, 1), (5, 4, 99, 1)],
        "id bigint, purchase_order_id bigint, supply_id bigint, quantity_ordered bigint",
    )
    supplies = spark.createDataFrame([(3, "gauze", 10)], "id bigint, name string, quantity bigint")
    receipts = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1)], "request bigint, order_id bigint")
    return orders, items, supplies, receipts


@pytest.mark.parametrize("hot", [{}, {"hot_rows": 0, "blocks": 2}])
def test_orders_are_received_whole_or_not_at_all(spark, hot):
    supplies, orders, log, verdicts = inventory.receive_orders(*purchase(spark), ["id"], **hot)
    assert rows(verdicts, "request", "verdict") == [
        (1, "received"), (2, "already completed"), (3, "no items"), (4, "unknown supply"), (5, "unknown order"),
        (6, "already completed"),
    ]
    assert rows(log, "change_amount", "new_quantity", "notes") == [
        (4, 14, "استلام أمر شراء رقم 1"), (6, 20, "استلام أمر شراء رقم 1"),
    ]
    assert rows(supplies, "id", "quantity") == [(3, 20)]
    assert dict(rows(orders, "id", "status")) == {1: "Completed", 2: "Completed", 3: "Pending", 4: "Pending"}
