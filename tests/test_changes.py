import random
from datetime import date

import pytest

from careflow.operators import changes
from careflow.plans import inventory, roster, schedule
from tests.conftest import rows

D = date
DAY = D(2025, 3, 1)
SESSION = "id bigint, patient_id bigint, session_date date, shift string, machine_id bigint"
KEY = ["patient_id", "session_date"]


def sessions(spark, data):
    return spark.createDataFrame(data, SESSION)


def test_upsert_same_patient_twice(spark):
    state = sessions(spark, [(1, 1, DAY, "a", 1), (2, 1, DAY, "a", 1)])
    batch = spark.createDataFrame(
        [(1, 5, DAY, "x", 1), (2, 5, DAY, "y", None), (3, None, DAY, "z", 1), (4, 1, DAY, None, 7)],
        "seq int, patient_id bigint, session_date date, shift string, machine_id bigint",
    )
    new, log = changes.upsert(state, batch, KEY, ["shift", "machine_id"], ["seq"])
    assert rows(new) == [(1, 1, DAY, None, 7), (2, 1, DAY, "a", 1), (3, 5, DAY, "y", None)]
    assert rows(log, "seq", "action") == [(1, "added"), (2, "updated"), (3, "failed"), (4, "updated")]


def test_saving_a_roster_clears_other_columns(spark):
    state = spark.createDataFrame(
        [(3, 1, D(2025, 4, 1), "M", 9, "note"), (4, 1, D(2025, 4, 2), "M", 9, "kept")],
        "id bigint, staff_id bigint, shift_date date, new_shift_type string, substitute_staff_id bigint, notes string",
    )
    batch = spark.createDataFrame([(1, 1, 1, "A"), (2, 1, 1, "N"), (3, 2, 31, "L")], "seq int, staff_id bigint, day int, shift_code string")
    new, log = roster.save_roster(state, batch, "2025-04", ["seq"])
    assert rows(new) == [(4, 1, D(2025, 4, 2), "M", 9, "kept"), (6, 1, D(2025, 4, 1), "N", None, None)]
    assert rows(log, "staff_id", "action") == [(1, "replaced"), (2, "refused: no such day")]


def test_toggle(spark):
    state = sessions(spark, [(1, 1, DAY, "a", 1)])
    events = spark.createDataFrame([(1, DAY), (2, DAY), (2, DAY)], "patient_id bigint, session_date date")
    new, log = changes.toggle(state, events, KEY)
    assert new.count() == 0
    assert rows(log, "patient_id", "rows_before", "events", "deleted", "created") == [(1, 1, 1, 1, 0), (2, 0, 2, 0, 0)]


@pytest.mark.parametrize("hot", [{}, {"hot_rows": 0, "blocks": 3}])
def test_toggle_equals_one_event_at_a_time(spark, hot):
    rng = random.Random(3)
    data = [(i, rng.choice([0, 0, 1, 2, 3]), DAY, "a", 1) for i in range(1, 30)]
    events = [(rng.choice([0, 1, 2, 3, 4, 5]), DAY) for _ in range(25)]
    state = {i: p for i, p, *_ in data}
    for p, _ in events:
        mine = sorted(i for i, q in state.items() if q == p)
        if mine:
            del state[mine[0]]
        else:
            state[1000 + len(state) + rng.random()] = p
    new, _ = changes.toggle(sessions(spark, data), spark.createDataFrame(events, "patient_id bigint, session_date date"), KEY, **hot)
    assert sorted(r.patient_id for r in new.collect()) == sorted(state.values())
    kept = {i for i in state if i < 1000}
    assert {r.id for r in new.collect() if r.id < 30} == kept


def test_toggling_twice_changes_nothing(spark):
    state = sessions(spark, [(1, 1, DAY, None, None), (2, 2, DAY, None, None)])
    events = spark.createDataFrame([(1, DAY), (3, DAY)], "patient_id bigint, session_date date")
    once, _ = changes.toggle(state, events, KEY)
    assert rows(once, *KEY) == [(2, DAY), (3, DAY)]
    assert rows(changes.toggle(once, events, KEY)[0], *KEY) == rows(state, *KEY)


def test_delta(spark):
    state = sessions(spark, [(1, 1, DAY, "a", 1), (2, 1, DAY, "b", 1), (3, 9, DAY, "a", 1)])
    schema = "patient_id bigint, session_date date"
    added = spark.createDataFrame([(1, DAY), (2, DAY), (2, DAY), (9, DAY)], schema)
    removed = spark.createDataFrame([(1, DAY), (1, DAY), (8, DAY)], schema)
    new, log = changes.apply_delta(state, added, removed, KEY)
    assert rows(new, "patient_id", "shift") == [(1, None), (2, None), (9, "a")]
    assert rows(log, "patient_id", "action", "rows") == [(1, "added", 1), (1, "removed", 2), (2, "added", 1)]


def test_insert_if_absent_is_idempotent(spark):
    state = sessions(spark, [(1, 1, DAY, "a", 1)])
    batch = spark.createDataFrame([(1, DAY), (2, DAY), (2, DAY)], "patient_id bigint, session_date date")
    once, log = changes.insert_if_absent(state, batch, KEY)
    assert rows(once, "id", "patient_id") == [(1, 1), (2, 2)]
    assert log.count() == 1
    assert rows(changes.insert_if_absent(once, batch, KEY)[0]) == rows(once)


def test_delete_and_update(spark):
    state = sessions(spark, [(1, 1, DAY, "a", 1), (2, 2, DAY, "b", 2)])
    asked = spark.createDataFrame([(1,), (1,), (7,)], "id bigint")
    left, log = changes.delete_by_key(state, asked)
    assert rows(left, "id") == [(2,)]
    assert rows(log) == [(1, "deleted"), (7, "not_found")]
    batch = spark.createDataFrame([(1, 2, "x"), (2, 2, None), (3, 7, "x")], "seq int, id bigint, shift string")
    new, log = changes.update_by_key(state, batch, "id", ["shift"], ["seq"])
    assert rows(new, "id", "shift", "machine_id") == [(1, "a", 1), (2, None, 2)]
    assert rows(log) == [(2, "updated"), (7, "not_found")]


def test_session_rules(spark):
    state = sessions(spark, [(1, 1, DAY, "a", 1)])
    batch = spark.createDataFrame(
        [(1, 1, DAY), (2, 2, DAY), (3, 2, DAY), (4, 3, D(2025, 3, 2)), (5, None, DAY), (6, 4, None)],
        "seq int, patient_id bigint, session_date date",
    )
    got = schedule.session_rules(batch, state, "2025-03-01", ["seq"])
    assert rows(got, "seq", "verdict") == [
        (1, "second session"), (2, "accepted"), (3, "second session"), (4, "future date"),
        (5, "missing patient_id"), (6, "missing session_date"),
    ]
    new, log = schedule.add_sessions(state, batch, "2025-03-01", ["seq"])
    assert rows(new, "id", "patient_id") == [(1, 1), (2, 2)]
    assert dict(rows(log, "seq", "action"))[2] == "added" and log.count() == 6


def test_unique_first_in_batch_wins_and_null_never_conflicts(spark):
    existing = spark.createDataFrame([("m0", "n0"), ("m9", None)], "medical_id string, national_id string")
    batch = spark.createDataFrame(
        [(1, "m1", "n1"), (2, "m1", "n2"), (3, "m3", "n2"), (4, "m4", None), (5, "m5", None), (6, "m0", "n6"), (7, "m7", "n0")],
        "seq int, medical_id string, national_id string",
    )
    keys = {"medical_id": ["medical_id"], "national_id": ["national_id"]}
    got = changes.unique(batch, keys, ["seq"], existing)
    assert rows(got, "seq", "verdict") == [
        (1, "accepted"), (2, "medical_id"), (3, "accepted"), (4, "accepted"), (5, "accepted"),
        (6, "medical_id"), (7, "national_id"),
    ]


def test_large_ids_stay_exact(spark):
    big = 2**60 + 1
    batch = spark.createDataFrame([(1, big, big), (2, None, big + 1), (3, big, big + 2)], "seq int, a bigint, b bigint")
    got = changes.unique(batch, {"a": ["a"], "b": ["b"]}, ["seq"])
    assert rows(got) == [(1, big, big, "accepted"), (2, None, big + 1, "accepted"), (3, big, big + 2, "a")]


def test_create_orders(spark):
    orders = spark.createDataFrame([(5, 1, DAY, "Completed")], "id bigint, supplier_id bigint, order_date date, status string")
    items = spark.createDataFrame([(8, 5, 1, 2, 1.0)], "id bigint, purchase_order_id bigint, supply_id bigint, quantity_ordered bigint, unit_price double")
    headers = spark.createDataFrame([(1, 2, DAY), (2, None, DAY), (3, 3, DAY), (4, 4, DAY)], "request int, supplier_id bigint, order_date date")
    lines = spark.createDataFrame([(1, 1, 7, 3), (4, 1, 7, None), (4, 2, 8, 2), (2, 1, 9, 1)], "request int, position int, supply_id bigint, quantity_ordered bigint")
    new_orders, new_items, log = inventory.create_orders(orders, items, headers, lines, ["request"], ["position"])
    assert rows(new_orders, "id", "supplier_id", "status") == [(5, 1, "Completed"), (6, 2, "Pending"), (7, 4, "Pending")]
    assert rows(new_items) == [(8, 5, 1, 2, 1.0), (9, 6, 7, 3, 0.0), (10, 7, 7, 1, 0.0), (11, 7, 8, 2, 0.0)]
    assert rows(log, "request", "action") == [(1, "created"), (2, "missing supplier_id"), (3, "no items"), (4, "created")]


def test_transfusions(spark):
    state = spark.createDataFrame([(1, 0, None), (2, 0, None)], "id bigint, blood_transfusion_bags bigint, notes string")
    batch = spark.createDataFrame([(1, "2.0", "ok"), (2, "-1", "no"), (3, "1", "gone"), (1, "1.5", "no")], "id bigint, blood_transfusion_bags string, notes string")
    new, log = schedule.record_transfusions(state, batch, ["id"])
    assert rows(new) == [(1, 2, "ok"), (2, 0, None)]
    assert rows(log) == [(1, "bad bag count"), (1, "updated"), (2, "bad bag count"), (3, "not_found")]


def test_edit_keeps_invalid_rows_out(spark):
    state = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id bigint, name string, grade string")
    batch = spark.createDataFrame([(1, "", "z"), (2, "c", None), (3, "d", "z")], "id bigint, name string, grade string")
    new, log = changes.update_by_key(state, batch, "id", ["name", "grade"], ["id"], required=["name"])
    assert rows(new) == [(1, "a", "x"), (2, "c", None)]
    assert rows(log) == [(1, "missing name"), (2, "updated"), (3, "not_found")]


def test_edits_keep_keys_unique(spark):
    state = spark.createDataFrame([(1, "A", "x"), (2, "B", "x"), (3, None, "x"), (4, "D", "x")], "id bigint, name string, phone string")
    batch = spark.createDataFrame(
        [(1, 2, "A", "p"), (2, 3, "N", "p"), (3, 4, "N", "p"), (4, 1, "A", "p"), (5, 9, "Z", "p"), (6, 2, "C", ""), (7, 3, "N", "q")],
        "seq int, id bigint, name string, phone string",
    )
    new, log = changes.update_by_key(state, batch, "id", ["name", "phone"], ["seq"], ["phone"], keysets={"name": ["name"]})
    # 2 may not take 1's name; of 3 and 4 the one whose last edit came first gets N.
    assert rows(new) == [(1, "A", "p"), (2, "B", "x"), (3, None, "x"), (4, "N", "p")]
    assert rows(log) == [(1, "updated"), (2, "duplicate name"), (2, "missing phone"), (3, "duplicate name"), (4, "updated"), (9, "not_found")]
