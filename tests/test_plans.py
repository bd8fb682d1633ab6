"""The physical plans: what reaches the scan, how rows are shuffled, how many jobs run."""

import re

import pytest
from pyspark.sql import functions as F

from careflow.bindings.views import Views
from careflow.functions import filters
from careflow.operators import ordered, paging
from careflow.plans import billing, inventory, labs, reports, roster
from careflow.sources import tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, FOLDER)


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_month_filter_reaches_the_scan(spark, v):
    text = plan(filters.in_month(v.sessions, "session_date", "1997-03"))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed


def test_declared_columns_stay_pushable(spark, v):
    from careflow.session import shared_path

    folder = shared_path(spark, "plans")
    v.sessions.write.parquet(f"{folder}/sessions")
    text = plan(filters.in_month(tables.read_table(spark, folder, "sessions"), "session_date", "1997-03").select("id"))
    assert "GreaterThanOrEqual(session_date" in text
    assert re.search(r"ReadSchema: struct<id:bigint,session_date:date>", text)


def test_invoices_read_few_columns_and_combine_before_the_shuffle(v):
    text = plan(billing.bulk_invoices(v.patients, v.sessions, v.app_settings, "1997-03"))
    assert "struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate" in text
    assert "partial_count" in text and "partial_sum" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["sessions_per_machine", "sessions_per_patient"])
def test_counts_are_combined_before_the_join(v, name):
    dim = v.machines if name.endswith("machine") else v.patients
    text = plan(getattr(reports, name)(v.sessions, dim), "simple")
    assert text.index("Join") < text.index("partial_count")  # parents are printed first
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_top_k_does_not_sort_everything(v):
    text = plan(reports.top_patients(v.sessions, v.patients, "1997-01-01", "1997-06-30"), "simple")
    assert "TakeOrderedAndProject" in text
    assert "TakeOrderedAndProject" in plan(labs.critical_labs(v.lab_results, v.patients, v.lab_test_types), "simple")
    assert "TakeOrderedAndProject" in plan(paging.paginate(v.staff, ["name", "id"], 3), "simple")


def test_attendance_marks_use_a_hash_aggregate(v):
    from datetime import date

    text = plan(reports.attendance_sheet(v.patients, v.sessions, date(1997, 3, 1), date(1997, 3, 31)), "simple")
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_dashboard_scans_each_table_once(v):
    df = reports.dashboard(
        v.patients, v.sessions, v.preventive_maintenances, v.curative_maintenances, v.staff,
        "1997-01-01", "1997-06-30", "1998-06-15",
    )
    assert plan(df, "simple").count("FileScan") == 5


def test_no_cross_products_in_any_report(v):
    for df in (
        reports.predicted_roster(v.patients, v.sessions, "1997-03", "1998-06-15"),
        reports.unit_daily_report(v.patients, v.machines, v.sessions, "1997-03-05"),
        reports.missed_in_month(v.patients, v.sessions, "1997-03"),
    ):
        text = plan(df, "simple")
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_last_rows_are_found_in_a_hash_aggregate(v):
    text = plan(ordered.last_wins(v.lab_results, ["patient_id", "result_date"], ["id"]), "simple")
    assert "HashAggregate" in text and "SortAggregate" not in text and "Window" not in text
    # Only keys and order are read for the aggregate.
    narrow = plan(ordered.last_wins(v.lab_results, ["patient_id", "result_date"], ["id"]))
    assert "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in narrow


def test_roster_hours_need_no_calendar(v):
    text = plan(roster.roster_hours(v.staff, v.shift_changes, "2024-01"), "simple")
    assert text.count("first(") < 5 and "pivot" not in text.lower() and "day31" not in text


def test_predicted_dates_are_made_for_the_patients_weekdays_only(v):
    expected = reports.predicted_roster(v.patients, v.sessions, "1997-03", "1998-06-15")
    text = plan(expected, "simple")
    assert "sequence(" not in text and text.count("Generate") >= 1


def test_received_items_are_read_once(spark, v, monkeypatch):
    scans, plain = [], inventory.stored
    monkeypatch.setattr(inventory, "stored", lambda df, name: scans.append((name, plan(df, "simple"))) or plain(df, name))
    receipts = v.purchase_orders.selectExpr("id AS request", "id AS order_id")
    out = inventory.receive_orders(v.purchase_orders, v.purchase_order_items, v.medical_supplies, receipts, ["id"])
    assert [name for name, _ in scans] == ["received-items"]
    # What comes after reads the stored items, not the order lines.
    assert "lineitem" in scans[0][1] and not any("lineitem" in plan(df, "simple") for df in out)


def test_reconciling_takes_one_window_over_the_log(spark, v):
    log = v.stock_movements.withColumn("new_quantity", F.col("change_amount"))
    text = plan(inventory.reconcile_ledger(v.medical_supplies, log, ["moved_on", "order_no", "line_no"]), "simple")
    # The second window is over one row per supply and block.
    assert len(re.findall(r"\bWindow \[", text)) <= 2 and text.count("FileScan") == 2
