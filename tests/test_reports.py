from datetime import date

import pytest
from pyspark.sql import functions as F

from careflow.operators import paging
from careflow.plans import billing, daily_reports, labs, patients, reports, roster, schedule
from tests.conftest import rows

D = date


def people(spark, data):
    return spark.createDataFrame(
        data,
        "id bigint, name string, medical_id string, national_id string, phone string, referral_place string, "
        "referral_date date, dialysis_unit string, virus_status string, is_archived int, added_date date, "
        "dialysis_days string, referral_expiry date, dob date",
    )


def person(i, unit="A", virus="سلبي", archived=0, added=D(2025, 1, 1), days=None, expiry=None, dob=None):
    return (i, f"p{i}", f"m{i}", None, None, None, None, unit, virus, archived, added, days, expiry, dob)


def held(spark, data):
    return spark.createDataFrame(data, "id bigint, patient_id bigint, session_date date, blood_transfusion_bags bigint")


def prices(spark, session, bag):
    return spark.createDataFrame([(1, session, bag)], "id bigint, price_per_session double, price_per_blood_bag double")


MARCH = [(1, 7, D(2025, 3, 2), 1), (2, 7, D(2025, 3, 9), None), (3, 7, D(2025, 3, 30), 2), (4, 7, D(2025, 4, 1), 9)]


@pytest.mark.parametrize("session,bag,total", [(1450.0, 950.0, 7200), (0.0, None, 1050), (None, 0.0, 1050)])
def test_invoice_amounts(spark, session, bag, total):
    bill = billing.invoice(people(spark, [person(7)]), held(spark, MARCH), prices(spark, session, bag), 7, "2025-03")
    row = bill.first()
    assert (row.session_count, row.total_bags, row.grand_total) == (3, 3, total)
    assert (row.first_session_date, row.last_session_date) == (D(2025, 3, 2), D(2025, 3, 30))


def test_missing_settings_row(spark):
    none = prices(spark, 1.0, 1.0).where("id = 2")
    assert tuple(billing.settings(none).first()) == (200.0, 150.0)


def test_invoice_without_sessions(spark):
    who, sessions, paid = people(spark, [person(7), person(8)]), held(spark, MARCH), prices(spark, 10.0, 1.0)
    row = billing.invoice(who, sessions, paid, 8, "2025-03").first()
    assert (row.session_count, row.total_bags, row.grand_total, row.first_session_date) == (0, 0, 0, None)
    assert rows(billing.bulk_invoices(who, sessions, paid, "2025-03"), "id", "grand_total") == [(7, 33.0)]
    assert billing.bulk_invoices(who, sessions, paid, "2025-03", "all").count() == 1
    assert billing.bulk_invoices(who, sessions, paid, "2025-03", "B").count() == 0


def test_bulk_total_is_counts_times_prices(spark):
    sessions = held(spark, [(i, i % 5, D(2025, 3, 1 + i % 28), i % 3) for i in range(100)])
    bills = billing.bulk_invoices(people(spark, [person(i) for i in range(5)]), sessions, prices(spark, 7.0, 3.0), "2025-03")
    assert bills.agg(F.sum("grand_total")).first()[0] == 100 * 7 + sum(i % 3 for i in range(100)) * 3


def test_roster_hours(spark):
    staff = spark.createDataFrame([(1, "n", "M", "Nurse"), (2, "o", None, "")], "id bigint, name string, default_shift string, job_title string")
    changes = spark.createDataFrame(
        [(1, D(2025, 4, d), "N") for d in (1, 2, 30)] + [(1, D(2025, 4, 5), "X"), (1, D(2025, 5, 1), "N")],
        "staff_id bigint, shift_date date, new_shift_type string",
    )
    assert rows(roster.roster_hours(staff, changes, "2025-04")) == [(1, "n", 244), (2, "o", 0)]
    sheet = roster.roster_sheet(staff, changes, "2025-04", "Nurse").collect()
    assert len(sheet) == 1 and (sheet[0].day1, sheet[0].day3, sheet[0].day5) == ("N", "M", "X")
    assert "day31" not in sheet[0].asDict()


def test_unit_report(spark):
    who = people(spark, [person(1), person(2, virus="الجراي زون"), person(3, unit=None), person(4, archived=1)])
    machines = spark.createDataFrame([(1, "ANNEX"), (2, "A"), (3, "")], "id bigint, internal_unit string")
    day = D(2025, 3, 1)
    sessions = held(spark, [(i, p, day, 0) for i, p in enumerate([1, 2, 3, 4])])
    got = rows(reports.unit_daily_report(who, machines, sessions, day))
    assert got == [("A", 2, 1, 2, 1, 0, 0), ("ANNEX", 0, 1, 0, 0, 0, 0)]
    assert rows(reports.sessions_by_unit_and_virus(sessions, who, day)) == [(None, 2, 1, 0, 0), ("A", 2, 1, 0, 0)]
    assert rows(reports.sessions_by_unit_and_virus(sessions, who, D(2025, 3, 2))) == [(None, 0, 0, 0, 0)]


def test_missed_and_attended(spark):
    who = people(
        spark,
        [person(1), person(2, added=D(2025, 4, 10)), person(3, archived=1), person(4, added=D(2025, 3, 31)), person(5, added=None)],
    )
    sessions = held(spark, [(1, 1, D(2025, 3, 31), 0), (2, 1, D(2025, 3, 31), 0), (3, 4, D(2025, 4, 1), 0)])
    assert rows(reports.missed_in_month(who, sessions, "2025-03"), "id") == [(4,)]
    assert rows(reports.attended_in_month(who, sessions, "2025-03"), "id") == [(1,)]


def test_with_and_without_are_disjoint(spark):
    who = people(spark, [person(1, days="Sat, Mon"), person(2, days="Sun,Mon"), person(3, days="Tue"), person(4)])
    sessions = held(spark, [(1, 1, D(2025, 3, 3), 0), (2, 1, D(2025, 3, 3), 0), (3, 4, D(2025, 3, 3), 0)])
    got = rows(reports.attendance_on(who, sessions, "2025-03-03"), "attendance", "id")
    assert got == [("with", 1), ("with", 1), ("with", 4), ("without", 2)]


def test_monthly_cards_keep_repeated_dates(spark):
    sessions = held(spark, [(1, 1, D(2025, 3, 9), 0), (2, 1, D(2025, 3, 2), 0), (3, 1, D(2025, 3, 9), 0)])
    card = reports.monthly_cards(people(spark, [person(1), person(2)]), sessions, "2025-03").collect()
    assert [(c.id, [tuple(d) for d in c.dates]) for c in card] == [(1, [(D(2025, 3, 2), 1), (D(2025, 3, 9), 2)])]


def test_attendance_sheet_over_two_months(spark):
    who = people(spark, [person(1)])
    sessions = held(spark, [(1, 1, D(2025, 2, 27), 0)])
    start, end = D(2025, 1, 25), D(2025, 3, 28)
    exact = reports.attendance_sheet(who, sessions, start, end).first().asDict()
    by_day = reports.attendance_sheet(who, sessions, start, end, by="day_of_month").first().asDict()
    assert [k for k, v in exact.items() if v == "✔"] == ["2025-02-27"]
    assert [k for k, v in by_day.items() if v == "✔"] == ["2025-01-27", "2025-02-27", "2025-03-27"]
    assert len(exact) == 4 + (end - start).days + 1


def test_categories_share_the_label(spark):
    df = spark.createDataFrame([("x",), ("",), (None,), ("x",)], "gender string")
    got = dict(rows(reports.distribution(df, "gender")))
    assert got == {"x": 2, "غير محدد": 2}
    assert dict(rows(reports.distribution(df, "gender", None))) == {"x": 2, "": 1, None: 1}


def test_dashboard_dates(spark):
    who = people(
        spark,
        [person(1, expiry=D(2025, 3, 31)), person(2, expiry=D(2025, 2, 28)), person(3, expiry=D(2025, 2, 27), added=D(2025, 2, 1)), person(4, archived=1)],
    )
    sessions = held(spark, [(1, 1, D(2025, 3, 1), 2), (2, 1, D(2025, 3, 31), 0), (3, 1, D(2025, 1, 29), 1), (4, 1, D(2025, 1, 28), 1)])
    prev = spark.createDataFrame([(D(2025, 3, 5),), (D(2025, 2, 5),)], "maintenance_date date")
    cur = spark.createDataFrame([(D(2025, 3, 5),)], "report_date date")
    got = {
        (p, m): n
        for p, m, n in rows(
            reports.dashboard(who, sessions, prev, cur, prev, "2025-03-01", "2025-03-31", "2025-04-10")
        )
    }
    assert got[("current", "total_patients")] == 4
    assert got[("current", "active_referrals")] == 1 and got[("current", "expired_referrals")] == 3
    assert got[("previous", "active_referrals")] == 2 and got[("previous", "expired_referrals")] == 1
    assert got[("current", "total_sessions")] == 2 and got[("previous", "total_sessions")] == 1
    assert got[("current", "sessions_with_blood")] == 1 and got[("previous", "sessions_with_blood")] == 1
    assert got[("previous", "new_patients")] == 1
    assert got[("current", "preventive_maintenances")] == 1 and got[("other", "total_staff")] == 2


def test_machines_keep_rows_without_records(spark):
    machines = spark.createDataFrame(
        [(1, "S1"), (2, "S2")], "id bigint, serial_number string"
    ).selectExpr("*", *[f"CAST(NULL AS STRING) AS {c}" for c in ("brand", "model", "ward", "internal_unit", "status", "last_maintenance", "notes")])
    prev = spark.createDataFrame(
        [(1, 1, D(2025, 4, 1)), (2, 1, D(2025, 6, 30)), (3, 1, D(2025, 7, 1))], "id bigint, machine_id bigint, maintenance_date date"
    ).selectExpr("*", *[f"CAST(NULL AS STRING) AS {c}" for c in ("technician_name", "notes", "visitor_name", "section")])
    cur = spark.createDataFrame([(9, 1, D(2025, 5, 1))], "id bigint, machine_id bigint, report_date date").selectExpr(
        "*", *[f"CAST(NULL AS STRING) AS {c}" for c in ("request_number", "repair_date", "engineer_name", "cost", "parts_details", "failure_description", "repair_notes")]
    )
    got = reports.machines_with_maintenance(machines, prev, cur, "quarterly", "2025-05-10")
    assert [tuple(r) for r in got.select("serial_number", "maintenance", "record_id").collect()] == [
        ("S1", "preventive", 2), ("S1", "preventive", 1), ("S1", "curative", 9), ("S2", None, None),
    ]


def test_pages(spark):
    df = spark.range(31).select("id", F.lit("same").alias("name"))
    assert [r.id for r in paging.paginate(df, ["name", "id"], page=3).collect()] == [30]
    assert tuple(paging.page_info(df).first()) == (31, 3)
    assert [r.id for r in paging.page_after(df, ["name", "id"], {"name": "same", "id": 14}, 3).collect()] == [15, 16, 17]
    assert [r.id for r in paging.page_after(df, ["name", "-id"], {"name": "same", "id": 14}, 3).collect()] == [13, 12, 11]


def test_null_order_of_listings(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a")], "id int, name string")
    assert [r.id for r in paging.ordered_listing(df, ["name", "id"]).collect()] == [1, 3, 2]
    assert [r.id for r in paging.ordered_listing(df, ["-name", "id"]).collect()] == [2, 3, 1]


def test_critical_labs_order(spark):
    types = spark.createDataFrame(
        [(1, "K", "mmol", "number", 4.0, 6.0, None)],
        "id bigint, test_name string, unit string, result_type string, normal_range_low double, normal_range_high double, normal_value_text string",
    )
    results = spark.createDataFrame(
        [(i, i % 3, 1, v, D(2025, 1, 1 + i % 2)) for i, v in enumerate(["3.9", "5", "7 high", "n/a", "9"])] + [(9, 77, 1, "9", D(2025, 2, 1))],
        "id bigint, patient_id bigint, test_id bigint, result_value string, result_date date",
    )
    who = people(spark, [person(i) for i in range(3)])
    got = [r.id for r in labs.critical_labs(results, who, types, 3).collect()]
    assert got == [3, 0, 4]


def test_predicted_roster(spark):
    who = people(
        spark,
        [person(1, days="Sat,Mon", expiry=D(2025, 3, 1)), person(2, days="Sat", expiry=D(2025, 2, 1)), person(3, days="", expiry=D(2026, 1, 1))],
    )
    sessions = held(spark, [(1, 1, D(2025, 3, 3), 0), (2, 1, D(2025, 3, 3), 0), (3, 1, D(2025, 3, 4), 0)])
    got = rows(reports.predicted_roster(who, sessions, "2025-03", "2025-03-01"), "id", "session_date", "held")
    assert len(got) == 10 and {r[0] for r in got} == {1}
    assert [r[1] for r in got if r[2]] == [D(2025, 3, 3)]


def test_confirmed_reports(spark):
    reports_state = spark.createDataFrame(
        [(4, D(2025, 1, 1), "DRAFT", "{}", "x", None)],
        "id bigint, report_date date, report_status string, final_data string, confirmed_by_user string, confirmed_at timestamp",
    )
    batch = spark.createDataFrame([(D(2025, 1, 1), (3,), ""), (D(2025, 1, 2), (5,), "dr")], "report_date date, final_data struct<total:int>, user string")
    new = daily_reports.confirm_reports(reports_state, batch, "2025-01-03 10:00:00")
    got = rows(new.withColumn("at", F.col("confirmed_at").isNotNull()), "id", "report_status", "final_data", "confirmed_by_user", "at")
    assert got == [(4, "CONFIRMED", '{"total":3}', "SYSTEM", True), (5, "CONFIRMED", '{"total":5}', "dr", False)]
    assert daily_reports.load_report(new, "2025-01-02", "total int").first().final_data.total == 5


def test_archive_and_restore(spark):
    active = people(spark, [person(1), person(2), person(3)])
    gone = active.where("id > 9").drop("is_archived").selectExpr(
        "*", "CAST(NULL AS STRING) AS archive_reason", "CAST(NULL AS STRING) AS archive_details",
        "CAST(NULL AS DATE) AS date_of_death", "CAST(NULL AS TIMESTAMP) AS archived_at",
    )
    ids = spark.createDataFrame([(1,), (2,), (2,), (50,)], "id bigint")
    left, archived, log = patients.archive(active, gone, ids, "Transfer", "x", "2025-01-01")
    assert rows(archived, "id", "archive_reason", "date_of_death") == [(1, "Transfer", None), (2, "Transfer", None)]
    assert rows(log) == [(1, "archived"), (2, "archived"), (50, "skipped")]
    died = patients.archive(active, gone, ids, patients.DEATH, None, "2025-01-01")[1]
    assert rows(died, "date_of_death") == [(D(2025, 1, 1),)] * 2
    back, emptied, _ = patients.unarchive(left, archived, ids)
    assert rows(back) == rows(active)
    assert emptied.count() == 0


def test_orphans_follow_the_join_kind(spark):
    schema = "id bigint, patient_id bigint, machine_id bigint, schedule_date date, shift string, notes string"
    booked = spark.createDataFrame([(1, 1, 99, D(2025, 1, 1), "a", None), (2, 98, 1, D(2025, 1, 1), "a", None)], schema)
    machines = spark.createDataFrame([(1, "S", "w", "u")], "id bigint, serial_number string, ward string, internal_unit string")
    who = people(spark, [person(1), person(2)]).withColumn("dialysis_shift", F.lit("1"))
    assert rows(schedule.daily_schedule(booked, who, machines, "2025-01-01"), "patient_id", "machine_serial_number") == [(1, None)]
    assert schedule.weekly_schedule(booked, who, machines, "2025-01-01", "2025-01-07").count() == 0
    assert rows(schedule.unscheduled(who, booked, "2025-01-01", "2025-01-01"), "id") == [(2,)]
