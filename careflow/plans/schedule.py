"""Sessions and bookings: lists, free patients, slot booking."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from careflow.functions import filters, scalars as S
from careflow.operators.admission import admit_first_come
from careflow.operators.changes import append, conform, require, split_valid, update_by_key, with_new_ids
from careflow.operators.paging import ordered_listing
from careflow.session import stored

# States in which a machine is offered.
OFFERED = ["نشط", "تحت الصيانة"]

# Why a booking is refused, in the order of the checks.
BOOKING_RULES = {
    "machine taken": ["machine_id", "schedule_date", "shift"],
    "patient booked": ["patient_id", "schedule_date"],
}


def sessions_with_patient(
    sessions: DataFrame,
    patients: DataFrame,
    day: S.DateLike | None = None,
    patient_id: Any = None,
    status: str | None = None,
    term: str | None = None,
) -> DataFrame:
    """Sessions with patient name and medical id, newest first."""
    rows = filters.equals_if_given(sessions, {"patient_id": patient_id, "status": status})
    if day is not None:
        rows = rows.where(F.col("session_date") == S.as_date(day))
    people = patients.select(F.col("id").alias("patient_id"), F.col("name").alias("patient_name"), "medical_id")
    joined = rows.join(filters.search(people, term, ["patient_name", "medical_id"]), "patient_id")
    return ordered_listing(joined.select(*sessions.columns, "patient_name", "medical_id"), ["-session_date", "-id"])


def patient_sessions(sessions: DataFrame, patient_id: Any, month: str | None = None) -> DataFrame:
    """One patient's sessions, newest first."""
    rows = sessions.where(F.col("patient_id") == F.lit(patient_id))
    if month:
        rows = filters.in_month(rows, "session_date", month)
    return ordered_listing(rows, ["-session_date", "-id"])


def _patient_side(patients: DataFrame, *cols: str) -> DataFrame:
    return patients.select(F.col("id").alias("patient_id"), F.col("name").alias("patient_name"), *cols)


def _machine_side(machines: DataFrame) -> DataFrame:
    return machines.select(
        F.col("id").alias("machine_id"),
        F.col("serial_number").alias("machine_serial_number"),
        F.col("ward").alias("machine_ward"),
        F.col("internal_unit").alias("machine_internal_unit"),
    )


MACHINE_COLUMNS = ["machine_serial_number", "machine_ward", "machine_internal_unit"]


def daily_schedule(
    schedule: DataFrame, patients: DataFrame, machines: DataFrame, day: S.DateLike
) -> DataFrame:
    """Bookings of one date; a booking whose machine is gone stays."""
    people = _patient_side(patients, "medical_id", "dialysis_days", "dialysis_shift")
    return (
        schedule.where(F.col("schedule_date") == S.as_date(day))
        .join(people, "patient_id")
        .join(_machine_side(machines), "machine_id", "left")
        .select(
            "patient_id", "patient_name", "medical_id", "dialysis_days", "dialysis_shift",
            "machine_id", *MACHINE_COLUMNS, "shift",
        )
    )


def weekly_schedule(
    schedule: DataFrame, patients: DataFrame, machines: DataFrame, start: S.DateLike, end: S.DateLike
) -> DataFrame:
    """Bookings of the period with patient and machine."""
    joined = (
        filters.date_between(schedule, "schedule_date", start, end)
        .join(_patient_side(patients, "medical_id", "virus_status"), "patient_id")
        .join(_machine_side(machines), "machine_id")
    )
    columns = ["id", "patient_id", "machine_id", "schedule_date", "shift", "notes"]
    return ordered_listing(
        joined.select(*columns, "patient_name", "medical_id", "virus_status", *MACHINE_COLUMNS),
        ["schedule_date", "shift", "id"],
    )


def unscheduled(
    patients: DataFrame, schedule: DataFrame, start: S.DateLike, end: S.DateLike
) -> DataFrame:
    """Patients without a booking in the period."""
    booked = filters.date_between(schedule, "schedule_date", start, end).select(F.col("patient_id").alias("id"))
    return (
        patients.join(booked.distinct(), "id", "left_anti")
        .select("id", "name", "medical_id", "virus_status")
        .orderBy("name", "id")
    )


def offered_machines(machines: DataFrame) -> DataFrame:
    return filters.in_set(machines, "status", OFFERED).select("id", "serial_number", "ward", "internal_unit", "status")


def book_slots(schedule: DataFrame, requests: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Bookings granted first come, first served: one per machine, date and shift, and
    one per patient and date. Log: the request and its verdict."""
    needed = ["patient_id", "machine_id", "schedule_date", "shift"]
    valid, bad = split_valid(require(requests, needed))
    judged = admit_first_come(valid, BOOKING_RULES, order, {name: schedule for name in BOOKING_RULES})
    # Read for the numbers' ranges, for the numbers and for the log.
    judged = stored(judged, "bookings-judged")
    granted = with_new_ids(judged.where("verdict = 'accepted'"), schedule, order)
    log = judged.unionByName(
        bad.withColumn("verdict", F.array_join("reasons", "; ")).drop("reasons")
    )
    return schedule.unionByName(conform(granted, schedule, {"status": "Scheduled"})), log


SESSION_KEY = ["patient_id", "session_date"]


def session_rules(batch: DataFrame, sessions: DataFrame, as_of: S.DateLike, order: list[str]) -> DataFrame:
    """Adds `verdict`: accepted, missing field, future date, or second session of the day."""
    checked = require(batch, SESSION_KEY, {"future date": F.col("session_date") <= S.as_date(as_of)})
    valid, _ = split_valid(checked)
    judged = admit_first_come(valid, {"second session": SESSION_KEY}, order, {"second session": sessions})
    bad = checked.where(F.size("reasons") > 0).select(*batch.columns, F.col("reasons")[0].alias("verdict"))
    return judged.unionByName(bad)


SESSION_DEFAULTS = {"blood_transfusion_bags": 0, "machine_hours_operated": 0.0}


def add_sessions(
    sessions: DataFrame, batch: DataFrame, as_of: S.DateLike, order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Appends the sessions that keep the rules."""
    return append(
        sessions,
        batch,
        order,
        SESSION_KEY,
        {"session of the day": SESSION_KEY},
        {"future date": F.col("session_date") <= S.as_date(as_of)},
        SESSION_DEFAULTS,
    )


def record_transfusions(sessions: DataFrame, batch: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sets bags and notes of sessions from (id, blood_transfusion_bags, notes) rows.

    Bag counts that are not whole numbers from 0 up are refused. Log: id, action.
    """
    given = F.col("__given")
    rules = {
        "missing field": given.isNotNull() & F.col("notes").isNotNull(),
        "bad bag count": S.is_non_negative_int(given),
    }
    rows = batch.withColumn("__given", F.col("blood_transfusion_bags")).withColumn(
        "blood_transfusion_bags", S.int_part("blood_transfusion_bags")
    )
    return update_by_key(sessions, rows, "id", ["blood_transfusion_bags", "notes"], order, rules=rules)
