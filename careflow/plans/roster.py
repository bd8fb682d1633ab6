"""Staff rosters: effective shifts, hours, saving of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from careflow.functions import filters, scalars as S
from careflow.operators.changes import replace_by_key, require, split_valid


def roster_inputs(staff: DataFrame, changes: DataFrame, month: str, job: str | None = None) -> DataFrame:
    """Staff with the month's overrides, one row per override or one without."""
    people = filters.equals_if_given(staff, {"job_title": job}).select("id", "name", "default_shift")
    month_changes = filters.in_month(changes, "shift_date", month).select(
        F.col("staff_id").alias("id"), "shift_date", "new_shift_type"
    )
    return people.join(month_changes, "id", "left").orderBy("name", "id", "shift_date")


def _effective(staff: DataFrame, changes: DataFrame, month: str, job: str | None) -> tuple[DataFrame, list[str]]:
    """One row per staff member with the shift of every day of the month.

    Overrides are pivoted over the known days, so no calendar has to be joined to
    the staff.
    """
    days = [d.day for d in S.month_days(month)]
    names = [f"day{d}" for d in days]
    spread = (
        filters.in_month(changes, "shift_date", month)
        .select(F.col("staff_id").alias("id"), F.dayofmonth("shift_date").alias("day"), "new_shift_type")
        .groupBy("id")
        .pivot("day", days)
        .agg(F.max("new_shift_type"))
        .toDF("id", *names)
    )
    people = filters.equals_if_given(staff, {"job_title": job}).select("id", "name", "default_shift")
    shifts = [F.coalesce(F.col(n), F.col("default_shift"), F.lit("")).alias(n) for n in names]
    return people.join(spread, "id", "left").select("id", "name", *shifts), names


def roster_sheet(staff: DataFrame, changes: DataFrame, month: str, job: str | None = None) -> DataFrame:
    """Staff by day with the effective shift, and the total hours."""
    rows, names = _effective(staff, changes, month, job)
    hours = F.aggregate(F.array(*names), F.lit(0).cast("bigint"), lambda total, code: total + S.shift_hours(code))
    return rows.withColumn("total_hours", hours).orderBy("name", "id")


def roster_hours(staff: DataFrame, changes: DataFrame, month: str, job: str | None = None) -> DataFrame:
    """Total hours: the default shift on every day without an override, and the overrides."""
    per_day = filters.in_month(changes, "shift_date", month).groupBy(F.col("staff_id").alias("id"), "shift_date")
    # One code per day first, as in the sheet; then two numbers per staff member.
    codes = per_day.agg(F.max("new_shift_type").alias("code")).where(F.col("code").isNotNull())
    overrides = codes.groupBy("id").agg(
        F.count(F.lit(1)).alias("days"), F.sum(S.shift_hours("code").cast("bigint")).alias("hours")
    )
    people = filters.equals_if_given(staff, {"job_title": job}).select("id", "name", "default_shift")
    plain = F.lit(len(S.month_days(month))) - F.coalesce("days", F.lit(0))
    total = plain * S.shift_hours(F.coalesce("default_shift", F.lit(""))) + F.coalesce("hours", F.lit(0))
    return (
        people.join(overrides, "id", "left")
        .select("id", "name", total.cast("bigint").alias("total_hours"))
        .orderBy("name", "id")
    )


SHIFT_KEY = ["staff_id", "shift_date"]


def change_shifts(changes: DataFrame, batch: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Single shift changes (staff_id, shift_date, new_shift_type, substitute_staff_id, notes).

    A row of the same staff member and day is replaced whole, with the new substitute (0 counts as
    none) and notes. Log: staff_id, shift_date, action; a row without staff, date or shift is refused.
    """
    kept = ["staff_id", "shift_date", "new_shift_type", "substitute_staff_id", "notes"]
    rows = batch.select(*dict.fromkeys([*kept, *order]))
    rows = rows.withColumn("substitute_staff_id", F.nullif("substitute_staff_id", F.lit(0)))
    valid, bad = split_valid(require(rows, kept[:3]))
    state, log = replace_by_key(changes, valid, SHIFT_KEY, order)
    refused = F.concat(F.lit("refused: "), F.array_join("reasons", "; "))
    return state, log.unionByName(bad.select(*SHIFT_KEY, refused.alias("action")))


def roster_labels(month: str) -> dict[str, str]:
    """Display names of the roster sheet's columns."""
    days = {f"day{d.day}": str(d.day) for d in S.month_days(month)}
    return {"name": "الموظف", **days, "total_hours": "الإجمالي"}


def save_roster(
    changes: DataFrame, batch: DataFrame, month: str, order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Saves (staff_id, day, shift_code) rows of the month; a saved row replaces the old
    one whole, so its notes and substitute are cleared. Log: staff_id, shift_date, action;
    a row without staff, shift or a day of the month is refused with its reasons."""
    rows = batch.withColumn("shift_date", S.date_of(month, "day")).withColumnRenamed("shift_code", "new_shift_type")
    rows = rows.select("staff_id", "shift_date", "new_shift_type", *order)
    valid, bad = split_valid(require(rows, ["staff_id", "new_shift_type"], {"no such day": F.col("shift_date").isNotNull()}))
    state, log = replace_by_key(changes, valid, ["staff_id", "shift_date"], order)
    refused = F.concat(F.lit("refused: "), F.array_join("reasons", "; "))
    return state, log.unionByName(bad.select("staff_id", "shift_date", refused.alias("action")))
