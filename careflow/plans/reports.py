"""Counts, period and daily reports, attendance and missed sessions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from careflow.functions import filters, scalars as S
from careflow.operators.joins import join_many

# Virus status counted on its own.
VIRUS_COLUMNS = {
    "negative": "سلبي",
    "positive_b": "ايجابي فيروس B",
    "positive_c": "ايجابي فيروس C",
}
TICK = "✔"

# Days kept in one whole number.
WORD = 60


def _counts(fact: DataFrame, fk: str, name: str) -> DataFrame:
    """Rows per foreign key, combined before the shuffle, so hot keys stay small."""
    return fact.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("id")).agg(F.count(F.lit(1)).alias(name))


def sessions_per_machine(sessions: DataFrame, machines: DataFrame) -> DataFrame:
    names = machines.select("id", F.col("serial_number").alias("machine_name"))
    return (
        _counts(sessions, "machine_id", "session_count")
        .join(names, "id")
        .select(F.col("id").alias("machine_id"), "machine_name", "session_count")
        .orderBy(F.desc("session_count"), "machine_id")
    )


def sessions_per_patient(sessions: DataFrame, patients: DataFrame) -> DataFrame:
    names = patients.select("id", F.col("name").alias("patient_name"), "medical_id")
    return (
        _counts(sessions, "patient_id", "session_count")
        .join(names, "id")
        .select(F.col("id").alias("patient_id"), "patient_name", "medical_id", "session_count")
        .orderBy(F.desc("session_count"), "patient_id")
    )


def top_patients(
    sessions: DataFrame, patients: DataFrame, start: S.DateLike, end: S.DateLike, k: int = 10
) -> DataFrame:
    """The k patients with most sessions in the period."""
    return sessions_per_patient(filters.date_between(sessions, "session_date", start, end), patients).limit(k)


def period_summary(sessions: DataFrame, start: S.DateLike, end: S.DateLike) -> DataFrame:
    """Sessions per date, and the total in the row without a date."""
    daily = (
        filters.date_between(sessions, "session_date", start, end)
        .groupBy("session_date")
        .agg(F.count(F.lit(1)).alias("session_count"))
    )
    return _with_total(daily, ["session_count"]).orderBy(F.col("session_date").asc_nulls_last())


def _with_total(groups: DataFrame, counters: list[str]) -> DataFrame:
    """Adds a row with the sums of the groups, also when there are none.

    Sums the aggregated groups, whose shuffle both branches share.
    """
    sums = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])
    return groups.unionByName(sums, allowMissingColumns=True)


def _metrics(df: DataFrame, metrics: dict[tuple[str, str], Column]) -> DataFrame:
    """All conditional counts of one table in one scan, as (period, metric, value) rows."""
    row = df.agg(*[F.count_if(cond).alias(f"{p}|{m}") for (p, m), cond in metrics.items()])
    pairs = F.array(
        *[
            F.struct(F.lit(p).alias("period"), F.lit(m).alias("metric"), F.col(f"{p}|{m}").alias("value"))
            for p, m in metrics
        ]
    )
    return row.select(F.inline(pairs))


def dashboard(
    patients: DataFrame,
    sessions: DataFrame,
    preventive: DataFrame,
    curative: DataFrame,
    staff: DataFrame,
    start: S.DateLike,
    end: S.DateLike,
    as_of: S.DateLike,
) -> DataFrame:
    """Counts of the period and of the equally long one before it. One scan per table."""
    start, end, today = S.as_date(start), S.as_date(end), S.as_date(as_of)
    prev_start, prev_end = S.previous_period(start, end)
    now, before = "current", "previous"

    expiry, added = F.col("referral_expiry"), F.col("added_date")
    day, bags = F.col("session_date"), F.col("blood_transfusion_bags")
    in_period, in_previous = day.between(start, end), day.between(prev_start, prev_end)
    # Only the two periods are read from the large table.
    held = sessions.where(day.between(prev_start, end))
    parts = [
        _metrics(
            patients,
            {
                (now, "total_patients"): F.lit(True),
                (now, "active_referrals"): expiry >= end,
                (now, "expired_referrals"): expiry < today,
                (now, "new_patients"): added.between(start, end),
                (before, "active_referrals"): expiry >= prev_end,
                (before, "expired_referrals"): expiry < prev_end,
                (before, "new_patients"): added.between(prev_start, prev_end),
            },
        ),
        _metrics(
            held,
            {
                (now, "total_sessions"): in_period,
                (now, "sessions_with_blood"): in_period & (bags > 0),
                (before, "total_sessions"): in_previous,
                (before, "sessions_with_blood"): in_previous & (bags > 0),
            },
        ),
        _metrics(
            filters.date_between(preventive, "maintenance_date", start, end),
            {(now, "preventive_maintenances"): F.lit(True)},
        ),
        _metrics(
            filters.date_between(curative, "report_date", start, end),
            {(now, "curative_maintenances"): F.lit(True)},
        ),
        _metrics(staff, {("other", "total_staff"): F.lit(True)}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_last_in_group(df: DataFrame, key: str, col: str) -> DataFrame:
    """First and last date of each key, as aggregates: no rows have to be sorted."""
    return df.groupBy(key).agg(F.min(col).alias(f"first_{col}"), F.max(col).alias(f"last_{col}"))


def sessions_with_blood(sessions: DataFrame, start: S.DateLike, end: S.DateLike) -> DataFrame:
    return filters.positive(filters.date_between(sessions, "session_date", start, end), "blood_transfusion_bags")


def distribution(df: DataFrame, col: str, label: str | None = S.UNSPECIFIED) -> DataFrame:
    """Rows per category; blank and NULL share the label. No label keeps them as they are."""
    category = S.label_or_default(col, label) if label else F.col(col)
    return df.groupBy(category.alias(col)).agg(F.count(F.lit(1)).alias("total"))


def age_distribution(patients: DataFrame, as_of: S.DateLike, dob: str = "dob") -> DataFrame:
    """Patients per age label, in label order."""
    rank = F.array_position(F.array(*[F.lit(g) for g in S.AGE_GROUPS]), F.col("age_group"))
    return (
        patients.groupBy(S.age_group(dob, as_of).alias("age_group"))
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy(rank)
    )


def monthly_trend(df: DataFrame, col: str, start: S.DateLike, end: S.DateLike) -> DataFrame:
    return (
        filters.date_between(df, col, start, end)
        .groupBy(S.month_label(col).alias("month"))
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy("month")
    )


def referral_status(patients: DataFrame, as_of: S.DateLike, col: str = "referral_expiry") -> DataFrame:
    """Active, expiring and expired referrals; expiring ones are active too."""
    return patients.agg(
        *[
            F.count_if(filters.expiry_condition(col, as_of, status)).alias(status)
            for status in ("active", "expiring", "expired")
        ]
    )


def count_by_unit(df: DataFrame, unit: str, name: str) -> DataFrame:
    """Rows per unit; archived patients do not count."""
    rows = df.where("is_archived = 0") if "is_archived" in df.columns else df
    return rows.groupBy(F.col(unit).alias("unit")).agg(F.count(F.lit(1)).alias(name))


def _unit_sessions(sessions: DataFrame, patients: DataFrame, day: S.DateLike) -> DataFrame:
    """Per non-blank unit of patients not archived: sessions of the day by virus status."""
    people = filters.non_blank(patients.where("is_archived = 0"), "dialysis_unit").select(
        "id", F.col("dialysis_unit").alias("unit"), "virus_status"
    )
    daily = _counts(sessions.where(F.col("session_date") == S.as_date(day)), "patient_id", "n")
    split = [
        F.sum(F.when(F.col("virus_status") == status, F.col("n")).otherwise(0)).alias(name)
        for name, status in VIRUS_COLUMNS.items()
    ]
    return daily.join(people, "id").groupBy("unit").agg(F.sum("n").alias("total"), *split)


SPLIT = ["total", *VIRUS_COLUMNS]


def sessions_by_unit_and_virus(sessions: DataFrame, patients: DataFrame, day: S.DateLike) -> DataFrame:
    """Sessions of the day per unit, and over all units in the row without a unit."""
    units = _unit_sessions(sessions, patients, day)
    return _with_total(units, SPLIT).orderBy(F.col("unit").asc_nulls_last())


def unit_daily_report(
    patients: DataFrame, machines: DataFrame, sessions: DataFrame, day: S.DateLike
) -> DataFrame:
    """Patients, machines and sessions of the day for every unit any of them names."""
    parts = [
        count_by_unit(patients, "dialysis_unit", "patient_count"),
        count_by_unit(machines, "internal_unit", "machine_count"),
        _unit_sessions(sessions, patients, day),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    counters = ["patient_count", "machine_count", *SPLIT]
    return (
        filters.non_blank(merged, "unit")
        .groupBy("unit")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])
        .orderBy("unit")
    )


def _session_patients(sessions: DataFrame, month: str) -> DataFrame:
    """Patients with a session in the month, each once."""
    return filters.in_month(sessions, "session_date", month).select(F.col("patient_id").alias("id")).distinct()


def missed_in_month(
    patients: DataFrame, sessions: DataFrame, month: str, unit: str | None = None
) -> DataFrame:
    """Patients not archived, added by the end of the month, without a session in it."""
    _, after = S.month_bounds(month)
    people = patients.where((F.col("is_archived") == 0) & (F.col("added_date") < after))
    return (
        filters.equals_if_given(people, {"dialysis_unit": unit})
        .join(_session_patients(sessions, month), "id", "left_anti")
        .select("id", "name", "medical_id", "phone", "dialysis_unit")
        .orderBy("name", "id")
    )


def attended_in_month(
    patients: DataFrame, sessions: DataFrame, month: str, unit: str | None = None
) -> DataFrame:
    return (
        filters.equals_if_given(patients, {"dialysis_unit": unit})
        .join(_session_patients(sessions, month), "id", "left_semi")
        .select("id", "name", "medical_id", "national_id", "referral_place")
        .orderBy("name", "id")
    )


def attendance_on(
    patients: DataFrame,
    sessions: DataFrame,
    day: S.DateLike,
    virus_status: str | None = None,
    unit: str | None = None,
) -> DataFrame:
    """`attendance` 'with': one row per session of the day; 'without': patients whose
    weekday it is and who have none."""
    people = filters.equals_if_given(patients, {"virus_status": virus_status, "dialysis_unit": unit})
    today = sessions.where(F.col("session_date") == S.as_date(day)).select(F.col("patient_id").alias("id"))
    columns = ["id", "name", "medical_id"]
    present = people.join(today, "id").select(F.lit("with").alias("attendance"), *columns)
    due = filters.has_token(people, "dialysis_days", S.weekday_token(S.as_date(day)))
    absent = due.join(today.distinct(), "id", "left_anti").select(F.lit("without").alias("attendance"), *columns)
    return present.unionByName(absent).orderBy("attendance", "name", "id")


def predicted_roster(
    patients: DataFrame, sessions: DataFrame, month: str, as_of: S.DateLike, unit: str | None = None
) -> DataFrame:
    """Expected dates of active patients in the month, and whether a session was held."""
    people = filters.equals_if_given(patients, {"dialysis_unit": unit})
    people = filters.non_blank(filters.expiry_status(people, "referral_expiry", as_of, "active"), "dialysis_days")
    # The month's dates of each weekday are constants; only those of a patient's days are made rows.
    given = S.tokens("dialysis_days")
    none = F.array().cast("array<date>")
    dates = [
        F.when(F.array_contains(given, name), F.array(*map(F.lit, days))).otherwise(none)
        for name, days in S.dates_by_weekday(month).items()
    ]
    expected = people.select("id", "name", F.explode(F.flatten(F.array(*dates))).alias("session_date"))
    held = (
        filters.in_month(sessions, "session_date", month)
        .select(F.col("patient_id").alias("id"), "session_date")
        .distinct()
        .withColumn("held", F.lit(True))
    )
    return (
        expected.join(held, ["id", "session_date"], "left")
        .select("id", "name", "session_date", F.coalesce("held", F.lit(False)).alias("held"))
        .orderBy("name", "id", "session_date")
    )


def predicted_inputs(patients: DataFrame, as_of: S.DateLike, unit: str | None = None) -> DataFrame:
    """Active patients with fixed weekdays, by name."""
    people = filters.equals_if_given(patients, {"dialysis_unit": unit})
    people = filters.non_blank(filters.expiry_status(people, "referral_expiry", as_of, "active"), "dialysis_days")
    return people.select("id", "name", "dialysis_days").orderBy("name", "id")


def monthly_cards(patients: DataFrame, sessions: DataFrame, month: str) -> DataFrame:
    """Per patient, the month's session dates with the number of sessions on each.

    Sessions are counted per date first, so an array has at most 31 entries.
    """
    per_day = (
        filters.in_month(sessions, "session_date", month)
        .groupBy("patient_id", "session_date")
        .agg(F.count(F.lit(1)).alias("sessions"))
    )
    cards = per_day.groupBy(F.col("patient_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("session_date", "sessions"))).alias("dates")
    )
    return (
        patients.select("id", "name", "medical_id").join(cards, "id").select("id", "name", "medical_id", "dates")
        .orderBy("name", "id")
    )


def attendance_sheet(
    patients: DataFrame, sessions: DataFrame, start: date, end: date, by: str = "date"
) -> DataFrame:
    """A row per patient with a session in the period and a tick per day attended.

    by='day_of_month' ticks every day that shares its day number with a session.
    """
    days = [start + timedelta(days=n) for n in range((end - start).days + 1)]
    held = filters.date_between(sessions, "session_date", start, end)
    if by == "day_of_month":
        place, places = F.dayofmonth("session_date"), [d.day for d in days]
    else:
        place, places = F.datediff("session_date", S.as_date(start)), list(range(len(days)))
    # The days a patient came are bits of a few whole numbers, which a hash
    # aggregate can update in place.
    words = range(max(places) // WORD + 1)
    masks = held.groupBy(F.col("patient_id").alias("id")).agg(
        *[
            F.bit_or(
                F.when(F.floor(place / WORD) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), place % WORD))
                .otherwise(F.lit(0).cast("bigint"))
            ).alias(f"__days{w}")
            for w in words
        ]
    )
    ticks = [
        F.when(F.col(f"__days{p // WORD}").bitwiseAND(F.lit(1 << (p % WORD)).cast("bigint")) != 0, TICK)
        .otherwise("")
        .alias(d.isoformat())
        for d, p in zip(days, places)
    ]
    people = patients.select(
        "id", "name", "medical_id", F.coalesce("dialysis_unit", F.lit("")).alias("dialysis_unit")
    )
    return people.join(masks, "id").select(*people.columns, *ticks).orderBy("name", "id")


def machines_with_maintenance(
    machines: DataFrame, preventive: DataFrame, curative: DataFrame, kind: str, day: S.DateLike
) -> DataFrame:
    """Every machine with its maintenance records of the period, newest first.

    One row per record; a machine without records has one row with NULL
    `maintenance`. Records are not gathered into arrays: their number per
    machine has no bound.
    """
    start, end = S.period_bounds(kind, day)
    records = filters.date_between(preventive, "maintenance_date", start, end).select(
        F.col("machine_id").alias("id"),
        F.lit("preventive").alias("maintenance"),
        F.col("id").alias("record_id"),
        F.col("maintenance_date").alias("record_date"),
        "technician_name", F.col("notes").alias("record_notes"), "visitor_name", "section",
    )
    repairs = filters.date_between(curative, "report_date", start, end).select(
        F.col("machine_id").alias("id"),
        F.lit("curative").alias("maintenance"),
        F.col("id").alias("record_id"),
        F.col("report_date").alias("record_date"),
        "request_number", "repair_date", "engineer_name", "cost", "parts_details", "failure_description", "repair_notes",
    )
    both = records.unionByName(repairs, allowMissingColumns=True)
    listing = machines.select(
        "id", "serial_number", "brand", "model", "ward", "internal_unit", "status", "last_maintenance", "notes"
    )
    joined = join_many(listing, both, ["id"]).select(*listing.columns, *[c for c in both.columns if c != "id"])
    return joined.orderBy(
        "serial_number", "id", F.desc("maintenance"), F.desc("record_date"), F.desc("record_id")
    )
