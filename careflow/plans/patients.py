"""Patient lists, archive and restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from careflow.functions import filters, scalars as S
from careflow.operators.changes import append_to, conform, update_by_key, without
from careflow.operators.joins import join_unique
from careflow.operators.paging import ordered_listing, page_info, paginate
from careflow.schemas import UNIQUE
from careflow.session import materialise

SEARCH_COLUMNS = ["name", "medical_id", "national_id"]

# Searched columns of each archive, and the reason that keeps a death date.
ARCHIVE_SEARCH = {
    "patients": ["name", "medical_id", "national_id", "archive_reason"],
    "staff": ["name", "national_id", "job_title"],
    "sessions": ["patient_name", "patient_medical_id", "session_date"],
}
DEATH = "وفاة"
ARCHIVE_COLUMNS = ["archive_reason", "archive_details", "date_of_death", "archived_at"]


# Display names of the patient sheet's columns.
EXPORT_LABELS = {
    "name": "الاسم الكامل",
    "medical_id": "الرقم الطبي",
    "national_id": "الرقم القومي",
    "age": "العمر",
    "dob": "تاريخ الميلاد",
    "gender": "الجنس",
    "blood_type": "فصيلة الدم",
    "phone": "رقم الهاتف",
    "address": "العنوان",
    "added_date": "تاريخ الإضافة",
    "referral_date": "تاريخ الإحالة",
    "referral_expiry": "انتهاء الإحالة",
    "referral_place": "مكان الإحالة",
    "dialysis_unit": "الوحدة الداخلية",
    "virus_status": "حالة الفيروسات",
    "chronic_diseases": "الأمراض المزمنة",
    "dialysis_days": "أيام الغسيل الثابتة",
    "dialysis_shift": "الشفت",
    "patient_notes": "ملاحظات المريض",
}


def with_age(patients: DataFrame, as_of: S.DateLike) -> DataFrame:
    return patients.withColumn("age", S.age_years("dob", as_of))


def filter_patients(
    patients: DataFrame,
    as_of: S.DateLike,
    term: str | None = None,
    place: str | None = None,
    weekday: str | None = None,
    unit: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """All given conditions together."""
    rows = filters.search(patients, term, SEARCH_COLUMNS)
    rows = filters.contains(rows, "referral_place", place)
    rows = filters.has_token(rows, "dialysis_days", weekday) if weekday else rows
    rows = filters.equals_if_given(rows, {"dialysis_unit": unit})
    return filters.expiry_status(rows, "referral_expiry", as_of, status) if status else rows


def patient_list(
    patients: DataFrame, as_of: S.DateLike, page: int = 1, limit: int = 15, **conditions: str | None
) -> DataFrame:
    """One page of the filtered patients by name, with age."""
    rows = with_age(filter_patients(patients, as_of, **conditions), as_of)
    return paginate(rows, ["name", "id"], page, limit)


def patient_list_info(
    patients: DataFrame, as_of: S.DateLike, limit: int = 15, **conditions: str | None
) -> DataFrame:
    return page_info(filter_patients(patients, as_of, **conditions), limit)


def newest_patients(patients: DataFrame, start: S.DateLike, end: S.DateLike) -> DataFrame:
    rows = filters.date_between(patients, "added_date", start, end)
    return ordered_listing(rows.select("id", "name", "medical_id", "added_date"), ["-added_date", "id"])


# The columns an edit of a patient sets.
EDITED = [
    "name", "phone", "address", "added_date", "referral_date", "referral_expiry", "referral_place", "dialysis_unit",
    "blood_type", "chronic_diseases", "virus_status", "patient_notes", "dialysis_days", "dialysis_shift",
]
EDIT_REQUIRED = ["name", "added_date", "referral_date", "dialysis_unit", "virus_status"]


def _with_expiry(batch: DataFrame) -> DataFrame:
    """The referral runs for the given months, or 12."""
    months = "referral_duration_months"
    given = F.col(months) if months in batch.columns else F.lit("")
    return batch.withColumn("referral_expiry", S.referral_expiry("referral_date", given))


def add_patients(patients: DataFrame, batch: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Appends valid new patients. Log: order columns, action, reason."""
    return append_to("patients", patients, _with_expiry(batch), order)


def edit_patients(patients: DataFrame, batch: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sets the edited columns of existing patients. Log: id, action."""
    rows = _with_expiry(batch)
    cols = [c for c in EDITED if c in patients.columns and c in rows.columns]
    return update_by_key(patients, rows, "id", cols, order, EDIT_REQUIRED, keysets=UNIQUE["patients"])


def archive(
    active: DataFrame,
    archived: DataFrame,
    ids: DataFrame,
    reason: str,
    details: str | None,
    death_date: S.DateLike | None,
    archived_at: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves patients to the archive; unknown ids are skipped.

    Returns active, archived, log (id, action).
    """
    wanted = materialise(ids.select("id").distinct())
    died = S.as_date(death_date) if reason == DEATH and death_date is not None else F.lit(None).cast("date")
    moved = (
        join_unique(active, wanted, ["id"], "left_semi")
        .withColumn("archive_reason", F.lit(reason))
        .withColumn("archive_details", F.lit(details).cast("string"))
        .withColumn("date_of_death", died)
        .withColumn("archived_at", F.lit(archived_at).cast("timestamp"))
    )
    kept = without(archived, materialise(moved.select("id")), ["id"])
    return (
        without(active, wanted, ["id"]),
        kept.unionByName(conform(moved, archived)),
        _move_log(wanted, moved, "archived"),
    )


def unarchive(
    active: DataFrame, archived: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves patients back as not archived, without the archive columns."""
    wanted = materialise(ids.select("id").distinct())
    moved = join_unique(archived, wanted, ["id"], "left_semi").drop(*ARCHIVE_COLUMNS).withColumn("is_archived", F.lit(0))
    kept = without(active, materialise(moved.select("id")), ["id"])
    return (
        kept.unionByName(conform(moved, active)),
        without(archived, wanted, ["id"]),
        _move_log(wanted, moved, "restored"),
    )


def _move_log(wanted: DataFrame, moved: DataFrame, action: str) -> DataFrame:
    done = moved.select("id", F.lit(True).alias("__done"))
    return wanted.join(done, "id", "left").select(
        "id", F.when(F.col("__done"), action).otherwise("skipped").alias("action")
    )


def archive_listing(archived: DataFrame, kind: str, term: str | None = None, page: int = 1, limit: int = 15) -> DataFrame:
    """One page of an archive, latest archived first."""
    rows = filters.search(archived, term, ARCHIVE_SEARCH[kind])
    return paginate(rows, ["-archived_at", "id"], page, limit)
