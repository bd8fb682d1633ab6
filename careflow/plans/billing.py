"""Prices, single and monthly invoices."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from careflow.functions import filters, scalars as S
from careflow.operators.ordered import number_rows


def settings(table: DataFrame) -> DataFrame:
    """One row of prices; a missing row and a 0 or NULL price take the fallback."""
    row = table.where("id = 1").agg(
        F.max("price_per_session").alias("session"), F.max("price_per_blood_bag").alias("bag")
    )
    return row.select(
        S.number_or_default("session", S.DEFAULT_SESSION_PRICE).alias("price_per_session"),
        S.number_or_default("bag", S.DEFAULT_BAG_PRICE).alias("price_per_blood_bag"),
    )


def _month_totals(sessions: DataFrame, month: str) -> DataFrame:
    """Per patient: session count, bags, first and last date. Combined before the shuffle."""
    return (
        filters.in_month(sessions, "session_date", month)
        .groupBy("patient_id")
        .agg(
            F.count(F.lit(1)).alias("session_count"),
            F.sum(F.coalesce("blood_transfusion_bags", F.lit(0))).alias("total_bags"),
            F.min("session_date").alias("first_session_date"),
            F.max("session_date").alias("last_session_date"),
        )
    )


def _priced(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds the prices as scalar subqueries and the amounts."""
    one = settings(prices)
    return (
        rows.withColumn("price_per_session", one.select("price_per_session").scalar())
        .withColumn("price_per_blood_bag", one.select("price_per_blood_bag").scalar())
        .withColumn("total_sessions_price", F.col("session_count") * F.col("price_per_session"))
        .withColumn("total_blood_price", F.col("total_bags") * F.col("price_per_blood_bag"))
        .withColumn("grand_total", F.col("total_sessions_price") + F.col("total_blood_price"))
    )


INVOICE = [
    "session_count", "total_bags", "price_per_session", "price_per_blood_bag",
    "total_sessions_price", "total_blood_price", "grand_total",
    "first_session_date", "last_session_date",
]


def invoice(
    patients: DataFrame, sessions: DataFrame, prices: DataFrame, patient_id: Any, month: str
) -> DataFrame:
    """One patient's month; zeros and no dates without a session."""
    person = patients.where(F.col("id") == F.lit(patient_id)).select(
        "id", "name", "medical_id", "national_id", "referral_place"
    )
    totals = _month_totals(sessions.where(F.col("patient_id") == F.lit(patient_id)), month)
    rows = person.join(totals.withColumnRenamed("patient_id", "id"), "id", "left").na.fill(
        0, ["session_count", "total_bags"]
    )
    return _priced(rows, prices).select(*person.columns, F.lit(month).alias("billing_month"), *INVOICE)


def bulk_invoices(
    patients: DataFrame, sessions: DataFrame, prices: DataFrame, month: str, unit: str | None = None
) -> DataFrame:
    """An invoice for every patient with a session in the month, by name.

    Sessions are added up per patient before the join; 'all' means no unit filter.
    """
    people = filters.equals_if_given(patients, {"dialysis_unit": None if unit == "all" else unit})
    totals = _month_totals(sessions, month).withColumnRenamed("patient_id", "id")
    rows = _priced(people.join(totals, "id"), prices)
    return rows.select(
        "id", "name", "medical_id", "national_id", "referral_place", "referral_date", "dialysis_unit",
        F.lit(month).alias("billing_month"), *INVOICE,
    ).orderBy("name", "id")


def invoice_export(
    patients: DataFrame, sessions: DataFrame, prices: DataFrame, month: str, unit: str | None = None
) -> DataFrame:
    """The invoice sheet: invoice id, claim period and amounts."""
    return bulk_invoices(patients, sessions, prices, month, unit).select(
        S.invoice_id(month, "id").alias("invoice_id"),
        F.col("name").alias("patient_name"),
        "medical_id",
        "dialysis_unit",
        "national_id",
        "referral_date",
        "referral_place",
        S.claim_period("first_session_date", "last_session_date", month).alias("claim_period"),
        "session_count",
        "price_per_session",
        "total_sessions_price",
        "total_bags",
        "price_per_blood_bag",
        "total_blood_price",
        "grand_total",
    )


# Display labels of the invoice sheet.
INVOICE_LABELS = {
    "invoice_id": "رقم الفاتورة",
    "patient_name": "اسم المريض",
    "medical_id": "الرقم الطبي",
    "dialysis_unit": "الوحدة الداخلية",
    "national_id": "الرقم القومي",
    "referral_date": "تاريخ الإحالة",
    "referral_place": "جهة التغطية",
    "claim_period": "فترة المطالبة",
    "session_count": "عدد الجلسات",
    "price_per_session": "سعر الجلسة",
    "total_sessions_price": "إجمالي الجلسات",
    "total_bags": "عدد أكياس الدم",
    "price_per_blood_bag": "سعر كيس الدم",
    "total_blood_price": "إجمالي الدم",
    "grand_total": "الإجمالي الكلي",
}


def numbered_invoices(
    patients: DataFrame, sessions: DataFrame, prices: DataFrame, month: str, unit: str | None = None
) -> DataFrame:
    """Invoices with their place in the name order."""
    rows = bulk_invoices(patients, sessions, prices, month, unit)
    return number_rows(rows, ["name", "id"], "invoice_number")
