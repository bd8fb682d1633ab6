"""Lab results with their test types, and abnormal results."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from careflow.functions import filters, scalars as S
from careflow.operators.joins import join_unique
from careflow.operators.paging import ordered_listing

TYPE_COLUMNS = ["test_name", "unit", "result_type", "normal_range_low", "normal_range_high", "normal_value_text"]


def _with_types(results: DataFrame, types: DataFrame) -> DataFrame:
    """Few test types share all results, so a shuffle by test would use few tasks; the
    types are counted and broadcast."""
    return join_unique(results, types.select(F.col("id").alias("test_id"), *TYPE_COLUMNS), ["test_id"], "inner")


def _with_patients(results: DataFrame, patients: DataFrame, names: bool = True) -> DataFrame:
    """Inner join to patients; many results of one patient are split by adaptive skew joins."""
    people = patients.select(
        F.col("id").alias("patient_id"), *([F.col("name").alias("patient_name"), "medical_id"] if names else [])
    )
    return results.join(people, "patient_id")


def lab_results_enriched(
    results: DataFrame,
    patients: DataFrame,
    types: DataFrame,
    patient_id: Any = None,
    month: str | None = None,
    newest_first: bool = True,
) -> DataFrame:
    """Results of known patients with their test type."""
    rows = filters.equals_if_given(results, {"patient_id": patient_id})
    if month:
        rows = filters.in_month(rows, "result_date", month)
    sign = "-" if newest_first else ""
    joined = _with_patients(_with_types(rows, types), patients, names=False)
    return ordered_listing(
        joined.select(*results.columns, *TYPE_COLUMNS), [f"{sign}result_date", f"{sign}id"]
    )


def lab_result(results: DataFrame, types: DataFrame, result_id: Any) -> DataFrame:
    """One result with its test type."""
    rows = results.where(F.col("id") == F.lit(result_id))
    return _with_types(rows, types).select(*results.columns, *TYPE_COLUMNS)


def patient_lab_history(results: DataFrame, types: DataFrame, patient_id: Any) -> DataFrame:
    """One patient's results, oldest first."""
    rows = results.where(F.col("patient_id") == F.lit(patient_id))
    return ordered_listing(
        _with_types(rows, types).select(
            "id", "result_value", "result_date", "notes", "test_name", "unit", "normal_range_low", "normal_range_high"
        ),
        ["result_date", "id"],
    )


def abnormal_results(results: DataFrame, patients: DataFrame, types: DataFrame) -> DataFrame:
    """Results outside their normal range or text. The test is made before patients are joined."""
    judged = _with_types(results, types).where(
        S.abnormal("result_type", "result_value", "normal_range_low", "normal_range_high", "normal_value_text")
    )
    return _with_patients(judged, patients).select(
        "id", "patient_id", "test_id", "result_value", "result_date", "patient_name", "medical_id", *TYPE_COLUMNS
    )


def critical_labs(results: DataFrame, patients: DataFrame, types: DataFrame, k: int = 20) -> DataFrame:
    """The k newest abnormal results."""
    return ordered_listing(abnormal_results(results, patients, types), ["-result_date", "patient_name", "id"]).limit(k)
