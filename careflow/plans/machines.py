"""Maintenance records with their machine."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from careflow.functions import filters
from careflow.operators.paging import ordered_listing


def maintenance_with_machine(records: DataFrame, machines: DataFrame, record_id: Any = None) -> DataFrame:
    """Maintenance records, newest first; a record whose machine is gone stays."""
    names = machines.select(F.col("id").alias("machine_id"), F.col("serial_number").alias("machine_name"))
    rows = filters.equals_if_given(records, {"id": record_id})
    joined = rows.join(names, "machine_id", "left").select(*records.columns, "machine_name")
    return ordered_listing(joined, ["-date", "-id"])
