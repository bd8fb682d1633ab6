"""Import of patient and machine sheets from text staging tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from careflow.functions import scalars as S
from careflow.operators.changes import require, split_valid, unique
from careflow.schemas import UNIQUE
from careflow.session import stored


@dataclass(frozen=True)
class SheetSpec:
    """Columns in sheet order, required ones, dates, and where the row label comes from."""

    table: str
    columns: list[str]
    required: list[str]
    dates: list[str]
    label: list[str]
    derived: dict[str, tuple[str, int]] = field(default_factory=dict)


# The sheets and the fields they must fill.
PATIENT_SHEET = SheetSpec(
    table="patients",
    columns=[
        "name", "medical_id", "national_id", "dob", "gender", "blood_type", "phone", "address",
        "added_date", "referral_date", "referral_place", "dialysis_unit", "virus_status",
        "chronic_diseases", "dialysis_days", "dialysis_shift", "patient_notes",
    ],
    required=["name", "medical_id", "national_id", "added_date", "referral_date", "dialysis_unit", "virus_status"],
    dates=["dob", "added_date", "referral_date"],
    label=["name", "medical_id"],
    derived={"referral_expiry": ("referral_date", 12)},
)
MACHINE_SHEET = SheetSpec(
    table="machines",
    columns=["serial_number", "brand", "model", "ward", "internal_unit", "status", "last_maintenance", "notes"],
    required=["serial_number", "ward", "internal_unit", "status"],
    dates=["last_maintenance"],
    label=["serial_number"],
)

SHEET_ORDER = ["sheet_file", "sheet_part", "sheet_line"]


def read_sheet(spark: SparkSession, path: str, spec: SheetSpec) -> DataFrame:
    """A CSV sheet with a header line; cells by position, all text, with their place in the file."""
    schema = ", ".join(f"`{c}` string" for c in spec.columns)
    cells = spark.read.schema(schema).option("enforceSchema", True).csv(path, header=True)
    return cells.select(
        *spec.columns,
        F.col("_metadata.file_path").alias("sheet_file"),
        F.col("_metadata.file_block_start").alias("sheet_part"),
        F.monotonically_increasing_id().alias("sheet_line"),
    )


def import_rows(
    staging: DataFrame, spec: SheetSpec, existing: DataFrame, order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Accepted rows in table types, and rejected ones as (order, row label, reason).

    Cells are trimmed and blank rows skipped; a row is rejected when a required
    field is blank or a unique key is used by the table or an earlier row.
    """
    trimmed = staging.select(*order, *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in spec.columns])
    filled = trimmed.where(F.concat(*spec.columns) != "")
    parsed = filled.withColumns({c: S.parse_sheet_date(c) for c in spec.dates})
    parsed = parsed.withColumns({c: S.add_months_overflow(src, n) for c, (src, n) in spec.derived.items()})
    label = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in spec.label], F.lit("")).alias("row")

    # Parsed once: the checks below and both results read these rows.
    valid, bad = split_valid(stored(require(parsed, spec.required), "sheet-rows"))
    judged = unique(valid, UNIQUE[spec.table], order, existing)
    accepted = judged.where("verdict = 'accepted'").drop("verdict")
    rejected = bad.select(*order, label, F.array_join("reasons", "; ").alias("reason")).unionByName(
        judged.where("verdict <> 'accepted'").select(
            *order, label, F.concat(F.lit("duplicate "), "verdict").alias("reason")
        )
    )
    return accepted, rejected
