import random
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from careflow.schemas import TABLES, UNIQUE
from careflow.session import shared_folder, shared_path
from careflow.sources import sheets, sinks, tables
from tests.conftest import rows


@pytest.fixture
def folder(spark):
    return shared_path(spark, "test")


def test_every_schema_parses(spark):
    for name in TABLES:
        assert "id" in tables.table_schema(name).fieldNames()


def test_table_round_trip_with_text_dates_and_missing_columns(spark, folder):
    stored = spark.createDataFrame(
        [(1, 5, "2025-03-01", None), (2, 5, " ", 2), (3, 5, "2025-13-01", 1)],
        "id bigint, patient_id bigint, session_date string, blood_transfusion_bags int",
    )
    stored.write.parquet(f"{folder}/sessions")
    df = tables.read_table(spark, folder, "sessions")
    assert df.schema == tables.table_schema("sessions")
    assert rows(df, "id", "session_date", "blood_transfusion_bags", "status") == [
        (1, date(2025, 3, 1), None, None), (2, None, 2, None), (3, None, 1, None),
    ]


def test_large_tables_are_written_by_month(spark, folder):
    df = spark.range(400).select(
        "id", F.lit(1).cast("bigint").alias("patient_id"), F.date_add(F.lit("2025-01-20").cast("date"), F.col("id").cast("int") % 40).alias("session_date"),
        F.lit(None).cast("bigint").alias("blood_transfusion_bags"),
    )
    tables.write_table(df, folder, "sessions")
    assert sorted(p.name for p in Path(folder.removeprefix("file:"), "sessions").glob("month=*")) == ["month=2025-01", "month=2025-02"]
    back = tables.read_table(spark, folder, "sessions")
    assert back.count() == 400 and back.where("blood_transfusion_bags = 0").count() == 400


def test_report_files(spark, folder):
    df = spark.createDataFrame([(1, "ب", date(2025, 1, 1)), (2, None, None)], "id int, name string, d date")
    labels = {"name": "الاسم", "d": "التاريخ"}
    sinks.write_report(df, f"{folder}/csv", "csv", labels)
    back = spark.read.csv(f"{folder}/csv", header=True)
    assert back.columns == list(labels.values()) and rows(back) == [(None, None), ("ب", "2025-01-01")]
    for fmt in ("json", "parquet"):
        sinks.write_report(df, f"{folder}/{fmt}", fmt)
        assert spark.read.format(fmt).load(f"{folder}/{fmt}").count() == 2


def test_sql_dump_files_load_in_order(spark, folder):
    data = {
        "machines": spark.createDataFrame([(1, "O'1", None)], "id bigint, serial_number string, notes string"),
        "sessions": spark.createDataFrame([(1, 2.0), (2, 2.5)], "id bigint, machine_hours_operated double"),
        "ignored": spark.range(1),
    }
    sinks.write_sql_dump(spark, data, folder, "2025-01-01T00:00:00Z")
    local = Path(folder.removeprefix("file:"))
    parts = sorted(p.name for p in local.iterdir())
    assert parts == ["00-begin", "01-sessions", "02-machines", "99-end"]
    text = [line for part in parts for f in sorted((local / part).glob("part-*")) for line in f.read_text().splitlines()]
    assert text[1:3] == ["PRAGMA foreign_keys=OFF;", "BEGIN TRANSACTION;"] and text[-1] == "COMMIT;"
    assert sorted(text[3:-1]) == [
        "INSERT INTO machines (id, serial_number, notes) VALUES ('1', 'O''1', NULL);",
        "INSERT INTO sessions (id, machine_hours_operated) VALUES ('1', '2');",
        "INSERT INTO sessions (id, machine_hours_operated) VALUES ('2', '2.5');",
    ]


def test_snapshots_newest_first(spark, folder):
    for stamp in ("2025-01-01T00:00:00.000Z", "2025-01-02T00:00:00.000Z"):
        path = sinks.snapshot({"a": spark.range(100), "b": spark.range(3)}, folder, stamp)
        assert spark.read.parquet(f"{path}/b").count() == 3
    got = sinks.list_snapshots(spark, folder).collect()
    assert [r.name for r in got] == ["backup-2025-01-02T00-00-00-000Z", "backup-2025-01-01T00-00-00-000Z"]
    assert all(r.size_kb > 0 for r in got)


def test_patient_sheet_from_csv(spark, folder):
    local = Path(folder.removeprefix("file:"))
    local.mkdir(parents=True)
    head = ",".join(sheets.PATIENT_SHEET.columns)
    full = "{name},{med},{nat},1990-01-01,,,,,2025-01-02,2024-02-29,,Unit,سلبي,,,,"
    lines = [
        full.format(name=" One ", med="m1", nat="n1"),
        "," * 16,
        full.format(name="Two", med="m1", nat="n2"),
        full.format(name="Three", med="m3", nat="n2"),
        full.format(name="", med="m4", nat="n4"),
        full.format(name="Five", med="m5", nat="n0"),
    ]
    (local / "sheet.csv").write_text("\n".join([head, *lines]) + "\n", encoding="utf-8")
    staging = sheets.read_sheet(spark, f"{folder}/sheet.csv", sheets.PATIENT_SHEET)
    existing = spark.createDataFrame([("m0", "n0")], "medical_id string, national_id string")
    accepted, rejected = sheets.import_rows(staging, sheets.PATIENT_SHEET, existing, sheets.SHEET_ORDER)
    assert rows(accepted, "name", "added_date", "referral_expiry") == [
        ("One", date(2025, 1, 2), date(2025, 3, 1)), ("Three", date(2025, 1, 2), date(2025, 3, 1)),
    ]
    assert rows(rejected, "row", "reason") == [
        ("Five", "duplicate national_id"), ("Two", "duplicate medical_id"), ("m4", "missing name"),
    ]


def test_sheet_uniqueness_equals_row_by_row(spark):
    rng = random.Random(5)
    data = [(i, f"m{rng.randrange(60)}", f"n{rng.randrange(80)}") for i in range(200)]
    seen, expected = {"m": set(), "n": set()}, []
    for i, m, n in data:
        if m not in seen["m"] and n not in seen["n"]:
            expected.append((i,))
            seen["m"].add(m), seen["n"].add(n)
    batch = spark.createDataFrame(data, "line int, medical_id string, national_id string")
    fixed = {c: F.lit("2025-01-01" if "date" in c else "x") for c in sheets.PATIENT_SHEET.columns if c not in UNIQUE["patients"]}
    none = batch.where("line < 0")
    accepted, _ = sheets.import_rows(batch.withColumns(fixed), sheets.PATIENT_SHEET, none, ["line"])
    assert rows(accepted, "line") == expected


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.sparkContext.getCheckpointDir()
