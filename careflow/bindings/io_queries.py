"""Sheet imports, report files, dumps, snapshots and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow.bindings.change_queries import LEDGER, LEDGER_LOG, MOVE_ORDER
from careflow.bindings.list_queries import ABNORMAL
from careflow.bindings.registry import query
from careflow.bindings.views import COUNTED, VIEWS
from careflow.plans import reports
from careflow.session import shared_path
from careflow.sources import sheets, sinks
from careflow.streaming import streams

SHEET_DATE = """CASE WHEN TRIM({c}) LIKE '____-__-__' THEN TRY_CAST(TRIM({c}) AS DATE)
  WHEN TRY_CAST(TRIM({c}) AS DOUBLE) <> 0
  THEN DATE '1970-01-01' + CAST(FLOOR(TRY_CAST(TRIM({c}) AS DOUBLE) - 25569) AS INT) END"""
PATIENT_IMPORT = f"""
t AS (SELECT line_no, TRIM(name) AS name, medical_id, national_id, {SHEET_DATE.format(c='dob')} AS dob,
    {SHEET_DATE.format(c='added_date')} AS added_date, {SHEET_DATE.format(c='referral_date')} AS referral_date,
    dialysis_unit, virus_status, line_no % {COUNTED["n_set"]} AS grp FROM patient_sheet),
c AS (SELECT *, CONCAT_WS('; ', CASE WHEN name = '' THEN 'missing name' END,
    CASE WHEN added_date IS NULL THEN 'missing added_date' END,
    CASE WHEN virus_status = '' THEN 'missing virus_status' END) AS bad FROM t),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY line_no) AS rn FROM c WHERE bad = ''),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, grp, CAST([] AS VARCHAR[]) AS meds, CAST([] AS VARCHAR[]) AS nats, '' AS verdict
  FROM (SELECT DISTINCT grp FROM r)
  UNION ALL
  SELECT rn, grp, CASE WHEN verdict = 'accepted' THEN LIST_APPEND(meds, medical_id) ELSE meds END,
    CASE WHEN verdict = 'accepted' THEN LIST_APPEND(nats, national_id) ELSE nats END, verdict
  FROM (SELECT r.rn, r.grp, w.meds, w.nats, r.medical_id, r.national_id,
      CASE WHEN LIST_CONTAINS(w.meds, r.medical_id) THEN 'duplicate medical_id'
        WHEN LIST_CONTAINS(w.nats, r.national_id) THEN 'duplicate national_id' ELSE 'accepted' END AS verdict
    FROM walk w JOIN r ON r.grp = w.grp AND r.rn = w.rn + 1))"""


def _import_patients(v):
    return sheets.import_rows(v.patient_sheet, sheets.PATIENT_SHEET, v.patients, ["line_no"])


@query(
    "import_patients",
    f"""WITH {PATIENT_IMPORT}
    SELECT r.line_no, r.name, r.medical_id, r.national_id, r.dob, r.added_date, r.referral_date,
      CAST(DATE_TRUNC('month', r.referral_date) + INTERVAL 12 MONTH AS DATE) + CAST(DAY(r.referral_date) - 1 AS INT)
        AS referral_expiry
    FROM r JOIN walk w ON w.grp = r.grp AND w.rn = r.rn WHERE w.verdict = 'accepted'""",
)
def import_patients(v):
    return _import_patients(v)[0].select(
        "line_no", "name", "medical_id", "national_id", "dob", "added_date", "referral_date", "referral_expiry"
    )


@query(
    "import_patients_rejected",
    f"""WITH {PATIENT_IMPORT}
    SELECT line_no, CASE WHEN name = '' THEN medical_id ELSE name END AS row, bad AS reason FROM c WHERE bad <> ''
    UNION ALL SELECT r.line_no, r.name, w.verdict FROM r JOIN walk w ON w.grp = r.grp AND w.rn = r.rn
    WHERE w.verdict <> 'accepted'""",
)
def import_patients_rejected(v):
    return _import_patients(v)[1]


MACHINE_IMPORT = f"""
t AS (SELECT line_no, TRIM(COALESCE(serial_number, '')) AS serial_number, COALESCE(brand, '') AS brand,
    TRIM(ward) AS ward, COALESCE(internal_unit, '') AS internal_unit, TRIM(status) AS status,
    {SHEET_DATE.format(c='last_maintenance')} AS last_maintenance FROM machine_sheet),
c AS (SELECT *, CONCAT_WS('; ', CASE WHEN serial_number = '' THEN 'missing serial_number' END,
    CASE WHEN ward = '' THEN 'missing ward' END, CASE WHEN internal_unit = '' THEN 'missing internal_unit' END,
    CASE WHEN status = '' THEN 'missing status' END) AS bad FROM t),
j AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY line_no) > 1
    OR serial_number IN (SELECT serial_number FROM machines) AS dup FROM c WHERE bad = '')"""


@query(
    "import_machines",
    f"""WITH {MACHINE_IMPORT} SELECT line_no, serial_number, brand, ward, internal_unit, status, last_maintenance
    FROM j WHERE NOT dup""",
)
def import_machines(v):
    accepted, _ = sheets.import_rows(v.machine_sheet, sheets.MACHINE_SHEET, v.machines, ["line_no"])
    return accepted.drop("model", "notes")


@query(
    "import_machines_rejected",
    f"""WITH {MACHINE_IMPORT} SELECT line_no, serial_number AS row, bad AS reason FROM c WHERE bad <> ''
    UNION ALL SELECT line_no, serial_number, 'duplicate serial_number' FROM j WHERE dup""",
)
def import_machines_rejected(v):
    return sheets.import_rows(v.machine_sheet, sheets.MACHINE_SHEET, v.machines, ["line_no"])[1]


def _insert_sql(name: str) -> str:
    quoted = []
    for col in VIEWS[name].columns:
        text = f"CAST({col} AS VARCHAR)"
        if col == "machine_hours_operated":
            text = f"CASE WHEN {col} = FLOOR({col}) THEN CAST(CAST({col} AS BIGINT) AS VARCHAR) ELSE {text} END"
        quoted.append(f"COALESCE('''' || REPLACE({text}, '''', '''''') || '''', 'NULL')")
    columns = ", ".join(VIEWS[name].columns)
    return (
        f"SELECT '{name}' AS table_name, 'INSERT INTO {name} ({columns}) VALUES (' || CONCAT_WS(', ', {', '.join(quoted)})"
        f" || ');' AS line FROM {name}"
    )


@query("sql_dump", " UNION ALL ".join(_insert_sql(name) for name in sinks.DUMPED))
def sql_dump(v):
    return sinks.sql_dump({name: getattr(v, name) for name in sinks.DUMPED})


@query(
    "write_report",
    """SELECT m.serial_number AS "الماكينة", CAST(COUNT(*) AS VARCHAR) AS "عدد الجلسات"
    FROM sessions s JOIN machines m ON s.machine_id = m.id GROUP BY m.id, m.serial_number""",
)
def write_report(v):
    path = shared_path(v.spark, "report")
    labels = {"machine_name": "الماكينة", "session_count": "عدد الجلسات"}
    sinks.write_report(reports.sessions_per_machine(v.sessions, v.machines), path, "csv", labels)
    return v.spark.read.csv(path, header=True)


SAVED = ["patients", "sessions", "machines", "medical_supplies", "lab_results"]


@query(
    "snapshot",
    " UNION ALL ".join(f"SELECT '{name}' AS table_name, COUNT(*) AS rows, MAX(id) AS max_id FROM {name}" for name in SAVED),
)
def snapshot(v):
    folder = sinks.snapshot({n: getattr(v, n) for n in SAVED}, shared_path(v.spark, "snapshots"), "2024-05-06T07:08:09.123Z")
    parts = [
        v.spark.read.parquet(f"{folder}/{n}").agg(
            F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.max("id").alias("max_id")
        )
        for n in SAVED
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "list_snapshots",
    """SELECT 'backup-2024-05-0' || CAST(day AS VARCHAR) || 'T00-00-00-000Z' AS name, TRUE AS has_size
    FROM (SELECT UNNEST([1, 2]) AS day)""",
)
def list_snapshots(v):
    base = shared_path(v.spark, "snapshots")
    for day in (1, 2):
        sinks.snapshot({"machines": v.machines}, base, f"2024-05-0{day}T00:00:00.000Z")
    return sinks.list_snapshots(v.spark, base).select("name", (F.col("size_kb") > 0).alias("has_size"))


def _stream(v, table: str, exprs: list[str]):
    # A file or a folder of that very name; a stream's path must be a folder or a pattern.
    schema = v.source(table).schema
    return v.spark.readStream.schema(schema).parquet(f"{v.folder}/{table}[.]parquet").selectExpr(*exprs)


def _columns(view: str) -> list[str]:
    return [f"{e} AS {c}" for c, e in VIEWS[view].columns.items()]


@query("stream_daily_counts", "SELECT CAST(ts AS DATE) AS session_date, COUNT(*) AS session_count FROM events GROUP BY 1")
def stream_daily_counts(v):
    rows = _stream(v, "events", ["CAST(ts AS TIMESTAMP) AS ts"])
    return streams.run_to_table(streams.daily_session_counts(rows, "ts"), shared_path(v.spark, "stream"), ["session_date"])


@query("stream_critical_alerts", ABNORMAL)
def stream_critical_alerts(v):
    alerts = streams.critical_alerts(_stream(v, "events", _columns("lab_results")), v.patients, v.lab_test_types)
    return streams.run_to_folder(alerts, shared_path(v.spark, "stream"))


DAY_RANK = """SELECT event_id, user_id AS patient_id, CAST(ts AS DATE) AS session_date,
    CASE WHEN CAST(ts AS DATE) > DATE '2024-01-25' THEN 'future date'
      WHEN ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) > 1 THEN 'second session'
      ELSE 'accepted' END AS verdict FROM events"""


def _judged_days(v):
    rows = _stream(v, "events", ["event_id", "user_id AS patient_id", "CAST(ts AS TIMESTAMP) AS ts"])
    judged = streams.one_session_a_day(rows, "ts", "2024-01-25", ["event_id"])
    return streams.run_split(judged, shared_path(v.spark, "stream"))


@query(
    "stream_one_session_a_day",
    f"SELECT event_id, patient_id, session_date FROM ({DAY_RANK}) WHERE verdict = 'accepted'",
)
def stream_one_session_a_day(v):
    return _judged_days(v)[0].select("event_id", "patient_id", "session_date")


@query("stream_one_session_rejected", f"SELECT * FROM ({DAY_RANK}) WHERE verdict <> 'accepted'")
def stream_one_session_rejected(v):
    return _judged_days(v)[1].select("event_id", "patient_id", "session_date", "verdict")


def _ledger(v) -> str:
    folder = shared_path(v.spark, "ledger")
    moves = _stream(v, "lineitem", _columns("stock_movements"))
    streams.ledger_stream(v.spark, moves, v.medical_supplies, folder, MOVE_ORDER).awaitTermination()
    return folder


@query("stream_stock_ledger", LEDGER_LOG)
def stream_stock_ledger(v):
    return streams.ledger_log(v.spark, _ledger(v))


@query(
    "stream_stock_ledger_supplies",
    f"""WITH {LEDGER}, c AS (SELECT m.supply_id, SUM(CASE WHEN w.ok THEN m.change_amount END) AS change
      FROM m JOIN walk w ON w.supply_id = m.supply_id AND w.rn = m.rn GROUP BY 1)
    SELECT s.id, s.name, CAST(COALESCE(s.quantity, 0) + COALESCE(c.change, 0) AS BIGINT) AS quantity
    FROM medical_supplies s LEFT JOIN c ON c.supply_id = s.id""",
)
def stream_stock_ledger_supplies(v):
    return streams.ledger_stock(v.spark, v.medical_supplies, _ledger(v)).select("id", "name", "quantity")
