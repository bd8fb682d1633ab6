"""Inserts, edits, usage, shift changes and labelled exports: what the forms and export buttons do."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow.bindings.change_queries import MOVE_ORDER, NEW_PATIENTS, split_columns
from careflow.bindings.list_queries import AGE
from careflow.bindings.registry import AS_OF, EVENT_MONTH, MONTH, query
from careflow.bindings.report_queries import INVOICE_EXPORT, ROSTER_SHEET
from careflow.bindings.views import VIEWS
from careflow.operators import changes, paging
from careflow.plans import billing, inventory, patients, roster, schedule
from careflow.schemas import DEFAULTS, REQUIRED, UNIQUE
from careflow.session import shared_path
from careflow.sources import sheets, sinks, tables

# Batches of new rows as (source view, columns); `line` is the order of arrival.
INSERTS: dict[str, tuple[str, dict[str, str]]] = {
    "staff": (
        "patients",
        {
            "name": "CASE WHEN id % 53 = 0 THEN '' ELSE name END",
            "national_id": "CASE WHEN id % 4 = 0 THEN 'S' || CAST(id AS STRING) WHEN id % 7 = 0 THEN NULL ELSE 'T' || CAST(id - id % 3 AS STRING) END",
            "phone": "phone",
            "job_title": "dialysis_unit",
            "grade": "CASE WHEN id % 59 = 0 THEN NULL ELSE blood_type END",
            "default_shift": "'M'",
        },
    ),
    "lab_results": (
        "lab_results",
        {
            "patient_id": "CASE WHEN id % 50 = 0 THEN NULL ELSE patient_id + 1 END",
            "test_id": "test_id",
            "result_value": "CASE WHEN id % 37 = 0 THEN '' ELSE result_value END",
            "result_date": "CASE WHEN id % 41 = 0 THEN NULL ELSE result_date END",
            "notes": "'line ' || CAST(id AS STRING)",
        },
    ),
    "lab_test_types": (
        "lab_results",
        {
            "test_name": "CASE WHEN id % 43 = 0 THEN NULL ELSE result_value END",
            "unit": "'mg'",
            "result_type": "CASE WHEN id % 47 = 0 THEN '' ELSE 'text' END",
            "normal_value_text": "'Negative'",
        },
    ),
    "medical_supplies": (
        "medical_supplies",
        {
            "name": "CASE WHEN id % 20 = 0 THEN NULL ELSE 'New ' || name END",
            "type": "CASE WHEN id % 23 = 0 THEN '' ELSE type END",
            "quantity": "CASE WHEN id % 3 = 0 THEN NULL ELSE quantity END",
            "expiry_date": "expiry_date",
        },
    ),
    "suppliers": (
        "patients",
        {
            "name": "CASE WHEN id % 3 = 0 THEN 'Supplier#000000' || LPAD(CAST(id % 200 AS STRING), 3, '0') WHEN id % 17 = 0 THEN '' ELSE name || CAST(id % 2 AS STRING) END",
            "contact_person": "address",
            "phone": "phone",
        },
    ),
    "maintenances": (
        "maintenances",
        {
            "machine_id": "CASE WHEN id % 29 = 0 THEN NULL ELSE machine_id + 1 END",
            "date": "CASE WHEN id % 31 = 0 THEN NULL ELSE date END",
            "type": "CASE WHEN id % 37 = 0 THEN '' ELSE type END",
            "technician": "technician",
        },
    ),
}


def _literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def _batch_sql(source: str, columns: dict[str, str], key: str, required: list[str]) -> str:
    picked = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    missing = ", ".join(
        f"CASE WHEN {c} IS NULL OR CAST({c} AS VARCHAR) = '' THEN 'missing {c}' END" for c in required
    )
    bad = f"CONCAT_WS('; ', {missing})" if missing else "''"
    return f"given AS (SELECT id AS {key}, {picked} FROM {source}), checked AS (SELECT *, {bad} AS bad FROM given)"


def _insert_sql(table: str) -> str:
    source, columns = INSERTS[table]
    sql = _batch_sql(source, columns, "line", REQUIRED[table])
    clash = "FALSE"
    for name, (key,) in UNIQUE.get(table, {}).items():
        clash = (
            f"{key} IS NOT NULL AND ({key} IN (SELECT {key} FROM {table} WHERE {key} IS NOT NULL)"
            f" OR ROW_NUMBER() OVER (PARTITION BY {key}, bad = '' ORDER BY line) > 1)"
        )
        sql += f", judged AS (SELECT *, CASE WHEN bad <> '' THEN bad WHEN {clash} THEN 'duplicate {name}' END AS reason FROM checked)"
    if clash == "FALSE":
        sql += ", judged AS (SELECT *, CASE WHEN bad <> '' THEN bad END AS reason FROM checked)"
    return sql


def _insert_state(table: str) -> str:
    names = list(VIEWS[table].columns)
    values = [f"(SELECT MAX(id) FROM {table}) + ROW_NUMBER() OVER (ORDER BY line)"]
    for name in names[1:]:
        value = name if name in INSERTS[table][1] else "NULL"
        if name in DEFAULTS.get(table, {}):
            value = f"COALESCE({value}, {_literal(DEFAULTS[table][name])})"
        values.append(value)
    return (
        f"WITH {_insert_sql(table)} SELECT {', '.join(names)} FROM {table}"
        f" UNION ALL SELECT {', '.join(values)} FROM judged WHERE reason IS NULL"
    )


def _insert(v, table: str):
    source, columns = INSERTS[table]
    batch = getattr(v, source).selectExpr("id AS line", *[f"{e} AS {c}" for c, e in columns.items()])
    return changes.append_to(table, getattr(v, table), batch, ["line"])


for _table in INSERTS:
    query(f"add_{_table}", _insert_state(_table))(lambda v, t=_table: _insert(v, t)[0])
    query(
        f"add_{_table}_log",
        f"WITH {_insert_sql(_table)} SELECT line, CASE WHEN reason IS NULL THEN 'added' ELSE 'rejected' END AS action, reason FROM judged",
    )(lambda v, t=_table: _insert(v, t)[1])

# Edits as (new values, id of the edited row): every seventh id is of no row.
EDITS: dict[str, dict[str, str]] = {
    "sessions": {
        "patient_id": "CASE WHEN id % 50 = 0 THEN NULL ELSE patient_id + 1 END",
        "session_date": "CASE WHEN id % 41 = 0 THEN NULL ELSE session_date END",
        "notes": "'edited ' || CAST(id AS STRING)",
        "blood_transfusion_bags": "id % 3",
        "machine_hours_operated": "CAST(4.5 AS DOUBLE)",
    },
    "lab_results": {
        "test_id": "CASE WHEN id % 43 = 0 THEN NULL ELSE test_id % 5 + 1 END",
        "result_value": "CASE WHEN id % 37 = 0 THEN '' ELSE '7' END",
        "result_date": "result_date",
        "notes": "'again'",
    },
    "medical_supplies": {"name": "'Renamed ' || name", "type": "CASE WHEN id % 19 = 0 THEN '' ELSE type END", "expiry_date": "NULL"},
    "maintenances": {
        "machine_id": "CASE WHEN id % 29 = 0 THEN NULL ELSE machine_id + 2 END",
        "date": "date",
        "type": "CASE WHEN id % 37 = 0 THEN '' ELSE 'revision' END",
        "technician": "'T'",
    },
}
EDITED_ID = "CASE WHEN id % 7 = 0 THEN -id ELSE id END"


def _edit_sql(table: str) -> str:
    columns = EDITS[table]
    required = [c for c in REQUIRED.get(table, []) if c in columns]
    return _batch_sql(table, columns, "row_id", required).replace("SELECT id AS row_id", f"SELECT {EDITED_ID} AS row_id")


def _edit_state(table: str) -> str:
    picked = ", ".join(
        f"CASE WHEN b.row_id IS NULL THEN p.{c} ELSE b.{c} END AS {c}" if c in EDITS[table] else f"p.{c}"
        for c in VIEWS[table].columns
    )
    return f"WITH {_edit_sql(table)} SELECT {picked} FROM {table} p LEFT JOIN checked b ON b.row_id = p.id AND b.bad = ''"


def _edit(v, table: str):
    state = getattr(v, table)
    types = {f.name: f.dataType.simpleString() for f in state.schema}
    values = [f"CAST({e} AS {types[c]}) AS {c}" for c, e in EDITS[table].items()]
    return changes.edit_in(table, state, state.selectExpr(f"{EDITED_ID} AS id", *values), ["id"])


for _table in EDITS:
    query(f"edit_{_table}", _edit_state(_table))(lambda v, t=_table: _edit(v, t)[0])
    query(
        f"edit_{_table}_log",
        f"""WITH {_edit_sql(_table)} SELECT row_id AS id, CASE WHEN bad <> '' THEN bad
        WHEN row_id IN (SELECT id FROM {_table}) THEN 'updated' ELSE 'not_found' END AS action FROM checked""",
    )(lambda v, t=_table: _edit(v, t)[1])

USED = """CASE WHEN order_no % 41 = 0 THEN -5.0 WHEN order_no % 43 = 0 THEN 0.0 WHEN order_no % 47 = 0 THEN NULL
  ELSE ABS(change_amount) / 8.0 END"""
USAGE = f"""
u AS (SELECT {', '.join(MOVE_ORDER)}, supply_id, CAST({USED} AS DOUBLE) AS used FROM stock_movements),
m AS (SELECT *, -CAST(FLOOR(used) AS BIGINT) AS taken,
    ROW_NUMBER() OVER (PARTITION BY supply_id ORDER BY {', '.join(MOVE_ORDER)}) AS rn
  FROM u WHERE used > 0 AND supply_id IN (SELECT id FROM medical_supplies)),
walk AS (
  SELECT id AS supply_id, CAST(0 AS BIGINT) AS rn, quantity, TRUE AS ok FROM medical_supplies
  UNION ALL
  SELECT m.supply_id, m.rn, CASE WHEN w.quantity + m.taken >= 0 THEN w.quantity + m.taken ELSE w.quantity END,
    w.quantity + m.taken >= 0
  FROM walk w JOIN m ON m.supply_id = w.supply_id AND m.rn = w.rn + 1)"""


def _usage(v):
    batch = v.stock_movements.withColumn("quantity_used", F.expr(f"CAST({USED} AS DOUBLE)"))
    order = [c for c in MOVE_ORDER if c != "change_amount"]
    return inventory.use_supplies(v.medical_supplies, batch.drop("change_amount"), order)


@query(
    "use_supplies_log",
    f"""WITH {USAGE} SELECT m.order_no, m.line_no, m.supply_id, m.taken AS change_amount,
      CASE WHEN w.ok THEN 'accepted' ELSE 'negative' END AS status, CASE WHEN w.ok THEN w.quantity END AS new_quantity
    FROM m JOIN walk w ON w.supply_id = m.supply_id AND w.rn = m.rn
    UNION ALL SELECT order_no, line_no, supply_id, CASE WHEN used > 0 THEN -CAST(FLOOR(used) AS BIGINT) END,
      CASE WHEN used > 0 THEN 'unknown supply' ELSE 'bad quantity' END, NULL FROM u
    WHERE used IS NULL OR used <= 0 OR supply_id NOT IN (SELECT id FROM medical_supplies)""",
)
def use_supplies_log(v):
    columns = ["order_no", "line_no", "supply_id", "change_amount", "status", "new_quantity"]
    return _usage(v)[1].select(*columns)


@query(
    "use_supplies",
    f"""WITH {USAGE}, t AS (SELECT m.supply_id, SUM(m.taken) AS taken FROM m
      JOIN walk w ON w.supply_id = m.supply_id AND w.rn = m.rn AND w.ok GROUP BY 1)
    SELECT s.id, s.name, CAST(s.quantity + COALESCE(t.taken, 0) AS BIGINT) AS quantity
    FROM medical_supplies s LEFT JOIN t ON t.supply_id = s.id""",
)
def use_supplies(v):
    return _usage(v)[0].select("id", "name", "quantity")


SHIFTS = {
    "staff_id": "CASE WHEN id % 61 = 0 THEN NULL ELSE patient_id + 75 END",
    "shift_date": "CASE WHEN id % 71 = 0 THEN NULL ELSE result_date END",
    "new_shift_type": "CASE WHEN id % 67 = 0 THEN '' ELSE 'C' || CAST(id % 5 AS STRING) END",
    "substitute_staff_id": "CASE WHEN id % 5 = 0 THEN 0 ELSE id % 100 END",
    "notes": "CASE WHEN id % 3 = 0 THEN NULL ELSE 'for ' || CAST(id AS STRING) END",
}
SHIFT_BATCH = f"""{_batch_sql('lab_results', SHIFTS, 'seq', REQUIRED['shift_changes'])},
n AS (SELECT ROW_NUMBER() OVER (ORDER BY seq) + (SELECT MAX(id) FROM shift_changes) AS new_id, * FROM checked WHERE bad = ''),
w AS (SELECT * FROM n QUALIFY ROW_NUMBER() OVER (PARTITION BY staff_id, shift_date ORDER BY seq DESC) = 1)"""


def _change_shifts(v):
    batch = v.lab_results.selectExpr("id AS seq", *[f"{e} AS {c}" for c, e in SHIFTS.items()])
    return roster.change_shifts(v.shift_changes, batch, ["seq"])


@query(
    "change_shifts",
    f"""WITH {SHIFT_BATCH}
    SELECT id, staff_id, shift_date, new_shift_type, substitute_staff_id, notes FROM shift_changes
    WHERE (staff_id, shift_date) NOT IN (SELECT (staff_id, shift_date) FROM w)
    UNION ALL SELECT new_id, staff_id, shift_date, new_shift_type, NULLIF(substitute_staff_id, 0), notes FROM w""",
)
def change_shifts(v):
    return _change_shifts(v)[0]


@query(
    "change_shifts_log",
    f"""WITH {SHIFT_BATCH} SELECT staff_id, shift_date, CASE WHEN (staff_id, shift_date) IN
      (SELECT (staff_id, shift_date) FROM shift_changes) THEN 'replaced' ELSE 'added' END AS action FROM w
    UNION ALL SELECT staff_id, shift_date, 'refused: ' || bad FROM checked WHERE bad <> ''""",
)
def change_shifts_log(v):
    return _change_shifts(v)[1]


def _labels_sql(labels: dict[str, str], values: dict[str, str] | None = None) -> str:
    return ", ".join(f'{(values or {}).get(c, c)} AS "{label}"' for c, label in labels.items())


@query("export_all_patients", f"SELECT {_labels_sql(patients.EXPORT_LABELS, {'age': AGE})} FROM patients")
def export_all_patients(v):
    rows = patients.with_age(v.patients, AS_OF)
    return sinks.labelled(paging.ordered_listing(rows, ["name", "id"]), patients.EXPORT_LABELS)


@query("export_invoices", f"SELECT {_labels_sql(billing.INVOICE_LABELS)} FROM ({INVOICE_EXPORT})")
def export_invoices(v):
    return sinks.labelled(billing.invoice_export(v.patients, v.sessions, v.app_settings, MONTH), billing.INVOICE_LABELS)


@query("export_roster", f"SELECT {_labels_sql(roster.roster_labels(EVENT_MONTH))} FROM ({ROSTER_SHEET})")
def export_roster(v):
    return sinks.labelled(roster.roster_sheet(v.staff, v.shift_changes, EVENT_MONTH), roster.roster_labels(EVENT_MONTH))


# Logs of changes whose new state is registered elsewhere.
ADDED_PATIENTS = f"""
b AS (SELECT {NEW_PATIENTS} FROM patients),
c AS (SELECT *, CONCAT_WS('; ', CASE WHEN name = '' THEN 'missing name' END,
    CASE WHEN COALESCE(dialysis_unit, '') = '' THEN 'missing dialysis_unit' END) AS bad FROM b),
j AS (SELECT *, medical_id IN (SELECT medical_id FROM patients) AS held_medical,
    COALESCE(national_id IN (SELECT national_id FROM patients WHERE national_id IS NOT NULL), FALSE) AS held_national FROM c),
f AS (SELECT *, bad = '' AND NOT held_medical AND NOT held_national AS free FROM j),
r AS (SELECT *, CASE WHEN bad <> '' THEN bad WHEN held_medical THEN 'duplicate medical_id'
    WHEN free AND ROW_NUMBER() OVER (PARTITION BY medical_id, free ORDER BY line) > 1 THEN 'duplicate medical_id'
    WHEN NOT free AND EXISTS (SELECT 1 FROM f e WHERE e.free AND e.medical_id = f.medical_id AND e.line < f.line)
      THEN 'duplicate medical_id'
    WHEN held_national THEN 'duplicate national_id' END AS reason FROM f)"""


@query(
    "add_patients_log",
    f"WITH {ADDED_PATIENTS} SELECT line, CASE WHEN reason IS NULL THEN 'added' ELSE 'rejected' END AS action, reason FROM r",
)
def add_patients_log(v):
    return patients.add_patients(v.patients, v.patients.selectExpr(*split_columns(NEW_PATIENTS)), ["line"])[1]


@query(
    "edit_patients_log",
    f"""WITH b AS (SELECT {NEW_PATIENTS} FROM patients)
    SELECT line AS id, CASE WHEN name = '' OR COALESCE(dialysis_unit, '') = '' THEN CONCAT_WS('; ',
      CASE WHEN name = '' THEN 'missing name' END, CASE WHEN COALESCE(dialysis_unit, '') = '' THEN 'missing dialysis_unit' END)
      ELSE 'updated' END AS action FROM b""",
)
def edit_patients_log(v):
    batch = v.patients.selectExpr(*split_columns(NEW_PATIENTS)).withColumnRenamed("line", "id")
    return patients.edit_patients(v.patients, batch, ["id"])[1]


@query(
    "append_water_log_log",
    """SELECT id AS line_no, CASE WHEN id % 9 = 0 THEN 'rejected' ELSE 'added' END AS action,
      CASE WHEN id % 9 = 0 THEN 'missing log_date' END AS reason FROM lab_results""",
)
def append_water_log_log(v):
    batch = v.lab_results.selectExpr(
        "id AS line_no", "CASE WHEN id % 9 = 0 THEN NULL ELSE result_date END AS log_date",
        "'T' || CAST(patient_id AS STRING) AS technician_name", "CAST(test_id AS DOUBLE) AS ph_level",
    )
    return changes.append_to("water_treatment_log", v.water_treatment_log, batch, ["line_no"])[1]


@query(
    "update_by_key_log",
    """SELECT id * 2 AS id, CASE WHEN id * 2 IN (SELECT id FROM lab_results) THEN 'updated' ELSE 'not_found' END AS action
    FROM lab_results""",
)
def update_by_key_log(v):
    batch = v.lab_results.selectExpr("id AS seq", "id * 2 AS id", "'checked' AS notes")
    return changes.update_by_key(v.lab_results.drop("result_date"), batch, "id", ["notes"], ["seq"])[1]


@query(
    "record_transfusions_log",
    "SELECT id, CASE WHEN id % 5 < 2 THEN 'bad bag count' ELSE 'updated' END AS action FROM sessions",
)
def record_transfusions_log(v):
    batch = v.sessions.selectExpr(
        "id", "CASE id % 5 WHEN 0 THEN 'two' WHEN 1 THEN '-1' ELSE CAST(id % 6 AS STRING) END AS blood_transfusion_bags",
        "'given' AS notes",
    )
    state = v.sessions.select("id", "blood_transfusion_bags", "notes")
    return schedule.record_transfusions(state, batch, ["id"])[1]


@query(
    "unarchive_log",
    """WITH w AS (SELECT id FROM archived_patients WHERE archive_details = 'file 3' UNION SELECT id FROM machines)
    SELECT id, CASE WHEN id IN (SELECT id FROM archived_patients) THEN 'restored' ELSE 'skipped' END AS action FROM w""",
)
def unarchive_log(v):
    ids = v.archived_patients.where("archive_details = 'file 3'").select("id").unionByName(v.machines.select("id"))
    return patients.unarchive(v.patients, v.archived_patients, ids)[2]


PRICE = "CASE WHEN quantity_ordered % 7 = 0 THEN -unit_price WHEN quantity_ordered % 5 = 0 THEN FLOOR(unit_price) * 1000000 ELSE unit_price END"
QUOTE = "''''"


@query(
    "insert_lines_of_prices",
    f"""SELECT 'purchase_order_items' AS table_name, 'INSERT INTO purchase_order_items (id, unit_price) VALUES ('
      || CONCAT_WS(', ', {QUOTE} || CAST(id AS VARCHAR) || {QUOTE}, {QUOTE} || CASE WHEN p = FLOOR(p)
        THEN CAST(CAST(p AS BIGINT) AS VARCHAR) ELSE CAST(p AS VARCHAR) END || {QUOTE}) || ');' AS line
    FROM (SELECT id, CAST({PRICE} AS DOUBLE) AS p FROM purchase_order_items)""",
)
def insert_lines_of_prices(v):
    """Prices of the order items as INSERT lines, among them negative ones and some above ten millions."""
    rows = v.purchase_order_items.selectExpr("id", f"CAST({PRICE} AS DOUBLE) AS unit_price")
    return sinks.insert_lines(rows, "purchase_order_items")


@query(
    "patient_list_of_a_day",
    f"""SELECT *, {AGE} AS age FROM patients
    WHERE REPLACE(',' || dialysis_days || ',', ' ', '') LIKE '%,Wed,%' AND dialysis_unit = 'BUILDING'
    ORDER BY name NULLS FIRST, id LIMIT 15""",
)
def patient_list_of_a_day(v):
    return patients.patient_list(v.patients, AS_OF, weekday="Wed", unit="BUILDING")


@query(
    "read_sheet",
    """SELECT COALESCE(serial_number, '') AS serial_number, COALESCE(brand, '') AS brand, COALESCE(ward, '') AS ward,
      COALESCE(internal_unit, '') AS internal_unit, COALESCE(status, '') AS status,
      COALESCE(last_maintenance, '') AS last_maintenance FROM machine_sheet""",
)
def read_sheet(v):
    """The machine sheet written as text files with a header line and read back by position."""
    path = shared_path(v.spark, "sheet")
    writer = v.machine_sheet.select(*sheets.MACHINE_SHEET.columns).write.option("header", True).option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    cells = sheets.read_sheet(v.spark, path, sheets.MACHINE_SHEET)
    names = ["serial_number", "brand", "ward", "internal_unit", "status", "last_maintenance"]
    return cells.select(*[F.coalesce(n, F.lit("")).alias(n) for n in names])


SAVED_SESSIONS = ["id", "patient_id", "session_date", "shift", "notes", "blood_transfusion_bags", "machine_id", "machine_hours_operated"]


@query(
    "reread_sessions",
    """SELECT id, patient_id, session_date, shift, notes, COALESCE(blood_transfusion_bags, 0) AS blood_transfusion_bags,
      machine_id, COALESCE(machine_hours_operated, 0.0) AS machine_hours_operated FROM sessions""",
)
def reread_sessions(v):
    """Sessions written by month and read back in their declared types."""
    folder = shared_path(v.spark, "tables")
    given = v.sessions
    tables.write_table(given.select(*[c for c in SAVED_SESSIONS if c in given.columns]), folder, "sessions")
    return tables.read_table(v.spark, folder, "sessions").select(*SAVED_SESSIONS)


@query(
    "snapshot_contents",
    """SELECT 'backup-2024-05-0' || CAST(day AS VARCHAR) || 'T00-00-00-000Z' AS name,
      CASE day WHEN 1 THEN (SELECT COUNT(*) FROM machines) ELSE (SELECT COUNT(*) FROM sessions) END AS rows, TRUE AS same_size
    FROM (SELECT UNNEST([1, 2]) AS day)""",
)
def snapshot_contents(v):
    """The listed snapshots with their rows, and whether the listed size is that of their files."""
    base = shared_path(v.spark, "snapshots")
    out = None
    for day, name in ((1, "machines"), (2, "sessions")):
        folder = sinks.snapshot({name: getattr(v, name)}, base, f"2024-05-0{day}T00:00:00.000Z")
        files = v.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/{name}")
        size = files.agg((F.round(F.sum("length") / 1024, 2)).alias("files_kb"))
        rows = v.spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("rows"))
        part = rows.crossJoin(size).withColumn("name", F.lit(folder.rpartition("/")[2]))  # one row each
        out = part if out is None else out.unionByName(part)
    listed = sinks.list_snapshots(v.spark, base)
    return listed.join(out, "name").select("name", "rows", (F.col("size_kb") == F.col("files_kb")).alias("same_size"))
