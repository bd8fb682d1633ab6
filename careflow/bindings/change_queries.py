"""Validation, table changes, stock and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow.bindings.registry import query
from careflow.operators import changes
from careflow.plans import daily_reports, inventory, patients, roster, schedule
from careflow.schemas import REQUIRED, ROLES, UNIQUE

KEY = ["patient_id", "session_date"]


@query(
    "require",
    """SELECT id, CONCAT_WS('; ', 
      CASE WHEN full_name IS NULL OR full_name = '' THEN 'missing full_name' END,
      CASE WHEN role NOT IN ('admin', 'doctor', 'nurse', 'clerk') THEN 'bad role' END,
      CASE WHEN is_active <> 1 THEN 'inactive' END) AS reasons FROM users""",
)
def require(v):
    rules = {"bad role": F.col("role").isin(ROLES), "inactive": F.col("is_active") == 1}
    checked = changes.require(v.users, ["full_name"], rules)
    return checked.select("id", F.array_join("reasons", "; ").alias("reasons"))


SHEET_VERDICT = """
first AS (SELECT line_no, serial_number, ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY line_no) AS rn
  FROM {rows} WHERE serial_number IS NOT NULL),
judged AS (SELECT line_no, CASE WHEN rn > 1 OR serial_number IN (SELECT serial_number FROM machines)
  THEN 'serial_number' ELSE 'accepted' END AS verdict FROM first)"""


@query(
    "unique",
    f"""WITH {SHEET_VERDICT.format(rows='machine_sheet')}
    SELECT s.line_no, s.serial_number, COALESCE(j.verdict, 'accepted') AS verdict
    FROM machine_sheet s LEFT JOIN judged j ON j.line_no = s.line_no""",
)
def unique(v):
    rows = v.machine_sheet.select("line_no", "serial_number")
    return changes.unique(rows, UNIQUE["machines"], ["line_no"], v.machines)


@query(
    "orphans",
    "SELECT * FROM sessions WHERE machine_id IS NOT NULL AND machine_id NOT IN (SELECT id FROM machines)",
)
def orphans(v):
    return changes.orphans(v.sessions, v.machines, "machine_id")


@query(
    "session_rules",
    """WITH b AS (SELECT id, CASE WHEN id % 50 = 0 THEN NULL ELSE patient_id END AS patient_id, session_date
      FROM sessions WHERE status <> 'F'),
    n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY patient_id, session_date ORDER BY id) AS rn FROM b)
    SELECT id, patient_id, session_date, CASE WHEN patient_id IS NULL THEN 'missing patient_id'
      WHEN session_date > DATE '2000-01-01' THEN 'future date'
      WHEN rn > 1 OR EXISTS (SELECT 1 FROM sessions e WHERE e.status = 'F' AND e.patient_id = n.patient_id
        AND e.session_date = n.session_date) THEN 'second session'
      ELSE 'accepted' END AS verdict FROM n""",
)
def session_rules(v):
    batch = v.sessions.where("status <> 'F'").selectExpr(
        "id", "CASE WHEN id % 50 = 0 THEN NULL ELSE patient_id END AS patient_id", "session_date"
    )
    return schedule.session_rules(batch, v.sessions.where("status = 'F'"), "2000-01-01", ["id"])


@query(
    "add_sessions_log",
    """WITH b AS (SELECT id AS line, CASE WHEN id % 50 = 0 THEN NULL ELSE patient_id END AS patient_id,
        session_date + CAST(id % 3 AS INT) AS session_date FROM sessions),
    n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY patient_id, session_date ORDER BY line) AS rn FROM b)
    SELECT line, CASE WHEN r IS NULL THEN 'added' ELSE 'rejected' END AS action, r AS reason FROM (
      SELECT line, CASE WHEN patient_id IS NULL AND session_date > DATE '2000-01-01' THEN 'missing patient_id; future date'
        WHEN patient_id IS NULL THEN 'missing patient_id'
        WHEN session_date > DATE '2000-01-01' THEN 'future date'
        WHEN rn > 1 OR EXISTS (SELECT 1 FROM sessions e WHERE e.patient_id = n.patient_id
          AND e.session_date = n.session_date) THEN 'duplicate session of the day' END AS r FROM n)""",
)
def add_sessions_log(v):
    batch = v.sessions.selectExpr(
        "id AS line",
        "CASE WHEN id % 50 = 0 THEN NULL ELSE patient_id END AS patient_id",
        "session_date + CAST(id % 3 AS INT) AS session_date",
    )
    return schedule.add_sessions(v.sessions, batch, "2000-01-01", ["line"])[1]


@query(
    "append_machines",
    f"""WITH valid AS (SELECT * FROM machine_sheet WHERE serial_number <> '' AND ward <> ''
        AND internal_unit <> '' AND status <> ''), {SHEET_VERDICT.format(rows='valid')}
    SELECT id, serial_number, brand, ward, internal_unit, status FROM machines UNION ALL
    SELECT (SELECT MAX(id) FROM machines) + ROW_NUMBER() OVER (ORDER BY s.line_no), s.serial_number, s.brand,
      s.ward, s.internal_unit, s.status
    FROM valid s JOIN judged j ON j.line_no = s.line_no AND j.verdict = 'accepted'""",
)
def append_machines(v):
    batch = v.machine_sheet.drop("last_maintenance")
    state, _ = changes.append_to("machines", v.machines, batch, ["line_no"])
    return state.select("id", "serial_number", "brand", "ward", "internal_unit", "status")


@query(
    "append_water_log",
    """SELECT id, log_date, technician_name, chlorine_level_before, ph_level FROM water_treatment_log UNION ALL
    SELECT (SELECT MAX(id) FROM water_treatment_log) + ROW_NUMBER() OVER (ORDER BY line_no), log_date,
      technician_name, NULL, ph_level
    FROM (SELECT id AS line_no, CASE WHEN id % 9 = 0 THEN NULL ELSE result_date END AS log_date,
      'T' || CAST(patient_id AS VARCHAR) AS technician_name, CAST(test_id AS DOUBLE) AS ph_level FROM lab_results)
    WHERE log_date IS NOT NULL""",
)
def append_water_log(v):
    batch = v.lab_results.selectExpr(
        "id AS line_no",
        "CASE WHEN id % 9 = 0 THEN NULL ELSE result_date END AS log_date",
        "'T' || CAST(patient_id AS STRING) AS technician_name",
        "CAST(test_id AS DOUBLE) AS ph_level",
    )
    return changes.append_to("water_treatment_log", v.water_treatment_log, batch, ["line_no"])[0]


NEW_PATIENTS = """id AS line, CASE WHEN id % 61 = 0 THEN '' ELSE name END AS name,
  CASE WHEN id % 9 = 0 THEN CAST(id AS STRING) ELSE 'X' || CAST(id - id % 2 AS STRING) END AS medical_id,
  CASE WHEN id % 8 = 0 THEN 'N' || CAST(id * 7 AS STRING) ELSE NULL END AS national_id,
  added_date, referral_date, dialysis_unit, virus_status,
  CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN '6' WHEN 2 THEN '0' WHEN 3 THEN NULL ELSE '18 months' END
    AS referral_duration_months"""
EXPIRY = """CAST(DATE_TRUNC('month', referral_date) + INTERVAL 1 MONTH * (CASE line % 5 WHEN 1 THEN 6 WHEN 4 THEN 18
  ELSE 12 END) AS DATE) + CAST(DAY(referral_date) - 1 AS INT)"""


@query(
    "add_patients",
    f"""WITH b AS (SELECT {NEW_PATIENTS} FROM patients),
    free AS (SELECT * FROM b WHERE name <> '' AND dialysis_unit <> ''
      AND medical_id NOT IN (SELECT medical_id FROM patients)
      AND (national_id IS NULL OR national_id NOT IN (SELECT national_id FROM patients WHERE national_id IS NOT NULL))),
    ok AS (SELECT * FROM free QUALIFY ROW_NUMBER() OVER (PARTITION BY medical_id ORDER BY line) = 1)
    SELECT id, name, medical_id, national_id, referral_expiry, is_archived FROM patients UNION ALL
    SELECT (SELECT MAX(id) FROM patients) + ROW_NUMBER() OVER (ORDER BY line), name, medical_id, national_id, {EXPIRY}, 0
    FROM ok""",
)
def add_patients(v):
    batch = v.patients.selectExpr(*split_columns(NEW_PATIENTS))
    state, _ = patients.add_patients(v.patients, batch, ["line"])
    return state.select("id", "name", "medical_id", "national_id", "referral_expiry", "is_archived")


@query(
    "edit_patients",
    f"""WITH b AS (SELECT {NEW_PATIENTS} FROM patients)
    SELECT p.id, CASE WHEN b.line IS NULL THEN p.name ELSE b.name END AS name, p.medical_id,
      CASE WHEN b.line IS NULL THEN p.referral_expiry ELSE b.expiry END AS referral_expiry, p.phone
    FROM patients p LEFT JOIN (SELECT line, name, {EXPIRY} AS expiry FROM b WHERE name <> '' AND dialysis_unit <> '') b
      ON b.line = p.id""",
)
def edit_patients(v):
    batch = v.patients.selectExpr(*split_columns(NEW_PATIENTS)).withColumnRenamed("line", "id")
    state, _ = patients.edit_patients(v.patients, batch, ["id"])
    return state.select("id", "name", "medical_id", "referral_expiry", "phone")


def split_columns(sql: str) -> list[str]:
    """The expressions of a select list without commas inside parentheses."""
    return [part.strip() for part in sql.split(",")]

SHIFTED = "SELECT id, patient_id, session_date + CAST(id % 2 AS INT) AS session_date FROM sessions"


def _shifted(v):
    return v.sessions.selectExpr("id AS seq", "patient_id", "session_date + CAST(id % 2 AS INT) AS session_date")


@query(
    "insert_if_absent",
    f"""WITH b AS (SELECT DISTINCT patient_id, session_date FROM ({SHIFTED})
      EXCEPT SELECT patient_id, session_date FROM sessions)
    SELECT id, patient_id, session_date, blood_transfusion_bags FROM sessions UNION ALL
    SELECT (SELECT MAX(id) FROM sessions) + ROW_NUMBER() OVER (ORDER BY patient_id, session_date),
      patient_id, session_date, 0 FROM b""",
)
def insert_if_absent(v):
    state = v.sessions.select("id", *KEY, "blood_transfusion_bags")
    return changes.insert_if_absent(state, _shifted(v), KEY, {"blood_transfusion_bags": 0})[0]


UPSERT_BATCH = f"""
b AS (SELECT id AS seq, CASE WHEN id % 50 = 0 THEN NULL ELSE patient_id END AS patient_id,
    session_date + CAST(id % 2 AS INT) AS session_date, 'S' || CAST(id % 3 AS VARCHAR) AS shift,
    CASE WHEN id % 6 = 0 THEN NULL ELSE id % 7 END AS machine_id FROM sessions),
l AS (SELECT patient_id, session_date, MAX(seq) AS last_seq, MIN(seq) AS arrived FROM b
  WHERE patient_id IS NOT NULL GROUP BY 1, 2),
t AS (SELECT l.*, b.shift AS new_shift, b.machine_id AS new_machine,
    (SELECT MIN(s.id) FROM sessions s WHERE s.patient_id = l.patient_id AND s.session_date = l.session_date) AS target
  FROM l JOIN b ON b.seq = l.last_seq)"""


def _upsert(v):
    batch = v.sessions.selectExpr(
        "id AS seq",
        "CASE WHEN id % 50 = 0 THEN NULL ELSE patient_id END AS patient_id",
        "session_date + CAST(id % 2 AS INT) AS session_date",
        "'S' || CAST(id % 3 AS STRING) AS shift",
        "CASE WHEN id % 6 = 0 THEN NULL ELSE id % 7 END AS machine_id",
    )
    state = v.sessions.select("id", *KEY, "shift", "machine_id", "blood_transfusion_bags")
    return changes.upsert(state, batch, KEY, ["shift", "machine_id"], ["seq"], {"blood_transfusion_bags": 0})


@query(
    "upsert",
    f"""WITH {UPSERT_BATCH}
    SELECT s.id, s.patient_id, s.session_date, CASE WHEN t.target IS NULL THEN s.shift ELSE t.new_shift END AS shift,
      CASE WHEN t.target IS NULL THEN s.machine_id ELSE t.new_machine END AS machine_id, s.blood_transfusion_bags
    FROM sessions s LEFT JOIN t ON t.target = s.id
    UNION ALL
    SELECT (SELECT MAX(id) FROM sessions) + ROW_NUMBER() OVER (ORDER BY arrived), patient_id, session_date,
      new_shift, new_machine, 0 FROM t WHERE target IS NULL""",
)
def upsert(v):
    return _upsert(v)[0]


@query(
    "upsert_log",
    f"""WITH {UPSERT_BATCH}
    SELECT b.seq, b.patient_id, b.session_date, CASE WHEN b.patient_id IS NULL THEN 'failed'
      WHEN t.target IS NULL AND t.arrived = b.seq THEN 'added' ELSE 'updated' END AS action
    FROM b LEFT JOIN t ON t.patient_id = b.patient_id AND t.session_date = b.session_date""",
)
def upsert_log(v):
    return _upsert(v)[1]


ROSTER_BATCH = """
given AS (SELECT id AS seq, CASE WHEN id % 61 = 0 THEN NULL ELSE patient_id + 75 END AS staff_id,
    CASE WHEN id % 71 = 0 THEN NULL ELSE result_date END AS shift_date,
    CASE WHEN id % 67 = 0 THEN '' ELSE 'C' || CAST(id % 5 AS VARCHAR) END AS new_shift_type FROM lab_results),
bad AS (SELECT *, CONCAT_WS('; ', CASE WHEN staff_id IS NULL THEN 'missing staff_id' END,
    CASE WHEN new_shift_type = '' THEN 'missing new_shift_type' END,
    CASE WHEN shift_date IS NULL THEN 'no such day' END) AS reason FROM given),
n AS (SELECT ROW_NUMBER() OVER (ORDER BY seq) + (SELECT MAX(id) FROM shift_changes) AS new_id, seq,
    staff_id, shift_date, new_shift_type FROM bad WHERE reason = ''),
w AS (SELECT * FROM n QUALIFY ROW_NUMBER() OVER (PARTITION BY staff_id, shift_date ORDER BY seq DESC) = 1)"""


def _save_roster(v):
    batch = v.lab_results.selectExpr(
        "id AS seq",
        "CASE WHEN id % 61 = 0 THEN NULL ELSE patient_id + 75 END AS staff_id",
        "CASE WHEN id % 71 = 0 THEN 32 ELSE DAY(result_date) END AS day",
        "CASE WHEN id % 67 = 0 THEN '' ELSE 'C' || CAST(id % 5 AS STRING) END AS shift_code",
    )
    return roster.save_roster(v.shift_changes, batch, "2024-01", ["seq"])


@query(
    "replace_by_key",
    f"""WITH {ROSTER_BATCH}
    SELECT id, staff_id, shift_date, new_shift_type, substitute_staff_id, notes FROM shift_changes c
    WHERE (staff_id, shift_date) NOT IN (SELECT (staff_id, shift_date) FROM w)
    UNION ALL SELECT new_id, staff_id, shift_date, new_shift_type, NULL, NULL FROM w""",
)
def replace_by_key(v):
    return _save_roster(v)[0]


@query(
    "replace_by_key_log",
    f"""WITH {ROSTER_BATCH} SELECT staff_id, shift_date, CASE WHEN (staff_id, shift_date) IN
      (SELECT (staff_id, shift_date) FROM shift_changes) THEN 'replaced' ELSE 'added' END AS action FROM w
    UNION ALL SELECT staff_id, shift_date, 'refused: ' || reason FROM bad WHERE reason <> ''""",
)
def replace_by_key_log(v):
    return _save_roster(v)[1]


TOGGLE = f"""
k AS (SELECT patient_id, session_date, COUNT(*) AS k FROM ({SHIFTED}) GROUP BY 1, 2),
s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY patient_id, session_date ORDER BY id) AS rn,
  COUNT(*) OVER (PARTITION BY patient_id, session_date) AS n FROM sessions),
c AS (SELECT k.*, COALESCE((SELECT COUNT(*) FROM sessions x WHERE x.patient_id = k.patient_id
  AND x.session_date = k.session_date), 0) AS n FROM k)"""


@query(
    "toggle",
    f"""WITH {TOGGLE}
    SELECT s.id, s.patient_id, s.session_date, s.blood_transfusion_bags FROM s
    LEFT JOIN k ON k.patient_id = s.patient_id AND k.session_date = s.session_date
    WHERE s.rn > COALESCE(k.k, 0)
    UNION ALL
    SELECT (SELECT MAX(id) FROM sessions) + ROW_NUMBER() OVER (ORDER BY patient_id, session_date),
      patient_id, session_date, 0 FROM c WHERE k > n AND (k - n) % 2 = 1""",
)
def toggle(v):
    state = v.sessions.select("id", *KEY, "blood_transfusion_bags")
    return changes.toggle(state, _shifted(v), KEY, {"blood_transfusion_bags": 0})[0]


@query(
    "toggle_log",
    f"""WITH {TOGGLE} SELECT patient_id, session_date, n AS rows_before, k AS events, LEAST(n, k) AS deleted,
      CASE WHEN k > n THEN (k - n) % 2 ELSE 0 END AS created FROM c""",
)
def toggle_log(v):
    return changes.toggle(v.sessions.select("id", *KEY), _shifted(v), KEY)[1]


DELTA = f"""
gone AS (SELECT DISTINCT patient_id, session_date FROM sessions WHERE status = 'P'),
kept AS (SELECT * FROM sessions WHERE (patient_id, session_date) NOT IN (SELECT (patient_id, session_date) FROM gone)),
fresh AS (SELECT DISTINCT patient_id, session_date FROM ({SHIFTED}) EXCEPT SELECT patient_id, session_date FROM kept)"""


def _delta(v):
    state = v.sessions.select("id", *KEY, "blood_transfusion_bags")
    return changes.apply_delta(state, _shifted(v), v.sessions.where("status = 'P'"), KEY, {"blood_transfusion_bags": 0})


@query(
    "apply_delta",
    f"""WITH {DELTA} SELECT id, patient_id, session_date, blood_transfusion_bags FROM kept UNION ALL
    SELECT (SELECT MAX(id) FROM kept) + ROW_NUMBER() OVER (ORDER BY patient_id, session_date), patient_id,
      session_date, 0 FROM fresh""",
)
def apply_delta(v):
    return _delta(v)[0]


@query(
    "apply_delta_log",
    f"""WITH {DELTA} SELECT patient_id, session_date, 'removed' AS action, COUNT(*) AS rows FROM sessions
    WHERE (patient_id, session_date) IN (SELECT (patient_id, session_date) FROM gone) GROUP BY 1, 2
    UNION ALL SELECT patient_id, session_date, 'added', 1 FROM fresh""",
)
def apply_delta_log(v):
    return _delta(v)[1]


@query(
    "archive",
    """SELECT 'active' AS part, id, name, NULL AS archive_reason, CAST(NULL AS DATE) AS date_of_death
    FROM patients WHERE is_archived = 0
    UNION ALL SELECT 'archived', id, name, archive_reason, date_of_death FROM archived_patients
    UNION ALL SELECT 'archived', id, name, 'وفاة', DATE '1998-05-01' FROM patients WHERE is_archived = 1
    UNION ALL SELECT 'archived log', id, NULL, 'archived', NULL FROM patients WHERE is_archived = 1
    UNION ALL SELECT 'skipped log', id, NULL, 'skipped', NULL FROM archived_patients""",
)
def archive(v):
    ids = v.patients.where("is_archived = 1").select("id").unionByName(v.archived_patients.select("id"))
    active, archived, log = patients.archive(
        v.patients, v.archived_patients, ids, patients.DEATH, "ward round", "1998-05-01", "1998-06-01 10:00:00"
    )
    nothing = F.lit(None).cast("string")
    return (
        active.select(
            F.lit("active").alias("part"), "id", "name", nothing.alias("archive_reason"),
            F.lit(None).cast("date").alias("date_of_death"),
        )
        .unionByName(archived.select(F.lit("archived").alias("part"), "id", "name", "archive_reason", "date_of_death"))
        .unionByName(
            log.select(
                F.concat("action", F.lit(" log")).alias("part"), "id", nothing.alias("name"),
                F.col("action").alias("archive_reason"), F.lit(None).cast("date").alias("date_of_death"),
            )
        )
    )


@query(
    "unarchive",
    """SELECT id, name, medical_id, is_archived FROM patients UNION ALL
    SELECT id, name, medical_id, 0 FROM archived_patients WHERE archive_details = 'file 3'""",
)
def unarchive(v):
    ids = v.archived_patients.where("archive_details = 'file 3'").select("id").unionByName(v.machines.select("id"))
    return patients.unarchive(v.patients, v.archived_patients, ids)[0].select("id", "name", "medical_id", "is_archived")


@query("delete_by_key", "SELECT * FROM sessions WHERE id NOT IN (SELECT id * 3 FROM sessions)")
def delete_by_key(v):
    return changes.delete_by_key(v.sessions, v.sessions.selectExpr("id * 3 AS id"))[0]


@query(
    "delete_by_key_log",
    """SELECT id * 3 AS id, CASE WHEN id * 3 IN (SELECT id FROM sessions) THEN 'deleted' ELSE 'not_found' END AS action
    FROM sessions""",
)
def delete_by_key_log(v):
    return changes.delete_by_key(v.sessions, v.sessions.selectExpr("id * 3 AS id"))[1]


@query(
    "update_by_key",
    """SELECT r.id, r.patient_id, r.test_id, CASE WHEN b.id IS NULL THEN r.result_value ELSE b.result_value END AS result_value,
      CASE WHEN b.id IS NULL THEN r.notes ELSE b.notes END AS notes
    FROM lab_results r LEFT JOIN (SELECT id * 2 AS id, CASE WHEN id % 4 = 0 THEN NULL ELSE 'v' || CAST(id AS VARCHAR) END
      AS result_value, 'checked' AS notes FROM lab_results) b ON b.id = r.id""",
)
def update_by_key(v):
    batch = v.lab_results.selectExpr(
        "id AS seq",
        "id * 2 AS id",
        "CASE WHEN id % 4 = 0 THEN NULL ELSE 'v' || CAST(id AS STRING) END AS result_value",
        "'checked' AS notes",
    )
    state = v.lab_results.drop("result_date")
    return changes.update_by_key(state, batch, "id", ["result_value", "notes"], ["seq"])[0]


def _edited(table: str, unique: str, other: str, *more: str) -> None:
    """Registers edits of a table whose batch takes other rows' keys, repeats new ones, keeps some."""
    batch = {
        "id": "id", unique: f"CASE id % 5 WHEN 0 THEN {other} WHEN 1 THEN 'New' || CAST(id - id % 10 AS STRING)"
        f" WHEN 2 THEN {unique} ELSE 'Own' || CAST(id AS STRING) END",
    }
    batch |= {c: f"CASE WHEN id % 13 = 0 THEN '' ELSE 'edit ' || CAST(id AS STRING) END" for c in more}
    blank = " || ".join(f"CASE WHEN {c} = '' THEN 'missing {c}' ELSE '' END" for c in more if c in REQUIRED[table]) or "''"
    listed = ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in batch.items())
    judged = f"""
    b AS (SELECT {listed} FROM {table}), v AS (SELECT *, {blank} AS bad FROM b),
    j AS (SELECT v.*, CASE WHEN bad <> '' THEN bad WHEN v.{unique} IS NOT DISTINCT FROM o.{unique} THEN 'updated'
        WHEN v.{unique} IN (SELECT {unique} FROM {table} WHERE {unique} IS NOT NULL) THEN 'duplicate {unique}'
        WHEN ROW_NUMBER() OVER (PARTITION BY v.{unique}, bad = '' ORDER BY v.id) > 1 THEN 'duplicate {unique}'
        ELSE 'updated' END AS action FROM v JOIN {table} o ON o.id = v.id)"""
    shown = [unique, *more]
    new = ", ".join(f"CASE WHEN j.action = 'updated' THEN j.{c} ELSE t.{c} END AS {c}" for c in shown)

    def run(v):
        edits = getattr(v, table).selectExpr("id AS seq", *[f"{e} AS {c}" for c, e in batch.items()])
        return changes.edit_in(table, getattr(v, table), edits, ["seq"])

    name = f"edit_{table.removeprefix('lab_')}"
    query(name, f"WITH {judged} SELECT t.id, {new} FROM {table} t JOIN j ON j.id = t.id")(lambda v: run(v)[0].select("id", *shown))
    query(f"{name}_log", f"WITH {judged} SELECT id, action FROM j")(lambda v: run(v)[1])


_edited("staff", "national_id", "'S' || CAST(id + 1 AS STRING)", "name", "phone")
_edited("suppliers", "name", "'Supplier#' || LPAD(CAST(id + 1 AS STRING), 9, '0')", "phone")
_edited("machines", "serial_number", "'Supplier#' || LPAD(CAST(id + 1 AS STRING), 9, '0')", "ward", "model")
_edited("lab_test_types", "test_name", "'view'", "unit")


@query(
    "record_transfusions",
    """WITH b AS (SELECT id, CASE id % 5 WHEN 0 THEN 'two' WHEN 1 THEN '-1' ELSE CAST(id % 6 AS VARCHAR) END AS bags
      FROM sessions)
    SELECT s.id, CASE WHEN TRY_CAST(b.bags AS BIGINT) >= 0 THEN TRY_CAST(b.bags AS BIGINT)
        ELSE s.blood_transfusion_bags END AS blood_transfusion_bags,
      CASE WHEN TRY_CAST(b.bags AS BIGINT) >= 0 THEN 'given' ELSE s.notes END AS notes
    FROM sessions s LEFT JOIN b ON b.id = s.id""",
)
def record_transfusions(v):
    batch = v.sessions.selectExpr(
        "id",
        "CASE id % 5 WHEN 0 THEN 'two' WHEN 1 THEN '-1' ELSE CAST(id % 6 AS STRING) END AS blood_transfusion_bags",
        "'given' AS notes",
    )
    state = v.sessions.select("id", "blood_transfusion_bags", "notes")
    return schedule.record_transfusions(state, batch, ["id"])[0]


REQUEST_ORDER = ["order_no", "line_no", "supply_no", "machine_id", "price"]
BOOKING = f"""
r AS (SELECT *, CAST(machine_id AS VARCHAR) || '/' || shift AS slot,
    ROW_NUMBER() OVER (PARTITION BY schedule_date ORDER BY {', '.join(REQUEST_ORDER)}) AS rn
  FROM booking_requests WHERE patient_id IS NOT NULL),
taken AS (SELECT schedule_date, LIST(DISTINCT CAST(machine_id AS VARCHAR) || '/' || shift) AS slots,
    LIST(DISTINCT patient_id) AS people FROM session_schedule GROUP BY 1),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, d.schedule_date, COALESCE(t.slots, []) AS slots, COALESCE(t.people, []) AS people,
    CAST('' AS VARCHAR) AS verdict
  FROM (SELECT DISTINCT schedule_date FROM r) d LEFT JOIN taken t ON t.schedule_date = d.schedule_date
  UNION ALL
  SELECT rn, schedule_date, CASE WHEN verdict = 'accepted' THEN LIST_APPEND(slots, slot) ELSE slots END,
    CASE WHEN verdict = 'accepted' THEN LIST_APPEND(people, patient_id) ELSE people END, verdict
  FROM (SELECT r.rn, r.schedule_date, w.slots, w.people, r.slot, r.patient_id,
      CASE WHEN LIST_CONTAINS(w.slots, r.slot) THEN 'machine taken'
        WHEN LIST_CONTAINS(w.people, r.patient_id) THEN 'patient booked' ELSE 'accepted' END AS verdict
    FROM walk w JOIN r ON r.schedule_date = w.schedule_date AND r.rn = w.rn + 1))"""


def _book(v):
    return schedule.book_slots(v.session_schedule, v.booking_requests, REQUEST_ORDER)


@query(
    "book_slots",
    f"""WITH {BOOKING}
    SELECT r.order_no, r.line_no, r.supply_no, r.machine_id, r.price, w.verdict
    FROM r JOIN walk w ON w.schedule_date = r.schedule_date AND w.rn = r.rn
    UNION ALL SELECT order_no, line_no, supply_no, machine_id, price, 'missing patient_id'
    FROM booking_requests WHERE patient_id IS NULL""",
)
def book_slots(v):
    return _book(v)[1].select(*REQUEST_ORDER, "verdict")


@query(
    "book_slots_schedule",
    f"""WITH {BOOKING}
    SELECT id, patient_id, machine_id, schedule_date, shift, status FROM session_schedule UNION ALL
    SELECT (SELECT MAX(id) FROM session_schedule) + ROW_NUMBER() OVER (ORDER BY {', '.join('r.' + c for c in REQUEST_ORDER)}),
      r.patient_id, r.machine_id, r.schedule_date, r.shift, 'Scheduled'
    FROM r JOIN walk w ON w.schedule_date = r.schedule_date AND w.rn = r.rn AND w.verdict = 'accepted'""",
)
def book_slots_schedule(v):
    return _book(v)[0].select("id", "patient_id", "machine_id", "schedule_date", "shift", "status")


MOVE_ORDER = ["moved_on", "order_no", "line_no", "machine_no", "price", "change_amount"]
LEDGER = f"""
m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY supply_id ORDER BY {', '.join(MOVE_ORDER)}) AS rn
  FROM stock_movements WHERE supply_id IN (SELECT id FROM medical_supplies)),
walk AS (
  SELECT id AS supply_id, CAST(0 AS BIGINT) AS rn, quantity, TRUE AS ok FROM medical_supplies
  UNION ALL
  SELECT m.supply_id, m.rn, CASE WHEN w.quantity + m.change_amount >= 0 THEN w.quantity + m.change_amount
    ELSE w.quantity END, w.quantity + m.change_amount >= 0
  FROM walk w JOIN m ON m.supply_id = w.supply_id AND m.rn = w.rn + 1)"""
LEDGER_LOG = f"""WITH {LEDGER}
  SELECT {', '.join('m.' + c for c in MOVE_ORDER)}, m.supply_id, CASE WHEN w.ok THEN 'accepted' ELSE 'negative' END AS status,
    CASE WHEN w.ok THEN w.quantity END AS new_quantity
  FROM m JOIN walk w ON w.supply_id = m.supply_id AND w.rn = m.rn
  UNION ALL SELECT {', '.join(MOVE_ORDER)}, supply_id, 'unknown supply', NULL FROM stock_movements
  WHERE supply_id NOT IN (SELECT id FROM medical_supplies)"""


@query("stock_ledger", LEDGER_LOG)
def stock_ledger(v):
    return inventory.stock_ledger(v.medical_supplies, v.stock_movements, MOVE_ORDER)[1]


@query(
    "stock_ledger_supplies",
    f"""WITH {LEDGER} SELECT s.id, s.name, MAX_BY(w.quantity, w.rn) AS quantity
    FROM medical_supplies s JOIN walk w ON w.supply_id = s.id GROUP BY s.id, s.name""",
)
def stock_ledger_supplies(v):
    return inventory.stock_ledger(v.medical_supplies, v.stock_movements, MOVE_ORDER)[0].select("id", "name", "quantity")


RUNNING = f"""SELECT supply_id, {', '.join(MOVE_ORDER)}, CAST(SUM(change_amount) OVER (PARTITION BY supply_id
  ORDER BY {', '.join(MOVE_ORDER)} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS new_quantity FROM stock_movements"""


@query("running_balance", RUNNING)
def running_balance(v):
    return inventory.running_balance(v.stock_movements, "supply_id", MOVE_ORDER, "change_amount")


@query(
    "reconcile_ledger",
    f"""WITH log AS (SELECT *, new_quantity - CASE WHEN order_no % 500 = 0 THEN 1 ELSE 0 END AS logged FROM ({RUNNING})),
    gaps AS (SELECT *, logged - change_amount - LAG(logged) OVER (PARTITION BY supply_id ORDER BY {', '.join(MOVE_ORDER)}) AS gap,
      ROW_NUMBER() OVER (PARTITION BY supply_id ORDER BY {', '.join(MOVE_ORDER)}) AS rn FROM log)
    SELECT g.supply_id, COUNT(*) AS entries, MAX_BY(logged, rn) AS last_logged, s.quantity,
      BOOL_AND(COALESCE(gap, 0) = 0) AS gap_free,
      COALESCE(MAX_BY(logged, rn) = s.quantity, FALSE) AS matches_stock
    FROM gaps g LEFT JOIN medical_supplies s ON s.id = g.supply_id GROUP BY g.supply_id, s.quantity""",
)
def reconcile_ledger(v):
    log = inventory.running_balance(v.stock_movements, "supply_id", MOVE_ORDER, "change_amount")
    wrong = F.when(F.col("order_no") % 500 == 0, 1).otherwise(0)
    log = log.withColumn("new_quantity", F.col("new_quantity") - wrong)
    return inventory.reconcile_ledger(v.medical_supplies, log, MOVE_ORDER)


RECEIPTS = """
receipts AS (SELECT id AS request, id AS order_id FROM purchase_orders
  UNION ALL SELECT id + 1000000000000, id FROM purchase_orders
  UNION ALL SELECT id + 2000000000000, -id - 1 FROM purchase_orders),
v AS (SELECT r.request, r.order_id, ROW_NUMBER() OVER (PARTITION BY r.order_id ORDER BY r.request) AS nth,
    CASE WHEN o.id IS NULL THEN 'unknown order' WHEN o.status = 'Completed' THEN 'already completed'
      WHEN i.items IS NULL THEN 'no items' WHEN i.unknown > 0 THEN 'unknown supply' ELSE 'received' END AS first_verdict
  FROM receipts r LEFT JOIN purchase_orders o ON o.id = r.order_id
  LEFT JOIN (SELECT purchase_order_id, COUNT(*) AS items, COUNT(*) FILTER (supply_id NOT IN (SELECT id FROM medical_supplies))
    AS unknown FROM purchase_order_items GROUP BY 1) i ON i.purchase_order_id = r.order_id),
lines AS (SELECT i.*, v.request FROM purchase_order_items i
  JOIN v ON v.order_id = i.purchase_order_id AND v.nth = 1 AND v.first_verdict = 'received')"""
ITEM_ORDER = ["id", "quantity_ordered", "unit_price"]


def _receive(v):
    receipts = v.purchase_orders.select(F.col("id").alias("request"), F.col("id").alias("order_id"))
    again = v.purchase_orders.selectExpr("id + 1000000000000 AS request", "id AS order_id")
    absent = v.purchase_orders.selectExpr("id + 2000000000000 AS request", "-id - 1 AS order_id")
    return inventory.receive_orders(
        v.purchase_orders, v.purchase_order_items, v.medical_supplies,
        receipts.unionByName(again).unionByName(absent), ITEM_ORDER,
    )


@query(
    "receive_orders",
    f"""WITH {RECEIPTS} SELECT request, order_id, CASE WHEN nth > 1 AND first_verdict = 'received'
      THEN 'already completed' ELSE first_verdict END AS verdict FROM v""",
)
def receive_orders(v):
    return _receive(v)[3]


@query(
    "receive_orders_log",
    f"""WITH {RECEIPTS} SELECT l.supply_id, l.quantity_ordered AS change_amount,
      s.quantity + CAST(SUM(l.quantity_ordered) OVER (PARTITION BY l.supply_id
        ORDER BY l.request, {', '.join('l.' + c for c in ITEM_ORDER)} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS new_quantity,
      'استلام أمر شراء رقم ' || CAST(l.purchase_order_id AS VARCHAR) AS notes
    FROM lines l JOIN medical_supplies s ON s.id = l.supply_id""",
)
def receive_orders_log(v):
    return _receive(v)[2]


@query(
    "receive_orders_supplies",
    f"""WITH {RECEIPTS} SELECT s.id, s.name, s.quantity + CAST(COALESCE((SELECT SUM(quantity_ordered) FROM lines l
      WHERE l.supply_id = s.id), 0) AS BIGINT) AS quantity FROM medical_supplies s""",
)
def receive_orders_supplies(v):
    return _receive(v)[0].select("id", "name", "quantity")


@query(
    "receive_orders_status",
    f"""WITH {RECEIPTS} SELECT o.id, CASE WHEN o.id IN (SELECT purchase_order_id FROM lines) THEN 'Completed'
      ELSE o.status END AS status FROM purchase_orders o""",
)
def receive_orders_status(v):
    return _receive(v)[1].select("id", "status")


CREATED = """
h AS (SELECT id AS request, CASE WHEN id % 40 = 0 THEN NULL ELSE supplier_id END AS supplier_id, order_date
  FROM purchase_orders),
ok AS (SELECT *, (SELECT MAX(id) FROM purchase_orders) + ROW_NUMBER() OVER (ORDER BY request) AS id FROM h
  WHERE supplier_id IS NOT NULL AND request IN (SELECT purchase_order_id FROM purchase_order_items))"""
LINE_ORDER = ["position", "supply_id", "quantity_ordered", "unit_price"]


def _create(v):
    headers = v.purchase_orders.selectExpr(
        "id AS request", "CASE WHEN id % 40 = 0 THEN NULL ELSE supplier_id END AS supplier_id", "order_date"
    )
    lines = v.purchase_order_items.selectExpr(
        "purchase_order_id AS request", "id % 8 AS position", "supply_id", "quantity_ordered", "unit_price"
    )
    return inventory.create_orders(v.purchase_orders, v.purchase_order_items, headers, lines, ["request"], LINE_ORDER)


@query(
    "create_orders",
    f"""WITH {CREATED} SELECT id, supplier_id, order_date, status FROM purchase_orders
    UNION ALL SELECT id, supplier_id, order_date, 'Pending' FROM ok""",
)
def create_orders(v):
    return _create(v)[0].select("id", "supplier_id", "order_date", "status")


@query(
    "create_orders_items",
    f"""WITH {CREATED} SELECT id, purchase_order_id, supply_id, quantity_ordered, unit_price FROM purchase_order_items
    UNION ALL SELECT (SELECT MAX(id) FROM purchase_order_items) + ROW_NUMBER() OVER (ORDER BY ok.id, i.id % 8,
      i.supply_id, i.quantity_ordered, i.unit_price), ok.id, i.supply_id, i.quantity_ordered, i.unit_price
    FROM ok JOIN purchase_order_items i ON i.purchase_order_id = ok.request""",
)
def create_orders_items(v):
    return _create(v)[1]


@query(
    "create_orders_log",
    f"""WITH {CREATED} SELECT h.request, CASE WHEN ok.id IS NOT NULL THEN 'created'
      WHEN h.supplier_id IS NULL AND h.request NOT IN (SELECT purchase_order_id FROM purchase_order_items)
        THEN 'missing supplier_id; no items'
      WHEN h.supplier_id IS NULL THEN 'missing supplier_id' ELSE 'no items' END AS action, ok.id
    FROM h LEFT JOIN ok ON ok.request = h.request""",
)
def create_orders_log(v):
    return _create(v)[2]


# Every seventh day of a month is confirmed twice, the second time with other numbers.
CONFIRMED = """
n AS (SELECT session_date AS report_date, DAY(session_date) % 7 = 0 AS twice,
    '{"sessions":' || CAST(COUNT(*) + CASE WHEN DAY(session_date) % 7 = 0 THEN 1000 ELSE 0 END AS VARCHAR) || ',"bags":' ||
    CAST(CAST(SUM(COALESCE(blood_transfusion_bags, 0)) AS BIGINT) AS VARCHAR) || '}' AS json,
    CASE WHEN DAY(session_date) % 7 = 0 THEN 'second' WHEN COUNT(*) % 2 = 0 THEN 'SYSTEM' ELSE 'doctor' END AS who
  FROM sessions GROUP BY session_date)"""


def _confirmed(v):
    daily = v.sessions.groupBy(F.col("session_date").alias("report_date")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum(F.coalesce("blood_transfusion_bags", F.lit(0))).alias("bags"),
    )
    batch = daily.select(
        "report_date",
        F.struct("sessions", "bags").alias("final_data"),
        F.when(F.col("sessions") % 2 == 0, "").otherwise("doctor").alias("user"),
        F.lit(1).alias("turn"),
    )
    again = daily.where(F.dayofmonth("report_date") % 7 == 0).select(
        "report_date", F.struct((F.col("sessions") + 1000).alias("sessions"), "bags").alias("final_data"), F.lit("second").alias("user"), F.lit(2).alias("turn")
    )
    return daily_reports.confirm_reports(v.daily_reports, again.union(batch), "2000-01-02 03:04:05", ["turn"])


@query(
    "confirm_report",
    f"""WITH {CONFIRMED}
    SELECT r.id, r.report_date, 'CONFIRMED' AS report_status, n.json AS final_data, n.who AS confirmed_by_user,
      '2000-01-02 03:04:05' AS confirmed_at
    FROM daily_reports r JOIN n ON n.report_date = r.report_date
    UNION ALL
    SELECT (SELECT MAX(id) FROM daily_reports) + ROW_NUMBER() OVER (ORDER BY report_date), report_date, 'CONFIRMED', json,
      who, CASE WHEN twice THEN '2000-01-02 03:04:05' END FROM n WHERE report_date NOT IN (SELECT report_date FROM daily_reports)""",
)
def confirm_report(v):
    return _confirmed(v).withColumn("confirmed_at", F.date_format("confirmed_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "load_report",
    """SELECT CAST(session_date AS DATE) AS report_date, COUNT(*) AS sessions,
      CAST(SUM(COALESCE(blood_transfusion_bags, 0)) AS BIGINT) AS bags
    FROM sessions WHERE session_date = DATE '1997-03-05' GROUP BY 1""",
)
def load_report(v):
    row = daily_reports.load_report(_confirmed(v), "1997-03-05", "sessions bigint, bags bigint")
    return row.select("report_date", "final_data.sessions", "final_data.bags")
