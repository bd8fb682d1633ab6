"""Scans, filters, lists, joins, labs and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow.bindings.registry import AS_OF, DAY, END, EVENT_END, EVENT_MONTH, EVENT_START, MONTH, START, query
from careflow.functions import filters, scalars as S
from careflow.operators import paging
from careflow.plans import inventory, labs, machines, patients, schedule

AGE = f"""CAST(YEAR(DATE '{AS_OF}') - YEAR(dob)
  - CASE WHEN STRFTIME(DATE '{AS_OF}', '%m%d') < STRFTIME(dob, '%m%d') THEN 1 ELSE 0 END AS INT)"""


@query("scan_sessions", "SELECT * FROM sessions")
def scan_sessions(v):
    return v.sessions


@query("lookup_patient", f"SELECT *, {AGE} AS age FROM patients WHERE id = 42")
def lookup_patient(v):
    return patients.with_age(paging.lookup(v.patients, "id", 42), AS_OF)


@query("lookup_machine", "SELECT * FROM machines WHERE id = 3")
def lookup_machine(v):
    return paging.lookup(v.machines, "id", 3)


@query("lookup_staff", "SELECT * FROM staff WHERE id = 11")
def lookup_staff(v):
    return paging.lookup(v.staff, "id", 11)


@query("lookup_supply", "SELECT * FROM medical_supplies WHERE id = 5")
def lookup_supply(v):
    return paging.lookup(v.medical_supplies, "id", 5)


@query("lookup_supplier", "SELECT * FROM suppliers WHERE id = 5")
def lookup_supplier(v):
    return paging.lookup(v.suppliers, "id", 5)


@query("lookup_test_type", "SELECT * FROM lab_test_types WHERE id = 4")
def lookup_test_type(v):
    return paging.lookup(v.lab_test_types, "id", 4)


@query(
    "search_patients",
    "SELECT * FROM patients WHERE name ILIKE '%mer#0%1_2%' OR medical_id ILIKE '%mer#0%1_2%' OR national_id ILIKE '%mer#0%1_2%'",
)
def search_patients(v):
    return filters.search(v.patients, "MER#0%1_2", patients.SEARCH_COLUMNS)


@query("search_suppliers", "SELECT * FROM suppliers WHERE name ILIKE '%9%' OR contact_person ILIKE '%9%'")
def search_suppliers(v):
    return filters.search(v.suppliers, "9", ["name", "contact_person"])


@query("equals_if_given", "SELECT * FROM machines WHERE status = 'نشط' AND ward = 'Ward 0'")
def equals_if_given(v):
    return filters.equals_if_given(v.machines, {"status": "نشط", "ward": "Ward 0", "brand": None, "absent": "x"})


@query("contains_place", "SELECT * FROM patients WHERE referral_place ILIKE '%clinic%'")
def contains_place(v):
    return filters.contains(v.patients, "referral_place", "CLINIC")


@query(
    "has_weekday",
    "SELECT * FROM patients WHERE REPLACE(',' || dialysis_days || ',', ' ', '') LIKE '%,Wed,%'",
)
def has_weekday(v):
    return filters.has_token(v.patients, "dialysis_days", "Wed")


@query("expiry_active", f"SELECT * FROM patients WHERE referral_expiry >= DATE '{AS_OF}'")
def expiry_active(v):
    return filters.expiry_status(v.patients, "referral_expiry", AS_OF, "active")


@query(
    "expiry_expiring",
    f"SELECT * FROM patients WHERE referral_expiry BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30",
)
def expiry_expiring(v):
    return filters.expiry_status(v.patients, "referral_expiry", AS_OF, "expiring")


@query("expiry_expired", f"SELECT * FROM patients WHERE referral_expiry < DATE '{AS_OF}'")
def expiry_expired(v):
    return filters.expiry_status(v.patients, "referral_expiry", AS_OF, "expired")


@query("date_between", f"SELECT * FROM sessions WHERE session_date BETWEEN DATE '{START}' AND DATE '{END}'")
def date_between(v):
    return filters.date_between(v.sessions, "session_date", START, END)


@query("low_stock", "SELECT * FROM medical_supplies WHERE quantity < 10")
def low_stock(v):
    return filters.low_stock(v.medical_supplies)


@query("non_blank_units", "SELECT * FROM patients WHERE dialysis_unit IS NOT NULL AND dialysis_unit <> ''")
def non_blank_units(v):
    return filters.non_blank(v.patients, "dialysis_unit")


@query(
    "offered_machines",
    "SELECT id, serial_number, ward, internal_unit, status FROM machines WHERE status IN ('نشط', 'تحت الصيانة')",
)
def offered_machines(v):
    return schedule.offered_machines(v.machines)


@query("public_users", "SELECT id, username, full_name, role, is_active FROM users")
def public_users(v):
    return filters.public_columns(v.users, ["password_hash"], ["full_name", "id"])


@query(
    "sessions_with_patient",
    f"""SELECT s.*, p.name AS patient_name, p.medical_id FROM sessions s JOIN patients p ON s.patient_id = p.id
    WHERE s.status = 'F' AND (p.name ILIKE '%7%' OR p.medical_id ILIKE '%7%')""",
)
def sessions_with_patient(v):
    return schedule.sessions_with_patient(v.sessions, v.patients, status="F", term="7")


@query(
    "sessions_with_patient_on_day",
    f"""SELECT s.*, p.name AS patient_name, p.medical_id FROM sessions s JOIN patients p ON s.patient_id = p.id
    WHERE s.session_date = DATE '{DAY}'""",
)
def sessions_with_patient_on_day(v):
    return schedule.sessions_with_patient(v.sessions, v.patients, day=DAY)


@query(
    "orders_with_supplier",
    "SELECT o.*, s.name AS supplier_name FROM purchase_orders o JOIN suppliers s ON o.supplier_id = s.id",
)
def orders_with_supplier(v):
    return inventory.orders_with_supplier(v.purchase_orders, v.suppliers)


ORDER_DETAIL = """
  SELECT o.id, o.supplier_id, s.name AS supplier_name, o.order_date, o.status, i.item_id, i.supply_id,
    i.supply_name, i.quantity_ordered, i.unit_price
  FROM purchase_orders o JOIN suppliers s ON o.supplier_id = s.id
  LEFT JOIN (SELECT x.id AS item_id, x.purchase_order_id, x.supply_id, m.name AS supply_name,
    x.quantity_ordered, x.unit_price FROM purchase_order_items x
    JOIN medical_supplies m ON x.supply_id = m.id) i ON i.purchase_order_id = o.id"""


@query("order_detail", f"{ORDER_DETAIL} WHERE o.id = 77")
def order_detail(v):
    return inventory.order_detail(v.purchase_orders, v.suppliers, v.purchase_order_items, v.medical_supplies, 77)


@query("order_details_all", ORDER_DETAIL)
def order_details_all(v):
    return inventory.order_detail(v.purchase_orders, v.suppliers, v.purchase_order_items, v.medical_supplies)


TYPES = "t.test_name, t.unit, t.result_type, t.normal_range_low, t.normal_range_high, t.normal_value_text"
ENRICHED = f"""SELECT r.*, {TYPES} FROM lab_results r JOIN patients p ON r.patient_id = p.id
  JOIN lab_test_types t ON r.test_id = t.id"""


@query("lab_results_enriched", ENRICHED)
def lab_results_enriched(v):
    return labs.lab_results_enriched(v.lab_results, v.patients, v.lab_test_types)


@query(
    "lab_results_of_patient",
    f"{ENRICHED} WHERE r.patient_id = 8 AND STRFTIME(r.result_date, '%Y-%m') = '{EVENT_MONTH}'",
)
def lab_results_of_patient(v):
    return labs.lab_results_enriched(v.lab_results, v.patients, v.lab_test_types, 8, EVENT_MONTH)


@query("lab_result", f"SELECT r.*, {TYPES} FROM lab_results r JOIN lab_test_types t ON r.test_id = t.id WHERE r.id = 99")
def lab_result(v):
    return labs.lab_result(v.lab_results, v.lab_test_types, 99)


@query(
    "patient_lab_history",
    """SELECT r.id, r.result_value, r.result_date, r.notes, t.test_name, t.unit, t.normal_range_low,
    t.normal_range_high FROM lab_results r JOIN lab_test_types t ON r.test_id = t.id WHERE r.patient_id = 8""",
)
def patient_lab_history(v):
    return labs.patient_lab_history(v.lab_results, v.lab_test_types, 8)


REAL = r"""COALESCE(TRY_CAST(NULLIF(TRIM(REGEXP_EXTRACT(r.result_value,
  '^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')), '') AS DOUBLE), 0)"""
ABNORMAL = f"""SELECT r.id, r.patient_id, r.test_id, r.result_value, r.result_date, p.name AS patient_name,
    p.medical_id, {TYPES}
  FROM lab_results r JOIN patients p ON r.patient_id = p.id JOIN lab_test_types t ON r.test_id = t.id
  WHERE (t.result_type = 'number' AND ({REAL} < t.normal_range_low OR {REAL} > t.normal_range_high))
     OR (t.result_type = 'text' AND t.normal_value_text IS NOT NULL
         AND LOWER(TRIM(r.result_value)) <> LOWER(TRIM(t.normal_value_text)))"""


@query("abnormal_results", ABNORMAL)
def abnormal_results(v):
    return labs.abnormal_results(v.lab_results, v.patients, v.lab_test_types)


@query("critical_labs", f"{ABNORMAL} ORDER BY result_date DESC, patient_name NULLS FIRST, id LIMIT 20")
def critical_labs(v):
    return labs.critical_labs(v.lab_results, v.patients, v.lab_test_types)


@query(
    "maintenance_with_machine",
    """SELECT m.*, c.serial_number AS machine_name FROM maintenances m LEFT JOIN machines c ON m.machine_id = c.id""",
)
def maintenance_with_machine(v):
    return machines.maintenance_with_machine(v.maintenances, v.machines)


@query(
    "maintenance_record",
    """SELECT m.*, c.serial_number AS machine_name FROM maintenances m LEFT JOIN machines c ON m.machine_id = c.id
    WHERE m.id = 2""",
)
def maintenance_record(v):
    return machines.maintenance_with_machine(v.maintenances, v.machines, 2)


MACHINE = """m.serial_number AS machine_serial_number, m.ward AS machine_ward,
  m.internal_unit AS machine_internal_unit"""


@query(
    "daily_schedule",
    f"""SELECT s.patient_id, p.name AS patient_name, p.medical_id, p.dialysis_days, p.dialysis_shift,
      s.machine_id, {MACHINE}, s.shift
    FROM session_schedule s JOIN patients p ON s.patient_id = p.id LEFT JOIN machines m ON s.machine_id = m.id
    WHERE s.schedule_date = DATE '{DAY}'""",
)
def daily_schedule(v):
    return schedule.daily_schedule(v.session_schedule, v.patients, v.machines, DAY)


@query(
    "weekly_schedule",
    f"""SELECT s.id, s.patient_id, s.machine_id, s.schedule_date, s.shift, s.notes, p.name AS patient_name,
      p.medical_id, p.virus_status, {MACHINE}
    FROM session_schedule s JOIN patients p ON s.patient_id = p.id JOIN machines m ON s.machine_id = m.id
    WHERE s.schedule_date BETWEEN DATE '{START}' AND DATE '{END}'""",
)
def weekly_schedule(v):
    return schedule.weekly_schedule(v.session_schedule, v.patients, v.machines, START, END)


FREE = """SELECT id, name, medical_id, virus_status FROM patients WHERE id NOT IN (
  SELECT patient_id FROM session_schedule WHERE schedule_date {when})"""


@query("unscheduled_on_day", FREE.format(when=f"= DATE '{DAY}'"))
def unscheduled_on_day(v):
    return schedule.unscheduled(v.patients, v.session_schedule, DAY, DAY)


@query("unscheduled_in_period", FREE.format(when=f"BETWEEN DATE '{START}' AND DATE '{END}'"))
def unscheduled_in_period(v):
    return schedule.unscheduled(v.patients, v.session_schedule, START, END)


@query("page_water_log", """SELECT * FROM water_treatment_log WHERE log_date BETWEEN DATE '2024-01-10' AND
  DATE '2024-01-20' ORDER BY log_date DESC, id LIMIT 20 OFFSET 40""")
def page_water_log(v):
    rows = filters.date_between(v.water_treatment_log, "log_date", EVENT_START, EVENT_END)
    return paging.paginate(rows, ["-log_date", "id"], page=3, limit=20)


@query(
    "page_water_log_info",
    """SELECT COUNT(*) AS total, CAST(CEIL(COUNT(*) / 20.0) AS BIGINT) AS total_pages FROM water_treatment_log
    WHERE log_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""",
)
def page_water_log_info(v):
    rows = filters.date_between(v.water_treatment_log, "log_date", EVENT_START, EVENT_END)
    return paging.page_info(rows, 20)


@query("page_after", "SELECT * FROM staff WHERE (name, id) > ('Customer#000000075', 75) ORDER BY name, id LIMIT 15")
def page_after(v):
    return paging.page_after(v.staff, ["name", "id"], {"name": "Customer#000000075", "id": 75})


@query(
    "page_staff",
    """SELECT * FROM staff WHERE name ILIKE '%1%' AND employment_status = 'contract'
    ORDER BY name NULLS FIRST, id LIMIT 15 OFFSET 15""",
)
def page_staff(v):
    rows = filters.equals_if_given(
        filters.search(v.staff, "1", ["name", "national_id"]), {"employment_status": "contract"}
    )
    return paging.paginate(rows, ["name", "id"], page=2)


CONDITIONS = f"""(name ILIKE '%1%' OR medical_id ILIKE '%1%' OR national_id ILIKE '%1%')
  AND referral_place ILIKE '%clinic%' AND referral_expiry >= DATE '{AS_OF}'"""
ASKED = {"term": "1", "place": "clinic", "status": "active"}


@query(
    "patient_list",
    f"SELECT *, {AGE} AS age FROM patients WHERE {CONDITIONS} ORDER BY name NULLS FIRST, id LIMIT 15 OFFSET 15",
)
def patient_list(v):
    return patients.patient_list(v.patients, AS_OF, page=2, **ASKED)


@query(
    "patient_list_info",
    f"""SELECT COUNT(*) AS total, CAST(CEIL(COUNT(*) / 15.0) AS BIGINT) AS total_pages
    FROM patients WHERE {CONDITIONS}""",
)
def patient_list_info(v):
    return patients.patient_list_info(v.patients, AS_OF, **ASKED)


@query("all_patients_with_age", f"SELECT id, name, medical_id, referral_expiry, {AGE} AS age FROM patients")
def all_patients_with_age(v):
    rows = patients.with_age(v.patients, AS_OF).select("id", "name", "medical_id", "referral_expiry", "age")
    return paging.ordered_listing(rows, ["name", "id"])


@query(
    "newest_patients",
    f"""SELECT id, name, medical_id, added_date FROM patients
    WHERE added_date BETWEEN DATE '{START}' AND DATE '{END}'""",
)
def newest_patients(v):
    return patients.newest_patients(v.patients, START, END)


@query("list_machines", "SELECT * FROM machines WHERE ward = 'Ward 1'")
def list_machines(v):
    return paging.ordered_listing(filters.equals_if_given(v.machines, {"ward": "Ward 1"}), ["serial_number", "id"])


@query("list_test_types", "SELECT * FROM lab_test_types")
def list_test_types(v):
    return paging.ordered_listing(v.lab_test_types, ["test_name", "id"])


@query("list_suppliers", "SELECT * FROM suppliers")
def list_suppliers(v):
    return paging.ordered_listing(v.suppliers, ["name", "id"])


@query("patient_sessions", f"SELECT * FROM sessions WHERE patient_id = 7")
def patient_sessions(v):
    return schedule.patient_sessions(v.sessions, 7)


@query(
    "patient_sessions_month",
    f"""SELECT * FROM sessions WHERE STRFTIME(session_date, '%Y-%m') = '{MONTH}' AND patient_id =
    (SELECT MIN(patient_id) FROM sessions WHERE STRFTIME(session_date, '%Y-%m') = '{MONTH}')""",
)
def patient_sessions_month(v):
    patient = filters.in_month(v.sessions, "session_date", MONTH).agg(F.min("patient_id")).first()[0]
    return schedule.patient_sessions(v.sessions, patient, MONTH)


@query(
    "supply_list",
    f"""SELECT * FROM medical_supplies WHERE (name ILIKE '%bolt%' OR type ILIKE '%bolt%')
    AND expiry_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30""",
)
def supply_list(v):
    return inventory.supply_list(v.medical_supplies, "BOLT", "expiring_soon", AS_OF)


@query("supply_list_low", "SELECT * FROM medical_supplies WHERE (name ILIKE '%ring%' OR type ILIKE '%ring%') AND quantity < 10")
def supply_list_low(v):
    return inventory.supply_list(v.medical_supplies, "ring", "low_stock")


@query("supply_list_expired", f"SELECT * FROM medical_supplies WHERE expiry_date < DATE '{AS_OF}'")
def supply_list_expired(v):
    return inventory.supply_list(v.medical_supplies, None, "expired", AS_OF)


@query(
    "archive_listing",
    """SELECT id, name, medical_id, archive_reason, date_of_death, CAST(CAST(archived_at AS DATE) AS VARCHAR) AS archived_on
    FROM archived_patients WHERE name ILIKE '%tr%' OR medical_id ILIKE '%tr%' OR national_id ILIKE '%tr%'
      OR archive_reason ILIKE '%tr%' ORDER BY archived_at DESC, id LIMIT 15""",
)
def archive_listing(v):
    page = patients.archive_listing(v.archived_patients, "patients", "TR")
    return page.select(
        "id", "name", "medical_id", "archive_reason", "date_of_death",
        F.date_format("archived_at", "yyyy-MM-dd").alias("archived_on"),
    )


@query(
    "archive_listing_staff",
    """SELECT id, name, national_id, job_title, CAST(CAST(archived_at AS DATE) AS VARCHAR) AS archived_on FROM (
      SELECT id, name, national_id, dialysis_unit AS job_title, archived_at FROM archived_patients)
    WHERE name ILIKE '%build%' OR national_id ILIKE '%build%' OR job_title ILIKE '%build%'
    ORDER BY archived_at DESC, id LIMIT 15""",
)
def archive_listing_staff(v):
    gone = v.archived_patients.withColumnRenamed("dialysis_unit", "job_title")
    page = patients.archive_listing(gone, "staff", "build")
    return page.select(
        "id", "name", "national_id", "job_title", F.date_format("archived_at", "yyyy-MM-dd").alias("archived_on")
    )


@query(
    "archive_listing_sessions",
    """SELECT s.id, p.name AS patient_name, p.medical_id AS patient_medical_id, s.session_date,
      CAST(s.session_date + 30 AS VARCHAR) AS archived_on
    FROM sessions s JOIN patients p ON s.patient_id = p.id
    WHERE p.is_archived = 1 AND (p.name ILIKE '%1997-03%' OR p.medical_id ILIKE '%1997-03%'
      OR CAST(s.session_date AS VARCHAR) ILIKE '%1997-03%')
    ORDER BY s.session_date + 30 DESC, s.id LIMIT 15""",
)
def archive_listing_sessions(v):
    people = v.patients.where("is_archived = 1").select(
        F.col("id").alias("patient_id"), F.col("name").alias("patient_name"), F.col("medical_id").alias("patient_medical_id")
    )
    gone = v.sessions.join(people, "patient_id").select(
        "id", "patient_name", "patient_medical_id", "session_date",
        F.date_add("session_date", 30).cast("timestamp").alias("archived_at"),
    )
    page = patients.archive_listing(gone, "sessions", "1997-03")
    return page.withColumn("archived_on", F.date_format("archived_at", "yyyy-MM-dd")).drop("archived_at")


@query(
    "export_patients",
    f"""SELECT name AS "الاسم الكامل", medical_id AS "الرقم الطبي", {AGE} AS "العمر",
    dialysis_unit AS "الوحدة الداخلية" FROM patients""",
)
def export_patients(v):
    from careflow.sources.sinks import labelled

    rows = patients.with_age(v.patients, AS_OF)
    labels = {"name": "الاسم الكامل", "medical_id": "الرقم الطبي", "age": "العمر", "dialysis_unit": "الوحدة الداخلية"}
    return labelled(paging.ordered_listing(rows, ["name", "id"]), labels)


@query("age_years", f"SELECT id, {AGE} AS age FROM patients")
def age_years(v):
    return v.patients.select("id", S.age_years("dob", AS_OF).alias("age"))


@query(
    "add_months_overflow",
    """SELECT id, CAST(DATE_TRUNC('month', session_date) + INTERVAL 1 MONTH AS DATE) + CAST(DAY(session_date) - 1 AS INT) AS expiry
    FROM sessions""",
)
def add_months_overflow(v):
    return v.sessions.select("id", S.add_months_overflow("session_date", 1).alias("expiry"))


@query(
    "period_bounds",
    """SELECT id, CAST(DATE_TRUNC('month', d) AS DATE) AS monthly_start, LAST_DAY(d) AS monthly_end,
      CAST(DATE_TRUNC('quarter', d) AS DATE) AS quarterly_start,
      CAST(DATE_TRUNC('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarterly_end,
      CASE WHEN MONTH(d) <= 6 THEN MAKE_DATE(YEAR(d), 1, 1) ELSE MAKE_DATE(YEAR(d), 7, 1) END AS half_start,
      CASE WHEN MONTH(d) <= 6 THEN MAKE_DATE(YEAR(d), 6, 30) ELSE MAKE_DATE(YEAR(d), 12, 31) END AS half_end,
      MAKE_DATE(YEAR(d), 1, 1) AS annual_start, MAKE_DATE(YEAR(d), 12, 31) AS annual_end
    FROM (SELECT id, session_date AS d FROM sessions)""",
)
def period_bounds(v):
    names = {"monthly": "monthly", "quarterly": "quarterly", "semi-annually": "half", "annually": "annual"}
    out = []
    for kind, name in names.items():
        start, end = S.period_bounds(kind, F.col("session_date"))
        out += [start.alias(f"{name}_start"), end.alias(f"{name}_end")]
    return v.sessions.select("id", *out)


@query(
    "previous_period",
    """SELECT id, order_date - 1 - CAST(expected_delivery_date - order_date AS INT) AS prev_start,
    order_date - 1 AS prev_end FROM purchase_orders""",
)
def previous_period(v):
    start, end = S.previous_period(F.col("order_date"), F.col("expected_delivery_date"))
    return v.purchase_orders.select("id", start.alias("prev_start"), end.alias("prev_end"))


@query(
    "parse_sheet_date",
    """SELECT line_no, CASE WHEN t LIKE '____-__-__' THEN TRY_CAST(t AS DATE)
        WHEN TRY_CAST(t AS DOUBLE) IS NOT NULL AND TRY_CAST(t AS DOUBLE) <> 0
        THEN DATE '1970-01-01' + CAST(FLOOR(TRY_CAST(t AS DOUBLE) - 25569) AS INT) END AS parsed
    FROM (SELECT line_no, TRIM(dob) AS t FROM patient_sheet UNION ALL
          SELECT line_no, TRIM(referral_date) FROM patient_sheet UNION ALL
          SELECT line_no, TRIM(added_date) FROM patient_sheet)""",
)
def parse_sheet_date(v):
    cells = F.explode(F.array("dob", "referral_date", "added_date"))
    return v.patient_sheet.select("line_no", cells.alias("cell")).select(
        "line_no", S.parse_sheet_date("cell").alias("parsed")
    )


@query("sqlite_real", f"SELECT r.id, {REAL} AS number FROM lab_results r")
def sqlite_real(v):
    return v.lab_results.select("id", S.sqlite_real("result_value").alias("number"))


@query("normalise_text", "SELECT id, LOWER(TRIM(result_value, ' ')) AS text FROM lab_results")
def normalise_text(v):
    return v.lab_results.select("id", S.normalise_text("result_value").alias("text"))


@query("weekday_token", "SELECT id, STRFTIME(session_date, '%a') AS weekday FROM sessions")
def weekday_token(v):
    return v.sessions.select("id", S.weekday_token("session_date").alias("weekday"))


@query(
    "days_in_month",
    """SELECT id, CAST(DAY(LAST_DAY(session_date)) AS INT) AS days,
    TRY_CAST('1997-02-' || LPAD(CAST(DAY(session_date) AS VARCHAR), 2, '0') AS DATE) AS same_day FROM sessions""",
)
def days_in_month(v):
    return v.sessions.select(
        "id",
        S.days_in_month("session_date").alias("days"),
        S.date_of("1997-02", F.dayofmonth("session_date")).alias("same_day"),
    )


@query("label_or_default", "SELECT id, COALESCE(NULLIF(dialysis_unit, ''), 'x') AS unit FROM patients")
def label_or_default(v):
    return v.patients.select("id", S.label_or_default("dialysis_unit", "x").alias("unit"))


@query(
    "shift_hours",
    """SELECT id, CASE new_shift_type WHEN 'M' THEN 8 WHEN 'A' THEN 8 WHEN 'L' THEN 12 WHEN 'N' THEN 12
    WHEN 'NM' THEN 18 WHEN 'AN' THEN 18 ELSE 0 END AS hours FROM shift_changes""",
)
def shift_hours(v):
    return v.shift_changes.select("id", S.shift_hours("new_shift_type").alias("hours"))


@query(
    "int_checks",
    """SELECT id, COALESCE(n >= 0 AND n = FLOOR(n), FALSE) AS ok, CAST(TRUNC(n) AS BIGINT) AS whole
    FROM (SELECT id, TRY_CAST(result_value AS DOUBLE) AS n FROM lab_results)""",
)
def int_checks(v):
    return v.lab_results.select(
        "id", S.is_non_negative_int("result_value").alias("ok"), S.int_part("result_value").alias("whole")
    )
