"""Billing, counts, dashboards, attendance."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from careflow.bindings.registry import AS_OF, DAY, END, EVENT_MONTH, MONTH, START, query
from careflow.functions import filters, scalars as S
from careflow.operators import ordered, paging
from careflow.plans import billing, reports, roster

IN_MONTH = f"session_date >= DATE '{MONTH}-01' AND session_date < DATE '1997-04-01'"
PRICES = """
prices AS (
  SELECT COALESCE(NULLIF(MAX(price_per_session), 0), 200.0) AS ps,
         COALESCE(NULLIF(MAX(price_per_blood_bag), 0), 150.0) AS pb
  FROM app_settings WHERE id = 1)"""
TOTALS = f"""
totals AS (
  SELECT patient_id, COUNT(*) AS session_count,
         CAST(SUM(COALESCE(blood_transfusion_bags, 0)) AS BIGINT) AS total_bags,
         MIN(session_date) AS first_session_date, MAX(session_date) AS last_session_date
  FROM sessions WHERE {IN_MONTH} GROUP BY patient_id)"""
AMOUNTS = """
  session_count, total_bags, ps AS price_per_session, pb AS price_per_blood_bag,
  session_count * ps AS total_sessions_price, total_bags * pb AS total_blood_price,
  session_count * ps + total_bags * pb AS grand_total, first_session_date, last_session_date"""

BULK = f"""WITH {PRICES}, {TOTALS}
SELECT p.id, p.name, p.medical_id, p.national_id, p.referral_place, p.referral_date,
       p.dialysis_unit, '{MONTH}' AS billing_month, {AMOUNTS}
FROM patients p JOIN totals t ON t.patient_id = p.id CROSS JOIN prices"""


@query("bulk_invoices", BULK)
def bulk_invoices(v):
    return billing.bulk_invoices(v.patients, v.sessions, v.app_settings, MONTH)


@query("bulk_invoices_unit", f"SELECT * FROM ({BULK}) WHERE dialysis_unit = 'BUILDING'")
def bulk_invoices_unit(v):
    return billing.bulk_invoices(v.patients, v.sessions, v.app_settings, MONTH, "BUILDING")


@query(
    "invoice",
    f"""WITH {PRICES}, {TOTALS}
    SELECT p.id, p.name, p.medical_id, p.national_id, p.referral_place, '{MONTH}' AS billing_month,
      COALESCE(session_count, 0) AS session_count, COALESCE(total_bags, 0) AS total_bags,
      ps AS price_per_session, pb AS price_per_blood_bag,
      COALESCE(session_count, 0) * ps AS total_sessions_price,
      COALESCE(total_bags, 0) * pb AS total_blood_price,
      COALESCE(session_count, 0) * ps + COALESCE(total_bags, 0) * pb AS grand_total,
      first_session_date, last_session_date
    FROM patients p LEFT JOIN totals t ON t.patient_id = p.id CROSS JOIN prices WHERE p.id = 7""",
)
def invoice(v):
    return billing.invoice(v.patients, v.sessions, v.app_settings, 7, MONTH)


INVOICE_EXPORT = f"""WITH {PRICES}, {TOTALS}
    SELECT 'INV-199703-' || CAST(p.id AS VARCHAR) AS invoice_id, p.name AS patient_name, p.medical_id,
      p.dialysis_unit, p.national_id, p.referral_date, p.referral_place,
      'من ' || CAST(first_session_date AS VARCHAR) || ' إلى ' || CAST(last_session_date AS VARCHAR) AS claim_period,
      session_count, ps AS price_per_session, session_count * ps AS total_sessions_price,
      total_bags, pb AS price_per_blood_bag, total_bags * pb AS total_blood_price,
      session_count * ps + total_bags * pb AS grand_total
    FROM patients p JOIN totals t ON t.patient_id = p.id CROSS JOIN prices"""


@query("invoice_export", INVOICE_EXPORT)
def invoice_export(v):
    return billing.invoice_export(v.patients, v.sessions, v.app_settings, MONTH)


@query(
    "invoice_numbers",
    f"""WITH {TOTALS}
    SELECT p.id, p.name, ROW_NUMBER() OVER (ORDER BY p.name, p.id) AS invoice_number
    FROM patients p JOIN totals t ON t.patient_id = p.id""",
)
def invoice_numbers(v):
    rows = billing.numbered_invoices(v.patients, v.sessions, v.app_settings, MONTH)
    return rows.select("id", "name", "invoice_number")


@query("settings", f"WITH {PRICES} SELECT ps AS price_per_session, pb AS price_per_blood_bag FROM prices")
def settings(v):
    return billing.settings(v.app_settings)


@query(
    "first_last_in_group",
    """SELECT patient_id, MIN(session_date) AS first_session_date, MAX(session_date) AS last_session_date
    FROM sessions GROUP BY patient_id""",
)
def first_last_in_group(v):
    return reports.first_last_in_group(v.sessions, "patient_id", "session_date")


@query(
    "sessions_per_machine",
    """SELECT m.id AS machine_id, m.serial_number AS machine_name, COUNT(*) AS session_count
    FROM sessions s JOIN machines m ON s.machine_id = m.id GROUP BY m.id, m.serial_number""",
)
def sessions_per_machine(v):
    return reports.sessions_per_machine(v.sessions, v.machines)


@query(
    "sessions_per_patient",
    """SELECT p.id AS patient_id, p.name AS patient_name, p.medical_id, COUNT(*) AS session_count
    FROM sessions s JOIN patients p ON s.patient_id = p.id GROUP BY p.id, p.name, p.medical_id""",
)
def sessions_per_patient(v):
    return reports.sessions_per_patient(v.sessions, v.patients)


@query(
    "top_patients",
    f"""SELECT p.id AS patient_id, p.name AS patient_name, p.medical_id, COUNT(*) AS session_count
    FROM sessions s JOIN patients p ON s.patient_id = p.id
    WHERE session_date BETWEEN DATE '{START}' AND DATE '{END}'
    GROUP BY p.id, p.name, p.medical_id ORDER BY session_count DESC, patient_id LIMIT 10""",
)
def top_patients(v):
    return reports.top_patients(v.sessions, v.patients, START, END)


@query(
    "period_summary",
    f"""SELECT session_date, COUNT(*) AS session_count FROM sessions
    WHERE session_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY ROLLUP (session_date)""",
)
def period_summary(v):
    return reports.period_summary(v.sessions, START, END)


def _count(period: str, metric: str, table: str, where: str = "TRUE") -> str:
    return f"SELECT '{period}' AS period, '{metric}' AS metric, COUNT(*) AS value FROM {table} WHERE {where}"


NOW_RANGE, OLD_RANGE = (
    f"BETWEEN DATE '{START}' AND DATE '{END}'",
    "BETWEEN DATE '1996-07-04' AND DATE '1996-12-31'",
)
DASHBOARD = " UNION ALL ".join(
    [
        _count("current", "total_patients", "patients"),
        _count("current", "active_referrals", "patients", f"referral_expiry >= DATE '{END}'"),
        _count("current", "expired_referrals", "patients", f"referral_expiry < DATE '{AS_OF}'"),
        _count("current", "new_patients", "patients", f"added_date {NOW_RANGE}"),
        _count("current", "total_sessions", "sessions", f"session_date {NOW_RANGE}"),
        _count("current", "sessions_with_blood", "sessions", f"session_date {NOW_RANGE} AND blood_transfusion_bags > 0"),
        _count("current", "preventive_maintenances", "preventive_maintenances", f"maintenance_date {NOW_RANGE}"),
        _count("current", "curative_maintenances", "curative_maintenances", f"report_date {NOW_RANGE}"),
        _count("previous", "active_referrals", "patients", "referral_expiry >= DATE '1996-12-31'"),
        _count("previous", "expired_referrals", "patients", "referral_expiry < DATE '1996-12-31'"),
        _count("previous", "new_patients", "patients", f"added_date {OLD_RANGE}"),
        _count("previous", "total_sessions", "sessions", f"session_date {OLD_RANGE}"),
        _count("previous", "sessions_with_blood", "sessions", f"session_date {OLD_RANGE} AND blood_transfusion_bags > 0"),
        _count("other", "total_staff", "staff"),
    ]
)


@query("dashboard", DASHBOARD)
def dashboard(v):
    return reports.dashboard(
        v.patients, v.sessions, v.preventive_maintenances, v.curative_maintenances, v.staff, START, END, AS_OF
    )


@query(
    "distribution_gender",
    f"""SELECT COALESCE(NULLIF(gender, ''), '{S.UNSPECIFIED}') AS gender, COUNT(*) AS total
    FROM patients GROUP BY 1""",
)
def distribution_gender(v):
    return reports.distribution(v.patients, "gender")


@query(
    "distribution_virus_status",
    f"""SELECT COALESCE(NULLIF(virus_status, ''), '{S.UNSPECIFIED}') AS virus_status, COUNT(*) AS total
    FROM patients GROUP BY 1""",
)
def distribution_virus_status(v):
    return reports.distribution(v.patients, "virus_status")


@query(
    "distribution_unit",
    f"""SELECT COALESCE(NULLIF(dialysis_unit, ''), '{S.UNSPECIFIED_UNIT}') AS dialysis_unit, COUNT(*) AS total
    FROM patients WHERE is_archived = 0 GROUP BY 1""",
)
def distribution_unit(v):
    return reports.distribution(v.patients.where("is_archived = 0"), "dialysis_unit", S.UNSPECIFIED_UNIT)


@query("distribution_blood_type", "SELECT blood_type, COUNT(*) AS total FROM patients GROUP BY blood_type")
def distribution_blood_type(v):
    return reports.distribution(v.patients, "blood_type", None)


@query(
    "age_distribution",
    f"""SELECT CASE WHEN dob IS NULL THEN '{S.AGE_GROUPS[4]}'
      WHEN 1998 - YEAR(dob) < 18 THEN '{S.AGE_GROUPS[0]}' WHEN 1998 - YEAR(dob) <= 45 THEN '18-45'
      WHEN 1998 - YEAR(dob) <= 65 THEN '46-65' ELSE '{S.AGE_GROUPS[3]}' END AS age_group,
      COUNT(*) AS total FROM patients GROUP BY 1""",
)
def age_distribution(v):
    return reports.age_distribution(v.patients, AS_OF)


@query(
    "monthly_trend_sessions",
    f"""SELECT STRFTIME(session_date, '%Y-%m') AS month, COUNT(*) AS total FROM sessions
    WHERE session_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1""",
)
def monthly_trend_sessions(v):
    return reports.monthly_trend(v.sessions, "session_date", START, END)


@query(
    "monthly_trend_patients",
    f"""SELECT STRFTIME(added_date, '%Y-%m') AS month, COUNT(*) AS total FROM patients
    WHERE added_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1""",
)
def monthly_trend_patients(v):
    return reports.monthly_trend(v.patients, "added_date", START, END)


@query(
    "referral_status",
    f"""SELECT COUNT(*) FILTER (referral_expiry >= DATE '{AS_OF}') AS active,
      COUNT(*) FILTER (referral_expiry BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30) AS expiring,
      COUNT(*) FILTER (referral_expiry < DATE '{AS_OF}') AS expired FROM patients""",
)
def referral_status(v):
    return reports.referral_status(v.patients, AS_OF)


@query(
    "count_by_unit_patients",
    "SELECT dialysis_unit AS unit, COUNT(*) AS patient_count FROM patients WHERE is_archived = 0 GROUP BY 1",
)
def count_by_unit_patients(v):
    return reports.count_by_unit(v.patients, "dialysis_unit", "patient_count")


@query("count_by_unit_machines", "SELECT internal_unit AS unit, COUNT(*) AS machine_count FROM machines GROUP BY 1")
def count_by_unit_machines(v):
    return reports.count_by_unit(v.machines, "internal_unit", "machine_count")


@query("total_staff", "SELECT COUNT(*) AS total FROM staff")
def total_staff(v):
    return paging.total(v.staff)


VIRUS_SPLIT = f"""
  SELECT p.dialysis_unit AS unit, COUNT(*) AS total,
    COUNT(*) FILTER (p.virus_status = 'سلبي') AS negative,
    COUNT(*) FILTER (p.virus_status = 'ايجابي فيروس B') AS positive_b,
    COUNT(*) FILTER (p.virus_status = 'ايجابي فيروس C') AS positive_c
  FROM sessions s JOIN patients p ON s.patient_id = p.id
  WHERE s.session_date = DATE '{DAY}' AND p.is_archived = 0 AND p.dialysis_unit <> ''"""


@query("sessions_by_unit_and_virus", f"{VIRUS_SPLIT} GROUP BY ROLLUP (p.dialysis_unit)")
def sessions_by_unit_and_virus(v):
    return reports.sessions_by_unit_and_virus(v.sessions, v.patients, DAY)


@query(
    "unit_daily_report",
    f"""WITH s AS ({VIRUS_SPLIT} GROUP BY 1),
    p AS (SELECT dialysis_unit AS unit, COUNT(*) AS patient_count FROM patients
          WHERE is_archived = 0 AND dialysis_unit <> '' GROUP BY 1),
    m AS (SELECT internal_unit AS unit, COUNT(*) AS machine_count FROM machines
          WHERE internal_unit <> '' GROUP BY 1)
    SELECT COALESCE(p.unit, m.unit, s.unit) AS unit, COALESCE(patient_count, 0) AS patient_count,
      COALESCE(machine_count, 0) AS machine_count, COALESCE(total, 0) AS total,
      COALESCE(negative, 0) AS negative, COALESCE(positive_b, 0) AS positive_b,
      COALESCE(positive_c, 0) AS positive_c
    FROM p FULL JOIN m ON p.unit = m.unit FULL JOIN s ON s.unit = COALESCE(p.unit, m.unit)""",
)
def unit_daily_report(v):
    return reports.unit_daily_report(v.patients, v.machines, v.sessions, DAY)


@query(
    "missed_in_month",
    f"""SELECT id, name, medical_id, phone, dialysis_unit FROM patients
    WHERE is_archived = 0 AND STRFTIME(added_date, '%Y-%m') <= '{MONTH}'
      AND id NOT IN (SELECT patient_id FROM sessions WHERE {IN_MONTH})""",
)
def missed_in_month(v):
    return reports.missed_in_month(v.patients, v.sessions, MONTH)


@query(
    "missed_in_month_unit",
    f"""SELECT id, name, medical_id, phone, dialysis_unit FROM patients
    WHERE is_archived = 0 AND STRFTIME(added_date, '%Y-%m') <= '{MONTH}' AND dialysis_unit = 'MACHINERY'
      AND id NOT IN (SELECT patient_id FROM sessions WHERE {IN_MONTH})""",
)
def missed_in_month_unit(v):
    return reports.missed_in_month(v.patients, v.sessions, MONTH, "MACHINERY")


@query(
    "attended_in_month",
    f"""SELECT DISTINCT p.id, p.name, p.medical_id, p.national_id, p.referral_place
    FROM patients p JOIN sessions s ON p.id = s.patient_id WHERE {IN_MONTH}""",
)
def attended_in_month(v):
    return reports.attended_in_month(v.patients, v.sessions, MONTH)


ATTENDANCE = f"""
  SELECT 'with' AS attendance, p.id, p.name, p.medical_id
  FROM sessions s JOIN patients p ON s.patient_id = p.id WHERE s.session_date = DATE '{DAY}' {{extra}}
  UNION ALL
  SELECT 'without', p.id, p.name, p.medical_id FROM patients p
  WHERE REPLACE(',' || dialysis_days || ',', ' ', '') LIKE '%,Wed,%' {{extra}}
    AND id NOT IN (SELECT patient_id FROM sessions WHERE session_date = DATE '{DAY}')"""


@query("attendance_on", ATTENDANCE.format(extra=""))
def attendance_on(v):
    return reports.attendance_on(v.patients, v.sessions, DAY)


@query(
    "attendance_on_filtered",
    ATTENDANCE.format(extra="AND p.virus_status = 'سلبي' AND p.dialysis_unit = 'FURNITURE'"),
)
def attendance_on_filtered(v):
    return reports.attendance_on(v.patients, v.sessions, DAY, "سلبي", "FURNITURE")


EXPECTED = f"referral_expiry >= DATE '{AS_OF}' AND dialysis_days IS NOT NULL AND dialysis_days <> ''"


@query(
    "predicted_roster",
    f"""WITH expected AS (
      SELECT p.id, p.name, CAST(d.day AS DATE) AS session_date, p.dialysis_days FROM patients p,
        generate_series(DATE '{MONTH}-01', DATE '{MONTH}-31', INTERVAL 1 DAY) AS d(day) WHERE {EXPECTED})
    SELECT id, name, session_date,
      (id, session_date) IN (SELECT (patient_id, session_date) FROM sessions) AS held
    FROM expected
    WHERE REPLACE(',' || dialysis_days || ',', ' ', '') LIKE '%,' || STRFTIME(session_date, '%a') || ',%'""",
)
def predicted_roster(v):
    return reports.predicted_roster(v.patients, v.sessions, MONTH, AS_OF)


@query("predicted_inputs", f"SELECT id, name, dialysis_days FROM patients WHERE {EXPECTED}")
def predicted_inputs(v):
    return reports.predicted_inputs(v.patients, AS_OF)


@query(
    "monthly_cards",
    f"""WITH d AS (SELECT patient_id, session_date, COUNT(*) AS n FROM sessions WHERE {IN_MONTH} GROUP BY ALL)
    SELECT p.id, p.name, p.medical_id,
      STRING_AGG(CAST(session_date AS VARCHAR) || 'x' || CAST(n AS VARCHAR), ',' ORDER BY session_date) AS dates
    FROM patients p JOIN d ON d.patient_id = p.id GROUP BY p.id, p.name, p.medical_id""",
)
def monthly_cards(v):
    cards = reports.monthly_cards(v.patients, v.sessions, MONTH)
    text = F.transform(
        "dates", lambda d: F.concat(d["session_date"].cast("string"), F.lit("x"), d["sessions"].cast("string"))
    )
    return cards.withColumn("dates", F.array_join(text, ","))


SHEET_DAYS = [date(1997, 3, d) for d in range(1, 12)]


@query(
    "attendance_sheet",
    """SELECT p.id, p.name, p.medical_id, COALESCE(p.dialysis_unit, '') AS dialysis_unit, """
    + ", ".join(
        f"COALESCE(MAX(CASE WHEN session_date = DATE '{d}' THEN '✔' END), '') AS \"{d}\"" for d in SHEET_DAYS
    )
    + f""" FROM sessions s JOIN patients p ON s.patient_id = p.id
    WHERE session_date BETWEEN DATE '{SHEET_DAYS[0]}' AND DATE '{SHEET_DAYS[-1]}'
    GROUP BY p.id, p.name, p.medical_id, p.dialysis_unit""",
)
def attendance_sheet(v):
    return reports.attendance_sheet(v.patients, v.sessions, SHEET_DAYS[0], SHEET_DAYS[-1])


TWO_MONTHS = [date(1997, 2, 27), date(1997, 2, 28), *[date(1997, 3, d) for d in range(1, 29)]]


@query(
    "attendance_sheet_by_day_of_month",
    """SELECT p.id, p.name, p.medical_id, COALESCE(p.dialysis_unit, '') AS dialysis_unit, """
    + ", ".join(
        f"COALESCE(MAX(CASE WHEN DAY(session_date) = {d.day} THEN '✔' END), '') AS \"{d}\"" for d in TWO_MONTHS
    )
    + f""" FROM sessions s JOIN patients p ON s.patient_id = p.id
    WHERE session_date BETWEEN DATE '{TWO_MONTHS[0]}' AND DATE '{TWO_MONTHS[-1]}'
    GROUP BY p.id, p.name, p.medical_id, p.dialysis_unit""",
)
def attendance_sheet_by_day_of_month(v):
    return reports.attendance_sheet(v.patients, v.sessions, TWO_MONTHS[0], TWO_MONTHS[-1], by="day_of_month")


@query(
    "machines_with_maintenance",
    """WITH r AS (
      SELECT machine_id, 'preventive' AS maintenance, id AS record_id, maintenance_date AS record_date,
        technician_name, notes AS record_notes, visitor_name, section, CAST(NULL AS VARCHAR) AS request_number,
        CAST(NULL AS DATE) AS repair_date, CAST(NULL AS VARCHAR) AS engineer_name, CAST(NULL AS DOUBLE) AS cost,
        CAST(NULL AS VARCHAR) AS parts_details, CAST(NULL AS VARCHAR) AS failure_description,
        CAST(NULL AS VARCHAR) AS repair_notes
      FROM preventive_maintenances WHERE maintenance_date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'
      UNION ALL
      SELECT machine_id, 'curative', id, report_date, NULL, NULL, NULL, NULL, request_number, repair_date,
        engineer_name, cost, parts_details, failure_description, repair_notes
      FROM curative_maintenances WHERE report_date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31')
    SELECT m.*, r.* EXCLUDE (machine_id) FROM machines m LEFT JOIN r ON r.machine_id = m.id""",
)
def machines_with_maintenance(v):
    return reports.machines_with_maintenance(
        v.machines, v.preventive_maintenances, v.curative_maintenances, "quarterly", DAY
    )


DAYS31 = range(1, 32)
EFFECTIVE = f"""
cal AS (SELECT s.id, s.name, s.default_shift, CAST(g.day AS DATE) AS day FROM staff s,
  generate_series(DATE '{EVENT_MONTH}-01', DATE '{EVENT_MONTH}-31', INTERVAL 1 DAY) AS g(day)),
eff AS (SELECT c.id, c.name, c.day, COALESCE(x.new_shift_type, c.default_shift, '') AS code
  FROM cal c LEFT JOIN shift_changes x ON x.staff_id = c.id AND x.shift_date = c.day),
hrs AS (SELECT *, CASE code WHEN 'M' THEN 8 WHEN 'A' THEN 8 WHEN 'L' THEN 12 WHEN 'N' THEN 12
  WHEN 'NM' THEN 18 WHEN 'AN' THEN 18 ELSE 0 END AS h FROM eff)"""


@query("roster_hours", f"WITH {EFFECTIVE} SELECT id, name, CAST(SUM(h) AS BIGINT) AS total_hours FROM hrs GROUP BY 1, 2")
def roster_hours(v):
    return roster.roster_hours(v.staff, v.shift_changes, EVENT_MONTH)


ROSTER_SHEET = (
    f"WITH {EFFECTIVE} SELECT id, name, "
    + ", ".join(f"MAX(CASE WHEN DAY(day) = {d} THEN code END) AS day{d}" for d in DAYS31)
    + ", CAST(SUM(h) AS BIGINT) AS total_hours FROM hrs GROUP BY 1, 2"
)


@query("roster_sheet", ROSTER_SHEET)
def roster_sheet(v):
    return roster.roster_sheet(v.staff, v.shift_changes, EVENT_MONTH)


@query(
    "roster_inputs",
    """SELECT s.id, s.name, s.default_shift, x.shift_date, x.new_shift_type FROM staff s
    LEFT JOIN shift_changes x ON x.staff_id = s.id AND STRFTIME(x.shift_date, '%Y-%m') = '2024-01'
    WHERE s.job_title = 'BUILDING'""",
)
def roster_inputs(v):
    return roster.roster_inputs(v.staff, v.shift_changes, EVENT_MONTH, "BUILDING")


@query("distinct_job_titles", "SELECT DISTINCT job_title FROM staff WHERE job_title IS NOT NULL AND job_title <> ''")
def distinct_job_titles(v):
    return paging.distinct_values(v.staff, "job_title")


@query(
    "sessions_with_blood",
    f"SELECT * FROM sessions WHERE session_date BETWEEN DATE '{START}' AND DATE '{END}' AND blood_transfusion_bags > 0",
)
def sessions_with_blood(v):
    return reports.sessions_with_blood(v.sessions, START, END)


@query("in_month", f"SELECT * FROM sessions WHERE {IN_MONTH}")
def in_month(v):
    return filters.in_month(v.sessions, "session_date", MONTH)


@query(
    "last_wins",
    """SELECT * FROM sessions QUALIFY ROW_NUMBER() OVER (PARTITION BY patient_id, session_date ORDER BY id DESC) = 1""",
)
def last_wins(v):
    return ordered.last_wins(v.sessions, ["patient_id", "session_date"], ["id"])


@query(
    "first_wins",
    """SELECT * FROM sessions QUALIFY ROW_NUMBER() OVER (PARTITION BY machine_id ORDER BY session_date, id) = 1""",
)
def first_wins(v):
    return ordered.first_wins(v.sessions, ["machine_id"], ["session_date", "id"])
