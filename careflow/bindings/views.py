"""The driver tables seen as care-unit tables.

The expressions are plain SQL that Spark and DuckDB read alike, so both engines
start from the same rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class View:
    source: str
    columns: dict[str, str]
    where: str | None = None
    group: str | None = None


TEXT = "CAST(NULL AS STRING)"
DAY = "CAST(NULL AS DATE)"

# {n_sup} and {n_cust} stand for the numbers of suppliers and customers, {n_set} for a tenth of the customers.
COUNTS = {
    "n_sup": ("supplier", "count(*)"),
    "n_cust": ("customer", "count(*)"),
    "n_set": ("customer", "greatest(CAST(floor(count(*) / 10) AS BIGINT), 1)"),
}

VIEWS: dict[str, View] = {
    "patients": View(
        "customer",
        {
            "id": "c_custkey",
            "name": "c_name",
            "medical_id": "CAST(c_custkey AS STRING)",
            "national_id": "CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE 'N' || CAST(c_custkey * 7 AS STRING) END",
            "phone": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE '010' || CAST(c_custkey * 31 AS STRING) END",
            "address": "'Nation ' || CAST(c_nationkey AS STRING)",
            "added_date": "DATE '1995-01-01' + CAST(c_custkey * 13 % 1500 AS INT)",
            "referral_date": "DATE '1997-01-01' + CAST(c_custkey * 17 % 700 AS INT)",
            "referral_expiry": "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE DATE '1998-01-01' + CAST(c_custkey * 29 % 400 AS INT) END",
            "referral_place": "CASE c_custkey % 3 WHEN 0 THEN 'North Clinic' WHEN 1 THEN 'South clinic' ELSE 'Harbour' END",
            "dialysis_unit": "CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN '' ELSE c_mktsegment END",
            "blood_type": "CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'A+' WHEN c_custkey % 3 = 0 THEN 'O-' ELSE 'B+' END",
            "chronic_diseases": "CASE c_custkey % 3 WHEN 0 THEN 'diabetes,hypertension' WHEN 1 THEN 'asthma' ELSE '' END",
            "virus_status": "CASE c_nationkey % 4 WHEN 0 THEN 'سلبي' WHEN 1 THEN 'ايجابي فيروس B' WHEN 2 THEN 'ايجابي فيروس C' ELSE 'الجراي زون' END",
            "dob": "CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE DATE '1925-01-01' + CAST(c_custkey * 97 % 30000 AS INT) END",
            "gender": "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'ذكر' ELSE 'أنثى' END",
            "patient_notes": f"{TEXT}",
            "dialysis_days": "CASE c_custkey % 4 WHEN 0 THEN 'Sat,Mon,Wed' WHEN 1 THEN 'Sun,Tue,Thu' WHEN 2 THEN 'Sat, Wed' ELSE NULL END",
            "dialysis_shift": "CAST(c_custkey % 4 + 1 AS STRING)",
            "is_archived": "CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END",
        },
    ),
    "archived_patients": View(
        "customer",
        {
            "id": "c_custkey + 1000000000",
            "name": "c_name",
            "medical_id": "CAST(c_custkey + 1000000000 AS STRING)",
            "national_id": "'N' || CAST(c_custkey * 7 AS STRING)",
            "dialysis_unit": "c_mktsegment",
            "archive_reason": "CASE WHEN c_custkey % 2 = 0 THEN 'وفاة' ELSE 'Transfer' END",
            "archive_details": "'file ' || CAST(c_custkey % 10 AS STRING)",
            "date_of_death": "CASE WHEN c_custkey % 2 = 0 THEN DATE '1997-01-01' + CAST(c_custkey % 300 AS INT) END",
            "archived_at": "CAST(DATE '1998-01-01' + CAST(c_custkey % 90 AS INT) AS TIMESTAMP)",
        },
        where="c_acctbal < 0",
    ),
    "machines": View(
        "supplier",
        {
            "id": "s_suppkey",
            "serial_number": "s_name",
            "brand": "'Brand ' || CAST(s_suppkey % 4 AS STRING)",
            "model": "'M' || CAST(s_suppkey % 9 AS STRING)",
            "ward": "'Ward ' || CAST(s_suppkey % 3 AS STRING)",
            "internal_unit": "CASE s_nationkey % 7 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'FURNITURE' WHEN 2 THEN 'HOUSEHOLD' WHEN 3 THEN 'MACHINERY' WHEN 4 THEN 'ANNEX' WHEN 5 THEN '' ELSE NULL END",
            "status": "CASE s_suppkey % 4 WHEN 0 THEN 'نشط' WHEN 1 THEN 'تحت الصيانة' ELSE 'خارج الخدمة' END",
            "last_maintenance": "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE DATE '1996-01-01' + CAST(s_suppkey * 11 % 900 AS INT) END",
            "notes": f"{TEXT}",
        },
    ),
    "staff": View(
        "customer",
        {
            "id": "c_custkey",
            "name": "c_name",
            "national_id": "'S' || CAST(c_custkey AS STRING)",
            "phone": f"{TEXT}",
            "address": "'Nation ' || CAST(c_nationkey AS STRING)",
            "job_title": "CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN NULL ELSE c_mktsegment END",
            "employment_status": "CASE c_custkey % 3 WHEN 0 THEN 'permanent' ELSE 'contract' END",
            "grade": "CAST(c_custkey % 5 AS STRING)",
            "default_shift": "CASE c_custkey % 7 WHEN 0 THEN 'M' WHEN 1 THEN 'A' WHEN 2 THEN 'L' WHEN 3 THEN 'N' WHEN 4 THEN 'NM' WHEN 5 THEN 'OFF' ELSE NULL END",
        },
    ),
    "sessions": View(
        "orders",
        {
            "id": "o_orderkey",
            "patient_id": "o_custkey",
            "session_date": "CAST(o_orderdate AS DATE)",
            "shift": "o_orderpriority",
            "notes": "CASE WHEN o_orderkey % 5 = 0 THEN 'seen by Dr O''Neil' ELSE NULL END",
            "blood_transfusion_bags": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 4 END",
            "machine_id": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % ({n_sup} + 3) END",
            "machine_hours_operated": "CAST(o_orderkey % 9 AS DOUBLE) / 2.0",
            "status": "o_orderstatus",
        },
    ),
    "medical_supplies": View(
        "part",
        {
            "id": "p_partkey",
            "name": "p_name",
            "type": "p_type",
            "quantity": "CAST(p_size AS BIGINT)",
            "expiry_date": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE DATE '1998-01-01' + CAST(p_partkey * 7 % 400 AS INT) END",
        },
    ),
    "suppliers": View(
        "supplier",
        {
            "id": "s_suppkey",
            "name": "s_name",
            "contact_person": "'Contact ' || CAST(s_nationkey AS STRING)",
            "phone": "'02' || CAST(s_suppkey * 37 AS STRING)",
        },
    ),
    "purchase_orders": View(
        "orders",
        {
            "id": "o_orderkey",
            "supplier_id": "o_orderkey % ({n_sup} + 1)",
            "order_date": "CAST(o_orderdate AS DATE)",
            "expected_delivery_date": "CAST(o_orderdate AS DATE) + 7",
            "status": "CASE o_orderstatus WHEN 'F' THEN 'Completed' ELSE 'Pending' END",
            "notes": f"{TEXT}",
        },
    ),
    "purchase_order_items": View(
        "lineitem",
        {
            "id": "l_orderkey * 8 + l_linenumber",
            "purchase_order_id": "l_orderkey",
            "supply_id": "CASE WHEN l_orderkey % 29 = 0 AND l_linenumber = 1 THEN -1 ELSE l_partkey END",
            "quantity_ordered": "CAST(l_quantity AS BIGINT)",
            "unit_price": "l_extendedprice",
        },
    ),
    "stock_movements": View(
        "lineitem",
        {
            "supply_id": "CASE WHEN l_orderkey % 997 = 0 THEN -1 ELSE l_partkey END",
            "change_amount": "CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT)",
            "moved_on": "CAST(l_shipdate AS DATE)",
            "order_no": "l_orderkey",
            "line_no": "l_linenumber",
            "machine_no": "l_suppkey",
            "price": "l_extendedprice",
        },
    ),
    "preventive_maintenances": View(
        "orders",
        {
            "id": "o_orderkey",
            "machine_id": "o_orderkey % ({n_sup} + 3)",
            "maintenance_date": "CAST(o_orderdate AS DATE)",
            "technician_name": "o_orderpriority",
            "notes": "CASE WHEN o_orderkey % 6 = 0 THEN 'filter' ELSE NULL END",
            "visitor_name": f"{TEXT}",
            "section": "'S' || CAST(o_orderkey % 3 AS STRING)",
        },
        where="o_orderstatus = 'P'",
    ),
    "curative_maintenances": View(
        "orders",
        {
            "id": "o_orderkey",
            "machine_id": "o_orderkey % ({n_sup} + 3)",
            "report_date": "CAST(o_orderdate AS DATE)",
            "request_number": "'R' || CAST(o_orderkey AS STRING)",
            "repair_date": "CAST(o_orderdate AS DATE) + 3",
            "engineer_name": "o_orderpriority",
            "cost": "o_totalprice",
            "parts_details": f"{TEXT}",
            "failure_description": f"{TEXT}",
            "repair_notes": f"{TEXT}",
        },
        where="o_orderstatus = 'F'",
    ),
    "maintenances": View(
        "orders",
        {
            "id": "o_orderkey",
            "machine_id": "o_orderkey % ({n_sup} + 3)",
            "date": "CAST(o_orderdate AS DATE)",
            "type": "CASE o_orderkey % 2 WHEN 0 THEN 'preventive' ELSE 'curative' END",
            "technician": "o_orderpriority",
        },
        where="o_orderstatus = 'O'",
    ),
    "lab_test_types": View(
        "events",
        {
            "id": "CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS BIGINT)",
            "test_name": "event_type",
            "unit": "CASE event_type WHEN 'error' THEN NULL ELSE 'mg/dl' END",
            "result_type": "CASE event_type WHEN 'error' THEN 'text' ELSE 'number' END",
            "normal_range_low": "CAST(CASE event_type WHEN 'view' THEN 1.5 WHEN 'signup' THEN 0.5 WHEN 'click' THEN 2 END AS DOUBLE)",
            "normal_range_high": "CAST(CASE event_type WHEN 'view' THEN 60 WHEN 'purchase' THEN 100 WHEN 'click' THEN 40 END AS DOUBLE)",
            "normal_value_text": "CASE event_type WHEN 'error' THEN 'Negative' END",
        },
        group="event_type",
    ),
    "lab_results": View(
        "events",
        {
            "id": "event_id",
            "patient_id": "user_id",
            "test_id": "CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS BIGINT)",
            "result_value": "CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN ' negative ' WHEN 1 THEN 'NEGATIVE' ELSE 'Positive' END WHEN event_id % 7 = 0 THEN CAST(value AS STRING) || ' mg' WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 13 = 0 THEN '<5' ELSE CAST(value AS STRING) END",
            "result_date": "CAST(ts AS DATE)",
            "notes": f"{TEXT}",
        },
    ),
    "shift_changes": View(
        "events",
        {
            "id": "MAX(event_id)",
            "staff_id": "user_id",
            "shift_date": "CAST(ts AS DATE)",
            "new_shift_type": "MAX_BY(CASE event_id % 8 WHEN 0 THEN 'M' WHEN 1 THEN 'A' WHEN 2 THEN 'L' WHEN 3 THEN 'N' WHEN 4 THEN 'NM' WHEN 5 THEN 'AN' WHEN 6 THEN 'X' ELSE '' END, event_id)",
            "substitute_staff_id": "MAX(event_id) % 100",
            "notes": "'swap ' || CAST(MAX(event_id) % 10 AS STRING)",
        },
        group="user_id, CAST(ts AS DATE)",
    ),
    "session_schedule": View(
        "lineitem",
        {
            "id": "l_orderkey * 8 + l_linenumber",
            "patient_id": "l_orderkey % {n_cust}",
            "machine_id": "l_suppkey",
            "schedule_date": "CAST(l_shipdate AS DATE)",
            "shift": "CAST(l_linenumber AS STRING)",
            "status": "'Scheduled'",
            "notes": f"{TEXT}",
            "line_price": "l_extendedprice",
        },
        where="l_returnflag = 'N'",
    ),
    "booking_requests": View(
        "lineitem",
        {
            "patient_id": "CASE WHEN l_orderkey % 311 = 0 THEN NULL ELSE l_orderkey % {n_cust} END",
            "machine_id": "l_suppkey",
            "schedule_date": "CAST(l_shipdate AS DATE)",
            "shift": "CAST(l_linenumber AS STRING)",
            "order_no": "l_orderkey",
            "line_no": "l_linenumber",
            "supply_no": "l_partkey",
            "price": "l_extendedprice",
        },
        where="l_returnflag <> 'N'",
    ),
    "water_treatment_log": View(
        "events",
        {
            "id": "event_id",
            "log_date": "CAST(ts AS DATE)",
            "technician_name": "'T' || CAST(user_id % 10 AS STRING)",
            "chlorine_level_before": "value",
            "ph_level": "CAST(event_id % 14 AS DOUBLE)",
        },
        where="event_type = 'view'",
    ),
    "app_settings": View(
        "region",
        {
            "id": "CAST(r_regionkey AS BIGINT)",
            "price_per_session": "CAST(1400 + 50 * r_regionkey AS DOUBLE)",
            "price_per_blood_bag": "CAST(CASE WHEN r_regionkey = 1 THEN 0 ELSE 950 END AS DOUBLE)",
        },
    ),
    "users": View(
        "supplier",
        {
            "id": "s_suppkey",
            "username": "'user' || CAST(s_suppkey AS STRING)",
            "password_hash": "'hash' || CAST(s_suppkey * 7919 AS STRING)",
            "full_name": "s_name",
            "role": "CASE s_suppkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'doctor' WHEN 2 THEN 'nurse' WHEN 3 THEN 'clerk' ELSE 'guest' END",
            "is_active": "CASE WHEN s_acctbal < 0 THEN 0 ELSE 1 END",
        },
    ),
    "daily_reports": View(
        "orders",
        {
            "id": "CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT)",
            "report_date": "CAST(o_orderdate AS DATE)",
            "report_status": "'DRAFT'",
            "final_data": "'{{\"sessions\":0,\"bags\":' || CAST(COUNT(*) AS STRING) || '}}'",
            "confirmed_by_user": "'clerk'",
            "confirmed_at": "CAST(NULL AS TIMESTAMP)",
        },
        where="o_orderstatus = 'P'",
        group="CAST(o_orderdate AS DATE)",
    ),
    "patient_sheet": View(
        "events",
        {
            "line_no": "event_id",
            "name": "CASE WHEN event_id % 37 = 0 THEN '  ' ELSE ' Person ' || CAST(event_id AS STRING) || ' ' END",
            "medical_id": "'E' || CAST(event_id % {n_set} AS STRING) || '-' || CAST(event_id * 3 % 11 AS STRING)",
            "national_id": "'I' || CAST(event_id % {n_set} AS STRING) || '-' || CAST(event_id * 5 % 7 AS STRING)",
            "dob": "CASE event_id % 4 WHEN 0 THEN '1960-02-29' WHEN 1 THEN '22000' WHEN 2 THEN 'unknown' ELSE '' END",
            "gender": "''",
            "blood_type": "'A+'",
            "phone": "CAST(user_id AS STRING)",
            "address": "''",
            "added_date": "CASE WHEN event_id % 43 = 0 THEN '2024-13-01' ELSE CAST(CAST(ts AS DATE) AS STRING) END",
            "referral_date": "CASE event_id % 3 WHEN 0 THEN '45351' WHEN 1 THEN '45322.75' ELSE ' 2024-02-29 ' END",
            "referral_place": "'Clinic'",
            "dialysis_unit": "event_type",
            "virus_status": "CASE WHEN event_id % 53 = 0 THEN '' ELSE 'سلبي' END",
            "chronic_diseases": "''",
            "dialysis_days": "'Sat,Mon'",
            "dialysis_shift": "'1'",
            "patient_notes": f"{TEXT}",
        },
    ),
    "machine_sheet": View(
        "events",
        {
            "line_no": "event_id",
            "serial_number": "CASE WHEN event_id % 5 = 0 THEN 'Supplier#000000' || LPAD(CAST(event_id % 200 AS STRING), 3, '0') WHEN event_id % 31 = 0 THEN NULL ELSE ' SN' || CAST(event_id % ({n_cust} + 1) AS STRING) || ' ' END",
            "brand": "CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_type END",
            "model": f"{TEXT}",
            "ward": "CASE WHEN event_id % 31 = 0 THEN ' ' ELSE 'Ward' END",
            "internal_unit": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE 'Unit' END",
            "status": "CASE WHEN event_id % 31 = 0 THEN '' WHEN event_id % 29 = 0 THEN ' ' ELSE 'نشط' END",
            "last_maintenance": "CASE event_id % 3 WHEN 0 THEN '45658.75' WHEN 1 THEN '2024-05-06' ELSE 'soon' END",
            "notes": f"{TEXT}",
        },
    ),
}


class Views:
    """Care-unit tables over one data folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._counts: dict[str, int] = {}

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def count_of(self, name: str) -> int:
        if name not in self._counts:
            table, expr = COUNTS[name]
            self._counts[name] = self.source(table).agg(F.expr(expr)).first()[0]
        return self._counts[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        view = VIEWS[name]
        df = self.source(view.source)
        if view.where:
            df = df.where(view.where)
        columns = {c: self._fill(e) for c, e in view.columns.items()}
        if not view.group:
            return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
        df.createOrReplaceTempView("careflow_source")
        picked = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        return self.spark.sql(f"SELECT {picked} FROM careflow_source GROUP BY {view.group}")

    def _fill(self, expr: str) -> str:
        return expr.format(**{n: self.count_of(n) for n in COUNTS if f"{{{n}}}" in expr}) if "{" in expr else expr


COUNTED = {n: f"(SELECT {expr} FROM {table})" for n, (table, expr) in COUNTS.items()}


def view_sql(name: str) -> str:
    """The view as a DuckDB common table expression."""
    view = VIEWS[name]
    picked = ", ".join(
        f"{e.format(**COUNTED) if '{' in e else e} AS {c}"
        for c, e in view.columns.items()
    )
    sql = f"SELECT {picked} FROM {view.source}"
    sql += f" WHERE {view.where}" if view.where else ""
    sql += f" GROUP BY {view.group}" if view.group else ""
    return f"{name} AS ({sql})"


def with_views(sql: str) -> str:
    """Puts the views the SQL names in front of it. SQL may start with its own WITH."""
    named = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    sql = sql.strip()
    own = re.match(r"(?is)with\s+(recursive\s+)?(.*)", sql)
    ctes = ", ".join(view_sql(n) for n in named)
    if own:
        return f"WITH RECURSIVE {ctes}{', ' if ctes else ''}{own.group(2)}"
    return f"WITH RECURSIVE {ctes} {sql}" if ctes else sql
