"""Table schemas: columns, types, unique keys, required fields and defaults."""

from __future__ import annotations

# The columns of every table, as DDL.
TABLES = {
    "patients": "id bigint, name string, medical_id string, national_id string, phone string, "
    "address string, added_date date, referral_date date, referral_expiry date, "
    "referral_place string, dialysis_unit string, blood_type string, chronic_diseases string, "
    "virus_status string, dob date, gender string, patient_notes string, dialysis_days string, "
    "dialysis_shift string, is_archived int",
    "machines": "id bigint, serial_number string, brand string, model string, ward string, "
    "internal_unit string, status string, last_maintenance date, notes string",
    "staff": "id bigint, name string, national_id string, phone string, address string, "
    "job_title string, specialization string, current_position string, employment_status string, "
    "appointment_date date, work_start_date date, grade string, default_shift string",
    "sessions": "id bigint, patient_id bigint, session_date date, shift string, notes string, "
    "blood_transfusion_bags bigint, machine_id bigint, machine_hours_operated double, "
    "created_at date, status string",
    "medical_supplies": "id bigint, name string, type string, quantity bigint, expiry_date date",
    "inventory_log": "id bigint, supply_id bigint, change_amount bigint, new_quantity bigint, "
    "notes string, timestamp date",
    "suppliers": "id bigint, name string, contact_person string, phone string, email string, "
    "address string, notes string, created_at date",
    "purchase_orders": "id bigint, supplier_id bigint, order_date date, "
    "expected_delivery_date date, status string, notes string, created_at date",
    "purchase_order_items": "id bigint, purchase_order_id bigint, supply_id bigint, "
    "quantity_ordered bigint, unit_price double",
    "preventive_maintenances": "id bigint, machine_id bigint, maintenance_date date, "
    "technician_name string, notes string, visitor_name string, section string",
    "curative_maintenances": "id bigint, machine_id bigint, report_date date, "
    "request_number string, repair_date date, engineer_name string, cost double, "
    "parts_details string, failure_description string, repair_notes string",
    "maintenances": "id bigint, machine_id bigint, date date, type string, technician string, "
    "description string, notes string",
    "lab_test_types": "id bigint, test_name string, unit string, result_type string, "
    "normal_range_low double, normal_range_high double, normal_value_text string",
    "lab_results": "id bigint, patient_id bigint, test_id bigint, result_value string, "
    "result_date date, notes string",
    "session_schedule": "id bigint, patient_id bigint, machine_id bigint, schedule_date date, "
    "shift string, status string, notes string",
    "app_settings": "id bigint, price_per_session double, price_per_blood_bag double",
    "daily_reports": "id bigint, report_date date, report_status string, final_data string, "
    "confirmed_by_user string, confirmed_at timestamp",
    "shift_changes": "id bigint, staff_id bigint, shift_date date, new_shift_type string, "
    "substitute_staff_id bigint, notes string, created_at timestamp",
    "users": "id bigint, username string, password_hash string, full_name string, role string, "
    "is_active int, created_at timestamp",
    "water_treatment_log": "id bigint, log_date date, technician_name string, "
    "chlorine_level_before double, chlorine_level_after double, water_hardness double, "
    "ph_level double, ro_inlet_pressure double, ro_outlet_pressure double, "
    "ro_reject_pressure double, conductivity double, notes string",
}
TABLES["archived_patients"] = TABLES["patients"].removesuffix(", is_archived int") + (
    ", archive_reason string, archive_details string, date_of_death date, archived_at timestamp"
)

# Fields that may not be blank when a row is added.
REQUIRED = {
    "patients": ["name", "medical_id", "added_date", "referral_date", "dialysis_unit", "virus_status"],
    "machines": ["serial_number", "ward", "internal_unit", "status"],
    "staff": ["name", "job_title", "grade"],
    "sessions": ["patient_id", "session_date"],
    "medical_supplies": ["name", "type"],
    "suppliers": ["name"],
    "maintenances": ["machine_id", "date", "type"],
    "lab_test_types": ["test_name", "result_type"],
    "lab_results": ["patient_id", "test_id", "result_value", "result_date"],
    "session_schedule": ["patient_id", "machine_id", "schedule_date", "shift"],
    "shift_changes": ["staff_id", "shift_date", "new_shift_type"],
    "water_treatment_log": ["log_date", "technician_name"],
    "users": ["username", "password_hash", "full_name", "role"],
}

# Columns that must be unique together.
UNIQUE = {
    "patients": {"medical_id": ["medical_id"], "national_id": ["national_id"]},
    "machines": {"serial_number": ["serial_number"]},
    "staff": {"national_id": ["national_id"]},
    "suppliers": {"name": ["name"]},
    "lab_test_types": {"test_name": ["test_name"]},
    "daily_reports": {"report_date": ["report_date"]},
    "users": {"username": ["username"]},
}

# Defaults of columns left out.
DEFAULTS = {
    "patients": {"is_archived": 0},
    "machines": {"status": "نشط"},
    "sessions": {"blood_transfusion_bags": 0, "machine_hours_operated": 0.0},
    "medical_supplies": {"quantity": 0},
    "purchase_orders": {"status": "Pending"},
    "purchase_order_items": {"quantity_ordered": 1, "unit_price": 0.0},
    "curative_maintenances": {"cost": 0.0},
    "lab_test_types": {"result_type": "number"},
    "session_schedule": {"status": "Scheduled"},
    "app_settings": {"price_per_session": 1450.0, "price_per_blood_bag": 950.0},
    "users": {"is_active": 1},
}

# Roles a user may have.
ROLES = ["admin", "doctor", "nurse", "clerk"]

# Date column by which large tables are partitioned when written.
MONTHLY = {
    "sessions": "session_date",
    "lab_results": "result_date",
    "inventory_log": "timestamp",
    "session_schedule": "schedule_date",
}
