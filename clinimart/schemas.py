"""Table schemas and declared rules, as data.

Column order, types, keys and value domains below are fixed values of the
system. Counters, row identifiers and the keys of patients, doctors and medicines
are BIGINT so that they hold at any scale.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

OPERATIONAL = {
    "patient": "patient_id BIGINT NOT NULL, age_group STRING NOT NULL, gender STRING NOT NULL, "
    "blood_group STRING, city STRING",
    "doctor": "doctor_id BIGINT NOT NULL, specialization STRING NOT NULL, "
    "experience_years INT NOT NULL, department STRING",
    "disease": "disease_code STRING NOT NULL, disease_name STRING NOT NULL, "
    "category STRING NOT NULL, severity_tier STRING NOT NULL",
    "medicine": "medicine_id BIGINT NOT NULL, medicine_name STRING NOT NULL, medicine_type STRING, "
    "unit_cost DECIMAL(10,2) NOT NULL",
    "ward": "ward_id INT NOT NULL, ward_name STRING NOT NULL, ward_type STRING NOT NULL, "
    "capacity INT NOT NULL",
    "visit": "visit_id BIGINT NOT NULL, patient_id BIGINT NOT NULL, doctor_id BIGINT NOT NULL, "
    "visit_date DATE NOT NULL, visit_type STRING NOT NULL",
    "diagnosis": "visit_id BIGINT NOT NULL, disease_code STRING NOT NULL, severity STRING NOT NULL",
    "treatment": "visit_id BIGINT NOT NULL, medicine_id BIGINT NOT NULL, "
    "dosage_mg DECIMAL(8,2) NOT NULL, duration_days INT NOT NULL",
    "bed_allocation": "allocation_id BIGINT NOT NULL, patient_id BIGINT NOT NULL, ward_id INT NOT NULL, "
    "admit_date DATE NOT NULL, discharge_date DATE, days_stayed INT",
    "outcome": "visit_id BIGINT NOT NULL, status STRING NOT NULL, outcome_date DATE NOT NULL",
    "admission_request": "request_id BIGINT NOT NULL, patient_id BIGINT NOT NULL, doctor_id BIGINT NOT NULL, "
    "ward_id INT NOT NULL, visit_type STRING NOT NULL, request_date DATE NOT NULL",
    "allocation_change": "allocation_id BIGINT NOT NULL, change_seq INT NOT NULL, "
    "operation STRING NOT NULL, patient_id BIGINT NOT NULL, ward_id INT NOT NULL, days_stayed INT",
    "alert_log": "allocation_id BIGINT NOT NULL, change_seq INT NOT NULL, patient_id BIGINT NOT NULL, "
    "ward_id INT NOT NULL, days_stayed INT, alert_message STRING, created_at TIMESTAMP",
}

WAREHOUSE = {
    "dim_date": "date_id INT NOT NULL, full_date DATE NOT NULL, day_of_week STRING, day_num INT, "
    "month_num INT, month_name STRING, quarter INT, year_num INT",
    "dim_disease": "disease_sk INT NOT NULL, disease_code STRING NOT NULL, disease_name STRING, "
    "category STRING, severity_tier STRING",
    "dim_doctor": "doctor_sk BIGINT NOT NULL, doctor_id BIGINT NOT NULL, specialization STRING, "
    "experience_band STRING, department STRING",
    "dim_ward": "ward_sk INT NOT NULL, ward_id INT NOT NULL, ward_name STRING, ward_type STRING, "
    "capacity INT",
    "dim_outcome": "outcome_sk INT NOT NULL, outcome_label STRING NOT NULL",
    "fact_treatment": "fact_id BIGINT NOT NULL, date_id INT NOT NULL, disease_sk INT NOT NULL, "
    "doctor_sk BIGINT NOT NULL, ward_sk INT, outcome_sk INT, total_cases BIGINT NOT NULL, "
    "recovered_cases BIGINT NOT NULL, readmitted_cases BIGINT NOT NULL, "
    "avg_recovery_days DECIMAL(6,2), avg_treatment_cost DECIMAL(10,2), total_bed_days BIGINT",
}

FACT_COLUMNS = [
    "fact_id", "date_id", "disease_sk", "doctor_sk", "ward_sk", "outcome_sk", "total_cases",
    "recovered_cases", "readmitted_cases", "avg_recovery_days", "avg_treatment_cost",
    "total_bed_days",
]
# The written load: fact columns, natural keys and outcome of the load, with its
# partition columns last.
FACT_LOAD = (
    "fact_id BIGINT, date_id INT, disease_sk INT, doctor_sk BIGINT, ward_sk INT, visit_date DATE, "
    "disease_code STRING, doctor_id BIGINT, ward_id INT, total_cases BIGINT, recovered_cases BIGINT, "
    "readmitted_cases BIGINT, avg_recovery_days DECIMAL(6,2), avg_treatment_cost DECIMAL(10,2), "
    "total_bed_days BIGINT, skip_reason STRING, load_status STRING, year_num INT"
)

OUTCOME_LABELS = ["Recovered", "Improved", "Readmitted", "Deceased"]

PRIMARY_KEYS = {
    "patient": ["patient_id"],
    "doctor": ["doctor_id"],
    "disease": ["disease_code"],
    "medicine": ["medicine_id"],
    "ward": ["ward_id"],
    "visit": ["visit_id"],
    "diagnosis": ["visit_id", "disease_code"],
    "bed_allocation": ["allocation_id"],
    "outcome": ["visit_id"],
    "admission_request": ["request_id"],
    "allocation_change": ["allocation_id", "change_seq"],
}

# Surrogate and natural keys.
WAREHOUSE_KEYS = {
    "dim_date": [["date_id"], ["full_date"]],
    "dim_disease": [["disease_sk"], ["disease_code"]],
    "dim_doctor": [["doctor_sk"], ["doctor_id"]],
    "dim_ward": [["ward_sk"], ["ward_id"]],
    "dim_outcome": [["outcome_sk"], ["outcome_label"]],
    "fact_treatment": [["fact_id"], ["date_id", "disease_sk", "doctor_sk", "ward_sk"]],
}

# child table, child column, parent table, parent column
FOREIGN_KEYS = [
    ("visit", "patient_id", "patient", "patient_id"),
    ("visit", "doctor_id", "doctor", "doctor_id"),
    ("diagnosis", "visit_id", "visit", "visit_id"),
    ("diagnosis", "disease_code", "disease", "disease_code"),
    ("treatment", "visit_id", "visit", "visit_id"),
    ("treatment", "medicine_id", "medicine", "medicine_id"),
    ("bed_allocation", "patient_id", "patient", "patient_id"),
    ("bed_allocation", "ward_id", "ward", "ward_id"),
    ("outcome", "visit_id", "visit", "visit_id"),
    ("admission_request", "ward_id", "ward", "ward_id"),
]
WAREHOUSE_FOREIGN_KEYS = [
    ("fact_treatment", "date_id", "dim_date", "date_id"),
    ("fact_treatment", "disease_sk", "dim_disease", "disease_sk"),
    ("fact_treatment", "doctor_sk", "dim_doctor", "doctor_sk"),
    ("fact_treatment", "ward_sk", "dim_ward", "ward_sk"),
    ("fact_treatment", "outcome_sk", "dim_outcome", "outcome_sk"),
]

# table, column, rule that every non-NULL value must satisfy
DOMAIN_RULES = [
    ("patient", "gender", "gender IN ('M', 'F', 'O')"),
    ("doctor", "experience_years", "experience_years >= 0"),
    ("disease", "severity_tier", "severity_tier IN ('Low', 'Moderate', 'High', 'Critical')"),
    ("medicine", "unit_cost", "unit_cost >= 0"),
    ("ward", "capacity", "capacity > 0"),
    ("visit", "visit_type", "visit_type IN ('OPD', 'IPD', 'Emergency')"),
    ("diagnosis", "severity", "severity IN ('Mild', 'Moderate', 'Severe')"),
    ("treatment", "duration_days", "duration_days > 0"),
    ("outcome", "status", "status IN ('Recovered', 'Improved', 'Readmitted', 'Deceased')"),
]
# table, column, longest text allowed
LENGTH_RULES = [
    ("patient", "age_group", 20),
    ("patient", "gender", 1),
    ("patient", "blood_group", 5),
    ("patient", "city", 50),
    ("doctor", "specialization", 80),
    ("doctor", "department", 60),
    ("disease", "disease_code", 10),
    ("disease", "disease_name", 100),
    ("disease", "category", 60),
    ("medicine", "medicine_name", 100),
    ("medicine", "medicine_type", 50),
    ("ward", "ward_name", 60),
    ("ward", "ward_type", 40),
]


def operational_schema(table: str) -> StructType:
    return StructType.fromDDL(OPERATIONAL[table])


def required_columns(table: str) -> list[str]:
    schema = StructType.fromDDL({**OPERATIONAL, **WAREHOUSE}[table])
    return [f.name for f in schema.fields if not f.nullable]
