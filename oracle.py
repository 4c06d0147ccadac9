"""Reference SQL for every query, in DuckDB's dialect, over the sample tables.

Built from named blocks: the operational mapping, the extract, the fact on
natural keys and the reports. A query lists what it reads and ``statement`` puts
the needed blocks in front of it.
"""

from __future__ import annotations

import re

# Calendar of the load that shows skipped rows; all others run over all visits.
SHORT_FROM, SHORT_TO = "1995-07-01", "2001-01-31"
FALLBACK_FROM, FALLBACK_TO = "2001-03-01", "2001-03-31"
FROM, TO = "1995-01-01", "2001-12-31"
# Day of an earlier load, and a ward whose admissions from a day on were reported later.
KNOWN_BEFORE, LATE_WARD, LATE_FROM = "2001-02-01", 3, "1999-06-01"
WIN_FROM, WIN_TO = "1997-01-01", "1998-12-31"
REQUEST_TO = "1997-09-30"


def ratio(num: str, den: str) -> str:
    """Exact num / den, two places, half away from zero."""
    n = f"abs(CAST(CAST({num} AS DECIMAL(28,4)) * 10000 AS HUGEINT))"
    d = f"nullif(CAST(CAST({den} AS DECIMAL(28,4)) * 10000 AS HUGEINT), 0)"
    q = f"CAST((200 * {n} + {d}) // (2 * {d}) AS BIGINT)"
    return (
        f"CAST(CAST(CASE WHEN ({num}) < 0 THEN -{q} ELSE {q} END AS DECIMAL(18,0)) * 0.01"
        " AS DECIMAL(18,2))"
    )


def pct(part: str, whole: str) -> str:
    return ratio(f"100 * ({part})", whole)


def label(year: str = "year_num", month: str = "month_num") -> str:
    return f"concat(CAST({year} AS VARCHAR), '-', lpad(CAST({month} AS VARCHAR), 2, '0'))"


def band(num: str, den: str) -> str:
    return (
        f"CASE WHEN {num} >= 90 * {den} THEN 'Critical Over-Utilization'"
        f" WHEN {num} >= 75 * {den} THEN 'High Utilization'"
        f" WHEN {num} >= 50 * {den} THEN 'Moderate Utilization' ELSE 'Low Utilization' END"
    )


def severity(rate: str) -> str:
    return f"CASE WHEN {rate} >= 25 THEN 'high' WHEN {rate} >= 15 THEN 'moderate' ELSE 'low' END"


BLOCKS: dict[str, str] = {}

# --- operational mapping ----------------------------------------------------
BLOCKS["patient"] = """
SELECT CAST(c_custkey AS BIGINT) patient_id,
  CASE c_custkey % 6 WHEN 0 THEN '0-17' WHEN 1 THEN '18-30' WHEN 2 THEN '31-45'
       WHEN 3 THEN '46-60' WHEN 4 THEN '61-75' ELSE '76+' END age_group,
  CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'O' END gender,
  CAST(NULL AS VARCHAR) blood_group, n_name city
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
BLOCKS["doctor"] = """
SELECT CAST(s_suppkey AS BIGINT) doctor_id, n_name specialization,
  CAST(s_suppkey % 20 AS INT) experience_years, r_name department
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
BLOCKS["disease"] = """
SELECT DISTINCT p_brand disease_code, concat('Condition ', p_brand) disease_name,
  CASE CAST(substr(p_brand, 7) AS INT) % 5 WHEN 0 THEN 'Respiratory' WHEN 1 THEN 'Cardiac'
       WHEN 2 THEN 'Renal' WHEN 3 THEN 'Endocrine' ELSE 'Infectious' END category,
  CASE CAST(substr(p_brand, 7) AS INT) % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Moderate'
       WHEN 2 THEN 'High' ELSE 'Critical' END severity_tier
FROM part"""
BLOCKS["medicine"] = """
SELECT CAST(p_partkey AS BIGINT) medicine_id, p_name medicine_name, p_type medicine_type,
  CAST(p_retailprice AS DECIMAL(10,2)) unit_cost
FROM part"""
BLOCKS["ward"] = """
SELECT CAST(n_nationkey + 1 AS INT) ward_id, n_name ward_name, r_name ward_type,
  CAST(4 + (n_nationkey * 7) % 23 AS INT) capacity
FROM nation JOIN region ON n_regionkey = r_regionkey"""
BLOCKS["visit"] = """
SELECT o_orderkey visit_id, CAST(o_custkey AS BIGINT) patient_id,
  CAST(min(l_suppkey) AS BIGINT) doctor_id, CAST(o_orderdate AS DATE) visit_date,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Emergency'
       WHEN o_orderpriority = '2-HIGH' THEN 'IPD' ELSE 'OPD' END visit_type
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey, o_custkey, o_orderdate, o_orderpriority"""
BLOCKS["diagnosis"] = """
SELECT l_orderkey visit_id, p_brand disease_code,
  CASE WHEN max(l_quantity) <= 25 THEN 'Mild' WHEN max(l_quantity) <= 42 THEN 'Moderate'
       ELSE 'Severe' END severity
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_orderkey, p_brand"""
BLOCKS["treatment"] = """
SELECT l_orderkey visit_id, CAST(l_partkey AS BIGINT) medicine_id,
  CAST(l_quantity AS DECIMAL(8,2)) dosage_mg, CAST(3 + l_linenumber AS INT) duration_days
FROM lineitem"""
BLOCKS["bed_allocation"] = """
SELECT o_orderkey allocation_id, CAST(o_custkey AS BIGINT) patient_id,
  CAST(o_orderkey % 25 + 1 AS INT) ward_id, CAST(o_orderdate AS DATE) admit_date,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN NULL
       ELSE CAST(2 + o_orderkey % 20 AS INT) END days_stayed
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"""
BLOCKS["outcome"] = """
SELECT o_orderkey visit_id,
  CASE WHEN (o_orderkey * 7 + o_custkey * 13) % 100 < 55 THEN 'Recovered'
       WHEN (o_orderkey * 7 + o_custkey * 13) % 100 < 85 THEN 'Improved'
       WHEN (o_orderkey * 7 + o_custkey * 13) % 100 < 97 THEN 'Readmitted'
       ELSE 'Deceased' END status,
  CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 30 AS INT) outcome_date
FROM orders WHERE o_custkey % 50 <> 0"""
BLOCKS["admission_request"] = """
SELECT o_orderkey request_id, CAST(o_custkey AS BIGINT) patient_id,
  CAST(o_orderkey % 10 AS BIGINT) doctor_id, CAST(o_orderkey % 26 + 1 AS INT) ward_id,
  'IPD' visit_type, CAST(o_orderdate AS DATE) request_date
FROM orders WHERE o_orderpriority = '3-MEDIUM'"""
BLOCKS["allocation_change"] = """
SELECT allocation_id, 0 change_seq, 'insert' operation, patient_id, ward_id,
  CAST(NULL AS INT) days_stayed FROM bed_allocation
UNION ALL
SELECT allocation_id, 1, 'update', patient_id, ward_id, days_stayed
FROM bed_allocation WHERE days_stayed IS NOT NULL"""

# --- dimensions ---------------------------------------------------------------
BLOCKS["dim_date"] = """
SELECT CAST(strftime(d, '%Y%m%d') AS INT) date_id, d full_date, strftime(d, '%A') day_of_week,
  CAST(day(d) AS INT) day_num, CAST(month(d) AS INT) month_num, strftime(d, '%B') month_name,
  CAST(quarter(d) AS INT) AS quarter, CAST(year(d) AS INT) year_num
FROM (SELECT CAST(unnest(generate_series(
  (SELECT min(visit_date) FROM visit), (SELECT max(visit_date) FROM visit), INTERVAL 1 DAY)) AS DATE) d)"""
BLOCKS["dim_disease"] = """
SELECT CAST(row_number() OVER (ORDER BY disease_code) AS INT) disease_sk, * FROM disease"""
BLOCKS["dim_doctor"] = """
SELECT CAST(row_number() OVER (ORDER BY doctor_id) AS BIGINT) doctor_sk, doctor_id, specialization,
  CASE WHEN experience_years <= 5 THEN '0-5 yrs' WHEN experience_years <= 10 THEN '6-10 yrs'
       ELSE '11+ yrs' END experience_band, department FROM doctor"""
BLOCKS["dim_ward"] = """
SELECT CAST(row_number() OVER (ORDER BY ward_id) AS INT) ward_sk, * FROM ward"""
BLOCKS["dim_outcome"] = """
SELECT CAST(outcome_sk AS INT) outcome_sk, outcome_label FROM (VALUES (1, 'Recovered'),
  (2, 'Improved'), (3, 'Readmitted'), (4, 'Deceased')) t(outcome_sk, outcome_label)"""

# --- extract and fact ---------------------------------------------------------
BLOCKS["visit_cost"] = """
SELECT visit_id, CAST(sum(dosage_mg * unit_cost) AS DECIMAL(22,4)) treatment_cost
FROM treatment JOIN medicine USING (medicine_id) GROUP BY visit_id"""
BLOCKS["raw_extract"] = """
SELECT v.visit_id, v.visit_date, v.doctor_id, d.disease_code, o.status outcome_status,
  ba.days_stayed, ba.ward_id, c.treatment_cost
FROM visit v
JOIN diagnosis d ON v.visit_id = d.visit_id
LEFT JOIN outcome o ON v.visit_id = o.visit_id
LEFT JOIN bed_allocation ba ON v.patient_id = ba.patient_id AND ba.admit_date <= v.visit_date
LEFT JOIN visit_cost c ON c.visit_id = v.visit_id"""
BLOCKS["fact_groups"] = f"""
SELECT visit_date, disease_code, doctor_id, ward_id, CAST(count(*) AS BIGINT) total_cases,
  CAST(count(*) FILTER (outcome_status = 'Recovered') AS BIGINT) recovered_cases,
  CAST(count(*) FILTER (outcome_status = 'Readmitted') AS BIGINT) readmitted_cases,
  CAST({ratio('sum(days_stayed)', 'count(days_stayed)')} AS DECIMAL(6,2)) avg_recovery_days,
  CAST({ratio('sum(treatment_cost)', 'count(treatment_cost)')} AS DECIMAL(10,2)) avg_treatment_cost,
  CAST(sum(days_stayed) AS BIGINT) total_bed_days
FROM raw_extract GROUP BY visit_date, disease_code, doctor_id, ward_id"""
BLOCKS["touched_visits"] = f"""
SELECT v.visit_date FROM visit v WHERE v.visit_date >= DATE '{KNOWN_BEFORE}'
UNION ALL
SELECT v.visit_date FROM visit v JOIN outcome o ON v.visit_id = o.visit_id
WHERE o.outcome_date >= DATE '{KNOWN_BEFORE}'
UNION ALL
SELECT v.visit_date FROM visit v JOIN bed_allocation ba
  ON v.patient_id = ba.patient_id AND ba.admit_date <= v.visit_date
WHERE ba.admit_date >= DATE '{KNOWN_BEFORE}'
  OR ba.admit_date + ba.days_stayed >= DATE '{KNOWN_BEFORE}'
  OR (ba.ward_id = {LATE_WARD} AND ba.admit_date >= DATE '{LATE_FROM}')"""
BLOCKS["fact"] = """
SELECT CAST(year(visit_date) AS INT) year_num, CAST(month(visit_date) AS INT) month_num, *,
  CAST(coalesce(avg_treatment_cost, 0) * total_cases AS DECIMAL(18,2)) spend
FROM fact_groups"""


def _windowed(name: str, where: str) -> None:
    """Reports over ``fact`` (suffix '') and over a window of it (suffix '_w')."""
    for suffix, condition in (("", "TRUE"), ("_w", where)):
        BLOCKS[f"{name}{suffix}"] = REPORTS[name].replace("{F}", f"fact WHERE {condition}")


RATES = (
    f"{pct('readmitted_cases', 'total_cases')} readmission_rate_pct,"
    f" {pct('recovered_cases', 'total_cases')} recovery_rate_pct"
)
SUMS = ", ".join(
    f"CAST(sum({c}) AS BIGINT) {c}" for c in ("total_cases", "recovered_cases", "readmitted_cases")
)
REPORTS = {
    "disease_resources": """
SELECT year_num, month_num, disease_name, CAST(sum(total_cases) AS BIGINT) total_cases,
  CAST(sum(coalesce(total_bed_days, 0)) AS BIGINT) total_bed_days,
  CAST(sum(spend) AS DECIMAL(28,2)) total_treatment_spend
FROM (SELECT * FROM {F}) JOIN disease USING (disease_code)
GROUP BY year_num, month_num, disease_name""",
    "doctor_ranking": f"""
SELECT *, CAST(rank() OVER (ORDER BY recovery_rate_pct DESC, readmission_rate_pct ASC,
    total_cases DESC) AS BIGINT) performance_rank
FROM (SELECT doctor_id, specialization, department, total_cases, recovered_cases,
        readmitted_cases, {RATES}, {ratio('spend', 'total_cases')} weighted_avg_treatment_cost
      FROM (SELECT doctor_id, {SUMS}, sum(spend) spend FROM {{F}} GROUP BY doctor_id)
      JOIN doctor USING (doctor_id) WHERE total_cases >= 30)""",
    "ward_day": """
SELECT visit_date full_date, ward_id, ward_name, ward_type, capacity,
  CAST(max(coalesce(total_bed_days, 0)) AS BIGINT) occupied_bed_days
FROM (SELECT * FROM {F}) JOIN ward USING (ward_id) WHERE ward_id IS NOT NULL
GROUP BY visit_date, ward_id, ward_name, ward_type, capacity""",
    "readmission_by_disease": f"""
SELECT disease_name, total_cases, readmitted_cases, recovered_cases, {RATES}
FROM (SELECT disease_name, {SUMS} FROM (SELECT * FROM {{F}}) JOIN disease USING (disease_code)
      GROUP BY disease_name) WHERE total_cases >= 25""",
    "readmission_monthly": f"""
SELECT year_num, month_num, {label()} month_label, disease_name, total_cases, readmitted_cases,
  recovered_cases, {RATES}
FROM (SELECT year_num, month_num, disease_name, {SUMS}
      FROM (SELECT * FROM {{F}}) JOIN disease USING (disease_code)
      GROUP BY year_num, month_num, disease_name) WHERE total_cases > 0""",
    "overview": f"""
SELECT total_cases, readmitted_cases, recovered_cases,
  coalesce({ratio('cost', 'n')}, 0.00) avg_treatment_cost, total_bed_days, {RATES}
FROM (SELECT coalesce(CAST(sum(total_cases) AS BIGINT), 0) total_cases,
        coalesce(CAST(sum(recovered_cases) AS BIGINT), 0) recovered_cases,
        coalesce(CAST(sum(readmitted_cases) AS BIGINT), 0) readmitted_cases,
        coalesce(CAST(sum(total_bed_days) AS BIGINT), 0) total_bed_days,
        sum(avg_treatment_cost) cost, count(avg_treatment_cost) n FROM {{F}})""",
    "doctor_monthly": f"""
SELECT doctor_id, specialization, department, year_num, month_num, {label()} month_label,
  total_cases, recovered_cases, readmitted_cases, {RATES}
FROM (SELECT doctor_id, year_num, month_num, {SUMS} FROM {{F}}
      GROUP BY doctor_id, year_num, month_num) JOIN doctor USING (doctor_id)
WHERE total_cases > 0""",
}
for _name in REPORTS:
    _windowed(_name, f"visit_date BETWEEN DATE '{WIN_FROM}' AND DATE '{WIN_TO}'")
BLOCKS["overview_empty"] = REPORTS["overview"].replace(
    "{F}", "fact WHERE visit_date BETWEEN DATE '2022-01-01' AND DATE '2023-12-31'"
)
for _bound, _sign, _day in (("from", ">=", WIN_FROM), ("until", "<=", WIN_TO)):
    BLOCKS[f"overview_{_bound}"] = REPORTS["overview"].replace(
        "{F}", f"fact WHERE visit_date {_sign} DATE '{_day}'"
    )
BLOCKS["overview_request"] = REPORTS["overview"].replace(
    "{F}", f"fact WHERE visit_date BETWEEN DATE '{WIN_FROM}' AND DATE '{REQUEST_TO}'"
)
BLOCKS["ward_utilization"] = f"""
SELECT year_num, month_num, ward_id, ward_name, ward_type, capacity, month_occupied_bed_days,
  {pct('month_occupied_bed_days', 'capacity * dim')} utilization_pct,
  {band('100 * month_occupied_bed_days', '(capacity * dim)')} utilization_band
FROM (SELECT CAST(year(full_date) AS INT) year_num, CAST(month(full_date) AS INT) month_num,
        ward_id, ward_name, ward_type, capacity,
        CAST(sum(occupied_bed_days) AS BIGINT) month_occupied_bed_days,
        day(last_day(max(full_date))) dim
      FROM ward_day GROUP BY 1, 2, 3, 4, 5, 6)"""
BLOCKS["ward_months"] = f"SELECT *, {label()} month_label FROM ward_utilization"
BLOCKS["doctor_view"] = (
    "SELECT d.doctor_id, d.specialization, d.experience_years,"
    " CAST(count(DISTINCT v.visit_id) AS BIGINT) total_visits, "
    + ratio("sum(ba.days_stayed)", "count(ba.days_stayed)")
    + " avg_patient_stay,"
    " CAST(count(*) FILTER (o.status = 'Recovered') AS BIGINT) recovered_count,"
    " CAST(count(*) FILTER (o.status = 'Readmitted') AS BIGINT) readmission_count, "
    + pct("count(*) FILTER (o.status = 'Recovered')", "count(DISTINCT v.visit_id)")
    + " recovery_rate_pct FROM doctor d LEFT JOIN visit v ON d.doctor_id = v.doctor_id"
    " LEFT JOIN bed_allocation ba ON v.patient_id = ba.patient_id"
    " LEFT JOIN outcome o ON v.visit_id = o.visit_id GROUP BY 1, 2, 3"
)
BLOCKS["doctor_monthly_ops"] = f"""
SELECT doctor_id, specialization, department, year_num, month_num, {label()} month_label,
  total_cases, recovered_cases, readmitted_cases, {RATES}
FROM (SELECT v.doctor_id, CAST(year(visit_date) AS INT) year_num,
        CAST(month(visit_date) AS INT) month_num, CAST(count(*) AS BIGINT) total_cases,
        CAST(count(*) FILTER (status = 'Recovered') AS BIGINT) recovered_cases,
        CAST(count(*) FILTER (status = 'Readmitted') AS BIGINT) readmitted_cases
      FROM visit v LEFT JOIN outcome o ON o.visit_id = v.visit_id
      WHERE visit_date BETWEEN DATE '{{FROM}}' AND DATE '{{TO}}' GROUP BY 1, 2, 3)
JOIN doctor USING (doctor_id)"""
_OPS = BLOCKS["doctor_monthly_ops"]
BLOCKS["doctor_monthly_ops"] = _OPS.replace("{FROM}", FROM).replace("{TO}", TO)
BLOCKS["doctor_monthly_late"] = _OPS.replace("{FROM}", FALLBACK_FROM).replace("{TO}", FALLBACK_TO)
BLOCKS["disease_totals"] = """
SELECT disease_name, CAST(sum(total_cases) AS BIGINT) total_cases,
  CAST(sum(total_treatment_spend) AS DECIMAL(28,2)) total_treatment_spend,
  CAST(sum(total_bed_days) AS BIGINT) total_bed_days
FROM disease_resources GROUP BY disease_name"""
BLOCKS["ward_summary"] = f"""
SELECT ward_id, ward_name, ward_type, max(capacity) capacity,
  CAST(count(DISTINCT month_label) AS BIGINT) months_tracked,
  CAST(sum(month_occupied_bed_days) AS BIGINT) total_occupied_bed_days,
  {ratio('sum(utilization_pct)', 'count(*)')} avg_utilization_pct,
  max(utilization_pct) peak_utilization_pct,
  {band('sum(utilization_pct)', 'count(*)')} avg_utilization_band
FROM ward_months GROUP BY ward_id, ward_name, ward_type"""
BLOCKS["occupancy"] = """
SELECT w.ward_id, ward_name, capacity, CAST(count(a.allocation_id) AS BIGINT) current_occupancy,
  count(a.allocation_id) >= capacity is_full
FROM ward w LEFT JOIN bed_allocation a ON a.ward_id = w.ward_id AND a.days_stayed IS NULL
GROUP BY w.ward_id, ward_name, capacity"""
BLOCKS["decisions"] = """
SELECT r.*, coalesce(current_occupancy + queue_position <= capacity, FALSE) accepted,
  CASE WHEN capacity IS NULL THEN 'Ward does not exist. Cannot admit patient.'
       WHEN current_occupancy + queue_position > capacity
       THEN 'Ward is at full capacity. Cannot admit patient.' END reason
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ward_id ORDER BY request_date, request_id)
        AS BIGINT) queue_position FROM admission_request) r
LEFT JOIN occupancy o ON o.ward_id = r.ward_id"""
_MESSAGE = (
    "concat('Patient ', CAST(patient_id AS VARCHAR), ' has stayed ', CAST(days_stayed AS VARCHAR),"
    " ' days in ward ', CAST(ward_id AS VARCHAR), '. Review required.')"
)


def statement(sql: str) -> str:
    """``sql`` with all the blocks it reads, directly or not, in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in BLOCKS:
            if name not in needed and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                visit(BLOCKS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    blocks = ",\n".join(f"{name} AS ({BLOCKS[name]})" for name in needed)
    return f"WITH {blocks}\n{sql}" if needed else sql


def _union_checks(rows: list[str]) -> str:
    return "\nUNION ALL\n".join(rows)


# The rules of the system, stated here once more: nothing is taken from the library, so
# that a rule which is missing or wrong there shows.
REQUIRED = {
    "patient": "patient_id age_group gender",
    "doctor": "doctor_id specialization experience_years",
    "disease": "disease_code disease_name category severity_tier",
    "medicine": "medicine_id medicine_name unit_cost",
    "ward": "ward_id ward_name ward_type capacity",
    "visit": "visit_id patient_id doctor_id visit_date visit_type",
    "diagnosis": "visit_id disease_code severity",
    "treatment": "visit_id medicine_id dosage_mg duration_days",
    "bed_allocation": "allocation_id patient_id ward_id admit_date",
    "outcome": "visit_id status outcome_date",
    "admission_request": "request_id patient_id doctor_id ward_id visit_type request_date",
}
REQUIRED_IN_WAREHOUSE = {
    "dim_date": "date_id full_date",
    "dim_disease": "disease_sk disease_code",
    "dim_doctor": "doctor_sk doctor_id",
    "dim_ward": "ward_sk ward_id",
    "dim_outcome": "outcome_sk outcome_label",
    "fact_treatment": "fact_id date_id disease_sk doctor_sk total_cases recovered_cases readmitted_cases",
}
DOMAINS = [
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
LENGTHS = {
    "patient": "age_group 20 gender 1 blood_group 5 city 50",
    "doctor": "specialization 80 department 60",
    "disease": "disease_code 10 disease_name 100 category 60",
    "medicine": "medicine_name 100 medicine_type 50",
    "ward": "ward_name 60 ward_type 40",
}
KEYS = [
    ("patient", "patient_id"), ("doctor", "doctor_id"), ("disease", "disease_code"),
    ("medicine", "medicine_id"), ("ward", "ward_id"), ("visit", "visit_id"),
    ("diagnosis", "visit_id, disease_code"), ("bed_allocation", "allocation_id"),
    ("outcome", "visit_id"), ("admission_request", "request_id"),
    ("allocation_change", "allocation_id, change_seq"),
    ("treatment", "visit_id, medicine_id, duration_days"),
    ("dim_date", "date_id"), ("dim_date", "full_date"),
    ("dim_disease", "disease_sk"), ("dim_disease", "disease_code"),
    ("dim_doctor", "doctor_sk"), ("dim_doctor", "doctor_id"),
    ("dim_ward", "ward_sk"), ("dim_ward", "ward_id"),
    ("dim_outcome", "outcome_sk"), ("dim_outcome", "outcome_label"),
    ("fact_treatment", "date_id, disease_sk, doctor_sk, ward_sk"),
]
REFERENCES = [
    ("visit", "patient_id", "patient"), ("visit", "doctor_id", "doctor"),
    ("diagnosis", "visit_id", "visit"), ("diagnosis", "disease_code", "disease"),
    ("treatment", "visit_id", "visit"), ("treatment", "medicine_id", "medicine"),
    ("bed_allocation", "patient_id", "patient"), ("bed_allocation", "ward_id", "ward"),
    ("outcome", "visit_id", "visit"), ("admission_request", "ward_id", "ward"),
]
WAREHOUSE_REFERENCES = [
    ("fact_treatment", "date_id", "dim_date"), ("fact_treatment", "disease_sk", "dim_disease"),
    ("fact_treatment", "doctor_sk", "dim_doctor"), ("fact_treatment", "ward_sk", "dim_ward"),
    ("fact_treatment", "outcome_sk", "dim_outcome"),
]


def _nulls(required: dict[str, str]) -> str:
    # the fact's identifier is a hash of its grain and not made here; it is never NULL
    return _union_checks(
        [
            f"SELECT '{table}' table_name, '{column}' rule_name, count(*) checked_rows,"
            f" count(*) FILTER ({'false' if column == 'fact_id' else f'{column} IS NULL'}) violations FROM {table}"
            for table, columns in required.items()
            for column in columns.split()
        ]
    )


def _domains() -> str:
    rows = [
        f"SELECT '{t}' table_name, '{c} domain' rule_name, count(*) checked_rows,"
        f" count(*) FILTER (NOT ({rule})) violations FROM {t}"
        for t, c, rule in DOMAINS
    ]
    for table, limits in LENGTHS.items():
        parts = limits.split()
        rows += [
            f"SELECT '{table}' table_name, '{c} length' rule_name, count(*) checked_rows,"
            f" count(*) FILTER (length({c}) > {n}) violations FROM {table}"
            for c, n in zip(parts[::2], parts[1::2], strict=True)
        ]
    return _union_checks(rows)


def _duplicates() -> str:
    def one(table: str, shown: str, key: str) -> str:
        return (
            f"SELECT '{table}' table_name, '{shown}' key_columns, CAST(sum(n) AS BIGINT) checked_rows,"
            " count(*) FILTER (n > 1) duplicate_keys, CAST(sum(n - 1) AS BIGINT) surplus_rows"
            f" FROM (SELECT count(*) n FROM {table} GROUP BY {key})"
        )

    grain = "date_id, disease_sk, doctor_sk, ward_sk"
    return _union_checks(
        [one("fact_treatment", "fact_id", grain), *[one(table, key, key) for table, key in KEYS]]
    )


def _orphans(references: list[tuple[str, str, str]]) -> str:
    return _union_checks(
        [
            f"SELECT '{child}' table_name, '{column}' column_name, '{parent}' parent_table,"
            f" count(DISTINCT {column}) orphan_keys, count(*) orphan_rows"
            f" FROM {child} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {column} FROM {parent})"
            for child, column, parent in references
        ]
    )


NULL_TABLES = list(REQUIRED)
BLOCKS["fact_treatment"] = """
SELECT CAST(strftime(visit_date, '%Y%m%d') AS INT) date_id, disease_sk, doctor_sk, ward_sk,
  CAST(NULL AS INT) outcome_sk, total_cases, recovered_cases, readmitted_cases,
  avg_recovery_days, avg_treatment_cost, total_bed_days
FROM fact JOIN dim_disease USING (disease_code) JOIN dim_doctor USING (doctor_id)
LEFT JOIN dim_ward USING (ward_id)"""
BLOCKS["share_base"] = "SELECT * FROM readmission_by_disease"
_DIGITS = "regexp_replace(p, '^0+', '')"
_NATURAL = (
    "array_to_string(list_transform(regexp_extract_all(lower({c}), '[0-9]+|[^0-9]+'), lambda p:"
    " CASE WHEN regexp_matches(p, '^[0-9]') THEN concat(lpad(CAST(length("
    + _DIGITS
    + ") AS VARCHAR), 5, '0'), "
    + _DIGITS
    + ") ELSE p END), '')"
)


def _natural(column: str) -> str:
    return _NATURAL.replace("{c}", f"CAST({column} AS VARCHAR)")


def _sorted(rows: str, order: str) -> str:
    """Rows with their place in an order."""
    return f"SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS position FROM ({rows})"


_DOCTOR_ROWS = (
    "SELECT doctor_id, specialization, recovery_rate_pct, concat('Dr ', CAST(doctor_id AS VARCHAR))"
    " doctor_label FROM doctor_ranking"
)
_DISEASE_ROWS = "SELECT disease_name, total_cases, total_bed_days FROM disease_totals"


def _search(table: str, columns: list[str], text: str) -> str:
    hits = " OR ".join(
        f"contains(lower(coalesce(CAST({c} AS VARCHAR), '')), '{text}')" for c in columns
    )
    return f"SELECT * FROM {table} WHERE {hits}"


def _worst_best(order: str, insight: str, sentence: str, kept: str = "true") -> str:
    return (
        f"SELECT * FROM (SELECT '{insight}' insight, doctor_id, recovery_rate_pct,"
        f" readmission_rate_pct, total_cases, {sentence} sentence FROM doctor_ranking"
        f" WHERE {kept} ORDER BY {order}, doctor_id LIMIT 1)"
    )


def _readmission_kpis(rows: str) -> str:
    burden = "readmission_rate_pct DESC, total_cases DESC, disease_name"
    return (
        "SELECT (SELECT "
        + pct("sum(readmitted_cases)", "sum(total_cases)")
        + f" FROM {rows} a) avg_readmission_rate_pct, hi.disease_name highest_risk_disease,"
        " hi.readmission_rate_pct highest_risk_pct, lo.disease_name lowest_recovery_disease,"
        f" lo.recovery_rate_pct lowest_recovery_pct, (SELECT count(*) FROM {rows} b) disease_count"
        f" FROM (SELECT 1) one LEFT JOIN (SELECT * FROM {rows} c ORDER BY {burden} LIMIT 1) hi ON true"
        f" LEFT JOIN (SELECT * FROM {rows} d ORDER BY recovery_rate_pct, {burden} LIMIT 1) lo ON true"
    )


_BEST = "recovery_rate_pct DESC, readmission_rate_pct ASC, total_cases DESC"
_WORST = "recovery_rate_pct ASC, readmission_rate_pct DESC, total_cases DESC"
_TXT = "CAST({} AS VARCHAR)"
_EXACT = ", ".join(f"CAST({c} AS DECIMAL(28,10)) {c}" for c in ("readmission_rate_pct", "recovery_rate_pct"))


def _queries() -> dict[str, str]:
    best = (
        "concat('Dr. ', CAST(doctor_id AS VARCHAR), ' has highest recovery (',"
        f" CAST(recovery_rate_pct AS VARCHAR), '%) with ', {severity('readmission_rate_pct')},"
        " ' readmissions (', CAST(readmission_rate_pct AS VARCHAR), '%).')"
    )
    worst = (
        "concat('Dr. ', CAST(doctor_id AS VARCHAR), ' needs attention with recovery ',"
        " CAST(recovery_rate_pct AS VARCHAR), '% and readmission ',"
        " CAST(readmission_rate_pct AS VARCHAR), '%.')"
    )
    filtered = "specialization = 'NATION_7' AND total_cases >= 100"
    trend = (
        "SELECT m.* FROM doctor_monthly m WHERE doctor_id = (SELECT doctor_id FROM doctor_ranking"
        " WHERE doctor_id IN (SELECT doctor_id FROM doctor_monthly)"
        f" ORDER BY {_BEST}, doctor_id LIMIT 1)"
    )
    return {
        # sources
        "scan_projection": "SELECT visit_id, patient_id, visit_date FROM visit",
        "bed_allocation_days": "SELECT allocation_id, admit_date,"
        " admit_date + days_stayed discharge_date, days_stayed FROM bed_allocation",
        "inpatient_visits": "SELECT visit_id, patient_id, visit_date, visit_type FROM visit"
        " WHERE visit_type IN ('IPD', 'Emergency')",
        "dim_date": "SELECT d.*, CAST(count(v.visit_id) AS BIGINT) visits FROM dim_date d LEFT JOIN"
        " visit v ON v.visit_date = d.full_date GROUP BY ALL",
        "dim_disease": "SELECT * FROM dim_disease",
        "dim_doctor": "SELECT * FROM dim_doctor",
        "dim_ward": "SELECT * FROM dim_ward",
        "dim_outcome": "SELECT d.outcome_sk, d.outcome_label, CAST(count(o.visit_id) AS BIGINT)"
        " outcomes FROM dim_outcome d LEFT JOIN outcome o ON o.status = d.outcome_label GROUP BY ALL",
        # extract and fact
        "visit_treatment_cost": "SELECT * FROM visit_cost",
        "visit_stay_range_join": "SELECT v.visit_id, v.patient_id, v.visit_date, b.ward_id,"
        " CAST(count(*) AS BIGINT) copies,"
        " CASE WHEN b.ward_id IS NOT NULL THEN CAST(count(b.days_stayed) AS BIGINT) END known_stays,"
        " CAST(sum(b.days_stayed) AS BIGINT) stay_days FROM visit v LEFT JOIN bed_allocation b"
        " ON v.patient_id = b.patient_id AND b.admit_date <= v.visit_date GROUP BY 1, 2, 3, 4",
        "raw_extract": "SELECT * FROM raw_extract",
        "fact_treatment": "SELECT * FROM fact_treatment",
        "fact_refreshed": "SELECT * FROM fact_treatment",
        "fact_refresh_partitions": "SELECT 'loaded' load_status, year_num, count(*) fact_rows,"
        " year_num IN (SELECT year(visit_date) FROM touched_visits) rewritten"
        " FROM fact GROUP BY year_num",
        "fact_date_semi": "SELECT visit_date, disease_code, doctor_id, ward_id, total_cases"
        f" FROM fact_groups WHERE visit_date BETWEEN DATE '{SHORT_FROM}' AND DATE '{SHORT_TO}'",
        "fact_skipped_rows": "SELECT visit_date, disease_code, doctor_id, ward_id, total_cases,"
        " 'date not in calendar' skip_reason FROM fact_groups"
        f" WHERE visit_date NOT BETWEEN DATE '{SHORT_FROM}' AND DATE '{SHORT_TO}'",
        "fact_labelled_sample": "SELECT visit_date full_date, disease_name, specialization, ward_name,"
        " total_cases, recovered_cases, avg_treatment_cost FROM fact JOIN disease USING (disease_code)"
        " JOIN doctor USING (doctor_id) LEFT JOIN ward USING (ward_id)"
        " ORDER BY visit_date, disease_code, doctor_id, ward_id NULLS FIRST LIMIT 5",
        "etl_counters": "SELECT CAST(sum(total_cases) AS BIGINT) extracted_rows,"
        " count(*) transformed_groups,"
        f" count(*) FILTER (visit_date BETWEEN DATE '{SHORT_FROM}' AND DATE '{SHORT_TO}') loaded_groups,"
        f" count(*) FILTER (visit_date NOT BETWEEN DATE '{SHORT_FROM}' AND DATE '{SHORT_TO}') skipped_groups"
        " FROM fact_groups",
        "etl_counters_recounted": "SELECT CAST(sum(total_cases) AS BIGINT) extracted_rows,"
        " count(*) transformed_groups,"
        f" count(*) FILTER (visit_date BETWEEN DATE '{SHORT_FROM}' AND DATE '{SHORT_TO}') loaded_groups,"
        f" count(*) FILTER (visit_date NOT BETWEEN DATE '{SHORT_FROM}' AND DATE '{SHORT_TO}') skipped_groups"
        " FROM fact_groups",
        # reports
        "disease_trend": "SELECT *, "
        + ratio(
            "sum(total_treatment_spend) OVER w",
            "count(total_treatment_spend) OVER w",
        )
        + " spend_3m_moving_avg FROM disease_resources WINDOW w AS (PARTITION BY disease_name"
        " ORDER BY year_num, month_num ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
        "disease_trend_windowed": "SELECT * FROM disease_resources_w",
        "doctor_ranking": "SELECT * FROM doctor_ranking",
        "doctor_ranking_windowed": "SELECT * FROM doctor_ranking_w",
        "doctor_ranking_filtered": "SELECT * FROM doctor_ranking"
        " WHERE specialization = 'NATION_7' AND total_cases >= 100",
        "ward_day_occupancy": "SELECT * FROM ward_day",
        "ward_utilization": "SELECT * FROM ward_utilization",
        "cost_trend": "SELECT year_num, month_num, avg_treatment_cost, "
        + pct("avg_treatment_cost - before", "before")
        + " mom_change_pct FROM (SELECT *, lag(avg_treatment_cost) OVER (ORDER BY year_num, month_num)"
        f" before FROM (SELECT year_num, month_num, {ratio('sum(spend)', 'sum(total_cases)')}"
        " avg_treatment_cost FROM fact GROUP BY year_num, month_num))",
        "readmission_by_disease": "SELECT * FROM readmission_by_disease",
        "readmission_monthly": "SELECT * FROM readmission_monthly",
        "warehouse_meta": "SELECT max(visit_date) last_fact_date, count(*) fact_rows FROM fact",
        "overview": "SELECT * FROM overview",
        "overview_window": "SELECT * FROM overview_w",
        "overview_default_window": "SELECT * FROM overview_empty",
        "overview_own_default_window": "SELECT * FROM overview_w",
        "overview_half_open_request": "SELECT * FROM overview_request",
        "overview_window_sql": "SELECT * FROM overview_w",
        "overview_empty_window_sql": "SELECT * FROM overview_empty",
        "disease_resources_sql": "SELECT * FROM disease_resources_w",
        "doctor_performance_view_sql": "SELECT * FROM doctor_view",
        "doctors_by_specialization_sql": "SELECT * FROM doctor_view"
        " WHERE specialization = 'NATION_7' AND total_visits >= 100",
        "overview_from": "SELECT * FROM overview_from",
        "overview_until": "SELECT * FROM overview_until",
        "monthly_trend": f"SELECT {label()} month_label, CAST(sum(total_cases) AS BIGINT) total_cases,"
        f" {ratio('sum(avg_treatment_cost)', 'count(avg_treatment_cost)')} avg_cost,"
        " CAST(sum(readmitted_cases) AS BIGINT) readmitted_cases FROM fact"
        " GROUP BY year_num, month_num",
        "doctor_monthly": "SELECT * FROM doctor_monthly",
        "doctor_monthly_ops": "SELECT * FROM doctor_monthly_ops",
        "doctor_monthly_with_fallback": "SELECT * FROM doctor_monthly_w",
        "doctor_monthly_fallback_used": "SELECT * FROM doctor_monthly_late",
        "doctor_performance_view": "SELECT * FROM doctor_view",
        "default_doctor_trend": trend,
        "requested_doctor_trend": "SELECT * FROM doctor_monthly WHERE doctor_id = 7",
        "doctor_monthly_filtered": "SELECT * FROM doctor_monthly WHERE specialization = 'NATION_7'"
        " AND total_cases >= 5",
        # summaries
        "disease_totals": "SELECT * FROM disease_totals",
        "disease_totals_columns": "SELECT disease_name, total_treatment_spend, total_cases"
        " FROM disease_totals",
        "disease_monthly": f"SELECT {label()} month_label, disease_name, total_cases,"
        " total_treatment_spend, total_bed_days FROM disease_resources",
        "cases_by_month": f"SELECT {label()} month_label, CAST(sum(total_cases) AS BIGINT) total_cases"
        " FROM disease_resources GROUP BY year_num, month_num",
        "cases_by_month_of_disease": f"SELECT {label()} month_label, total_cases"
        " FROM disease_resources WHERE disease_name = 'Condition Brand#12'",
        "cases_by_month_unknown_disease": f"SELECT {label()} month_label, CAST(sum(total_cases) AS BIGINT)"
        " total_cases FROM disease_resources GROUP BY year_num, month_num",
        "top_diseases_by_spend": "SELECT disease_name, total_treatment_spend, total_cases"
        " FROM disease_totals ORDER BY total_treatment_spend DESC, disease_name LIMIT 8",
        "top_doctors": "SELECT concat('Dr ', CAST(doctor_id AS VARCHAR)) doctor_label,"
        " recovery_rate_pct, readmission_rate_pct, total_cases FROM doctor_ranking"
        f" ORDER BY {_BEST}, doctor_id LIMIT 10",
        "doctor_extremes": _worst_best(_BEST, "top performer", best)
        + " UNION ALL "
        + _worst_best(_WORST, "needs attention", worst),
        "doctor_extremes_filtered": _worst_best(_BEST, "top performer", best, filtered)
        + " UNION ALL "
        + _worst_best(_WORST, "needs attention", worst, filtered),
        "ward_monthly_filtered": "SELECT * FROM ward_months WHERE ward_type = 'ASIA'"
        " AND utilization_band = 'Low Utilization'",
        "ward_summary": "SELECT * FROM ward_summary",
        "ward_heatmap": "SELECT ward_id, ward_name, month_label,"
        f" {ratio('sum(utilization_pct)', 'count(*)')} utilization_pct"
        " FROM ward_months GROUP BY 1, 2, 3",
        "ward_heatmap_matrix": "SELECT * FROM (PIVOT (SELECT ward_id, ward_name, month_label,"
        " utilization_pct FROM ward_months) ON month_label USING max(utilization_pct)"
        " GROUP BY ward_id, ward_name)",
        "ward_kpis": "SELECT (SELECT "
        + ratio("sum(utilization_pct)", "count(*)")
        + " FROM ward_months) avg_utilization_pct, most.ward_name most_utilized_ward,"
        " most.m most_utilized_pct, least.ward_name least_utilized_ward, least.m least_utilized_pct,"
        " CAST(cap.c AS BIGINT) total_capacity_beds, CAST(cap.b AS BIGINT) total_used_bed_days FROM"
        f" (SELECT ward_name, {ratio('sum(utilization_pct)', 'count(*)')} m FROM ward_months"
        " GROUP BY ward_id, ward_name ORDER BY sum(utilization_pct) / count(*) DESC, min((month_label, -utilization_pct, ward_id))"
        f" LIMIT 1) most, (SELECT ward_name, {ratio('sum(utilization_pct)', 'count(*)')} m"
        " FROM ward_months GROUP BY ward_id, ward_name"
        " ORDER BY sum(utilization_pct) / count(*), min((month_label, -utilization_pct, ward_id))"
        " LIMIT 1) least,"
        " (SELECT sum(c) c, sum(b) b FROM (SELECT max_by(capacity, month_label) c,"
        " sum(month_occupied_bed_days) b FROM ward_months GROUP BY ward_id)) cap",
        "readmitted_by_month": f"SELECT {label()} month_label,"
        " CAST(sum(readmitted_cases) AS BIGINT) readmitted_cases FROM readmission_monthly"
        " GROUP BY year_num, month_num",
        "readmitted_by_month_of_disease": f"SELECT {label()} month_label, readmitted_cases"
        " FROM readmission_monthly WHERE disease_name = 'Condition Brand#12'",
        "readmitted_by_month_unknown_disease": f"SELECT {label()} month_label,"
        " CAST(sum(readmitted_cases) AS BIGINT) readmitted_cases FROM readmission_monthly"
        " GROUP BY year_num, month_num",
        "readmission_severity": "SELECT month_label, disease_name, total_cases, readmitted_cases,"
        f" recovered_cases, {_EXACT}, {severity('readmission_rate_pct')}"
        " severity FROM readmission_monthly",
        "readmission_risk_filtered": "SELECT * FROM (SELECT month_label, disease_name, total_cases,"
        f" readmitted_cases, recovered_cases, {_EXACT},"
        f" {severity('readmission_rate_pct')} severity FROM readmission_monthly)"
        " WHERE severity = 'high' AND total_cases >= 20",
        "readmission_kpis": _readmission_kpis("share_base"),
        "readmission_kpis_filtered": _readmission_kpis(
            "(SELECT * FROM share_base WHERE total_cases >= 100"
            f" AND {severity('readmission_rate_pct')} = 'high')"
        ),
        "top_diseases_by_cases": "SELECT disease_name, total_cases, readmitted_cases, recovered_cases"
        " FROM readmission_by_disease ORDER BY total_cases DESC, readmission_rate_pct DESC,"
        " disease_name LIMIT 10",
        "readmission_share": "SELECT disease_name, readmitted_cases, "
        + pct("readmitted_cases", "(SELECT sum(readmitted_cases) FROM share_base)")
        + " readmission_share_pct FROM share_base WHERE readmitted_cases > 0"
        " ORDER BY readmitted_cases DESC, readmission_rate_pct DESC, total_cases DESC, disease_name LIMIT 8",
        "filter_options": "SELECT DISTINCT 'specialization' filter_name, specialization AS option"
        " FROM doctor_ranking UNION ALL SELECT DISTINCT 'ward_type', ward_type FROM ward_utilization"
        " UNION ALL SELECT DISTINCT 'disease', disease_name FROM disease_resources"
        " UNION ALL SELECT DISTINCT 'readmission_disease', disease_name FROM readmission_monthly",
        # tables
        "table_search": _search(
            "doctor_ranking",
            ["doctor_id", "specialization", "department", "total_cases", "recovery_rate_pct"],
            "asia",
        ),
        "table_sort": "SELECT disease_name, total_cases, CAST(NULL AS DOUBLE) sort_number,"
        f" {_natural('disease_name')} sort_text FROM disease_totals",
        "table_sort_number": _sorted(_DISEASE_ROWS, f"total_cases, {_natural('total_cases')}, disease_name"),
        "table_sort_number_descending": _sorted(
            _DOCTOR_ROWS, f"recovery_rate_pct DESC, {_natural('recovery_rate_pct')} DESC, doctor_id"
        ),
        "table_sort_natural": _sorted(_DISEASE_ROWS, f"{_natural('disease_name')}, disease_name"),
        "table_sort_natural_descending": _sorted(
            _DOCTOR_ROWS, f"{_natural('doctor_label')} DESC, doctor_id"
        ),
        "table_sort_plain": _sorted(_DISEASE_ROWS, "lower(disease_name), disease_name"),
        "table_sort_plain_descending": _sorted(
            _DOCTOR_ROWS, "lower(specialization) DESC, specialization DESC, doctor_id"
        ),
        "disease_resources_order": _sorted(
            "SELECT * FROM disease_resources", "year_num, month_num, total_treatment_spend DESC, disease_name"
        ),
        "doctor_ranking_order": _sorted("SELECT * FROM doctor_ranking", "performance_rank, doctor_id"),
        "ward_utilization_order": _sorted(
            "SELECT * FROM ward_utilization", "year_num, month_num, utilization_pct DESC, ward_id"
        ),
        "readmission_monthly_order": _sorted(
            "SELECT * FROM readmission_monthly", "year_num, month_num, readmission_rate_pct DESC, disease_name"
        ),
        "display_table": "SELECT ward_name, ward_type, format('{:,}', capacity) capacity,"
        " format('{:,}', month_occupied_bed_days) month_occupied_bed_days,"
        " concat(CAST(utilization_pct AS VARCHAR), '%') utilization_pct, utilization_band,"
        " trim(regexp_replace(lower(utilization_band), '[^a-z0-9]+', '-', 'g'), '-') band_slug,"
        " month_label FROM ward_months",
        "display_money": "SELECT disease_name,"
        " format('{:,.2f}', CAST(total_treatment_spend AS DOUBLE)) total_treatment_spend,"
        " format('{:,}', total_cases) total_cases, format('{:,}', total_bed_days) total_bed_days"
        " FROM disease_totals",
        # quality
        "dq_duplicate_keys": _duplicates(),
        "dq_orphans": _orphans(REFERENCES),
        "dq_warehouse_orphans": _orphans(WAREHOUSE_REFERENCES),
        "dq_nulls": _nulls(REQUIRED),
        "dq_warehouse_nulls": _nulls(REQUIRED_IN_WAREHOUSE),
        "dq_domains": _domains(),
        "dq_row_counts": _union_checks(
            [
                f"SELECT '{t}' table_name, count(*) row_count FROM {t}"
                for t in [*NULL_TABLES, "dim_date", "dim_disease", "dim_doctor", "dim_ward",
                          "dim_outcome", "fact_treatment"]
            ]
        ),
        "dq_reconcile": f"SELECT 'cases by month' measure, {label()} item,"
        " CAST(sum(total_cases) AS BIGINT) amount FROM fact GROUP BY year_num, month_num"
        " UNION ALL SELECT 'rows by outcome', d.outcome_label, count(o.visit_id)"
        " FROM dim_outcome d LEFT JOIN outcome o ON o.status = d.outcome_label"
        " GROUP BY d.outcome_label",
        "dedup_append": "SELECT visit_id, disease_code, quantity FROM (SELECT l_orderkey visit_id,"
        " p_brand disease_code, min(l_quantity) quantity FROM lineitem"
        " JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
        " WHERE visit_id NOT IN (SELECT visit_id FROM visit WHERE visit_date < DATE '1998-01-01')",
        # admission and alerts
        "ward_current_occupancy": "SELECT * FROM occupancy",
        "admission_control": "SELECT * FROM decisions",
        "admission_visits": "SELECT row_number() OVER (ORDER BY request_id)"
        " + (SELECT max(visit_id) FROM visit) visit_id, patient_id, doctor_id,"
        " request_date visit_date, visit_type, request_id FROM decisions WHERE accepted",
        "admission_allocations": "SELECT row_number() OVER (ORDER BY request_id)"
        " + (SELECT max(allocation_id) FROM bed_allocation) allocation_id, patient_id, ward_id,"
        " request_date admit_date, CAST(NULL AS DATE) discharge_date, CAST(NULL AS INT) days_stayed,"
        " request_id FROM decisions WHERE accepted",
        "admission_rejections": "SELECT request_id, patient_id, ward_id, request_date, reason"
        " FROM decisions WHERE NOT accepted",
        "long_stay_alerts": f"SELECT allocation_id, patient_id, ward_id, days_stayed, {_MESSAGE}"
        " alert_message FROM bed_allocation WHERE days_stayed > 14",
        "long_stay_alerts_stream": "SELECT allocation_id, change_seq, patient_id, ward_id,"
        f" days_stayed, {_MESSAGE} alert_message FROM allocation_change"
        " WHERE operation = 'update' AND days_stayed > 14",
    }


def all_statements() -> dict[str, str]:
    return {name: statement(sql) for name, sql in _queries().items()}
