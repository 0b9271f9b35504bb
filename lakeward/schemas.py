"""Schemas, keys and reason codes of the medallion tables."""

from __future__ import annotations

META = "batch_id string, source_file string, ingest_timestamp string"
RAW = {
    "patients": "patient_id string, full_name string, gender string, date_of_birth string, phone string, email string, national_id string, city string, primary_hospital_id string, last_updated string",
    "encounters": "encounter_id string, patient_id string, hospital_id string, department string, encounter_type string, admit_date string, discharge_date string, diagnosis string, primary_diagnosis_code string, attending_doctor_id string, last_updated string",
    "lab_results": "lab_result_id string, encounter_id string, test_name string, result_value string, unit string, reference_low double, reference_high double, result_timestamp string, last_updated string",
    "claims": "claim_id string, encounter_id string, insurer string, claim_amount double, approved_amount double, claim_status string, claim_date string, last_updated string",
}
ENTITIES = tuple(RAW)
KEYS = {"patients": "patient_id", "encounters": "encounter_id", "lab_results": "lab_result_id", "claims": "claim_id"}
SILVER = {
    "patients": "patient_id string, original_patient_id string, full_name string, gender string, age_band string, patient_age int, phone string, email string, national_id string, city string, primary_hospital_id string, last_updated string, batch_id string",
    "encounters": "encounter_id string, patient_id string, original_patient_id string, hospital_id string, department string, encounter_type string, admit_date string, discharge_date string, length_of_stay_days int, primary_diagnosis_code string, attending_doctor_id string, last_updated string, batch_id string",
    "lab_results": "lab_result_id string, encounter_id string, test_name string, test_code string, result_value string, unit string, reference_low double, reference_high double, lab_flag string, result_timestamp string, result_date string, last_updated string, batch_id string",
    "claims": "claim_id string, encounter_id string, insurer string, claim_amount double, approved_amount double, claim_status string, claim_date string, last_updated string, batch_id string",
}
SILVER_KEYS = KEYS | {"patients": "original_patient_id"}
VAULT = "patient_id_token string, original_patient_id string, full_name string, phone string, email string, national_id string, date_of_birth string, batch_id string, created_at string"
QUARANTINE = "quarantine_id string, entity string, business_key string, reason string, batch_id string, record_payload string, quarantine_timestamp string"
AUDIT = "batch_id string, started_at string, finished_at string, rows_read long, rows_loaded long, rows_quarantined long, rows_superseded long, status string, error_message string"
HOSPITALS = "hospital_id string, hospital_name string, city string, region string, bed_capacity int"
USERS = "user_name string, role string, hospital_id string, region string"
NULL_KEY, BAD_DATE, ORPHAN = "NULL_BUSINESS_KEY", "BAD_DATE_FORMAT", "ORPHAN_FK"
