import pytest
from pyspark.sql import functions as F

from lakeward.operators import gold, governance, profile, reports, rules, upsert


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_dedupe_modes(spark):
    df = spark.createDataFrame([("P1", "10:00", "555", "a"), ("P1", "12:00", None, "b"), ("P2", None, "1", "c"), ("P2", "09:00", "2", "d"), ("P3", "1", "x", "f1"), ("P3", "1", "y", "f2")], "k string, ts string, phone string, f string")
    by = (F.col("ts"), [F.col("f")])
    assert rows(upsert.dedupe(df, "k", *by)) == [("P1", "12:00", "555", "b"), ("P2", "09:00", "1", "c"), ("P3", "1", "y", "f2")]
    assert rows(upsert.dedupe(df, "k", *by, mode="row")) == [("P1", "12:00", None, "b"), ("P2", None, "1", "c"), ("P3", "1", "y", "f2")]
    assert upsert.dedupe(df.limit(0), "k", *by).count() == 0


def test_watermark(spark):
    old = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", None)], "k string, ts int")
    new = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6), ("d", 1), ("e", None), ("a2", 1)], "k string, ts int")
    assert rows(upsert.newer(new, old, "k", "k", "ts").where("is_newer").select("k")) == [("a2",), ("c",), ("d",), ("e",)]
    assert rows(upsert.merge_upsert(old, new, "k", "ts")) == sorted([("a", 5), ("b", 5), ("c", 6), ("d", 1), ("e", None), ("a2", 1)], key=str)


def test_first_failing_rule(spark):
    data = [("1", "2026-01-01", "H1"), ("  ", "bad", "H9"), (None, "2026-01-01", "H1"), ("2", "bad", "H9"), ("3", None, "H1"), ("4", "2026-01-01", "H9"), ("5", "2026-01-01", None), ("6", "2026-01-01", " H1 ")]
    df = spark.createDataFrame(data, "k string, day string, h string")
    keys = spark.createDataFrame([("H1",), ("H1",)], "h string")
    got = {r["k"]: r["reject_reason"] for r in rules.classify(df, "k", ("day",), (), (rules.Reference("h", keys),)).collect()}
    assert got == {"1": None, "  ": "NULL_BUSINESS_KEY", None: "NULL_BUSINESS_KEY", "2": "BAD_DATE_FORMAT", "3": "BAD_DATE_FORMAT", "4": "ORPHAN_FK", "5": "ORPHAN_FK", "6": None}
    optional = rules.classify(df, "k", (), ("day",), (rules.Reference("h", keys, optional=True),))
    assert {r["k"]: r["reject_reason"] for r in optional.where("k in ('3', '5', '4', '2')").collect()} == {"3": None, "5": None, "4": "ORPHAN_FK", "2": "BAD_DATE_FORMAT"}
    records = rules.quarantine_records(optional.where("reject_reason is not null"), "x", "k", "b", ["k", "day", "h"], "t").collect()
    assert any(r["record_payload"] == '{"k":null,"day":"2026-01-01","h":"H1"}' for r in records)


@pytest.fixture
def stays(spark):
    data = [("E1", "P", "H01", "2026-01-01", "2026-01-03", "Inpatient"), ("E2", "P", "H01", "2026-01-10", "2026-01-12", " inpatient")]
    return spark.createDataFrame(data, "encounter_id string, patient_id string, hospital_id string, admit_date string, discharge_date string, encounter_type string").withColumn("length_of_stay_days", F.lit(2))


def test_marts_on_the_fixture(spark, stays):
    assert rows(gold.daily_admissions(stays)) == [("H01", f"2026-01-{d}", f"2026-01-{d}", 1, 0, 2.0, 2, 6.67, 30, 1) for d in ("01", "10")]
    assert rows(gold.readmission(stays)) == rows(gold.readmission(stays, method="join")) == [("H01", "2026-01", 2, 2, 1, 0.5, 50.0)]
    claims = spark.createDataFrame([("C", "E1", "star health", 1000.0, 900.0, "Approved", "2026-01-03")], "claim_id string, encounter_id string, insurer string, claim_amount double, approved_amount double, claim_status string, claim_date string")
    assert rows(gold.claims_summary(claims, stays)) == [("H01", "Star Health", "2026-01", 1, 1, 1000.0, 1000.0, 900.0, 900.0, 1000.0, 0, 0, 0, 0, 1, 0.0)]
    labs = spark.createDataFrame([("L", "E1", "GLUCOSE", "abnormal", None)], "lab_result_id string, encounter_id string, test_code string, lab_flag string, result_date string")
    assert rows(gold.lab_abnormality(labs, stays)) == [("H01", "GLUCOSE", "GLUCOSE", "2026-01", 1, 1, 1, 1, 1.0, 100.0)]
    for mart in (gold.daily_admissions(stays), gold.readmission(stays), gold.claims_summary(claims, stays), gold.lab_abnormality(labs, stays)):
        governance.guard(mart)


def test_readmission_gaps(spark):
    data = [("A1", "p", "2026-01-01", "2026-01-01"), ("A2", "p", "2026-01-01", "2026-01-01"), ("B1", "q", "2026-01-01", "2026-01-02"), ("B2", "q", "2026-02-01", "2026-02-02"), ("C1", "r", "2026-01-01", "2026-01-02"), ("C2", "r", "2026-02-02", "2026-02-03"), ("D1", "s", "2026-01-05", "2026-01-03"), ("E1", None, "2026-01-01", "2026-01-01")]
    df = spark.createDataFrame([(e, p, "H1", a, d) for e, p, a, d in data], "encounter_id string, patient_id string, hospital_id string, admit_date string, discharge_date string")
    assert rows(gold.readmission(df)) == rows(gold.readmission(df, method="join"))
    assert sum(r["readmissions_30d"] for r in gold.readmission(df).collect()) == 3


def test_all_encounters_without_inpatients(spark, stays):
    others = stays.withColumn("encounter_type", F.lit("Outpatient"))
    assert gold.daily_admissions(others).count() == 2
    mixed = others.unionByName(stays.where("encounter_id = 'E1'"))
    assert gold.daily_admissions(mixed).agg(F.sum("admissions")).first()[0] == 1
    assert gold.daily_admissions(stays.limit(0)).count() == 0


@pytest.fixture
def access(spark):
    hospitals = spark.createDataFrame([("H1", "One", "N", 10), ("H2", "Two", "S", 20)], "hospital_id string, hospital_name string, region string, bed_capacity int")
    users = spark.createDataFrame([("aud", "COMPLIANCE_AUDITOR", None, None), ("eng", "DATA_ENGINEER", None, None), ("north", "REGIONAL_ANALYST", None, "N"), ("m1", "HOSPITAL_MANAGER", "H1", None), ("m2", "HOSPITAL_MANAGER", "H2", None)], "user_name string, role string, hospital_id string, region string")
    facts = spark.createDataFrame([("e1", "H1"), ("e2", "H2"), ("e3", "H2"), ("e4", None)], "encounter_id string, hospital_id string")
    return users, hospitals, facts


def test_row_security(access):
    users, hospitals, facts = access
    seen = {u: rows(governance.fact_view(facts, users, hospitals, u, ["encounter_id"])) for u in ("aud", "eng", "north", "m1", "m2", "nobody")}
    assert seen["aud"] == seen["eng"] == [("e1",), ("e2",), ("e3",), ("e4",)]
    assert seen["north"] == seen["m1"] == [("e1",)] and seen["m2"] == [("e2",), ("e3",)] and seen["nobody"] == []
    for user, want in seen.items():
        assert rows(governance.predicate(facts, users, hospitals, user).select("encounter_id")) == want
    counts = {r["user_name"]: r["visible_encounters"] for r in governance.role_counts(facts, facts.withColumnRenamed("hospital_id", "primary_hospital_id"), users, hospitals).collect()}
    assert counts == {"aud": 4, "eng": 4, "north": 1, "m1": 1, "m2": 2}


def test_marts_refuse_personal_data(spark):
    with pytest.raises(ValueError, match="Phone"):
        governance.guard(spark.createDataFrame([], "hospital_id string, Patient_Phone string"))


def test_profile(spark):
    df = spark.createDataFrame([("a", 1.0, "2026-01-01", "x"), ("a", None, "1/1/2026", "9876543210"), (None, 3.0, None, None)], "k string, v double, visit_date string, phone string")
    got = {r["column_name"]: tuple(r)[1:] for r in profile.column_metrics(df).collect()}
    assert got["v"] == (1, 33.33, 2, 1.0, 3.0, 2.0) and got["k"] == (1, 33.33, 1, None, None, None)
    assert dict(map(tuple, profile.violations(df).collect())) == {"visit_date_non_iso": 1, "phone_format_violations": 1}
    assert profile.duplicate_keys(df, "k").first()[0] == 1
    assert profile.issues(df, "k").count() == 5
    assert rows(profile.column_metrics(df.limit(0)))[0][2] == 0.0
    assert rows(profile.column_metrics(df, approximate=True)) == rows(profile.column_metrics(df))
    assert "Expand" not in profile.column_metrics(df)._jdf.queryExecution().executedPlan().toString()


def test_pivot_and_outliers(spark):
    labs = spark.createDataFrame([("One", "A", 4, 1), ("One", "B", 2, 2), ("Two", "A", 1, 0)], "hospital_name string, test_name string, tests_done long, abnormal_count long")
    assert rows(reports.heatmap(labs, ["A", "B"])) == [("One", 25.0, 100.0), ("Two", 0.0, None)]
    assert reports.outliers(labs, 1).first()["test_name"] == "B"


def test_a_sixth_test_gets_a_column_and_too_many_are_an_error(spark):
    labs = spark.createDataFrame([("One", f"T{k}", 2, 1) for k in range(6)], "hospital_name string, test_name string, tests_done long, abnormal_count long")
    assert reports.heatmap(labs).columns == ["hospital_name", *(f"T{k}" for k in range(6))]
    with pytest.raises(ValueError, match="more than 5"):
        reports.heatmap(labs, most=5)


def test_stays_without_a_patient_are_no_readmissions(spark):
    rows_ = [("E1", None, "H1", "2026-01-01", "2026-01-02"), ("E2", None, "H1", "2026-01-05", "2026-01-06"), ("E3", "P", "H1", "2026-01-01", "2026-01-02"), ("E4", "P", "H1", "2026-01-05", "2026-01-06")]
    stays_ = spark.createDataFrame(rows_, "encounter_id string, patient_id string, hospital_id string, admit_date string, discharge_date string")
    for method in ("window", "join"):
        assert gold.readmission(stays_, method=method).first()["readmissions_30d"] == 1


def test_dirty_amounts_do_not_stop_the_mart(spark):
    claims = spark.createDataFrame([("c1", "e1", "x", 1e17, 1.0, "Approved", "2026-01-01"), ("c2", "e1", "x", 1e300, None, "Approved", "2026-01-01"), ("c3", "e1", "x", float("nan"), 2.0, "Approved", "2026-01-01"), ("c4", "e1", "x", 1.5, None, "Pending", "2026-01-01")], "claim_id string, encounter_id string, insurer string, claim_amount double, approved_amount double, claim_status string, claim_date string")
    got = gold.claims_summary(claims, spark.createDataFrame([("e1", "H1")], "encounter_id string, hospital_id string")).first()
    assert (got["total_claimed"], got["total_approved"], got["claims_count"]) == (1e17 + 1.5, 3.0, 4)


def test_the_vault_is_read_for_auditors_only(spark, access):
    users, hospitals, _ = access
    patients = spark.createDataFrame([("t1", "P1", "A***", "M", "30-39", 35, "******1", "a***@b.c", "****1", "X", "H1", "t")], "patient_id string, original_patient_id string, full_name string, gender string, age_band string, patient_age int, phone string, email string, national_id string, city string, primary_hospital_id string, last_updated string")
    vault = spark.createDataFrame([("P1", "Ann", "1", "a@b.c", "1", "1990-01-01", "vaulted")], "original_patient_id string, full_name string, phone string, email string, national_id string, date_of_birth string, mark string").where("mark = 'vaulted'")
    views = {u: governance.patients_view(patients, vault, users, hospitals, u) for u in ("aud", "m1", "m2", "nobody")}
    assert {u: [r["full_name"] for r in v.collect()] for u, v in views.items()} == {"aud": ["Ann"], "m1": ["A***"], "m2": [], "nobody": []}
    assert ["vaulted" in v._jdf.queryExecution().optimizedPlan().toString() for v in views.values()] == [True, False, False, False]
