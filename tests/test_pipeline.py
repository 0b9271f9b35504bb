import json
import shutil
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lakeward import schemas
from lakeward.config import get_config
from lakeward.operators import governance, rules, silver
from lakeward.plans import pipeline
from lakeward.sources import files, readers, storage
from lakeward.sources.storage import SnapshotTable
from lakeward.streaming import incremental

CLAIM = ["claim_id", "encounter_id", "insurer", "claim_amount", "approved_amount", "claim_status", "claim_date", "last_updated"]


def workbook(path, rows, sheet="claims"):
    """A minimal workbook: shared and inline strings, numbers, a date with a number format."""
    shared = []

    def cell(at, x):
        if x is None:
            return ""
        if isinstance(x, tuple):
            return f'<c r="{at}" s="1"><v>{x[0]}</v></c>'
        if isinstance(x, (int, float)):
            return f'<c r="{at}"><v>{x}</v></c>'
        if x.startswith("inline:"):
            return f'<c r="{at}" t="inlineStr"><is><t>{x[7:]}</t></is></c>'
        if x not in shared:
            shared.append(x)
        return f'<c r="{at}" t="s"><v>{shared.index(x)}</v></c>'

    body = "".join(f'<row r="{n}">' + "".join(cell(f"{chr(65 + k)}{n}", x) for k, x in enumerate(row)) + "</row>" for n, row in enumerate(rows, 1))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="notes" sheetId="1" r:id="rId9"/><sheet name="{sheet}" sheetId="2" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="worksheets/none.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def batch(folder, day, patients, encounters, labs, claims):
    folder.mkdir(parents=True)
    (folder / f"patients_{day}.csv").write_text("patient_id,full_name,gender,date_of_birth,phone,email,national_id,city,primary_hospital_id,last_updated\n" + "".join(f"{p}\n" for p in patients))
    (folder / f"encounters_{day}.jsonl").write_text("".join(json.dumps(e) + "\n" for e in encounters))
    (folder / f"lab_results_{day}.txt").write_text("lab_result_id|encounter_id|test_name|result_value|unit|reference_low|reference_high|result_timestamp|last_updated\n" + "".join(f"{x}\n" for x in labs))
    workbook(folder / f"claims_{day}.xlsx", [CLAIM, *claims])


@pytest.fixture
def root(tmp_path):
    data = tmp_path / "data"
    (data / "reference").mkdir(parents=True)
    (data / "reference" / "hospitals.csv").write_text("hospital_id,hospital_name,city,region,bed_capacity\nH01,One,Pune,West,24\nH02,Two,Delhi,North,30\n")
    (data / "reference" / "user_access_json.txt").write_text(json.dumps([{"user_name": "aud", "role": "COMPLIANCE_AUDITOR", "hospital_id": None, "region": None}, {"user_name": "m1", "role": "HOSPITAL_MANAGER", "hospital_id": "H01", "region": None}]))
    enc = lambda e, p, h, a, d, at, **more: {"encounter_id": e, "patient_id": p, "hospital_id": h, "department": None, "encounter_type": "inpatient", "admit_date": a, "discharge_date": d, "diagnosis": {"primary_code": "J10", "note": 1}, "attending_doctor_id": "D1", "last_updated": at, **more}
    batch(
        data / "batch_0_day1", "d1",
        ['P1,"  ann ""x""  lee",female,1990-05-01,+91-9876543210,ANN@X.ORG,123456789012,Pune,H01,2026-01-01 10:00:00', "P1,,F,01/05/1990,,ann@x.org,,Pune,H01,2026-01-01 12:00:00", "P2,bob,M,not a date,1,b@x.org,1,Pune,H01,2026-01-01 10:00:00", "P3,cy,M,1980-01-01,1,c@x.org,NA,Pune,H99,2026-01-01 10:00:00", ",dee,F,1980-01-01,1,d@x.org,1,Pune,H01,2026-01-01 10:00:00", "P4,eve,F,1970-02-03,12,e@x.org,1234,Delhi,,2026-01-01 10:00:00"],
        [enc("E1", "P1", "H01", "2026-01-01", "2026-01-03", "2026-01-03 10:00:00"), enc("E2", " P1 ", "H02", "10/01/2026", None, "2026-01-10 10:00:00", diagnosis="plain text"), enc("E3", "P9", "H01", "2026-01-01", None, "2026-01-03 10:00:00"), enc("E4", "P1", "H01", "2026-01-01", "bad", "2026-01-03 10:00:00")],
        ["L1|E1| glucose |5.2|mmol|4.0|5.6|2026-01-02 08:00:00|2026-01-02 09:00:00", "L2|E1|Glucose|pending|mmol|4.0|5.6|2026-01-02 08:00:00|2026-01-02 09:00:00", "L3|E9|Glucose|1|mmol|4.0|5.6|2026-01-02|2026-01-02 09:00:00", "L4|E2|Sodium|0|mmol|NA||2026-01-02|2026-01-02 09:00:00"],
        [["C1", "E1", "star health ", 1000, 900.5, "APPROVED", (46025,), "2026-01-05 10:00:00"], ["C2", "E1", "inline:Acme mutual", 10.25, None, "reject", "2026-01-05", "2026-01-05 10:00:00"], ["C3", "E9", "care", 1, None, "x", "2026-01-05", "2026-01-05 10:00:00"]],
    )
    batch(
        data / "batch_1_day2", "d2",
        ["P1,ann b,F,1990-05-01,7,ann@x.org,1,Pune,H01,2026-01-01 12:00:00", "P4,eve new,F,1970-02-03,12,e@x.org,1234,Delhi,H02,2026-01-02 10:00:00"],
        [enc("E1", "P1", "H01", "2026-01-01", "2026-01-04", "2026-01-04 10:00:00"), enc("E5", "P3", "H02", "2026-01-20", "2026-01-21", "2026-01-21 10:00:00"), enc("E6", "P4", "H02", "2026-01-20", "2026-01-21", "2026-01-21 10:00:00")],
        ["L1|E1|glucose|9.9|mmol|4.0|5.6|2026-01-02 08:00:00|2026-01-02 08:00:00"],
        [["C1", "E1", "star health", 1000, 950.0, "approved", "2026-01-05", "2026-01-06 10:00:00"]],
    )
    return tmp_path


def settings(root, **more):
    return get_config(str(root / "data"), str(root / "warehouse"), "pepper", as_of="2026-01-01", **more)


def test_batches_end_to_end(spark, root):
    config = settings(root)
    first = pipeline.run_batch(spark, config, "batch_0")
    assert first["entities"] == {
        "patients": {"read": 6, "loaded": 2, "quarantined": 3, "superseded": 1}, "encounters": {"read": 4, "loaded": 2, "quarantined": 2, "superseded": 0},
        "lab_results": {"read": 4, "loaded": 3, "quarantined": 1, "superseded": 0}, "claims": {"read": 3, "loaded": 2, "quarantined": 1, "superseded": 0},
    }
    tables = pipeline.load_silver(spark, config)
    one = tables["patients"].where("original_patient_id = 'P1'").first()
    assert (one["full_name"], one["phone"], one["email"], one["national_id"], one["patient_age"], one["age_band"], one["last_updated"]) == ("A***", "******3210", "a***@x.org", "********9012", 35, "30-39", "2026-01-01 12:00:00")
    vault = silver.vault_table(spark, config).read()
    assert vault.where("original_patient_id = 'P1'").first()["full_name"] == 'Ann "X" Lee'
    enc = {r["encounter_id"]: r for r in tables["encounters"].collect()}
    assert (enc["E1"]["primary_diagnosis_code"], enc["E1"]["length_of_stay_days"], enc["E2"]["admit_date"], enc["E2"]["primary_diagnosis_code"], enc["E2"]["department"]) == ("J10", 2, "2026-01-10", "", "")
    assert enc["E1"]["patient_id"] == one["patient_id"] != "P1"
    labs = {r["lab_result_id"]: (r["lab_flag"], r["result_value"], r["test_name"]) for r in tables["lab_results"].collect()}
    assert labs == {"L1": ("normal", "5.2", "GLUCOSE"), "L2": ("abnormal", "pending", "GLUCOSE"), "L4": ("normal", "0", "SODIUM")}
    claims = {r["claim_id"]: (r["insurer"], r["claim_amount"], r["claim_status"], r["claim_date"]) for r in tables["claims"].collect()}
    assert claims == {"C1": ("Star Health", 1000.0, "Approved", "2026-01-03"), "C2": ("Acme Mutual", 10.25, "Rejected", "2026-01-05")}
    reasons = {(r["entity"], r["business_key"]): r["reason"] for r in pipeline.load_quarantine(spark, config).collect()}
    assert reasons == {("patients", "P2"): schemas.BAD_DATE, ("patients", "P3"): schemas.ORPHAN, ("patients", ""): schemas.NULL_KEY, ("encounters", "E3"): schemas.ORPHAN, ("encounters", "E4"): schemas.BAD_DATE, ("lab_results", "L3"): schemas.ORPHAN, ("claims", "C3"): schemas.ORPHAN}

    again = pipeline.run_batch(spark, config, "batch_0")
    assert again["rows_loaded"] == 0 and again["rows_read"] == 17
    assert pipeline.load_bronze(spark, config, "patients").count() == 6 and pipeline.load_quarantine(spark, config).count() == 7
    assert pipeline.load_silver(spark, config)["patients"].count() == 2

    second = pipeline.run_batch(spark, config, "batch_1")
    assert {k: v["loaded"] for k, v in second["entities"].items()} == {"patients": 1, "encounters": 2, "lab_results": 0, "claims": 1}
    assert second["entities"]["encounters"]["quarantined"] == 1
    marts = pipeline.load_gold(spark, config)
    assert {r["hospital_id"]: r["index_discharges"] for r in marts["readmission_30d"].collect()} == {"H01": 1, "H02": 1}
    assert marts["claims_summary"].where("insurer = 'Star Health'").first()["total_approved"] == 950.0
    audit = pipeline.load_audit(spark, config)
    assert audit.count() == 3 and audit.where("status <> 'SUCCESS'").count() == 0
    seen = {r["user_name"]: (r["visible_encounters"], r["visible_patients"]) for r in pipeline.security_demo(spark, config).collect()}
    assert seen == {"aud": (3, 2), "m1": (1, 1)}
    users, hospitals = readers.read_users(spark, config.path("landing", "reference")), readers.read_hospitals(spark, config.path("landing", "reference"))
    clear = governance.patients_view(pipeline.load_silver(spark, config)["patients"], silver.vault_table(spark, config).read(), users, hospitals, "aud")
    assert {r["full_name"] for r in clear.collect()} == {'Ann "X" Lee', "Eve New"}
    assert "original_patient_id" not in clear.columns
    assert "| patients | 8 | 2 | 3 | 3 | 0 |" in pipeline.cleansing_report(spark, config)
    shown = {r["user_name"]: (r["sample_patient_name"], r["sample_patient_dob_or_band"]) for r in pipeline.security_demo(spark, config).collect()}
    assert shown["aud"] == ('Ann "X" Lee', "1990-05-01") and shown["m1"] == ("A***", "30-39")
    batch = {e: pipeline.load_bronze(spark, config, e, "batch_1") for e in schemas.ENTITIES}
    alone, held = (pipeline.profile_report("x", batch, hospitals, w) for w in (None, pipeline.load_silver(spark, config)))
    assert alone.count("Orphan foreign keys in 'patient_id'") == 1 and "(33.33 %" in alone.split("## encounters")[1].split("Orphan")[1] and "Orphan foreign keys in 'encounter_id'" not in held
    dates = [r["date"] for r in pipeline.load_gold(spark, config)["hospital_daily_admissions"].collect() if r["hospital_id"] == "H01"]
    assert dates == sorted(dates)
    assert files.exists(spark, config.path("reports", "profile_batch_0.md"))
    for table, key in schemas.SILVER_KEYS.items():
        assert pipeline.load_silver(spark, config)[table].groupBy(key).count().where("count > 1").count() == 0


def test_failure_leaves_silver_and_an_audit_row(spark, root, monkeypatch):
    config = settings(root)
    pipeline.run_batch(spark, config, "batch_0")
    monkeypatch.setattr(silver, "verify", lambda *a: (_ for _ in ()).throw(silver.ReconciliationError("forced")))
    with pytest.raises(silver.ReconciliationError):
        pipeline.run_batch(spark, config, "batch_1")
    assert silver.silver_table(spark, config, "encounters").version() == 1
    failed = pipeline.load_audit(spark, config).where("status = 'FAILED'").first()
    assert failed["error_message"] == "forced" and failed["rows_read"] == 7 and failed["rows_loaded"] == 0


def test_a_repeated_batch_leaves_versions_as_they_are(spark, root):
    """Nothing is fresh, so nothing is rewritten; a later batch that changes some entities writes these alone."""
    config = replace(settings(root), profiles=False)
    first, again = (pipeline.run_batch(spark, config, "batch_0") for _ in range(2))
    versions = lambda: [silver.silver_table(spark, config, e).version() for e in schemas.ENTITIES]
    assert versions() == [1, 1, 1, 1] and silver.vault_table(spark, config).version() == 1
    assert again["rows_loaded"] == 0 and again["rows_superseded"] == first["rows_loaded"] + first["rows_superseded"] and again["rows_quarantined"] == first["rows_quarantined"]
    pipeline.run_batch(spark, config, "batch_1")
    assert versions() == [2, 2, 1, 2]


def test_marts_stay_while_what_they_are_made_of_stays(spark, root):
    config = replace(settings(root), profiles=False)
    written = lambda: {name: {p.name for p in (root / "warehouse" / "gold" / name).glob("part-*")} for name in pipeline.GOLD}
    pipeline.run_batch(spark, config, "batch_0")
    first = written()
    pipeline.run_batch(spark, config, "batch_0")
    assert all(first.values()) and written() == first
    hospitals = spark.createDataFrame([("H01", 7)], "hospital_id string, bed_capacity int")
    pipeline.build_gold(spark, config, hospitals)
    assert (second := written()) != first
    shutil.rmtree(root / "warehouse" / "gold" / "claims_summary")
    pipeline.build_gold(spark, config, hospitals)
    assert (third := written())["claims_summary"] and third != second
    pipeline.run_batch(spark, config, "batch_1")
    assert all(written()[name] != third[name] for name in pipeline.GOLD)


@pytest.mark.parametrize("step", ["settled", "upsert"])
def test_a_lost_row_fails_the_batch(spark, root, monkeypatch, step):
    """A row that vanishes between validation and silver is noticed, and neither silver nor the quarantine changes."""
    config = settings(root)
    pipeline.run_batch(spark, config, "batch_0")
    before = sorted(map(str, pipeline.load_quarantine(spark, config).collect()))
    if step == "settled":
        whole = silver.settled
        monkeypatch.setattr(silver, "settled", lambda valid, *a: whole(valid, *a).where("coalesce(encounter_id, '') <> 'E6'" if "discharge_date" in valid.columns else "true"))
    else:
        whole = silver.upsert.upsert
        monkeypatch.setattr(silver.upsert, "upsert", lambda current, fresh, key: whole(current, fresh, key).where("encounter_id <> 'E6'" if key == "encounter_id" else "true"))
    with pytest.raises(silver.ReconciliationError, match="encounters"):
        pipeline.run_batch(spark, config, "batch_1")
    assert {silver.silver_table(spark, config, e).version() for e in schemas.ENTITIES} == {1} == {silver.vault_table(spark, config).version()}
    assert sorted(map(str, pipeline.load_quarantine(spark, config).collect())) == before


def test_missing_inputs(spark, root):
    with pytest.raises(FileNotFoundError):
        pipeline.run_batch(spark, settings(root), "batch_7")
    with pytest.raises(FileNotFoundError):
        readers.read_entity(spark, str(root / "data" / "reference"), "claims", "b", "t")
    with pytest.raises(FileNotFoundError):
        pipeline.load_bronze(spark, settings(root), "patients", "batch_0")
    assert pipeline.load_bronze(spark, settings(root), "patients").count() == 0
    with pytest.raises(ValueError, match="salt"):
        get_config("a", "b", " ")
    assert "pepper" not in repr(settings(root))


def test_batch_folder(spark, tmp_path):
    for name in ("batch_10", "batch_1_x", "Batch_2"):
        (tmp_path / name).mkdir()
    assert [readers.batch_folder(spark, str(tmp_path), b).rsplit("/", 1)[1] for b in (" BATCH_1", "batch_10", "batch_2")] == ["batch_1_x", "batch_10", "Batch_2"]


def test_reconciliation_is_exact(spark):
    frames = {e: spark.createDataFrame([], schemas.SILVER[e]) for e in schemas.ENTITIES}
    hospitals = spark.createDataFrame([("H1",)], "hospital_id string")
    silver.verify({"patients": {"read": 4, "loaded": 1, "quarantined": 2, "superseded": 1}}, frames, hospitals)
    with pytest.raises(silver.ReconciliationError):
        silver.verify({"patients": {"read": 4, "loaded": 1, "quarantined": 2, "superseded": 0}}, frames, hospitals)
    with pytest.raises(silver.ReconciliationError):
        silver.verify({"patients": {"read": 4, "loaded": 1, "quarantined": 2, "superseded": 1, "stays": 3, "silver": 3}}, frames, hospitals)
    frames["encounters"] = spark.createDataFrame([("E", "H9")], "encounter_id string, hospital_id string")
    with pytest.raises(silver.ReconciliationError):
        silver.verify({}, frames, hospitals)


def test_stream_of_files_upserts(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "k string, at int, v string"
    table = SnapshotTable(spark, str(tmp_path / "table"), schema)
    for rows in ([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], [("a", 1, "old"), ("c", 1, "new")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        incremental.upsert_stream(incremental.read_stream(spark, source, schema), table, "k", "at", str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, table.read().collect())) == [("a", 2, "y"), ("b", 1, "z"), ("c", 1, "new")]


def test_windowed_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([("2026-01-01 10:00:00", "a"), ("2026-01-01 11:00:00", "a"), ("2026-01-02 10:00:00", "b"), ("2026-01-09 10:00:00", "z")], "t string, event_type string").select(F.col("t").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(str(tmp_path / "e"))
    stream = incremental.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(str(r["start"])[:10], r["event_type"]): r["n"] for r in spark.table("windows").collect()}
    assert got == {("2026-01-01", "a"): 2, ("2026-01-02", "b"): 1}


def test_sheet_must_be_there(tmp_path):
    workbook(tmp_path / "x.xlsx", [["a"], [1]], sheet="other")
    with pytest.raises(ValueError, match="claims"):
        readers.sheet_rows((tmp_path / "x.xlsx").read_bytes(), "claims")


def test_rule_order_is_kept(spark):
    df = spark.createDataFrame([("1", "bad", "bad")], "k string, a string, b string")
    assert rules.classify(df, "k", ("a",), ("b",)).first()["reject_reason"] == schemas.BAD_DATE


def test_only_quoted_line_breaks_keep_a_file_whole(spark, tmp_path):
    head = "patient_id,full_name,gender,date_of_birth,phone,email,national_id,city,primary_hospital_id,last_updated\n"
    (tmp_path / "patients_a.csv").write_text(head + 'P1,"a ""b""",F,,,,,,,\n')
    read = lambda: readers.read_entity(spark, str(tmp_path), "patients", "b", "t")
    assert not readers._broken_lines(spark, [str(tmp_path / "patients_a.csv")]) and read().first()["full_name"] == 'a "b"'
    (tmp_path / "patients_b.csv").write_text(head + 'P2,"a\nb",F,,,,,,,\n')
    assert readers._broken_lines(spark, [str(tmp_path / "patients_b.csv")]) and {r["full_name"] for r in read().collect()} == {'a "b"', "a\nb"}


def test_tables_of_one_pointer_are_published_together(spark, tmp_path):
    a, b = (SnapshotTable(spark, str(tmp_path / name), "k int", str(tmp_path / "_CURRENT")) for name in "ab")
    staged = [(t, t.stage(spark.createDataFrame([(k,)], "k int"))) for k, t in enumerate((a, b))]
    assert a.version() == b.version() == 0
    storage.publish(staged)
    assert (a.read().first()[0], b.read().first()[0]) == (0, 1)
    a.publish(a.stage(spark.createDataFrame([(7,)], "k int")))
    assert (a.version(), b.version(), a.read().first()[0]) == (2, 1, 7)


def test_command_line_runs_all_batches(spark, root, monkeypatch, capsys):
    shutil.copytree(root / "data" / "batch_1_day2", root / "data" / "batch_2")
    monkeypatch.setattr(pipeline, "build_session", lambda *a: spark)
    pipeline.main(["--batch", "all", "--data-root", str(root / "data"), "--warehouse", str(root / "w"), "--salt", "s", "--as-of", "2026-01-01"])
    assert capsys.readouterr().out.count("SUCCESS") == 3
