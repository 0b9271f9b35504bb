"""What the optimiser makes of the queries: filters and columns reach the scan, dimensions are broadcast, no Python runs."""

import pytest

from lakeward.operators import gold, governance
from lakeward.plans import catalogue
from lakeward.plans import testbed as tb

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_literal_predicate_reaches_the_scan(spark, tmp_path):
    tb.encounters(spark, DATA).write.parquet(str(tmp_path / "e"))
    seen = governance.predicate(spark.read.parquet(str(tmp_path / "e")), tb.users(spark), tb.hospitals(spark, DATA), "manager_h03").select("encounter_id")
    assert "EqualTo(hospital_id,H03)" in plan(seen) and "ReadSchema: struct<encounter_id:bigint,hospital_id:string>" in plan(seen)


def test_readmissions_take_one_pass(spark):
    text = plan(gold.readmission(tb.encounters(spark, DATA)))
    assert "Join" not in text and text.count("FileScan") == 1 and "RangeFrame" in text


def test_dimensions_are_broadcast(spark):
    text = plan(catalogue.queries()["v_encounters_analyst"](spark, DATA))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_claims_read_only_their_columns(spark):
    scan = next(line for line in plan(catalogue.queries()["g_claims_summary"](spark, DATA)).splitlines() if "lineitem" in line)
    assert "l_linestatus" not in scan and "l_extendedprice" in scan


@pytest.mark.parametrize("name", ["g_daily_admissions", "g_claims_summary", "s_watermark_upsert", "f_parse_dates", "f_mask_all", "v_patients_auditor", "p_column_metrics", "d_kpis"])
def test_no_python_on_rows(spark, name):
    text = plan(catalogue.queries()[name](spark, DATA))
    assert not any(word in text for word in ("Python", "Pandas", "Arrow"))
