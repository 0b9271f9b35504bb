"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from lakeward.plans import catalogue, filequeries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: One query of each kind; all of them run with the driver's oracle at a larger size.
NAMES = ["g_daily_admissions", "g_readmission_30d", "g_readmission_30d_join", "g_claims_summary", "g_lab_abnormality", "s_claims_dedupe_row", "s_claims_dedupe_coalesce", "s_watermark_upsert", "s_merge_upsert", "s_quarantine_keys", "f_parse_dates", "f_clean_name", "f_mask_all", "f_policy_masks", "f_tokenize", "v_patients_auditor", "v_patients_analyst", "v_role_counts", "v_row_filter_exists", "p_column_metrics", "p_top5_issues", "d_kpis", "d_lab_heatmap", "d_top10_outliers", "u_union_batches", "s_quarantine_payload", "s_disposition_counts", "s_partition_filter", "st_available_now", *filequeries.QUERIES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()[:10]
    return round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    want = duck.sql(catalogue.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(([plain(x) for x in row] for row in df.collect()), key=str)
    assert got == sorted(([plain(row[k]) for k in order] for row in want.fetchall()), key=str)


def test_nothing_but_the_entry_imports_the_optional_package():
    import pathlib

    root = pathlib.Path(catalogue.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "lakeward.llm" not in path.read_text()
