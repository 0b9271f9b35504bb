"""The star-schema tables seen as hospital data: orders are encounters, lines are claims, events are lab results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions.scalars import half_even

PAYERS = ("Star Health", "ICICI Lombard", "HDFC ERGO", "Bajaj Allianz", "Care Health", "Niva Bupa")
#: Access entries for tests: an auditor, an engineer, analysts of regions, managers of hospitals.
USERS = [("auditor", "COMPLIANCE_AUDITOR", None, None), ("engineer", "DATA_ENGINEER", None, None), ("analyst_asia", "REGIONAL_ANALYST", None, "ASIA"), ("analyst_europe", "REGIONAL_ANALYST", None, "EUROPE"), *((f"manager_h{k:02d}", "HOSPITAL_MANAGER", f"H{k:02d}", None) for k in range(6))]
SALT = "testbed-salt"
AS_OF = "2026-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hospital(key):  # noqa: ANN001, ANN202
    return F.concat(F.lit("H"), F.lpad((key % 25).cast("string"), 2, "0"))


def hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(_hospital(F.col("n_nationkey")).alias("hospital_id"), F.col("n_name").alias("hospital_name"), F.col("r_name").alias("region"), (F.col("n_nationkey") % 15 + 18).cast("int").alias("bed_capacity"))


def users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(USERS, "user_name string, role string, hospital_id string, region string")


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    kind = F.when(F.col("o_orderstatus") == "F", "Inpatient").when(F.col("o_orderstatus") == "O", "Outpatient").otherwise("Emergency")
    rows = table(spark, sf_dir, "orders").select(k.alias("encounter_id"), F.col("o_custkey").alias("patient_id"), _hospital(k).alias("hospital_id"), kind.alias("encounter_type"), day.alias("admit_date"), F.when(k % 11 != 0, F.date_add(day, (k % 8).cast("int"))).alias("discharge_date"))
    return rows.withColumn("length_of_stay_days", F.date_diff("discharge_date", "admit_date"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by (l_orderkey, l_linenumber), which repeats: claims as they are delivered."""
    return table(spark, sf_dir, "lineitem").withColumn("claim_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))


def as_claims(df: DataFrame) -> DataFrame:
    payer = F.element_at(F.array(*map(F.lit, PAYERS)), (F.col("l_suppkey") % 6 + 1).cast("int"))
    status = F.when(F.col("l_returnflag") == "A", "Approved").when(F.col("l_returnflag") == "R", "Rejected").otherwise("Pending")
    return df.select("claim_id", F.col("l_orderkey").alias("encounter_id"), payer.alias("insurer"), F.col("l_extendedprice").alias("claim_amount"), F.when(F.col("l_returnflag") == "A", half_even(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2)).alias("approved_amount"), status.alias("claim_status"), F.col("l_shipdate").cast("date").alias("claim_date"))


def labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("value").between(10, 60), "normal").otherwise("abnormal")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("lab_result_id"), F.col("event_id").alias("encounter_id"), F.upper("event_type").alias("test_name"), "value", flag.alias("lab_flag"), F.col("ts").cast("date").alias("result_date"))


#: The same tables for the oracles.
SQL = {
    "hosp": "SELECT concat('H', lpad(cast(n_nationkey AS VARCHAR), 2, '0')) AS hospital_id, n_name AS hospital_name, r_name AS region, 18 + n_nationkey % 15 AS bed_capacity FROM nation JOIN region ON n_regionkey = r_regionkey",
    "enc": """SELECT *, date_diff('day', admit_date, discharge_date) AS length_of_stay_days FROM (SELECT o_orderkey AS encounter_id, o_custkey AS patient_id, concat('H', lpad(cast(o_orderkey % 25 AS VARCHAR), 2, '0')) AS hospital_id,
        CASE o_orderstatus WHEN 'F' THEN 'Inpatient' WHEN 'O' THEN 'Outpatient' ELSE 'Emergency' END AS encounter_type, cast(o_orderdate AS DATE) AS admit_date,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(o_orderdate AS DATE) + cast(o_orderkey % 8 AS INT) END AS discharge_date FROM orders)""",
    "line": "SELECT *, concat(l_orderkey, '-', l_linenumber) AS claim_id FROM lineitem",
    "line1": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS rn FROM line) WHERE rn = 1",
    "clm": """SELECT claim_id, l_orderkey AS encounter_id, CASE l_suppkey % 6 WHEN 0 THEN 'Star Health' WHEN 1 THEN 'ICICI Lombard' WHEN 2 THEN 'HDFC ERGO' WHEN 3 THEN 'Bajaj Allianz' WHEN 4 THEN 'Care Health' ELSE 'Niva Bupa' END AS insurer,
        l_extendedprice AS claim_amount, CASE WHEN l_returnflag = 'A' THEN round_even(l_extendedprice * (1 - l_discount) * 100, 0) / 100 END AS approved_amount, CASE l_returnflag WHEN 'A' THEN 'Approved' WHEN 'R' THEN 'Rejected' ELSE 'Pending' END AS claim_status, cast(l_shipdate AS DATE) AS claim_date FROM line1""",
    "lab": "SELECT event_id AS lab_result_id, event_id AS encounter_id, upper(event_type) AS test_name, value, CASE WHEN value BETWEEN 10 AND 60 THEN 'normal' ELSE 'abnormal' END AS lab_flag, cast(ts AS DATE) AS result_date FROM events",
    "usr": " UNION ALL ".join("SELECT {} AS user_name, {} AS role, {} AS hospital_id, {} AS region".format(*("CAST(NULL AS VARCHAR)" if x is None else f"'{x}'" for x in row)) for row in USERS),
    "pat": f"""SELECT sha256(concat('{SALT}', c_custkey)) AS patient_id, cast(c_custkey AS VARCHAR) AS original_patient_id, c_name AS full_name, concat('H', lpad(cast(c_custkey % 25 AS VARCHAR), 2, '0')) AS primary_hospital_id,
        concat('+91-', lpad(cast(c_custkey * 7919 % 10000000000 AS VARCHAR), 10, '0')) AS phone, concat(lower(c_mktsegment), c_custkey, '@example.com') AS email, lpad(cast(c_custkey * 104729 AS VARCHAR), 12, '0') AS national_id,
        date '1940-01-01' + cast(c_custkey * 37 % 30000 AS INT) AS birth, c_mktsegment AS city FROM customer""",
}
_NEEDS = {"line1": ["line"], "clm": ["line", "line1"]}


def with_tables(*names: str, body: str) -> str:
    """A query over some of the tables above."""
    order = [n for n in SQL if n in {m for name in names for m in [name, *_NEEDS.get(name, [])]}]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + body


def patients_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as clear patient rows."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("original_patient_id"), F.col("c_name").alias("full_name"), _hospital(k).alias("primary_hospital_id"), F.concat(F.lit("+91-"), F.lpad((k * 7919 % 10_000_000_000).cast("string"), 10, "0")).alias("phone"),
        F.concat(F.lower("c_mktsegment"), k.cast("string"), F.lit("@example.com")).alias("email"), F.lpad((k * 104_729).cast("string"), 12, "0").alias("national_id"),
        F.date_add(F.lit("1940-01-01").cast("date"), (k * 37 % 30_000).cast("int")).alias("birth"), F.col("c_mktsegment").alias("city"),
    )
