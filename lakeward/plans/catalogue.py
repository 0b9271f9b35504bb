"""Registered queries over the test tables and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions import masking, scalars
from lakeward.operators import gold, governance, profile, reports, rules, upsert
from lakeward.plans import filequeries
from lakeward.plans import testbed as tb
from lakeward.sources.storage import replace_partition, scratch
from lakeward.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None, *tables: str, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL over tables of the testbed."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _queries[key] = f
        if sql:
            _oracles[key] = tb.with_tables(*tables, body=sql) if tables else sql
        return f

    return add


# marts

DAILY = """, inp AS (SELECT * FROM enc WHERE encounter_type = 'Inpatient'),
  adm AS (SELECT hospital_id, admit_date AS d, count(encounter_id) AS admissions, count(DISTINCT patient_id) AS unique_patients, coalesce(round_even(cast(sum(length_of_stay_days) AS DOUBLE) / count(length_of_stay_days) * 100, 0) / 100, 1.0) AS los FROM inp GROUP BY 1, 2),
  dis AS (SELECT hospital_id, discharge_date AS d, count(encounter_id) AS discharges FROM inp WHERE discharge_date IS NOT NULL GROUP BY 1, 2),
  occ AS (SELECT adm.*, coalesce(discharges, 0) AS discharges, bed_capacity, least(cast(round_even(admissions * least(greatest(los, 1.0), 5.0), 0) AS BIGINT), cast(floor(bed_capacity * 1.2::DOUBLE) AS BIGINT)) AS inpatients_in_house FROM adm LEFT JOIN dis USING (hospital_id, d) LEFT JOIN hosp USING (hospital_id)),
  daily AS (SELECT hospital_id, cast(d AS VARCHAR) AS date, cast(d AS VARCHAR) AS admission_date, admissions, discharges, los AS avg_length_of_stay, inpatients_in_house, round_even(inpatients_in_house / bed_capacity * 100.0::DOUBLE * 100, 0) / 100 AS occupancy_pct, bed_capacity, unique_patients FROM occ)"""
READM = """, st AS (SELECT * FROM enc WHERE discharge_date IS NOT NULL AND admit_date IS NOT NULL),
  fl AS (SELECT *, EXISTS (SELECT 1 FROM st b WHERE b.patient_id = a.patient_id AND b.encounter_id <> a.encounter_id AND b.admit_date BETWEEN a.discharge_date AND a.discharge_date + 30) AS again FROM st a),
  readm0 AS (SELECT hospital_id, strftime(discharge_date, '%Y-%m') AS discharge_month, count(*) AS n, count(*) FILTER (again) AS r FROM fl GROUP BY 1, 2),
  readm AS (SELECT hospital_id, discharge_month, n AS index_discharges, n AS discharges, r AS readmissions_30d, round_even(r / n * 10000, 0) / 10000 AS readmission_rate, round_even(round_even(r / n * 10000, 0) / 10000 * 100.0::DOUBLE * 100, 0) / 100 AS readmission_rate_pct FROM readm0)"""
CLAIMS = """, cm0 AS (SELECT hospital_id, insurer, strftime(claim_date, '%Y-%m') AS claim_month, count(*) AS n, cast(sum(cast(claim_amount AS DECIMAL(18,2))) AS DOUBLE) AS total, coalesce(cast(sum(CASE WHEN claim_status = 'Approved' THEN cast(approved_amount AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS approved,
    count(claim_amount) AS priced, count(*) FILTER (claim_status = 'Rejected') AS rej, count(*) FILTER (claim_status = 'Pending') AS pend, count(*) FILTER (claim_status = 'Approved') AS appr FROM clm JOIN (SELECT DISTINCT encounter_id, hospital_id FROM enc) USING (encounter_id) GROUP BY 1, 2, 3),
  claims AS (SELECT hospital_id, insurer, claim_month, n AS claims_count, n AS total_claims, total AS total_claimed, total AS total_claim_amount, approved AS total_approved, approved AS approved_amount, round_even(total / priced * 100, 0) / 100 AS avg_claim_amount, rej AS rejected_count, rej AS rejected_claims,
    pend AS pending_count, pend AS pending_claims, appr AS approved_claims, round_even(rej / n * 100.0::DOUBLE * 100, 0) / 100 AS rejection_rate_pct FROM cm0)"""
LABS = """, lb0 AS (SELECT hospital_id, test_name, strftime(result_date, '%Y-%m') AS result_month, count(*) AS n, count(*) FILTER (lab_flag = 'abnormal') AS a FROM lab JOIN (SELECT DISTINCT encounter_id, hospital_id FROM enc) USING (encounter_id) GROUP BY 1, 2, 3),
  labs AS (SELECT hospital_id, test_name, test_name AS test_code, result_month, n AS tests_done, n AS total_tests, a AS abnormal_count, a AS abnormal_tests, round_even(a / n * 10000, 0) / 10000 AS abnormality_rate, round_even(round_even(a / n * 10000, 0) / 10000 * 100.0::DOUBLE * 100, 0) / 100 AS abnormal_pct FROM lb0)"""


def marted(mart: str, body: str, *tables: str) -> str:
    """SQL over a mart's tables: its common table expressions follow the testbed's."""
    order = [n for n in tb.SQL if n in {m for name in tables for m in [name, *tb._NEEDS.get(name, [])]}]
    return "WITH " + ", ".join(f"{n} AS ({tb.SQL[n]})" for n in order) + mart + " " + body


def daily(spark: SparkSession, d: str) -> DataFrame:
    return gold.daily_admissions(tb.encounters(spark, d), tb.hospitals(spark, d))


def last_line(df: DataFrame, mode: str) -> DataFrame:
    """The last delivery of each line; further columns decide between equal dates."""
    return upsert.dedupe(df, "claim_id", F.col("l_shipdate"), [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")], mode)


def claims(spark: SparkSession, d: str) -> DataFrame:
    return tb.as_claims(last_line(tb.lines(spark, d), "row"))


def claims_mart(spark: SparkSession, d: str) -> DataFrame:
    return gold.claims_summary(claims(spark, d), tb.encounters(spark, d))


def labs_mart(spark: SparkSession, d: str) -> DataFrame:
    return gold.lab_abnormality(tb.labs(spark, d), tb.encounters(spark, d))


def register(name: str, f: Query, sql: str | None = None) -> None:
    _queries[name] = f
    if sql:
        _oracles[name] = sql


register("g_daily_admissions", daily, marted(DAILY, "SELECT * FROM daily", "enc", "hosp"))
register("g_readmission_30d", lambda s, d: gold.readmission(tb.encounters(s, d)), marted(READM, "SELECT * FROM readm", "enc"))
register("g_readmission_30d_join", lambda s, d: gold.readmission(tb.encounters(s, d), method="join"), marted(READM, "SELECT * FROM readm", "enc"))
register("g_claims_summary", claims_mart, marted(CLAIMS, "SELECT * FROM claims", "enc", "clm"))
register("g_lab_abnormality", labs_mart, marted(LABS, "SELECT * FROM labs", "enc", "lab"))

# silver: deduplication, watermark, upsert, validation



@query("SELECT claim_id, l_partkey, l_suppkey, l_quantity, l_extendedprice, cast(l_shipdate AS DATE) AS shipped FROM line1", "line1")
def s_claims_dedupe_row(spark: SparkSession, d: str) -> DataFrame:
    return last_line(tb.lines(spark, d), "row").select("claim_id", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.col("l_shipdate").cast("date").alias("shipped"))


GAPS = "SELECT claim_id, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, CASE WHEN l_partkey % 3 <> 0 THEN l_returnflag END AS flag, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity END AS quantity FROM line"


@query(
    f""", gaps AS ({GAPS}), w AS (SELECT claim_id, last_value(flag IGNORE NULLS) OVER o AS flag, last_value(quantity IGNORE NULLS) OVER o AS quantity, last_value(l_partkey) OVER o AS l_partkey, row_number() OVER (PARTITION BY claim_id) AS n
    FROM gaps WINDOW o AS (PARTITION BY claim_id ORDER BY l_shipdate ASC NULLS LAST, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT claim_id, flag, quantity, l_partkey FROM w WHERE n = 1""",
    "line",
)
def s_claims_dedupe_coalesce(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.lines(spark, d).withColumns({"flag": F.when(F.col("l_partkey") % 3 != 0, F.col("l_returnflag")), "quantity": F.when(F.col("l_suppkey") % 2 == 0, F.col("l_quantity"))})
    return last_line(rows, "coalesce").select("claim_id", "flag", "quantity", "l_partkey")


def _batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = tb.lines(spark, d).select("claim_id", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    early = F.col("l_shipdate") < "1999-01-01"
    one = last_line(rows.where(early), "row")
    two = last_line(rows.where(~early | (F.col("l_orderkey") % 10 == 0)), "row")
    return one, two


UPSERT = """, r0 AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS n FROM line WHERE l_shipdate < '1999-01-01'),
  r1 AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS n FROM line WHERE l_shipdate >= '1999-01-01' OR l_orderkey % 10 = 0),
  b0 AS (SELECT * FROM r0 WHERE n = 1), b1 AS (SELECT * FROM r1 WHERE n = 1), fresh AS (SELECT b1.* FROM b1 LEFT JOIN b0 USING (claim_id) WHERE b0.l_shipdate IS NULL OR b1.l_shipdate > b0.l_shipdate)"""


@query(UPSERT + " SELECT claim_id, l_partkey, l_extendedprice, cast(l_shipdate AS DATE) AS shipped FROM fresh UNION ALL SELECT claim_id, l_partkey, l_extendedprice, cast(l_shipdate AS DATE) FROM b0 WHERE claim_id NOT IN (SELECT claim_id FROM fresh)", "line")
def s_watermark_upsert(spark: SparkSession, d: str) -> DataFrame:
    one, two = _batches(spark, d)
    fresh = upsert.newer(two, one, "claim_id", "claim_id", "l_shipdate").where("is_newer").drop("is_newer")
    return upsert.upsert(one, fresh, "claim_id").select("claim_id", "l_partkey", "l_extendedprice", F.col("l_shipdate").cast("date").alias("shipped"))


@query(UPSERT + " SELECT claim_id, l_suppkey, l_quantity FROM fresh UNION ALL SELECT claim_id, l_suppkey, l_quantity FROM b0 WHERE claim_id NOT IN (SELECT claim_id FROM fresh)", "line")
def s_merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    one, two = _batches(spark, d)
    return upsert.merge_upsert(one, two, "claim_id", "l_shipdate").select("claim_id", "l_suppkey", "l_quantity")


FAULTS = """, f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN '  ' ELSE cast(o_orderkey AS VARCHAR) END AS key, CASE WHEN o_orderkey % 103 = 0 THEN 'not a date' ELSE cast(cast(o_orderdate AS DATE) AS VARCHAR) END AS day, CASE WHEN o_orderkey % 97 = 0 THEN 'H99' ELSE concat('H', lpad(cast(o_orderkey % 25 AS VARCHAR), 2, '0')) END AS hospital,
    o_custkey % 89 = 0 AS lost FROM orders),
  c AS (SELECT *, CASE WHEN trim(key) = '' THEN 'NULL_BUSINESS_KEY' WHEN day = 'not a date' THEN 'BAD_DATE_FORMAT' WHEN hospital = 'H99' OR lost THEN 'ORPHAN_FK' END AS reason FROM f)"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = tb.table(spark, d, "orders").select(
        k, F.when(k % 101 == 0, "  ").otherwise(k.cast("string")).alias("encounter_id"), F.when(k % 103 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("admit_date"),
        F.when(k % 97 == 0, "H99").otherwise(F.concat(F.lit("H"), F.lpad((k % 25).cast("string"), 2, "0"))).alias("hospital_id"), F.col("o_custkey").cast("string").alias("patient_id"),
    )
    known = tb.table(spark, d, "customer").where("c_custkey % 89 <> 0").select(F.col("c_custkey").cast("string").alias("patient_id"))
    references = (rules.Reference("hospital_id", tb.hospitals(spark, d).select("hospital_id")), rules.Reference("patient_id", known))
    return rules.classify(rows, "encounter_id", ("admit_date",), (), references)


@query(FAULTS + " SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY 1", "hosp")
def s_quarantine_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).where("reject_reason is not null").groupBy(F.col("reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(FAULTS + " SELECT o_orderkey, trim(key) AS business_key, reason FROM c WHERE reason IS NOT NULL", "hosp")
def s_quarantine_keys(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).where("reject_reason is not null").select("o_orderkey", F.coalesce(scalars.filled(F.col("encounter_id")), F.lit("")).alias("business_key"), F.col("reject_reason").alias("reason"))


@query(
    FAULTS.replace("o_custkey % 89 = 0 AS lost", "o_custkey % 89 = 0 AS lost, cast(o_custkey AS VARCHAR) AS patient")
    + """, j AS (SELECT trim(key) AS business_key, reason, cast(json_object('encounter_id', key, 'admit_date', day, 'hospital_id', hospital, 'patient_id', patient) AS VARCHAR) AS record_payload FROM c WHERE reason IS NOT NULL)
    SELECT sha256(concat_ws(chr(31), 'encounters', business_key, reason, 'batch_0', record_payload)) AS quarantine_id, 'encounters' AS entity, business_key, reason, 'batch_0' AS batch_id, record_payload, '2026-01-01T00:00:00Z' AS quarantine_timestamp FROM j""",
    "hosp",
)
def s_quarantine_payload(spark: SparkSession, d: str) -> DataFrame:
    rejected = _classified(spark, d).where("reject_reason is not null")
    return rules.quarantine_records(rejected, "encounters", "encounter_id", "batch_0", ["encounter_id", "admit_date", "hospital_id", "patient_id"], "2026-01-01T00:00:00Z")


@query(UPSERT + " SELECT (SELECT count(*) FROM r1) AS bronze, (SELECT count(*) FROM fresh) AS loaded, (SELECT count(*) FROM r1 WHERE n > 1) AS duplicates, (SELECT count(*) FROM b1 WHERE claim_id NOT IN (SELECT claim_id FROM fresh)) AS older", "line")
def s_disposition_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered row by its own outcome: loaded, an earlier row of its key, or not newer than what is held."""
    one, _ = _batches(spark, d)
    rows = tb.lines(spark, d).where((F.col("l_shipdate") >= "1999-01-01") | (F.col("l_orderkey") % 10 == 0))
    ties = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")]
    marked = upsert.newer(upsert.ranked(rows, "claim_id", F.col("l_shipdate"), ties, "row"), one, "claim_id", "claim_id", "l_shipdate")
    return marked.agg(F.count(F.lit(1)).alias("bronze"), F.count_if(F.col("is_last") & F.col("is_newer")).alias("loaded"), F.count_if(~F.col("is_last")).alias("duplicates"), F.count_if(F.col("is_last") & ~F.col("is_newer")).alias("older"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 97 <> 0)")
def s_fk_anti(spark: SparkSession, d: str) -> DataFrame:
    return tb.table(spark, d, "orders").join(tb.table(spark, d, "customer").where("c_custkey % 97 <> 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def s_fk_semi(spark: SparkSession, d: str) -> DataFrame:
    return tb.table(spark, d, "events").join(tb.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("user_id") == F.col("c_custkey"), "left_semi").select("event_id")


# scalar functions


@query("SELECT o_orderkey, cast(o_orderdate AS DATE) AS parsed FROM orders")
def f_parse_dates(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    forms = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MMM-yyyy", "dd-MMMM-yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy")
    text = F.coalesce(*(F.when(k % 7 == n, F.date_format(day, f)) for n, f in enumerate(forms)))
    return tb.table(spark, d, "orders").select("o_orderkey", scalars.parse_date(F.concat(F.lit(" "), text)).alias("parsed"))


NOISY = "concat('  ', CASE c_custkey % 3 WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN lower(c_mktsegment) ELSE c_mktsegment END, '   o''', lower(c_mktsegment), '-', c_custkey % 5, 'x ')"


@query(rf"SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(lower(trim(regexp_replace({NOISY}, '\s+', ' ', 'g'))), '[a-z]+|[^a-z]+'), lambda x: concat(upper(substr(x, 1, 1)), substr(x, 2))), '') AS name FROM customer")
def f_clean_name(spark: SparkSession, d: str) -> DataFrame:
    return tb.table(spark, d, "customer").select("c_custkey", scalars.clean_name(F.expr(NOISY.replace("''", "\\'"))).alias("name"))


@query("SELECT c_custkey, nullif(regexp_replace(CASE WHEN c_custkey % 7 = 0 THEN 'none' ELSE concat('+91 (', c_custkey % 1000, ') ', c_custkey * 7919) END, '[^0-9]', '', 'g'), '') AS phone FROM customer")
def f_clean_phone(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 7 == 0, "none").otherwise(F.concat(F.lit("+91 ("), (k % 1000).cast("string"), F.lit(") "), (k * 7919).cast("string")))
    return tb.table(spark, d, "customer").select("c_custkey", scalars.clean_phone(text).alias("phone"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('user', c_custkey, '@mail.example') WHEN 1 THEN concat('a.b+c@d-', c_custkey % 10, '.co.in') END AS email FROM customer")
def f_clean_email(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit(" USER"), k.cast("string"), F.lit("@Mail.example "))).when(k % 4 == 1, F.concat(F.lit("A.b+c@d-"), (k % 10).cast("string"), F.lit(".co.in"))).when(k % 4 == 2, "no at sign").otherwise("two words@x.y")
    return tb.table(spark, d, "customer").select("c_custkey", scalars.clean_email(text).alias("email"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'O' WHEN 3 THEN 'M' ELSE 'U' END AS gender FROM customer")
def f_gender(spark: SparkSession, d: str) -> DataFrame:
    forms = F.element_at(F.array(*(F.lit(x) for x in (" male", "FEMALE ", "Other", "m", "unknown", None))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return tb.table(spark, d, "customer").select("c_custkey", scalars.clean_gender(forms).alias("gender"))


@query(f""", a AS (SELECT original_patient_id, cast(date_diff('year', birth, date '{tb.AS_OF}') - CASE WHEN strftime(date '{tb.AS_OF}', '%m%d') < strftime(birth, '%m%d') THEN 1 ELSE 0 END AS INT) AS age FROM pat)
    SELECT original_patient_id, greatest(age, 0) AS age, concat(greatest(age, 0) // 10 * 10, '-', greatest(age, 0) // 10 * 10 + 9) AS age_band FROM a""", "pat")  # fmt: skip
def f_age_band(spark: SparkSession, d: str) -> DataFrame:
    years = scalars.age(F.col("birth"), F.lit(tb.AS_OF).cast("date"))
    return tb.patients_raw(spark, d).select("original_patient_id", years.alias("age"), scalars.age_band(years).alias("age_band"))


@query("SELECT encounter_id, cast(length_of_stay_days AS INT) AS days FROM enc", "enc")
def f_length_of_stay(spark: SparkSession, d: str) -> DataFrame:
    return tb.encounters(spark, d).select("encounter_id", scalars.length_of_stay(F.col("admit_date"), F.col("discharge_date")).alias("days"))


@query("""SELECT event_id, CASE WHEN event_id % 13 = 0 OR value IS NULL THEN 'abnormal' WHEN event_id % 5 = 0 THEN 'normal' WHEN value BETWEEN 10 AND 60 THEN 'normal' ELSE 'abnormal' END AS flag FROM events""")
def f_lab_flag(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 13 == 0, "pending").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return tb.table(spark, d, "events").select("event_id", scalars.lab_flag(text, F.when(k % 5 != 0, F.lit(10.0)), F.lit(60.0)).alias("flag"))


@query("SELECT claim_id, l_partkey, CASE l_partkey % 5 WHEN 0 THEN 'Approved' WHEN 1 THEN 'Rejected' WHEN 2 THEN 'Pending' WHEN 3 THEN 'On Hold' ELSE 'Pending' END AS status FROM line1", "line1")
def f_claim_status(spark: SparkSession, d: str) -> DataFrame:
    forms = F.element_at(F.array(*(F.lit(x) for x in (" approved ", "REJECTED (2)", "pend.", "on hold", None))), (F.col("l_partkey") % 5 + 1).cast("int"))
    return last_line(tb.lines(spark, d), "row").select("claim_id", "l_partkey", scalars.claim_status(forms).alias("status"))


@query("SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'Star Health' WHEN 1 THEN 'ICICI Lombard' WHEN 2 THEN 'HDFC ERGO' WHEN 3 THEN 'Bajaj Allianz' WHEN 4 THEN 'Care Health' WHEN 5 THEN 'Niva Bupa' WHEN 6 THEN 'Acme Mutual' ELSE 'Unknown' END AS insurer FROM supplier")
def f_insurer(spark: SparkSession, d: str) -> DataFrame:
    forms = ("STAR  HEALTH ", "icici_lombard", "hdfc-ergo insurance", "Bajaj", "care health", "max_bupa", "acme mutual", "  ")
    return tb.table(spark, d, "supplier").select("s_suppkey", scalars.insurer(F.element_at(F.array(*map(F.lit, forms)), (F.col("s_suppkey") % 8 + 1).cast("int"))).alias("insurer"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'UNKNOWN' ELSE concat(upper(event_type), ' TEST') END AS test_name FROM events")
def f_test_name(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("  "), F.col("event_type"), F.lit("  \t test ")))
    return tb.table(spark, d, "events").select("event_id", scalars.test_name(text).alias("test_name"))


MASKED = f"""SELECT original_patient_id, concat(upper(substr(full_name, 1, 1)), '***') AS full_name, concat('******', right(phone, 4)) AS phone, concat(substr(email, 1, 1), '***', substr(email, instr(email, '@'))) AS email, concat(repeat('*', length(national_id) - 4), right(national_id, 4)) AS national_id,
    concat((date_diff('year', birth, date '{tb.AS_OF}') - CASE WHEN strftime(date '{tb.AS_OF}', '%m%d') < strftime(birth, '%m%d') THEN 1 ELSE 0 END) // 10 * 10, '-', (date_diff('year', birth, date '{tb.AS_OF}') - CASE WHEN strftime(date '{tb.AS_OF}', '%m%d') < strftime(birth, '%m%d') THEN 1 ELSE 0 END) // 10 * 10 + 9) AS age_band FROM pat"""


@query(MASKED, "pat")
def f_mask_all(spark: SparkSession, d: str) -> DataFrame:
    return tb.patients_raw(spark, d).select(
        "original_patient_id", masking.mask_full_name(F.col("full_name")).alias("full_name"), masking.mask_phone(F.col("phone")).alias("phone"), masking.mask_email(F.col("email")).alias("email"),
        masking.mask_national_id(F.col("national_id")).alias("national_id"), masking.mask_date_of_birth(F.col("birth"), F.lit(tb.AS_OF).cast("date")).alias("age_band"),
    )


@query("SELECT original_patient_id, patient_id AS token FROM pat", "pat")
def f_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return masking.with_token(tb.patients_raw(spark, d), "original_patient_id", tb.SALT, "token").select("original_patient_id", "token")


@query(f"""SELECT original_patient_id, concat(upper(substr(full_name, 1, 1)), '***') AS full_name, concat('******', right(phone, 4)) AS phone, concat(substr(email, 1, 1), '***', substr(email, instr(email, '@'))) AS email, concat('********', right(national_id, 4)) AS national_id,
    concat(cast(floor(date_diff('day', birth, date '{tb.AS_OF}') / 365.25 / 10) * 10 AS INT), '-', cast(floor(date_diff('day', birth, date '{tb.AS_OF}') / 365.25 / 10) * 10 + 9 AS INT)) AS age_band, patient_id FROM pat""", "pat")  # fmt: skip
def f_policy_masks(spark: SparkSession, d: str) -> DataFrame:
    masking.register_policies(spark, as_of=f"date'{tb.AS_OF}'")
    return tb.patients_raw(spark, d).selectExpr("original_patient_id", "policy_full_name(full_name) AS full_name", "policy_phone(phone) AS phone", "policy_email(email) AS email", "policy_national_id(national_id) AS national_id", "policy_dob(cast(birth AS STRING)) AS age_band", f"policy_patient_id(original_patient_id, '{tb.SALT}') AS patient_id")


# secure views


def _silver_patients(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Masked patients and their vault; every seventh patient is not in the vault."""
    rows = masking.with_token(tb.patients_raw(spark, d), "original_patient_id", tb.SALT, "patient_id")
    years = scalars.age(F.col("birth"), F.lit(tb.AS_OF).cast("date"))
    masked = rows.select(
        "patient_id", "original_patient_id", masking.mask_full_name(F.col("full_name")).alias("full_name"), F.lit("U").alias("gender"), scalars.age_band(years).alias("age_band"), years.alias("patient_age"),
        masking.mask_phone(F.col("phone")).alias("phone"), masking.mask_email(F.col("email")).alias("email"), masking.mask_national_id(F.col("national_id")).alias("national_id"), "city", "primary_hospital_id", F.lit("2026-01-01 00:00:00").alias("last_updated"),
    )
    vault = rows.where("cast(original_patient_id as long) % 7 <> 0").select("original_patient_id", "full_name", "phone", "email", "national_id", F.date_format("birth", "yyyy-MM-dd").alias("date_of_birth"))
    return masked, vault


def _patients_sql(user: str) -> str:
    masked = MASKED.replace("SELECT original_patient_id,", "SELECT patient_id, original_patient_id, city, primary_hospital_id, birth, full_name AS f0, phone AS p0, email AS e0, national_id AS n0,").replace("AS age_band FROM pat", "AS age_band, cast(original_patient_id AS BIGINT) % 7 <> 0 AS v FROM pat")
    clear = lambda c, m: f"CASE WHEN u.role = 'COMPLIANCE_AUDITOR' AND v THEN {c} ELSE {m} END"
    return tb.with_tables("pat", "hosp", "usr", body=f""", m AS ({masked}) SELECT CASE WHEN u.role = 'COMPLIANCE_AUDITOR' THEN original_patient_id ELSE patient_id END AS patient_id, {clear('f0', 'full_name')} AS full_name, 'U' AS gender, {clear('cast(birth AS VARCHAR)', 'age_band')} AS date_of_birth_or_age_band,
        cast(date_diff('year', birth, date '{tb.AS_OF}') - CASE WHEN strftime(date '{tb.AS_OF}', '%m%d') < strftime(birth, '%m%d') THEN 1 ELSE 0 END AS INT) AS patient_age, {clear('p0', 'phone')} AS phone, {clear('e0', 'email')} AS email, {clear('n0', 'national_id')} AS national_id, city, primary_hospital_id, h.region, '2026-01-01 00:00:00' AS last_updated
        FROM m LEFT JOIN hosp h ON primary_hospital_id = h.hospital_id LEFT JOIN usr u ON u.user_name = '{user}' WHERE {ALLOWED.format('primary_hospital_id')}""")  # fmt: skip


ALLOWED = "(u.role IN ('COMPLIANCE_AUDITOR', 'DATA_ENGINEER') OR (u.role = 'REGIONAL_ANALYST' AND h.region = u.region) OR (u.role = 'HOSPITAL_MANAGER' AND {} = u.hospital_id))"


def _patients_as(user: str) -> Query:
    return lambda s, d: governance.patients_view(*_silver_patients(s, d), tb.users(s), tb.hospitals(s, d), user)


for _label, _user in (("auditor", "auditor"), ("engineer", "engineer"), ("analyst", "analyst_asia"), ("manager", "manager_h03"), ("unknown", "nobody")):
    register(f"v_patients_{_label}", _patients_as(_user), _patients_sql(_user))

ENC_COLUMNS = ["encounter_id", "patient_id", "hospital_id", "hospital_name", "region", "encounter_type", "length_of_stay_days"]


def _enc_sql(user: str) -> str:
    return tb.with_tables("enc", "hosp", "usr", body=f"SELECT encounter_id, patient_id, e.hospital_id, hospital_name, h.region, encounter_type, cast(length_of_stay_days AS INT) AS length_of_stay_days FROM enc e LEFT JOIN hosp h USING (hospital_id) LEFT JOIN usr u ON u.user_name = '{user}' WHERE {ALLOWED.format('e.hospital_id')}")


def _enc_as(user: str) -> Query:
    return lambda s, d: governance.fact_view(tb.encounters(s, d), tb.users(s), tb.hospitals(s, d), user, ENC_COLUMNS)


for _label, _user in (("auditor", "auditor"), ("analyst", "analyst_europe"), ("manager", "manager_h02"), ("unknown", "nobody")):
    register(f"v_encounters_{_label}", _enc_as(_user), _enc_sql(_user))


@query(f"SELECT lab_result_id, l.encounter_id, e.hospital_id, h.region, test_name, lab_flag FROM lab l JOIN enc e USING (encounter_id) LEFT JOIN hosp h ON e.hospital_id = h.hospital_id LEFT JOIN usr u ON u.user_name = 'analyst_asia' WHERE {ALLOWED.format('e.hospital_id')}", "lab", "enc", "hosp", "usr")
def v_labs_analyst(spark: SparkSession, d: str) -> DataFrame:
    return governance.fact_view(tb.labs(spark, d), tb.users(spark), tb.hospitals(spark, d), "analyst_asia", ["lab_result_id", "encounter_id", "hospital_id", "region", "test_name", "lab_flag"], tb.encounters(spark, d))


@query(f"SELECT claim_id, c.encounter_id, e.hospital_id, h.region, insurer, claim_amount, claim_status FROM clm c JOIN enc e USING (encounter_id) LEFT JOIN hosp h ON e.hospital_id = h.hospital_id LEFT JOIN usr u ON u.user_name = 'manager_h01' WHERE {ALLOWED.format('e.hospital_id')}", "clm", "enc", "hosp", "usr")
def v_claims_manager(spark: SparkSession, d: str) -> DataFrame:
    return governance.fact_view(claims(spark, d), tb.users(spark), tb.hospitals(spark, d), "manager_h01", ["claim_id", "encounter_id", "hospital_id", "region", "insurer", "claim_amount", "claim_status"], tb.encounters(spark, d))


def _mart_view(name: str, make: Query, user: str, columns: list[str], sql: str, source: str, *tables: str) -> None:
    shown = ", ".join(f"h.{c}" if c in ("hospital_name", "region") else f"g.{c}" for c in columns)
    register(name, lambda s, d: governance.fact_view(make(s, d), tb.users(s), tb.hospitals(s, d), user, columns), marted(sql, f"SELECT {shown} FROM {source} g LEFT JOIN hosp h ON g.hospital_id = h.hospital_id LEFT JOIN usr u ON u.user_name = '{user}' WHERE {ALLOWED.format('g.hospital_id')}", *tables, "hosp", "usr"))


_mart_view("v_gold_daily_admissions", daily, "analyst_asia", ["hospital_id", "hospital_name", "region", "admission_date", "admissions", "unique_patients"], DAILY, "daily", "enc")
_mart_view("v_gold_readmission_30d", _queries["g_readmission_30d"], "manager_h04", ["hospital_id", "hospital_name", "region", "discharge_month", "index_discharges", "readmissions_30d", "readmission_rate"], READM, "readm", "enc")
_mart_view("v_gold_claims_summary", claims_mart, "engineer", ["hospital_id", "hospital_name", "region", "insurer", "claim_month", "total_claims", "approved_claims", "rejected_claims", "pending_claims", "total_claim_amount"], CLAIMS, "claims", "enc", "clm")
_mart_view("v_gold_lab_abnormality", labs_mart, "analyst_europe", ["hospital_id", "hospital_name", "region", "test_name", "result_month", "total_tests", "abnormal_tests", "abnormality_rate"], LABS, "labs", "enc", "lab")

REACH = "(u.role IN ('COMPLIANCE_AUDITOR', 'DATA_ENGINEER') OR (u.role = 'REGIONAL_ANALYST' AND h.region = u.region) OR (u.role = 'HOSPITAL_MANAGER' AND u.hospital_id = h.hospital_id))"


@query(f""", e AS (SELECT user_name, count(*) AS n FROM usr u JOIN hosp h ON {REACH} JOIN enc ON enc.hospital_id = h.hospital_id GROUP BY 1), p AS (SELECT user_name, count(*) AS n FROM usr u JOIN hosp h ON {REACH} JOIN pat ON primary_hospital_id = h.hospital_id GROUP BY 1)
    SELECT user_name, role, coalesce(e.n, 0) AS visible_encounters, coalesce(p.n, 0) AS visible_patients FROM usr LEFT JOIN e USING (user_name) LEFT JOIN p USING (user_name)""", "usr", "hosp", "enc", "pat")  # fmt: skip
def v_role_counts(spark: SparkSession, d: str) -> DataFrame:
    return governance.role_counts(tb.encounters(spark, d), tb.patients_raw(spark, d), tb.users(spark), tb.hospitals(spark, d))


@query(f"SELECT encounter_id, e.hospital_id FROM enc e WHERE EXISTS (SELECT 1 FROM usr u JOIN hosp h ON {REACH} WHERE u.user_name = 'analyst_asia' AND h.hospital_id = e.hospital_id)", "usr", "hosp", "enc")
def v_row_filter_exists(spark: SparkSession, d: str) -> DataFrame:
    return governance.row_filter(tb.encounters(spark, d), tb.users(spark), tb.hospitals(spark, d), "analyst_asia").select("encounter_id", "hospital_id")


@query("SELECT encounter_id, e.hospital_id FROM enc e JOIN hosp h USING (hospital_id) WHERE h.region = 'EUROPE'", "hosp", "enc")
def v_literal_predicate(spark: SparkSession, d: str) -> DataFrame:
    return governance.predicate(tb.encounters(spark, d), tb.users(spark), tb.hospitals(spark, d), "analyst_europe").select("encounter_id", "hospital_id")


@query("SELECT role, hospital_id, region FROM usr WHERE user_name = 'manager_h05'", "usr")
def v_user_scope(spark: SparkSession, d: str) -> DataFrame:
    governance.register_scope(spark, tb.users(spark))
    return spark.sql("SELECT * FROM user_scope('manager_h05')")


@query("SELECT concat(upper(substr(full_name, 1, 1)), '***') AS full_name, concat('******', right(phone, 4)) AS phone, concat(substr(email, 1, 1), '***', substr(email, instr(email, '@'))) AS email, concat('********', right(national_id, 4)) AS national_id, primary_hospital_id, birth, city FROM pat", "pat")
def v_column_masks(spark: SparkSession, d: str) -> DataFrame:
    masking.register_policies(spark, as_of=f"date'{tb.AS_OF}'")
    masks = {"full_name": "policy_full_name", "phone": "policy_phone", "email": "policy_email", "national_id": "policy_national_id"}
    return governance.column_masks(tb.patients_raw(spark, d), masks, drop=("original_patient_id",))


# profile


def _metrics_sql(table: str, columns: dict[str, bool]) -> str:
    one = "SELECT '{0}' AS column_name, count(*) - count({0}) AS null_count, round_even((count(*) - count({0})) / count(*) * 100.0::DOUBLE * 100, 0) / 100 AS null_pct, count(DISTINCT {0}) AS distinct_count, "
    number = "cast(min({0}) AS DOUBLE) AS min_value, cast(max({0}) AS DOUBLE) AS max_value, round_even(cast(sum(cast({0} AS DECIMAL(28,6))) AS DOUBLE) / count({0}) * 100, 0) / 100 AS mean_value FROM "
    text = "CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, CAST(NULL AS DOUBLE) AS mean_value FROM "
    return " UNION ALL ".join((one + (number if is_number else text)).format(c) + table for c, is_number in columns.items())


@query(_metrics_sql("customer", {"c_custkey": True, "c_name": False, "c_nationkey": True, "c_acctbal": True, "c_mktsegment": False}))
def p_column_metrics(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_metrics(tb.table(spark, d, "customer"))


DIRTY = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '31/12/1999' WHEN c_custkey % 7 <> 0 THEN '1999-12-31' END AS visit_date, CASE WHEN c_custkey % 3 = 0 THEN '+91 1' ELSE '9876543210' END AS phone, CASE WHEN c_custkey % 4 = 0 THEN 'nobody' ELSE 'a@b.c' END AS email, '2026-01-01 10:00:00' AS last_updated, c_nationkey FROM customer"


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return tb.table(spark, d, "customer").select(k, F.when(k % 5 == 0, "31/12/1999").when(k % 7 != 0, "1999-12-31").alias("visit_date"), F.when(k % 3 == 0, "+91 1").otherwise("9876543210").alias("phone"), F.when(k % 4 == 0, "nobody").otherwise("a@b.c").alias("email"), F.lit("2026-01-01 10:00:00").alias("last_updated"), "c_nationkey")


VIOLATIONS = f"""WITH t AS ({DIRTY}) SELECT 'visit_date_non_iso' AS violation, count(*) FILTER (visit_date = '31/12/1999') AS n FROM t UNION ALL SELECT 'phone_format_violations', count(*) FILTER (phone = '+91 1') FROM t
    UNION ALL SELECT 'email_invalid_syntax', count(*) FILTER (email = 'nobody') FROM t UNION ALL SELECT 'last_updated_non_iso', count(*) FROM t"""


@query(VIOLATIONS)
def p_violations(spark: SparkSession, d: str) -> DataFrame:
    return profile.violations(_dirty(spark, d))


@query("SELECT count(*) AS orphans FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 31 <> 0)")
def p_orphans(spark: SparkSession, d: str) -> DataFrame:
    return profile.orphans(tb.table(spark, d, "orders"), "o_custkey", tb.table(spark, d, "customer").where("c_custkey % 31 <> 0").select("c_custkey"))


@query("SELECT count(*) - count(DISTINCT claim_id) AS duplicate_business_keys FROM line", "line")
def p_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicate_keys(tb.lines(spark, d), "claim_id")


@query(f"""WITH t AS ({DIRTY}), n AS (SELECT count(*) AS total FROM t), i AS (SELECT 1 AS k, 'Null values in column ''visit_date''' AS issue, count(*) FILTER (visit_date IS NULL) AS n, 'MEDIUM' AS severity FROM t
    UNION ALL SELECT 6, 'Duplicate business keys in ''c_nationkey''', count(*) - count(DISTINCT c_nationkey), 'HIGH' FROM t UNION ALL SELECT 7, 'Violations: visit_date_non_iso', count(*) FILTER (visit_date = '31/12/1999'), 'MEDIUM' FROM t
    UNION ALL SELECT 8, 'Violations: phone_format_violations', count(*) FILTER (phone = '+91 1'), 'LOW' FROM t UNION ALL SELECT 9, 'Violations: email_invalid_syntax', count(*) FILTER (email = 'nobody'), 'LOW' FROM t UNION ALL SELECT 10, 'Violations: last_updated_non_iso', count(*), 'MEDIUM' FROM t)
    SELECT issue, n, round_even(n / total * 100.0::DOUBLE * 100, 0) / 100 AS pct, severity FROM i, (SELECT total FROM n) WHERE n > 0 ORDER BY n DESC, k LIMIT 5""")  # fmt: skip
def p_top5_issues(spark: SparkSession, d: str) -> DataFrame:
    return profile.issues(_dirty(spark, d), "c_nationkey")


# dashboards

PCT = "round_even({0} / {1} * 100.0::DOUBLE * 100, 0) / 100"


def _named(make: Query) -> Query:
    return lambda s, d: reports.named(make(s, d), tb.hospitals(s, d))


@query(marted(DAILY + READM + CLAIMS, f"""SELECT a.*, r.*, c.* FROM (SELECT cast(sum(admissions) AS BIGINT) AS total_admissions, round_even(cast(sum(cast(occupancy_pct AS DECIMAL(18,4))) AS DOUBLE) / count(occupancy_pct) * 100, 0) / 100 AS avg_occupancy_pct FROM daily) a,
    (SELECT {PCT.format('sum(readmissions_30d)', 'sum(index_discharges)')} AS readmission_rate_pct FROM readm) r, (SELECT cast(sum(cast(total_claimed AS DECIMAL(18,2))) AS DOUBLE) AS total_claimed FROM claims) c""", "enc", "hosp", "clm"))  # fmt: skip
def d_kpis(spark: SparkSession, d: str) -> DataFrame:
    return reports.kpis(daily(spark, d), gold.readmission(tb.encounters(spark, d)), claims_mart(spark, d))


@query(marted(CLAIMS, f"SELECT cast(sum(cast(total_claimed AS DECIMAL(18,2))) AS DOUBLE) AS total_claimed, cast(sum(cast(total_approved AS DECIMAL(18,2))) AS DOUBLE) AS total_approved, {PCT.format('sum(rejected_count)', 'sum(claims_count)')} AS rejection_rate_pct FROM claims WHERE claim_month BETWEEN '1996-01' AND '1997-06'", "enc", "clm"))
def d_finance_kpis(spark: SparkSession, d: str) -> DataFrame:
    return reports.finance_kpis(reports.chosen(claims_mart(spark, d), None, "1996-01", "1997-06", "claim_month"))


@query(marted(DAILY, "SELECT hospital_name, date, occupancy_pct FROM daily JOIN hosp USING (hospital_id) WHERE date = (SELECT max(date) FROM daily)", "enc", "hosp"))
def d_latest_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return reports.latest_occupancy(_named(daily)(spark, d))


@query(marted(DAILY, "SELECT min(date) AS first, max(date) AS last FROM daily", "enc", "hosp"))
def d_date_bounds(spark: SparkSession, d: str) -> DataFrame:
    return reports.bounds(daily(spark, d))


@query(marted(DAILY, "SELECT date, hospital_name, admissions FROM daily JOIN hosp USING (hospital_id) WHERE hospital_id IN ('H01', 'H02') AND date BETWEEN '1996-01-01' AND '1996-12-31'", "enc", "hosp"))
def d_admissions_trend(spark: SparkSession, d: str) -> DataFrame:
    return reports.admissions_trend(reports.chosen(_named(daily)(spark, d), ["H01", "H02"], "1996-01-01", "1996-12-31"))


@query(marted(DAILY, "SELECT hospital_name, round_even(cast(sum(cast(avg_length_of_stay AS DECIMAL(18,4))) AS DOUBLE) / count(*) * 100, 0) / 100 AS avg_length_of_stay FROM daily JOIN hosp USING (hospital_id) GROUP BY 1", "enc", "hosp"))
def d_avg_los(spark: SparkSession, d: str) -> DataFrame:
    return reports.average_stay(_named(daily)(spark, d))


for _name, _by in (("d_readm_by_hospital", ("hospital_name",)), ("d_readm_trend", ("discharge_month", "hospital_name"))):
    register(_name, lambda s, d, by=_by: reports.readmission_rates(reports.named(gold.readmission(tb.encounters(s, d)), tb.hospitals(s, d)), *by),
        marted(READM, f"SELECT {', '.join(_by)}, cast(sum(index_discharges) AS BIGINT) AS total_index, cast(sum(readmissions_30d) AS BIGINT) AS total_readm, {PCT.format('sum(readmissions_30d)', 'sum(index_discharges)')} AS readmission_rate_pct FROM readm JOIN hosp USING (hospital_id) GROUP BY {', '.join(_by)}", "enc", "hosp"))


@query(marted(CLAIMS, "SELECT insurer, cast(sum(rejected_count) AS BIGINT) AS rejected, cast(sum(pending_count) AS BIGINT) AS pending, cast(sum(claims_count) AS BIGINT) AS total_claims, cast(greatest(sum(claims_count) - sum(rejected_count) - sum(pending_count), 0) AS BIGINT) AS approved FROM claims GROUP BY 1", "enc", "clm"))
def d_claims_by_insurer(spark: SparkSession, d: str) -> DataFrame:
    return reports.claims_by_insurer(claims_mart(spark, d))


@query(marted(CLAIMS, f"SELECT hospital_name, insurer, cast(sum(rejected_count) AS BIGINT) AS rejected, cast(sum(claims_count) AS BIGINT) AS total_claims, {PCT.format('sum(rejected_count)', 'sum(claims_count)')} AS rejection_rate_pct FROM claims JOIN hosp USING (hospital_id) GROUP BY 1, 2", "enc", "clm", "hosp"))
def d_rejection_by_hospital_insurer(spark: SparkSession, d: str) -> DataFrame:
    return reports.rejection_rates(_named(claims_mart)(spark, d))


ABNORMAL = f"cast(sum(tests_done) AS BIGINT) AS total_tests, cast(sum(abnormal_count) AS BIGINT) AS abnormal_cases, {PCT.format('sum(abnormal_count)', 'sum(tests_done)')} AS abnormal_rate_pct"


@query(marted(LABS, f"SELECT test_name, {ABNORMAL} FROM labs GROUP BY 1", "enc", "lab"))
def d_abnormal_by_test(spark: SparkSession, d: str) -> DataFrame:
    return reports.abnormal_rates(labs_mart(spark, d), "test_name")


@query(marted(LABS, f"SELECT hospital_name, test_name, {ABNORMAL} FROM labs JOIN hosp USING (hospital_id) GROUP BY 1, 2 ORDER BY abnormal_cases DESC, 1, 2 LIMIT 10", "enc", "lab", "hosp"))
def d_top10_outliers(spark: SparkSession, d: str) -> DataFrame:
    return reports.outliers(_named(labs_mart)(spark, d))


TESTS = ["VIEW", "SIGNUP", "ERROR", "CLICK", "PURCHASE"]


@query(marted(LABS, "SELECT hospital_name, " + ", ".join(f"round_even(sum(abnormal_count) FILTER (test_name = '{t}') / sum(tests_done) FILTER (test_name = '{t}') * 100.0::DOUBLE * 100, 0) / 100 AS \"{t}\"" for t in TESTS) + " FROM labs JOIN hosp USING (hospital_id) GROUP BY 1", "enc", "lab", "hosp"))
def d_lab_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return reports.heatmap(_named(labs_mart)(spark, d))


# set operations, nested values, streams


@query("SELECT l_orderkey, l_linenumber, 'a' AS batch, l_tax FROM lineitem WHERE l_shipdate < '1995-01-01' UNION ALL SELECT l_orderkey, l_linenumber, 'b', NULL FROM lineitem WHERE l_shipdate >= '1995-01-01'")
def u_union_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.table(spark, d, "lineitem")
    one = rows.where("l_shipdate < '1995-01-01'").select("l_orderkey", "l_linenumber", F.lit("a").alias("batch"), "l_tax")
    return one.unionByName(rows.where("l_shipdate >= '1995-01-01'").select("l_orderkey", "l_linenumber", F.lit("b").alias("batch")), allowMissingColumns=True)


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def u_distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return reports.distinct_values(tb.table(spark, d, "customer"), "c_mktsegment")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def e_props_json(spark: SparkSession, d: str) -> DataFrame:
    return tb.table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts IS NOT NULL GROUP BY 1")
def e_events_by_type(spark: SparkSession, d: str) -> DataFrame:
    return tb.table(spark, d, "events").where("ts is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT concat('batch_', l_orderkey % 3) AS batch_id, count(*) AS n, cast(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem WHERE l_orderkey % 3 = 1 GROUP BY 1")
def s_partition_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines written by batch; of the table only one batch's folder is read."""
    rows = tb.table(spark, d, "lineitem").select(F.concat(F.lit("batch_"), (F.col("l_orderkey") % 3).cast("string")).alias("batch_id"), "l_quantity")
    replace_partition(rows, path := scratch(spark, "batches"))
    one = spark.read.schema(rows.schema).parquet(path).where("batch_id = 'batch_1'")
    return one.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query("SELECT insurer, count(*) AS bronze, count(DISTINCT claim_id) AS silver, count(*) - count(DISTINCT claim_id) AS superseded FROM (SELECT claim_id, CASE l_suppkey % 6 WHEN 0 THEN 'Star Health' WHEN 1 THEN 'ICICI Lombard' WHEN 2 THEN 'HDFC ERGO' WHEN 3 THEN 'Bajaj Allianz' WHEN 4 THEN 'Care Health' ELSE 'Niva Bupa' END AS insurer FROM line) GROUP BY 1", "line")
def r_rows_by_layer(spark: SparkSession, d: str) -> DataFrame:
    out = tb.as_claims(tb.lines(spark, d)).groupBy("insurer").agg(F.count(F.lit(1)).alias("bronze"), F.count_distinct("claim_id").alias("silver"))
    return out.withColumn("superseded", F.col("bronze") - F.col("silver"))


@query(FAULTS + ", t AS (SELECT count(*) AS bronze, count(*) FILTER (reason IS NULL) AS silver, count(*) FILTER (reason IS NOT NULL) AS quarantined FROM c) SELECT 'encounters' AS entity, bronze, silver, quarantined, 0::BIGINT AS superseded, 0::BIGINT AS unaccounted, round_even(silver / bronze * 100.0::DOUBLE * 100, 0) / 100 AS silver_pct FROM t", "hosp")
def r_cleansing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _classified(spark, d)
    records = rules.quarantine_records(rows.where("reject_reason is not null"), "encounters", "encounter_id", "batch_0", ["encounter_id"], "t")
    return reports.cleansing_summary({"encounters": rows}, {"encounters": rows.where("reject_reason is null")}, records)


@query("SELECT cast(cast(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def st_available_now(spark: SparkSession, d: str) -> DataFrame:
    """Counts by day and kind from a stream of all files that are there; equal to the batch result."""
    events = tb.table(spark, d, "events")
    stream = incremental.read_stream(spark, f"{d}/events.parquet*", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = incremental.table_of(incremental.windowed_counts(stream.where("ts is not null")), scratch(spark, "windows"))
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def queries() -> dict[str, Query]:
    return _queries | filequeries.QUERIES


def oracle_sql() -> dict[str, str]:
    return _oracles | filequeries.ORACLES
