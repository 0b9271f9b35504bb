"""The four marts, each one declarative plan over silver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.functions.scalars import half_even, insurer, month, parse_date, title_case, trimmed

#: Wide enough for sums; what is beyond it, or no number, counts as no amount.
MONEY = "decimal(28,2)"
DEFAULT_CAPACITY = 30


def _day(df: DataFrame, column: str) -> Column:
    return F.col(column) if dict(df.dtypes).get(column) == "date" else parse_date(F.col(column))


def money_sum(c: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.coalesce(F.try_sum(c.try_cast(MONEY)).cast("double"), F.lit(0.0))


def daily_admissions(encounters: DataFrame, hospitals: DataFrame | None = None) -> DataFrame:
    """Admissions, discharges, stay and occupancy by hospital and day of admission.

    Of inpatient encounters, or of all if there are none. Days with discharges only are left out.
    """
    rows = encounters.withColumns({"admit_date": _day(encounters, "admit_date"), "discharge_date": _day(encounters, "discharge_date")}).where("hospital_id is not null and admit_date is not null")
    if "length_of_stay_days" not in encounters.columns:
        rows = rows.withColumn("length_of_stay_days", F.greatest(F.date_diff("discharge_date", "admit_date"), F.lit(1)))
    rows = rows.select("hospital_id", "patient_id", "encounter_id", "admit_date", "discharge_date", "length_of_stay_days", *(["encounter_type"] if "encounter_type" in encounters.columns else []))
    if "encounter_type" in encounters.columns:
        inpatient = title_case(trimmed(F.col("encounter_type"))) == "Inpatient"
        some = rows.agg((F.count_if(inpatient) > 0).alias("__some"))
        rows = rows.crossJoin(F.broadcast(some)).where(inpatient | ~F.col("__some"))
    admitted = rows.groupBy("hospital_id", F.col("admit_date").alias("date")).agg(
        F.count("encounter_id").alias("admissions"), F.count_distinct("patient_id").alias("unique_patients"),
        F.coalesce(half_even(F.sum("length_of_stay_days").cast("double") / F.count("length_of_stay_days"), 2), F.lit(1.0)).alias("avg_length_of_stay"),
    )
    left = rows.where("discharge_date is not null").groupBy("hospital_id", F.col("discharge_date").alias("date")).agg(F.count("encounter_id").alias("discharges"))
    out = admitted.join(left, ["hospital_id", "date"], "left")
    if hospitals is None:
        out = out.withColumn("bed_capacity", F.lit(DEFAULT_CAPACITY))
    else:
        out = out.join(hospitals.select("hospital_id", "bed_capacity"), "hospital_id", "left").withColumn("bed_capacity", F.coalesce("bed_capacity", F.lit(DEFAULT_CAPACITY)).cast("int"))
    stay = F.least(F.greatest(F.col("avg_length_of_stay"), F.lit(1.0)), F.lit(5.0))
    present = F.least(F.rint(F.col("admissions") * stay).cast("long"), (F.col("bed_capacity") * F.lit(1.2)).cast("long"))
    out = out.withColumn("inpatients_in_house", present)
    return out.select(
        "hospital_id", F.date_format("date", "yyyy-MM-dd").alias("date"), F.date_format("date", "yyyy-MM-dd").alias("admission_date"), "admissions", F.coalesce("discharges", F.lit(0)).cast("long").alias("discharges"),
        "avg_length_of_stay", "inpatients_in_house", half_even(F.col("inpatients_in_house") / F.col("bed_capacity") * 100.0, 2).alias("occupancy_pct"), "bed_capacity", "unique_patients",
    )


def _readmitted(rows: DataFrame, days: int) -> DataFrame:
    """encounter_id of stays whose patient is admitted again 0 to days after the discharge.

    Admissions and discharges become points on one line for each patient; a range window counts the admissions
    that follow a discharge, less the stay's own. Linear in a patient's stays, where a self-join is quadratic.
    Stays without a patient are never readmissions, and each is a line of its own.
    """
    day = lambda c: F.date_diff(F.col(c), F.lit("1970-01-01").cast("date"))
    admit, leave = day("admit_date"), day("discharge_date")
    points = F.explode(
        F.array(
            F.struct(admit.alias("t"), F.lit(1).alias("n"), F.lit(0).alias("own"), F.lit(False).alias("leaves")),
            F.struct(leave.alias("t"), F.lit(0).alias("n"), (admit - leave).between(0, days).cast("int").alias("own"), F.lit(True).alias("leaves")),
        )
    )
    ahead = Window.partitionBy("patient_id", F.when(F.col("patient_id").isNull(), F.col("encounter_id"))).orderBy("t").rangeBetween(0, days)
    line = rows.select("patient_id", "encounter_id", "hospital_id", "discharge_date", points.alias("p")).select("*", "p.*")
    return line.withColumn("after", F.sum("n").over(ahead)).where("leaves").withColumn("again", F.col("patient_id").isNotNull() & (F.col("after") > F.col("own")))


def readmission(encounters: DataFrame, days: int = 30, method: str = "window") -> DataFrame:
    """Share of discharges, by hospital and month, that a further admission of the patient follows within days."""
    rows = encounters.select("encounter_id", "patient_id", "hospital_id", _day(encounters, "admit_date").alias("admit_date"), _day(encounters, "discharge_date").alias("discharge_date"))
    rows = rows.where("hospital_id is not null and admit_date is not null and discharge_date is not null")
    if method == "window":
        flagged = _readmitted(rows, days)
    else:
        later = rows.select(F.col("encounter_id").alias("e2"), F.col("patient_id").alias("p2"), F.col("admit_date").alias("a2"))
        meets = (F.col("patient_id") == F.col("p2")) & (F.col("encounter_id") != F.col("e2")) & F.col("a2").between(F.col("discharge_date"), F.date_add("discharge_date", days))
        again = rows.join(later, meets, "left_semi").withColumn("again", F.lit(True))
        flagged = again.unionByName(rows.join(later, meets, "left_anti").withColumn("again", F.lit(False)))
    out = flagged.groupBy("hospital_id", month(F.col("discharge_date")).alias("discharge_month")).agg(F.count("encounter_id").alias("index_discharges"), F.count_if("again").alias("readmissions_30d"))
    out = out.withColumn("readmission_rate", half_even(F.col("readmissions_30d") / F.col("index_discharges"), 4))
    return out.select("hospital_id", "discharge_month", "index_discharges", F.col("index_discharges").alias("discharges"), "readmissions_30d", "readmission_rate", half_even(F.col("readmission_rate") * 100.0, 2).alias("readmission_rate_pct"))


def claims_summary(claims: DataFrame, encounters: DataFrame) -> DataFrame:
    """Counts and amounts of claims by hospital, insurer and month."""
    payer = insurer(F.col("insurer")) if "insurer" in claims.columns else F.lit("UNKNOWN")
    rows = claims.select("encounter_id", payer.alias("insurer"), "claim_amount", "approved_amount", "claim_status", month(_day(claims, "claim_date")).alias("claim_month"))
    rows = rows.join(encounters.select("encounter_id", "hospital_id").distinct(), "encounter_id").where("claim_month is not null and hospital_id is not null")
    status = F.col("claim_status")
    out = rows.groupBy("hospital_id", "insurer", "claim_month").agg(
        F.count(F.lit(1)).alias("claims_count"), money_sum(F.col("claim_amount")).alias("total_claimed"), money_sum(F.when(status == "Approved", F.col("approved_amount"))).alias("total_approved"),
        F.count("claim_amount").alias("priced"), F.count_if(status == "Rejected").alias("rejected_count"), F.count_if(status == "Pending").alias("pending_count"), F.count_if(status == "Approved").alias("approved_claims"),
    )
    return out.select(
        "hospital_id", "insurer", "claim_month", "claims_count", F.col("claims_count").alias("total_claims"), "total_claimed", F.col("total_claimed").alias("total_claim_amount"),
        "total_approved", F.col("total_approved").alias("approved_amount"), half_even(F.try_divide(F.col("total_claimed"), F.col("priced")), 2).alias("avg_claim_amount"),
        "rejected_count", F.col("rejected_count").alias("rejected_claims"), "pending_count", F.col("pending_count").alias("pending_claims"), "approved_claims",
        half_even(F.col("rejected_count") / F.col("claims_count") * 100.0, 2).alias("rejection_rate_pct"),
    )


def lab_abnormality(labs: DataFrame, encounters: DataFrame) -> DataFrame:
    """Share of abnormal results by hospital, test and month; results without a date count for 2026-01."""
    test, code = ("test_name" if "test_name" in labs.columns else "test_code"), ("test_code" if "test_code" in labs.columns else "test_name")
    when = F.coalesce(month(_day(labs, "result_date")), F.lit("2026-01")) if "result_date" in labs.columns else F.lit("2026-01")
    rows = labs.select("lab_result_id", "encounter_id", F.col(test).alias("test_name"), F.col(code).alias("test_code"), "lab_flag", when.alias("result_month"))
    rows = rows.join(encounters.select("encounter_id", "hospital_id").distinct(), "encounter_id").where("hospital_id is not null and test_name is not null and test_code is not null")
    out = rows.groupBy("hospital_id", "test_name", "test_code", "result_month").agg(F.count("lab_result_id").alias("tests_done"), F.count_if(F.col("lab_flag") == "abnormal").alias("abnormal_count"))
    out = out.withColumn("abnormality_rate", half_even(F.try_divide(F.col("abnormal_count"), F.col("tests_done")), 4))
    return out.select(
        "hospital_id", "test_name", "test_code", "result_month", "tests_done", F.col("tests_done").alias("total_tests"), "abnormal_count", F.col("abnormal_count").alias("abnormal_tests"),
        "abnormality_rate", half_even(F.col("abnormality_rate") * 100.0, 2).alias("abnormal_pct"),
    )
