"""Datasets behind dashboards: filters, indicators and chart data over the marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward import schemas
from lakeward.functions.scalars import filled, half_even
from lakeward.operators.gold import money_sum
from lakeward.operators.governance import guard


def named(mart: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Adds hospital_name and region; refuses a mart with personal data."""
    return guard(mart).join(hospitals.select("hospital_id", "hospital_name", "region"), "hospital_id", "left")


def chosen(mart: DataFrame, hospitals: list[str] | None = None, first: str | None = None, last: str | None = None, by: str = "date") -> DataFrame:
    """Rows of some hospitals between two days or months; text in ISO form sorts as time does."""
    if hospitals is not None:
        mart = mart.where(F.col("hospital_id").isin(hospitals))
    return mart.where(F.col(by).between(first, last)) if first and last else mart


def bounds(mart: DataFrame, by: str = "date") -> DataFrame:
    return mart.agg(F.min(by).alias("first"), F.max(by).alias("last"))


def _pct(part: Column, whole: Column) -> Column:
    return half_even(F.try_divide(part, whole) * 100.0, 2)


def kpis(admissions: DataFrame, readmissions: DataFrame, claims: DataFrame) -> DataFrame:
    a = admissions.agg(F.coalesce(F.sum("admissions"), F.lit(0)).alias("total_admissions"), half_even(F.sum(F.col("occupancy_pct").cast("decimal(18,4)")).cast("double") / F.count("occupancy_pct"), 2).alias("avg_occupancy_pct"))
    r = readmissions.agg(_pct(F.sum("readmissions_30d"), F.sum("index_discharges")).alias("readmission_rate_pct"))
    c = claims.agg(money_sum(F.col("total_claimed")).alias("total_claimed"))
    return a.crossJoin(r).crossJoin(c)


def finance_kpis(claims: DataFrame) -> DataFrame:
    return claims.agg(money_sum(F.col("total_claimed")).alias("total_claimed"), money_sum(F.col("total_approved")).alias("total_approved"), _pct(F.sum("rejected_count"), F.sum("claims_count")).alias("rejection_rate_pct"))


def latest_occupancy(admissions: DataFrame) -> DataFrame:
    """Rows of the last day that any hospital has."""
    last = admissions.agg(F.max("date").alias("date"))
    return admissions.join(F.broadcast(last), "date", "left_semi").select("hospital_name", "date", "occupancy_pct")


def average_stay(admissions: DataFrame) -> DataFrame:
    """Mean of the daily means, each day alike."""
    return admissions.groupBy("hospital_name").agg(half_even(F.sum(F.col("avg_length_of_stay").cast("decimal(18,4)")).cast("double") / F.count("avg_length_of_stay"), 2).alias("avg_length_of_stay")).orderBy(F.desc("avg_length_of_stay"), "hospital_name")


def admissions_trend(admissions: DataFrame) -> DataFrame:
    return admissions.select("date", "hospital_name", "admissions")


def readmission_rates(readmissions: DataFrame, *by: str) -> DataFrame:
    out = readmissions.groupBy(*by).agg(F.sum("index_discharges").alias("total_index"), F.sum("readmissions_30d").alias("total_readm"))
    return out.withColumn("readmission_rate_pct", _pct(F.col("total_readm"), F.col("total_index")))


def claims_by_insurer(claims: DataFrame) -> DataFrame:
    out = claims.groupBy("insurer").agg(F.sum("rejected_count").alias("rejected"), F.sum("pending_count").alias("pending"), F.sum("claims_count").alias("total_claims"))
    return out.withColumn("approved", F.greatest(F.col("total_claims") - F.col("rejected") - F.col("pending"), F.lit(0)))


def rejection_rates(claims: DataFrame) -> DataFrame:
    out = claims.groupBy("hospital_name", "insurer").agg(F.sum("rejected_count").alias("rejected"), F.sum("claims_count").alias("total_claims"))
    return out.withColumn("rejection_rate_pct", _pct(F.col("rejected"), F.col("total_claims")))


def abnormal_rates(labs: DataFrame, *by: str) -> DataFrame:
    out = labs.groupBy(*by).agg(F.sum("tests_done").alias("total_tests"), F.sum("abnormal_count").alias("abnormal_cases"))
    return out.withColumn("abnormal_rate_pct", _pct(F.col("abnormal_cases"), F.col("total_tests")))


def heatmap(labs: DataFrame, tests: list[str] | None = None, most: int = 500) -> DataFrame:
    """A row for each hospital, a column for each test: its abnormal share in percent. More tests than ``most`` are an error."""
    if tests is None:
        tests = [r[0] for r in labs.where("test_name is not null").select("test_name").distinct().orderBy("test_name").limit(most + 1).collect()]
        if len(tests) > most:
            raise ValueError(f"more than {most} tests: name those to show")
    rate = _pct(F.sum("abnormal_count"), F.sum("tests_done"))
    return labs.groupBy("hospital_name").pivot("test_name", tests).agg(rate)


def outliers(labs: DataFrame, most: int = 10) -> DataFrame:
    return abnormal_rates(labs, "hospital_name", "test_name").orderBy(F.desc("abnormal_cases"), "hospital_name", "test_name").limit(most)


def cleansing_summary(bronze: dict[str, DataFrame], silver: dict[str, DataFrame], quarantine: DataFrame) -> DataFrame:
    """entity, bronze, silver, quarantined, superseded, unaccounted, and the share that became silver.

    Rows are counted key by key: of a key in silver all rows but one that were not quarantined are superseded;
    rows of other keys that were not quarantined are lost, and shown as unaccounted.
    """
    out = None
    for entity in bronze:
        key, silver_key = schemas.KEYS[entity], schemas.SILVER_KEYS[entity]
        at = F.coalesce(filled(F.col(key)), F.lit(""))
        read = bronze[entity].groupBy(at.alias("__key")).agg(F.count(F.lit(1)).alias("bronze"))
        bad = quarantine.where(F.col("entity") == entity).groupBy(F.col("business_key").alias("__key")).agg(F.count(F.lit(1)).alias("quarantined"))
        good = silver[entity].groupBy(F.coalesce(F.col(silver_key).cast("string"), F.lit("")).alias("__key")).agg(F.count(F.lit(1)).alias("silver"))
        one = read.join(bad, "__key", "full").join(good, "__key", "full").na.fill(0)
        left = F.col("bronze") - F.col("quarantined") - F.col("silver")
        sums = [F.sum(c).alias(c) for c in ("bronze", "silver", "quarantined")] + [F.sum(F.when(F.col("silver") > 0, left).otherwise(0)).alias("superseded"), F.sum(F.when(F.col("silver") == 0, left).otherwise(0)).alias("unaccounted")]
        one = one.agg(*sums).na.fill(0).select(F.lit(entity).alias("entity"), "bronze", "silver", "quarantined", "superseded", "unaccounted")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("silver_pct", _pct(F.col("silver"), F.col("bronze")))


def reason_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("entity", "reason").agg(F.count(F.lit(1)).alias("n")).orderBy("entity", "reason")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value")
