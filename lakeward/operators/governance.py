"""Row and column security: who sees which rows, and which values unmasked. Unknown users see nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDITOR, ENGINEER, ANALYST, MANAGER = "COMPLIANCE_AUDITOR", "DATA_ENGINEER", "REGIONAL_ANALYST", "HOSPITAL_MANAGER"
PII_NAMES = ("full_name", "phone", "email", "national_id")


def user_row(spark: SparkSession, users: DataFrame, user: str) -> DataFrame:
    """One row for the session's user; role null if unknown."""
    session = spark.createDataFrame([(user,)], "session_user string")
    known = users.where(F.col("user_name") == user).select("user_name", F.col("role").alias("__role"), F.col("hospital_id").alias("__hospital"), F.col("region").alias("__region"))
    return session.join(F.broadcast(known), F.col("session_user") == F.col("user_name"), "left").drop("session_user", "user_name")


#: A user's hospitals up to this many become a literal list that reaches the scan.
MOST_LISTED = 1000


def predicate(df: DataFrame, users: DataFrame, hospitals: DataFrame, user: str, hospital_col: str = "hospital_id") -> DataFrame:
    """Rows of df that the user may see, by a literal predicate, which reaches the scan: the user is looked up on the driver."""
    row = user_row(df.sparkSession, users, user).first()
    if row["__role"] in (AUDITOR, ENGINEER):
        return df
    if row["__role"] == MANAGER:
        return df.where(F.col(hospital_col) == row["__hospital"])
    if row["__role"] == ANALYST:
        ids = hospitals.where(F.col("region") == row["__region"]).select("hospital_id")
        listed = [r[0] for r in ids.limit(MOST_LISTED + 1).collect()]
        if len(listed) <= MOST_LISTED:
            return df.where(F.col(hospital_col).isin(listed))
        return df.join(ids.select(F.col("hospital_id").alias("__id")), F.col(hospital_col) == F.col("__id"), "left_semi")
    return df.where("false")


def secured(df: DataFrame, users: DataFrame, hospitals: DataFrame, user: str, hospital_col: str = "hospital_id") -> DataFrame:
    """Rows of df that the user may see, with hospital_name and region."""
    dimension = hospitals.select(F.col("hospital_id").alias("__id"), "hospital_name", "region")
    return predicate(df, users, hospitals, user, hospital_col).join(dimension, F.col(hospital_col) == F.col("__id"), "left").drop("__id")


def row_filter(df: DataFrame, users: DataFrame, hospitals: DataFrame, user: str, hospital_col: str = "hospital_id") -> DataFrame:
    """The row-filter function: rows for which an access entry of the user exists."""
    mine = users.where(F.col("user_name") == user).alias("u")
    reach = mine.join(hospitals.alias("h"), (F.col("u.role").isin(AUDITOR, ENGINEER)) | ((F.col("u.role") == ANALYST) & (F.col("u.region") == F.col("h.region"))) | ((F.col("u.role") == MANAGER) & (F.col("u.hospital_id") == F.col("h.hospital_id"))))
    ids = reach.select(F.col("h.hospital_id").alias("__id")).distinct()
    return df.join(ids, F.col(hospital_col) == F.col("__id"), "left_semi")


def patients_view(patients: DataFrame, vault: DataFrame, users: DataFrame, hospitals: DataFrame, user: str) -> DataFrame:
    """Patients; auditors see the vault's values, and only for them is the vault read. The natural key is in no other user's view."""
    rows = secured(patients, users, hospitals, user, "primary_hospital_id")
    clear = {"patient_id": "patient_id", "date_of_birth_or_age_band": "age_band", **{c: c for c in PII_NAMES}}
    if user_row(patients.sparkSession, users, user).first()["__role"] == AUDITOR:
        hidden = vault.select(F.col("original_patient_id").alias("__key"), *(F.col(c).alias(f"__{c}") for c in (*PII_NAMES, "date_of_birth")))
        rows = rows.join(hidden, F.col("original_patient_id") == F.col("__key"), "left")
        clear = {"patient_id": F.coalesce("__key", "original_patient_id"), "date_of_birth_or_age_band": F.coalesce("__date_of_birth", "age_band"), **{c: F.coalesce(f"__{c}", c) for c in PII_NAMES}}
    shown = lambda c: (F.col(clear[c]) if isinstance(clear[c], str) else clear[c]).alias(c)
    return rows.select(
        shown("patient_id"), shown("full_name"), "gender", shown("date_of_birth_or_age_band"), "patient_age", shown("phone"), shown("email"), shown("national_id"),
        "city", "primary_hospital_id", "region", "last_updated",
    )


def fact_view(df: DataFrame, users: DataFrame, hospitals: DataFrame, user: str, columns: list[str], encounters: DataFrame | None = None) -> DataFrame:
    """Encounters or a mart; labs and claims take their hospital from encounters."""
    if encounters is not None:
        df = df.join(encounters.select("encounter_id", "hospital_id"), "encounter_id")
    return secured(df, users, hospitals, user).select(*columns)


def register_scope(spark: SparkSession, users: DataFrame) -> None:
    """user_scope(name): table function of a user's role, hospital and region; no rows if unknown."""
    users.createOrReplaceTempView("user_access_entries")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION user_scope(who STRING) RETURNS TABLE (role STRING, hospital_id STRING, region STRING) RETURN SELECT role, hospital_id, region FROM user_access_entries WHERE user_name = who")


def column_masks(df: DataFrame, masks: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Applies registered SQL functions to columns, as a table's mask policies do; other columns stay."""
    return df.selectExpr(*(f"{masks[c]}(`{c}`) AS `{c}`" if c in masks else f"`{c}`" for c in df.columns if c not in drop))


def role_counts(encounters: DataFrame, patients: DataFrame, users: DataFrame, hospitals: DataFrame) -> DataFrame:
    """For each user: role, visible encounters and patients. One aggregation by hospital serves all users."""
    region = hospitals.select(F.col("hospital_id").alias("__id"), F.col("region").alias("__region"))
    out = users.select("user_name", "role", "hospital_id", "region")
    for df, column, name in ((encounters, "hospital_id", "visible_encounters"), (patients, "primary_hospital_id", "visible_patients")):
        per = df.groupBy(F.col(column).alias("__id")).agg(F.count(F.lit(1)).alias("__n")).join(region, "__id", "left")
        areas = per.where("__region is not null").groupBy("__region").agg(F.sum("__n").alias("__area"))
        whole = per.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__all"))
        seen = F.when(F.col("role").isin(AUDITOR, ENGINEER), F.col("__all")).when(F.col("role") == ANALYST, F.col("__area")).when(F.col("role") == MANAGER, F.col("__n"))
        out = out.join(per.select("__id", "__n"), F.col("hospital_id") == F.col("__id"), "left").join(areas, F.col("region") == F.col("__region"), "left").crossJoin(F.broadcast(whole))
        out = out.withColumn(name, F.coalesce(seen, F.lit(0)).cast("long")).drop("__id", "__n", "__region", "__area", "__all")
    return out.drop("hospital_id", "region")


def sample_rows(view: Callable[[str], DataFrame], users: list[str]) -> DataFrame:
    """For each user the first row, by patient_id, of what the user sees of patients; no row where nothing is seen."""
    out = None
    for user in users:
        one = view(user).orderBy("patient_id").limit(1).select(F.lit(user).alias("user_name"), F.col("patient_id").alias("sample_patient_id"), F.col("full_name").alias("sample_patient_name"), F.col("date_of_birth_or_age_band").alias("sample_patient_dob_or_band"))
        out = one if out is None else out.unionByName(one)
    return out


def guard(df: DataFrame) -> DataFrame:
    """Raises if a column's name holds the name of personal data."""
    found = [c for c in df.columns if any(name in c.lower() for name in PII_NAMES)]
    if found:
        raise ValueError(f"personal data must not be in a mart: {', '.join(found)}")
    return df
