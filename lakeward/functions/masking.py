"""Masks and tokens as column expressions, and the policy variants as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions.scalars import age, age_band, filled, trimmed


def mask_full_name(c: Column) -> Column:
    return F.coalesce(F.concat(F.upper(F.substring(filled(c), 1, 1)), F.lit("***")), F.lit("***"))


def mask_phone(c: Column) -> Column:
    return F.concat(F.lit("******"), F.right(F.coalesce(F.regexp_replace(c.cast("string"), r"\D", ""), F.lit("")), F.lit(4)))


def mask_email(c: Column) -> Column:
    """First character of what precedes the first @, and all that follows it; null for null and empty text."""
    s = trimmed(c)
    shown = F.concat(F.substring(F.substring_index(s, "@", 1), 1, 1), F.lit("***@"), F.substr(s, F.instr(s, "@") + 1))
    return F.when(F.coalesce(c, F.lit("")) == "", None).when(F.instr(s, "@") == 0, "***").otherwise(shown)


def mask_national_id(c: Column) -> Column:
    s = filled(c)
    return F.when(s.isNull(), "*" * 8).when(F.length(s) <= 4, F.concat(F.lit("****"), s)).otherwise(F.concat(F.repeat(F.lit("*"), F.length(s) - 4), F.right(s, F.lit(4))))


def mask_date_of_birth(birth: Column, as_of: Column) -> Column:
    return age_band(age(birth, as_of))


def with_token(df: DataFrame, id_col: str, salt: str, out: str) -> DataFrame:
    """Adds SHA-256 of salt and trimmed id; an empty or null id gives an empty token.

    The salt comes from a relation of one row: a literal would show in the text of plans.
    """
    secret = df.sparkSession.createDataFrame([(salt,)], "__salt string")
    token = F.when(filled(F.col(id_col)).isNull(), "").otherwise(F.sha2(F.concat(F.col("__salt"), trimmed(F.col(id_col))), 256))
    return df.crossJoin(F.broadcast(secret)).withColumn(out, token).drop("__salt")


#: Decade of age in years of 365.25 days; null where the text is no date.
_DECADE = "CAST(floor(datediff({as_of}, try_to_date(val)) / 3652.5) * 10 AS INT)"
#: Policy masks: what each shows of a value, in SQL, and what stands where it shows nothing. Unlike the
#: expressions above they take years of 365.25 days, eight stars, and of an address the part up to a second @.
POLICIES = {
    "policy_full_name": ("upper(left(nullif(trim(val), ''), 1)) || '***'", "'***'"),
    "policy_phone": ("'******' || right(regexp_replace(val, '[^0-9]', ''), 4)", "'******'"),
    "policy_email": ("if(contains(val, '@'), left(val, 1) || '***@' || split_part(val, '@', 2), nvl2(val, '***', NULL))", "NULL"),
    "policy_national_id": ("repeat('*', 8) || right(val, 4)", "repeat('*', 8)"),
    "policy_dob": (f"transform(array({_DECADE}), low -> low || '-' || (low + 9))[0]", "'Unknown'"),
}


def register_policies(spark: SparkSession, exempt: str = "false", as_of: str = "current_date()") -> list[str]:
    """Temporary SQL functions, inlined by the optimiser; exempt is a condition under which values show. Returns their names."""

    def register(name: str, arguments: str, masked: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS STRING RETURN if({exempt}, val, {masked})")

    for name, (shown, otherwise) in POLICIES.items():
        register(name, "val STRING", f"nvl({shown.replace('{as_of}', as_of)}, {otherwise})")
    register("policy_patient_id", "val STRING, salt STRING", "sha2(salt || val, 256)")
    return [*POLICIES, "policy_patient_id"]
