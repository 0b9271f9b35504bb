"""Data-quality profile: one aggregation for each column or set of checks, plus one join for each foreign key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.functions.scalars import half_even, is_email, is_iso_date, is_phone

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _numeric(kind: str) -> bool:
    return kind.startswith(NUMERIC)


def column_metrics(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column_name, null_count, null_pct, distinct_count, and of numbers min_value, max_value, mean_value.

    Each column is aggregated by itself and read by itself, so that all columns are read once and only a
    column's distinct values are shuffled. approximate counts those in sketches of fixed size (1 % error),
    with all columns in one pass.
    """

    def metrics(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        number, rows = c.cast("double") if _numeric(kind) else F.lit(None).cast("double"), F.count(F.lit(1))
        value = c.cast("string") if kind.startswith(("map", "variant")) else c
        return F.struct(
            F.lit(name).alias("column_name"), F.count_if(c.isNull()).alias("null_count"), F.coalesce(half_even(F.try_divide(F.count_if(c.isNull()), rows) * 100.0, 2), F.lit(0.0)).alias("null_pct"),
            (F.hll_sketch_estimate(F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(value)), 14)) if approximate else F.count_distinct(value)).alias("distinct_count"),
            F.min(number).alias("min_value"), F.max(number).alias("max_value"), half_even(F.avg(number.try_cast("decimal(28,6)")).cast("double"), 2).alias("mean_value"),
        )

    if approximate:
        return df.agg(F.array(*(metrics(*column) for column in df.dtypes)).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    parts = [df.select(f"`{name}`").agg(metrics(name, kind).alias("m")).select("m.*") for name, kind in df.dtypes]
    return reduce(DataFrame.unionByName, parts)


def violation_rules(columns: list[str]) -> dict[str, Column]:
    """Checks by the name of a column. A name that holds ``date`` is checked as a date, ``last_updated`` too."""
    rules = {}
    for name in columns:
        c, low = F.col(f"`{name}`"), name.lower()
        if "date" in low or "dob" in low:
            rules[f"{name}_non_iso"] = c.isNotNull() & ~F.coalesce(is_iso_date(c), F.lit(False))
        elif "phone" in low:
            rules[f"{name}_format_violations"] = c.isNotNull() & ~is_phone(c)
        elif "email" in low:
            rules[f"{name}_invalid_syntax"] = c.isNotNull() & ~is_email(c)
    return rules


def violations(df: DataFrame) -> DataFrame:
    """violation, n: one row for each check."""
    rules = violation_rules(df.columns)
    if not rules:
        return df.sparkSession.createDataFrame([], "violation string, n long")
    one = df.agg(*(F.count_if(rule).alias(f"v{k}") for k, rule in enumerate(rules.values())))
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("violation"), F.col(f"v{k}").alias("n")) for k, name in enumerate(rules)))).alias("x")).select("x.*")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """rows less distinct keys, a null key counting as one value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_business_keys"))


def orphans(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    known = keys.select(F.col(keys.columns[0]).alias("__key"))
    return df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__key"), "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def issues(df: DataFrame, key: str, references: dict[str, DataFrame] | None = None, most: int = 5) -> DataFrame:
    """issue, n, pct, severity: the commonest problems, equal counts in order of their finding."""
    spark = df.sparkSession
    total = df.agg(F.count(F.lit(1)).alias("total"))
    nulls = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(df.columns)))
    found = nulls.select(F.explode(F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(f"Null values in column '{c}'").alias("issue"), F.col(f"n{k}").alias("n"), F.lit("HIGH" if c == key else "MEDIUM").alias("severity")) for k, c in enumerate(df.columns)))).alias("x")).select("x.*")
    at = len(df.columns)
    found = found.unionByName(duplicate_keys(df, key).select(F.lit(at).alias("ordinal"), F.lit(f"Duplicate business keys in '{key}'").alias("issue"), F.col("duplicate_business_keys").alias("n"), F.lit("HIGH").alias("severity")))
    rules = violation_rules(df.columns)
    if rules:
        order = spark.createDataFrame([(at + 1 + k, name, "MEDIUM" if name.endswith("_non_iso") else "LOW") for k, name in enumerate(rules)], "ordinal int, violation string, severity string")
        found = found.unionByName(violations(df).join(F.broadcast(order), "violation").select("ordinal", F.concat(F.lit("Violations: "), "violation").alias("issue"), "n", "severity"))
    for k, (column, keys) in enumerate((references or {}).items()):
        found = found.unionByName(orphans(df, column, keys).select(F.lit(at + 100 + k).alias("ordinal"), F.lit(f"Orphan foreign keys in '{column}'").alias("issue"), F.col("orphans").alias("n"), F.lit("HIGH").alias("severity")))
    ranked = found.where("n > 0").crossJoin(F.broadcast(total)).orderBy(F.desc("n"), "ordinal").limit(most)
    return ranked.select("issue", "n", half_even(F.col("n") / F.col("total") * 100.0, 2).alias("pct"), "severity")


def markdown(title: str, tables: dict[str, dict]) -> str:
    """Report of profiled tables: {entity: {"rows": n, "metrics": rows, "violations": rows, "issues": rows}}."""
    lines = [f"# {title}", ""]
    for entity, told in tables.items():
        lines += [f"## {entity}", "", f"Rows: {told['rows']:,}", "", "| column | nulls | null % | distinct | min | max | mean |", "|---|---|---|---|---|---|---|"]
        lines += ["| " + " | ".join("" if x is None else str(x) for x in row) + " |" for row in told["metrics"]]
        lines += ["", "| check | rows |", "|---|---|", *(f"| {name} | {n} |" for name, n in told["violations"]), "", "Commonest issues:", ""]
        lines += [f"{k}. {row[0]}: {row[1]} ({row[2]} %, {row[3]})" for k, row in enumerate(told["issues"], 1)] + [""]
    return "\n".join(lines)
