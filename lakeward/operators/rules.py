"""Validation: ordered rules give each row its first reason to be rejected; rejects become quarantine records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward import schemas
from lakeward.functions.scalars import filled, parse_date


@dataclass(frozen=True)
class Reference:
    """A foreign key: column must be among keys (a frame of one column); a blank may be allowed."""

    column: str
    keys: DataFrame
    optional: bool = False


def bad_date(column: str, optional: bool = False) -> Column:
    missing = parse_date(F.col(column)).isNull()
    return filled(F.col(column)).isNotNull() & missing if optional else missing


def classify(df: DataFrame, key: str, dates: tuple[str, ...] = (), optional_dates: tuple[str, ...] = (), references: tuple[Reference, ...] = ()) -> DataFrame:
    """Adds reject_reason: key, then dates, then references in order; null for rows that pass. Each reference is one join, broadcast where Spark knows the keys to be few."""
    flags = []
    for k, reference in enumerate(references):
        found = f"__found{k}"
        keys = reference.keys.select(filled(F.col(reference.keys.columns[0])).alias(f"__key{k}")).distinct().withColumn(found, F.lit(True))
        df = df.join(keys, filled(F.col(reference.column)) == F.col(f"__key{k}"), "left").drop(f"__key{k}")
        orphan = F.col(found).isNull()
        flags.append((filled(F.col(reference.column)).isNotNull() & orphan if reference.optional else orphan, found))
    reasons = [F.when(filled(F.col(key)).isNull(), schemas.NULL_KEY)]
    reasons += [F.when(bad_date(c), schemas.BAD_DATE) for c in dates] + [F.when(bad_date(c, True), schemas.BAD_DATE) for c in optional_dates]
    reasons += [F.when(flag, schemas.ORPHAN) for flag, _ in flags]
    return df.withColumn("reject_reason", F.coalesce(*reasons)).drop(*(name for _, name in flags))


def quarantine_records(rejected: DataFrame, entity: str, key: str, batch_id: str, payload: list[str], at: str) -> DataFrame:
    """Records of the quarantine table; the identifier is a digest of the record, so that a rerun gives the same."""
    text = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    business_key = F.coalesce(filled(F.col(key)), F.lit(""))
    return rejected.select(
        F.sha2(F.concat_ws("\x1f", F.lit(entity), business_key, "reject_reason", F.lit(batch_id), text), 256).alias("quarantine_id"),
        F.lit(entity).alias("entity"), business_key.alias("business_key"), F.col("reject_reason").alias("reason"), F.lit(batch_id).alias("batch_id"), text.alias("record_payload"), F.lit(at).alias("quarantine_timestamp"),
    )
