"""Deduplication within a batch, the per-key watermark, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, key: str, order: Column, ties: list[Column], mode: str = "coalesce") -> DataFrame:
    """Adds is_last: true for one row of each key, the last by order (null order last), ties by further columns.

    coalesce: each column takes its key's last value that is not null, so that a newer row's gaps are filled
    from older rows. row: rows as they stand.
    """
    by = Window.partitionBy(key).orderBy(order.asc_nulls_last(), *ties)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_last = F.row_number().over(by) == F.count(F.lit(1)).over(whole)  # one sort serves both modes
    merged = [F.col(c) if c == key or mode == "row" else F.last(c, ignorenulls=True).over(whole).alias(c) for c in df.columns]
    return df.select(*merged, is_last.alias("is_last"))


def dedupe(df: DataFrame, key: str, order: Column, ties: list[Column], mode: str = "coalesce") -> DataFrame:
    """One row for each key."""
    return ranked(df, key, order, ties, mode).where("is_last").drop("is_last")


def newer(incoming: DataFrame, current: DataFrame, key: str, current_key: str, order: str) -> DataFrame:
    """Adds is_newer: false if the key's current order is not below the incoming one. A null on either side loads."""
    held = current.select(F.col(current_key).alias("__key"), F.col(order).alias("__order"))
    skip = F.col("__order").isNotNull() & F.col(order).isNotNull() & (F.col(order) <= F.col("__order"))
    return incoming.join(held, F.col(key) == F.col("__key"), "left").withColumn("is_newer", ~skip).drop("__key", "__order")


def upsert(current: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of fresh, and rows of current whose key fresh lacks."""
    return current.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def merge_upsert(target: DataFrame, source: DataFrame, key: str, order: str) -> DataFrame:
    """MERGE: a matched row is replaced if the source's order is above the target's; unmatched source rows are added."""
    marked = newer(source, target, key, key, order)
    return upsert(target, marked.where("is_newer").drop("is_newer"), key)
