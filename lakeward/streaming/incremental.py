"""Arrival of files as a stream, into the same upsert; and event-time windows, an extension of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeward.operators import upsert
from lakeward.sources.storage import SnapshotTable


def upsert_stream(stream: DataFrame, table: SnapshotTable, key: str, order: str, checkpoint: str):  # noqa: ANN201  a StreamingQuery
    """Applies each micro-batch to the table: the last row of a key, if newer than the table's. Reruns change nothing."""

    def apply(rows: DataFrame, epoch: int) -> None:
        current = table.read()
        last = upsert.dedupe(rows, key, F.col(order), [F.col(c) for c in rows.columns if c not in (key, order)], "row")
        table.publish(table.stage(upsert.merge_upsert(current, last, key, order)))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 day", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts by tumbling window and kind; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def table_of(counts: DataFrame, folder: str) -> DataFrame:
    """The complete result of an aggregated stream over all that has arrived, as a table in folder; nothing is gathered on the driver."""
    write = lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{folder}/result")
    counts.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return counts.sparkSession.read.schema(counts.schema).parquet(f"{folder}/result")
