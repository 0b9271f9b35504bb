"""Shared storage and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: texts may be long, so a batch stays small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir).

    Where that setting is absent in local mode, as in tests, a temporary folder takes its place; on a cluster,
    whose executors could not read that, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lakeward-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lakeward-{uuid.uuid4().hex}"


def parts_for(df: DataFrame, each: int = 32 << 20) -> int:
    """Partitions to deal df into: as many as the session asks for, and more where a share of the files' bytes would exceed ``each``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    asked = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asked if size >> 60 else max(asked, -(-size // each))


def sampled(h: Column, most: float, n: int) -> Column:
    """Whether a 64-bit hash falls into the share most / n of its range: about ``most`` of n distinct values, however large n is."""
    return F.shiftrightunsigned(h, 1) < F.lit(min((1 << 63) - 1, int(min(1.0, most / max(1, n)) * (1 << 63))))


def bounded(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """df to be broadcast if its rows, written as JSON, have at most that many bytes; else as it is, to be joined by shuffle."""
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= most else df


def written(df: DataFrame, name: str = "table", root: str | None = None) -> DataFrame:
    """The rows of df as a table in the shared folder: lineage ends there and no executor's loss repeats work."""
    spark = df.sparkSession
    path = f"{root or shared_dir(spark)}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage that no later step reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    squeezed = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def held(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves that remainder; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder
