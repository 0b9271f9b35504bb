"""Tables that are replaced as a whole: each version is a folder of its own, a pointer names the current one.

Spark can't overwrite a path that the same plan reads. A new version is written beside the old and published
by replacing the pointer, so that a failed check or a lost driver leaves the tables as they were.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lakeward.sources import files


@dataclass(frozen=True)
class SnapshotTable:
    """A table with versions. Tables that name the same pointer are published together."""

    spark: SparkSession
    path: str
    schema: str
    shared: str | None = None

    @property
    def pointer(self) -> str:
        return self.shared or f"{self.path}/_CURRENT"

    def version(self) -> int:
        return _versions(self.spark, self.pointer).get(self.path, 0)

    def read(self) -> DataFrame:
        """The current version; a table never written is empty."""
        version = self.version()
        return self.at(version) if version else self.spark.createDataFrame([], self.schema).limit(0)  # known to be empty when joins are planned

    def at(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def stage(self, df: DataFrame) -> int:
        """Writes a version that nobody reads yet."""
        version = self.version() + 1
        columns = [field.name for field in self.spark.createDataFrame([], self.schema).schema]
        df.select(*columns).write.mode("overwrite").parquet(f"{self.path}/v={version}")
        return version

    def publish(self, version: int) -> None:
        publish([(self, version)])


def _versions(spark: SparkSession, pointer: str) -> dict[str, int]:
    return json.loads(files.read_text(spark, pointer)) if files.exists(spark, pointer) else {}


def publish(staged: list[tuple[SnapshotTable, int]]) -> None:
    """Publishes versions; those of one pointer in one step, so that readers see all of them or none."""
    for pointer in dict.fromkeys(table.pointer for table, _ in staged):
        mine = [(table, version) for table, version in staged if table.pointer == pointer]
        told = _versions(mine[0][0].spark, pointer) | {table.path: version for table, version in mine}
        files.write_text(mine[0][0].spark, pointer, json.dumps(told, sort_keys=True))


def replace_partition(df: DataFrame, path: str, by: str = "batch_id") -> None:
    """Replaces the partitions that df holds; a rerun of a batch leaves one copy."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Moves a written table in place of another."""
    files.remove(spark, target)
    files.move_folder(spark, source, target)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "append", path: str | None = None) -> None:
    """A table of the catalogue; with path an external one, whose files lie there."""
    writer = df.write.mode(mode).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a query's own files, below spark.checkpoint.dir; without that setting a temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lakeward-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    return f"{base.rstrip('/')}/lakeward-{name}-{uuid.uuid4().hex}"
