"""Runs batches: landing, bronze, profile, silver, gold, audit. Also the command line."""

from __future__ import annotations

import argparse
import hashlib
import inspect
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward import schemas
from lakeward.config import Config, get_config
from lakeward.operators import gold, governance, profile, reports, silver
from lakeward.session import build_session
from lakeward.sources import files, readers
from lakeward.sources.storage import read_or_empty

BATCHES = ("batch_0", "batch_1", "batch_2")
#: Marts, each with the columns that a reader sees it in order of.
GOLD = {"hospital_daily_admissions": ("hospital_id", "date"), "readmission_30d": ("hospital_id", "discharge_month"), "claims_summary": ("hospital_id", "insurer", "claim_month"), "lab_abnormality": ("hospital_id", "test_name", "result_month")}


def now() -> str:
    return datetime.now(UTC).isoformat()


def load_silver(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    return {e: silver.silver_table(spark, config, e).read() for e in schemas.ENTITIES}


def load_bronze(spark: SparkSession, config: Config, entity: str, batch_id: str | None = None) -> DataFrame:
    """One batch, which must be there, or all batches."""
    path, schema = config.path("bronze", entity), f"{schemas.RAW[entity]}, source_file string, ingest_timestamp string, ingest_ordinal long, batch_id string"
    df = read_or_empty(spark, path, schema)
    if batch_id is None:
        return df
    if not files.exists(spark, f"{path}/batch_id={batch_id}"):
        raise FileNotFoundError(f"{path}/batch_id={batch_id}")
    return df.where(F.col("batch_id") == batch_id)


def load_quarantine(spark: SparkSession, config: Config) -> DataFrame:
    df = read_or_empty(spark, config.path("quarantine"), schemas.QUARANTINE)
    return df.drop("part_entity", "part_batch")


def load_audit(spark: SparkSession, config: Config) -> DataFrame:
    return read_or_empty(spark, config.path("audit"), schemas.AUDIT)


def load_gold(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """Marts in their order: written as they come, sorted for readers."""
    return {name: governance.guard(spark.read.parquet(config.path("gold", name))).orderBy(*order) for name, order in GOLD.items()}


def _gold_of(spark: SparkSession, config: Config, hospitals: DataFrame) -> str:
    """What the marts are made of: the files of silver versions, whose names no other write gives, hospitals, and the code."""
    tables = (silver.silver_table(spark, config, e) for e in schemas.ENTITIES)
    paths = [f"{t.path}/v={version}" for t in tables if (version := t.version())]
    versions = {p: hashlib.sha256("/".join(files.names(spark, p, folders=False)).encode()).hexdigest() for p in paths}
    rows = hospitals.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("*"))), {"ignoreNullFields": "false"}), 256)).first()[0]
    return json.dumps({"silver": versions, "hospitals": rows, "code": hashlib.sha256(inspect.getsource(gold).encode()).hexdigest()}, sort_keys=True)


def build_gold(spark: SparkSession, config: Config, hospitals: DataFrame) -> None:
    """Writes the marts side by side; those made of the same versions, hospitals and code stay."""
    made, of = config.path("gold", "_MADE_OF"), _gold_of(spark, config, hospitals)
    if all(files.exists(spark, p) for p in (made, *(config.path("gold", name) for name in GOLD))) and files.read_text(spark, made) == of:
        return
    files.remove(spark, made)
    tables = load_silver(spark, config)
    marts = (gold.daily_admissions(tables["encounters"], hospitals), gold.readmission(tables["encounters"]), gold.claims_summary(tables["claims"], tables["encounters"]), gold.lab_abnormality(tables["lab_results"], tables["encounters"]))
    with ThreadPoolExecutor(len(GOLD)) as pool:
        list(pool.map(lambda name, mart: governance.guard(mart).write.mode("overwrite").parquet(config.path("gold", name)), GOLD, marts))
    files.write_text(spark, made, of)


def record_run(spark: SparkSession, config: Config, batch_id: str, started: str, totals: dict[str, int], status: str, error: str | None = None) -> None:
    row = (batch_id, started, now(), totals.get("read", 0), totals.get("loaded", 0), totals.get("quarantined", 0), totals.get("superseded", 0), status, error)
    spark.createDataFrame([row], schemas.AUDIT).coalesce(1).write.mode("append").parquet(config.path("audit"))


def profile_report(title: str, tables: dict[str, DataFrame], hospitals: DataFrame, warehouse: dict[str, DataFrame] | None = None, sketches: bool = False) -> str:
    """Profile of each table. Foreign keys are held against the tables given, so that an incremental batch shows
    keys of earlier batches as orphans; with warehouse, silver tables by entity, against those too. Tables are profiled
    side by side, as most of a small one's time is planning.
    """
    parents = {"hospital_id": hospitals.select("hospital_id"), "primary_hospital_id": hospitals.select("hospital_id")}

    def told(entity: str, df: DataFrame) -> dict:
        key = "original_patient_id" if "original_patient_id" in df.columns and entity == "patients" else schemas.KEYS[entity]
        references = {c: k for c, k in parents.items() if c in df.columns}
        for parent in ("patients", "encounters"):
            column = schemas.KEYS[parent]
            if parent in tables and entity != parent and column in df.columns:
                references[column] = tables[parent].select(column)
                if warehouse:
                    references[column] = references[column].union(warehouse[parent].select(schemas.SILVER_KEYS[parent]))
                references[column] = references[column].distinct()
        rows = lambda frame: [tuple(r) for r in frame.collect()]  # noqa: E731  a row for each column or check
        return {"rows": df.count(), "metrics": rows(profile.column_metrics(df, sketches)), "violations": rows(profile.violations(df)), "issues": rows(profile.issues(df, key, references))}

    with ThreadPoolExecutor(max(1, len(tables))) as pool:
        return profile.markdown(title, dict(zip(tables, pool.map(told, tables, tables.values()), strict=True)))


def profile_batch(spark: SparkSession, config: Config, batch_id: str, hospitals: DataFrame) -> None:
    batch = {e: load_bronze(spark, config, e, batch_id) for e in schemas.ENTITIES}
    files.write_text(spark, config.path("reports", f"profile_{batch_id}.md"), profile_report(f"Bronze, {batch_id}", batch, hospitals, sketches=config.sketches))


def profile_silver(spark: SparkSession, config: Config, hospitals: DataFrame) -> None:
    files.write_text(spark, config.path("reports", "profile_silver.md"), profile_report("Silver", load_silver(spark, config), hospitals, sketches=config.sketches))


def land(spark: SparkSession, config: Config, batch_id: str) -> tuple[str, str]:
    """Copies the reference files and those of a batch into the landing zone; gives the folders of both there."""
    folder = readers.batch_folder(spark, config.data_root, batch_id)
    landing, reference = config.path("landing", batch_id), config.path("landing", "reference")
    files.copy(spark, f"{config.data_root}/reference", reference)
    files.copy(spark, folder, landing)
    return landing, reference


def ingest(spark: SparkSession, config: Config, batch_id: str, landing: str, at: str, entities: tuple[str, ...] = schemas.ENTITIES) -> dict[str, DataFrame]:
    """Writes the landed files of a batch to bronze; gives its rows there by entity."""
    silver.write_bronze({e: readers.read_entity(spark, landing, e, batch_id, at) for e in entities}, config)
    return {e: load_bronze(spark, config, e, batch_id) for e in entities}


#: Joins whose partitions, as shuffled, are at most that large hash the smaller side of each and sort neither.
HASHED = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m"}


@contextmanager
def _hashed_joins(spark: SparkSession) -> Iterator[None]:
    """Adaptive execution may choose hash joins within; settings of the session's own stay, and all are as before afterwards."""
    own = {k: spark.conf.get(k, None) for k in HASHED} if not any(spark.sparkContext.getConf().contains(k) for k in HASHED) else {}
    for k in own:
        spark.conf.set(k, HASHED[k])
    try:
        yield
    finally:
        for k, value in own.items():
            spark.conf.set(k, value) if value is not None else spark.conf.unset(k)


def run_batch(spark: SparkSession, config: Config, batch_id: str, entities: tuple[str, ...] = schemas.ENTITIES) -> dict:
    """One batch from files to marts. On failure an audit row is left, silver stays as it was, and the error is raised.

    With fewer entities, among which must be the parents of each, the batch is read and loaded for these alone;
    profiles and marts, which need all of them, are left as they are.
    """
    started, read = now(), {}
    try:
        if orphans := {e.name for e in silver.ENTITIES if e.name in entities and any(parent and parent not in entities for _, parent, _ in e.foreign)}:
            raise ValueError(f"parents are missing of {sorted(orphans)}")
        landing, reference = land(spark, config, batch_id)
        hospitals = readers.read_hospitals(spark, reference)
        hospitals.createOrReplaceTempView("reference_hospitals")
        readers.read_users(spark, reference).createOrReplaceTempView("reference_user_access")
        batch, whole = ingest(spark, config, batch_id, landing, started, entities), set(entities) == set(schemas.ENTITIES)
        read = {"read": sum(df.count() for df in batch.values())}
        if config.profiles and whole:
            profile_batch(spark, config, batch_id, hospitals)
        with _hashed_joins(spark):
            counts = silver.build(spark, config, batch_id, batch, hospitals, started)
        if config.profiles and whole:
            profile_silver(spark, config, hospitals)
        if whole:
            build_gold(spark, config, hospitals)
        totals = {k: sum(n[k] for n in counts.values()) for k in ("read", "loaded", "quarantined", "superseded")}
        record_run(spark, config, batch_id, started, totals, "SUCCESS")
    except Exception as error:
        record_run(spark, config, batch_id, started, read, "FAILED", str(error)[:2000])
        raise
    return {"batch_id": batch_id, "status": "SUCCESS", "entities": counts, **{f"rows_{k}": n for k, n in totals.items()}}


#: The demonstration samples a row for so many users, in order of their names.
DEMO_USERS = 20


def security_demo(spark: SparkSession, config: Config) -> DataFrame:
    """What each user sees: counts, and the first patient as the user sees it."""
    reference = config.path("landing", "reference")
    tables = load_silver(spark, config)
    users, hospitals = readers.read_users(spark, reference), readers.read_hospitals(spark, reference)
    counts = governance.role_counts(tables["encounters"], tables["patients"], users, hospitals)
    vault = silver.vault_table(spark, config).read()
    names = [r[0] for r in users.select("user_name").orderBy("user_name").limit(DEMO_USERS).collect()]
    return counts.join(governance.sample_rows(lambda user: governance.patients_view(tables["patients"], vault, users, hospitals, user), names), "user_name", "left")


def cleansing_report(spark: SparkSession, config: Config) -> str:
    """What cleansing changed; every figure is computed."""
    bronze, tables = {e: load_bronze(spark, config, e) for e in schemas.ENTITIES}, load_silver(spark, config)
    quarantine = load_quarantine(spark, config)
    summary = reports.cleansing_summary(bronze, tables, quarantine).collect()
    lines = ["# Cleansing report", "", "| entity | bronze | silver | quarantined | superseded | unaccounted | silver % |", "|---|---|---|---|---|---|---|"]
    lines += ["| " + " | ".join(map(str, row)) + " |" for row in summary] + ["", "| entity | reason | rows |", "|---|---|---|"]
    lines += [f"| {r['entity']} | {r['reason']} | {r['n']} |" for r in reports.reason_counts(quarantine).collect()]
    for title, entity, column in (("Insurers", "claims", "insurer"), ("Genders", "patients", "gender")):
        before, after = (", ".join(r[0] for r in reports.distinct_values(t[entity], column).limit(100).collect()) for t in (bronze, tables))
        lines += ["", f"## {title}", "", f"Before: {before}", "", f"After: {after}"]
    files.write_text(spark, config.path("reports", "cleansing.md"), text := "\n".join(lines) + "\n")
    return text


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run batches of the medallion pipeline")
    parser.add_argument("--batch", choices=[*BATCHES, "all"], required=True)
    for name in ("--data-root", "--warehouse", "--salt", "--as-of"):
        parser.add_argument(name)
    given = parser.parse_args(arguments)
    spark = build_session("lakeward")
    config = get_config(given.data_root, given.warehouse, given.salt, given.as_of)
    for batch_id in BATCHES if given.batch == "all" else [given.batch]:
        print(run_batch(spark, config, batch_id))


if __name__ == "__main__":
    main()
