"""The star-schema tables as deliveries of files: two batches of every format, run through the whole pipeline.

RAW holds the delivered rows in SQL that Spark and the oracles both read. They carry every fault that the rules
look for, dates in several forms, late and repeated rows, and gaps that older rows fill.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward import schemas
from lakeward.config import Config, get_config
from lakeward.plans import pipeline
from lakeward.plans import testbed as tb
from lakeward.sources import files
from lakeward.sources.storage import scratch

SALT, AS_OF = "filebed-salt", "2026-01-01"
FOLDERS = {"batch_0": "Batch_0_first", "batch_1": "batch_1"}
#: Rows of one workbook; a larger delivery has several.
SHEET_ROWS = 50_000
#: Rows of one file of the other formats, so that a task can hold a whole file.
FILE_ROWS = 250_000

_BIRTH = "DATE '1940-01-01' + CAST(c_custkey * 37 % 30000 AS INT)"
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_PATIENT = f"""SELECT CASE WHEN c_custkey % 101 = 0 THEN '' ELSE concat(' P', c_custkey) END AS patient_id, concat('ann "', c_name, '", jr') AS full_name,
    CASE c_custkey % 5 WHEN 0 THEN ' male' WHEN 1 THEN 'F' WHEN 2 THEN 'Other' WHEN 3 THEN 'NA' ELSE '?' END AS gender,
    CASE WHEN c_custkey % 97 = 0 THEN 'unknown' WHEN c_custkey % 4 = 0 THEN CAST({_BIRTH} AS STRING) WHEN c_custkey % 4 = 1 THEN concat(CAST({_BIRTH} AS STRING), 'T10:00:00')
        WHEN c_custkey % 4 = 2 THEN concat(substr(CAST({_BIRTH} AS STRING), 9, 2), '/', substr(CAST({_BIRTH} AS STRING), 6, 2), '/', substr(CAST({_BIRTH} AS STRING), 1, 4)) ELSE concat(CAST({_BIRTH} AS STRING), ' 07:30') END AS date_of_birth,
    CASE WHEN c_custkey % 2 = 0 AND {{gaps}} THEN '' ELSE concat('+91-', 1000 + c_custkey, {{phone}}) END AS phone, concat('U', c_custkey, '@Mail.Org') AS email, concat('ID', 1000 + c_custkey) AS national_id, {{city}} AS city,
    CASE WHEN c_custkey % 89 = 0 THEN 'H99' WHEN c_custkey % 10 = 3 THEN '' ELSE concat('H', lpad(CAST(c_custkey % 25 AS STRING), 2, '0')) END AS primary_hospital_id, '{{at}}' AS last_updated, '{{batch}}' AS batch FROM {{customer}} WHERE {{which}}"""


def _patients(**x: str) -> str:
    out = _PATIENT
    for name, value in x.items():
        out = out.replace("{" + name + "}", value)
    return out


#: Delivered rows by entity; {customer} and so on stand for the tables.
RAW = {
    "patients": " UNION ALL ".join([
        _patients(gaps="true", phone="''", city="c_mktsegment", at="2026-01-01 10:00:00", batch="batch_0", which="c_custkey % 5 <> 0"),
        _patients(gaps="false", phone="'77'", city="'OLDER'", at="2025-12-01 10:00:00", batch="batch_0", which="c_custkey % 5 <> 0 AND c_custkey % 13 = 0"),
        _patients(gaps="false", phone="''", city="c_mktsegment", at="2026-01-02 10:00:00", batch="batch_1", which="c_custkey % 5 = 0"),
        _patients(gaps="false", phone="'88'", city="'MOVED'", at="2026-02-01 10:00:00", batch="batch_1", which="c_custkey % 5 <> 0 AND c_custkey % 7 = 0"),
        _patients(gaps="false", phone="'99'", city="'STALE'", at="2025-11-01 10:00:00", batch="batch_1", which="c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 = 0"),
    ]),
    "encounters": f"""SELECT concat('E', o_orderkey) AS encounter_id, concat('P', o_custkey) AS patient_id, concat('H', lpad(CAST(o_orderkey % 25 AS STRING), 2, '0')) AS hospital_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE ' Ward ' END AS department,
        CASE o_orderstatus WHEN 'F' THEN 'inpatient' WHEN 'O' THEN 'Outpatient' ELSE 'Emergency' END AS encounter_type, CASE WHEN o_orderkey % 103 = 0 THEN 'not a date' ELSE {_DAY} END AS admit_date,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 107 = 0 THEN '31/31/2020' ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 8 AS INT) AS STRING) END AS discharge_date, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat('J', o_orderkey % 50) END AS primary_diagnosis_code,
        concat('D', o_orderkey % 40) AS attending_doctor_id, concat({_DAY}, ' 10:00:00') AS last_updated, concat('batch_', CAST(o_orderkey % 2 AS INT)) AS batch FROM {{orders}}""",
    "lab_results": """SELECT CASE WHEN event_id % 61 = 0 THEN NULL ELSE concat('L', event_id) END AS lab_result_id, concat('E', event_id) AS encounter_id, '  ' || lower(event_type) || '   panel ' AS test_name,
        CASE WHEN event_id % 13 = 0 THEN 'pending' WHEN value IS NULL THEN 'NA' ELSE CAST(CAST(floor(value) AS INT) AS STRING) END AS result_value, 'mmol' AS unit, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '10' END AS reference_low, '60' AS reference_high,
        CASE WHEN event_id % 59 = 0 THEN 'soon' ELSE CAST(CAST(ts AS DATE) AS STRING) || ' 08:00:00' END AS result_timestamp, '2026-01-01 10:00:00' AS last_updated, concat('batch_', CAST(event_id % 2 AS INT)) AS batch FROM {events}""",
    "claims": """SELECT concat('C', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)) AS claim_id, concat('E', l_orderkey) AS encounter_id,
        CASE l_suppkey % 4 WHEN 0 THEN 'STAR  health' WHEN 1 THEN 'icici_lombard' WHEN 2 THEN 'acme mutual' ELSE '' END AS insurer, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS claim_amount, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE '12.50' END AS approved_amount,
        CASE l_suppkey % 5 WHEN 0 THEN 'approved ' WHEN 1 THEN 'REJECTED' WHEN 2 THEN '' ELSE 'on hold' END AS claim_status, max(CAST(CAST(l_shipdate AS DATE) AS STRING)) AS claim_date, '2026-01-01 10:00:00' AS last_updated, concat('batch_', CAST(l_orderkey % 2 AS INT)) AS batch
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice""",
}
_TABLE = {"patients": "customer", "encounters": "orders", "lab_results": "events", "claims": "lineitem"}


def delivered(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    name = _TABLE[entity]
    return spark.sql(RAW[entity], **{name: tb.table(spark, sf_dir, name)})


def raw_sql(entity: str) -> str:
    return RAW[entity].replace("{" + _TABLE[entity] + "}", _TABLE[entity])


def _row(columns: list[Column]) -> Column:
    """A row of a sheet as XML: texts in place, an empty cell for null and empty texts."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = (F.when(F.coalesce(c, F.lit("")) == "", "<c/>").otherwise(F.concat(F.lit('<c t="inlineStr"><is><t'), F.when(F.trim(c) == c, ">").otherwise(' xml:space="preserve">'), escaped(c), F.lit("</t></is></c>"))) for c in columns)
    return F.concat(F.lit("<row>"), *cells, F.lit("</row>"))


def _sheet(rows: list[bytes]) -> bytes:
    """A workbook of one sheet, of rows as XML in UTF-8."""
    main, out = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="claims" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", b"".join([f"<worksheet {main}><sheetData>".encode(), *rows, b"</sheetData></worksheet>"]))
    return out.getvalue()


def _workbooks(spark: SparkSession, rows: DataFrame, folder: str, name: str) -> None:
    """Tasks write workbooks of up to SHEET_ROWS rows each; those of the attempts that count then get the names that a delivery has."""
    own, most, head = f"{folder}/__{name}", SHEET_ROWS, "<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in rows.columns) + "</row>"
    head = head.encode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(own)
        store.create_dir(path)
        at = (x for batch in batches for x in batch[0].cast(pa.binary()).to_pylist())
        while part := list(islice(at, most)):
            file = f"{uuid.uuid4().hex}.xlsx"
            with store.open_output_stream(f"{path}/{file}") as out:
                out.write(_sheet([head, *part]))
            yield pa.RecordBatch.from_arrays([pa.array([file])], ["file"])

    made = rows.select(_row([F.col(c).cast("string") for c in rows.columns]).alias("row")).mapInArrow(work, "file string").collect()  # a name for each workbook
    for k, file in enumerate(sorted(r["file"] for r in made)):
        files.move(spark, f"{own}/{file}", f"{folder}/{name}_{k:04d}.xlsx")
    files.remove(spark, own)


def _parts(spark: SparkSession, rows: DataFrame, kind: str, folder: str, name: str, suffix: str, **options: object) -> None:
    """Spark writes the files, which then get the names that a delivery has."""
    rows.write.format(kind).options(maxRecordsPerFile=FILE_ROWS, **options).save(f"{folder}/__{name}")
    for k, part in enumerate(n for n in files.names(spark, f"{folder}/__{name}", folders=False) if n.startswith("part-")):
        files.move(spark, f"{folder}/__{name}/{part}", f"{folder}/{name}_{k:04d}.{suffix}")
    files.remove(spark, f"{folder}/__{name}")


def _deliver_reference(spark: SparkSession, sf_dir: str, root: str) -> None:
    hospitals = tb.hospitals(spark, sf_dir).select("hospital_id", "hospital_name", F.lit("City").alias("city"), "region", "bed_capacity").orderBy("hospital_id")
    lines = ["hospital_id,hospital_name,city,region,bed_capacity", *(",".join(map(str, r)) for r in hospitals.collect())]
    files.write_text(spark, f"{root}/reference/hospitals.csv", "\n".join(lines) + "\n")
    users = [r.asDict() for r in tb.users(spark).collect()]
    files.write_text(spark, f"{root}/reference/user_access_json.txt", json.dumps(users, indent=1))
def _deliver(spark: SparkSession, sf_dir: str, root: str, entity: str) -> None:
    for batch, folder in FOLDERS.items():
        path, rows = f"{root}/{folder}", delivered(spark, sf_dir, entity).where(F.col("batch") == batch).drop("batch")
        if entity == "patients":
            _parts(spark, rows, "csv", path, entity, "csv", header=True, escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        elif entity == "encounters":
            nested = rows.withColumn("diagnosis", F.when(F.col("primary_diagnosis_code").isNotNull(), F.struct(F.col("primary_diagnosis_code").alias("primary_code"), F.lit("n").alias("note")))).drop("primary_diagnosis_code")
            _parts(spark, nested, "json", path, entity, "jsonl" if batch == "batch_0" else "txt")
        elif entity == "lab_results":
            _parts(spark, rows, "csv", path, entity, "txt", header=True, sep="|", nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        elif batch == "batch_1":
            _parts(spark, rows, "csv", path, entity, "csv", header=True, nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        else:
            _workbooks(spark, rows, path, entity)


#: The batches that run, in this order: the first twice.
RUNS = ("batch_0", "batch_0", "batch_1")
#: By session, folder of tables and what was made there: the configuration.
_made: dict[tuple[str, str, str, tuple[str, ...]], Config] = {}


def _once(spark: SparkSession, sf_dir: str, step: str, entities: tuple[str, ...], make: Callable[[], Config]) -> Config:
    """What was made for these entities, or for more; each is made once for a session and folder of tables."""
    session = spark.sparkContext.applicationId
    for (*key, had), config in list(_made.items()):
        if key == [session, sf_dir, step] and set(entities) <= set(had):
            return config
    _made[session, sf_dir, step, entities] = config = make()
    return config


def delivery(spark: SparkSession, sf_dir: str, entities: tuple[str, ...] = schemas.ENTITIES) -> Config:
    """The batches as files, at least those of these entities; a warehouse of their own belongs to them."""

    def reference() -> Config:
        root = scratch(spark, "filebed")
        _deliver_reference(spark, sf_dir, f"{root}/data")
        return get_config(f"{root}/data", f"{root}/warehouse", SALT, AS_OF, sketches=True, profiles=False)

    def files_of(entity: str) -> Config:
        _deliver(spark, sf_dir, config.data_root, entity)
        return config

    config = _once(spark, sf_dir, "reference", (), reference)
    with ThreadPoolExecutor(len(schemas.ENTITIES)) as pool:
        list(pool.map(lambda entity: _once(spark, sf_dir, f"files of {entity}", (), lambda: files_of(entity)), entities))
    return config


def _own(config: Config, name: str) -> Config:
    """The same files, a warehouse beside the whole one."""
    return replace(config, warehouse=f"{config.warehouse}_{name}")


def warehouse(spark: SparkSession, sf_dir: str, entities: tuple[str, ...] = schemas.ENTITIES) -> Config:
    """After the first batch, the same batch again, the second, and one whose folder is missing.

    A query of some entities' tables names these and their parents; the batches then run for them alone, unless
    they have run for more.
    """

    def runs() -> Config:
        config = delivery(spark, sf_dir, entities)
        if set(entities) != set(schemas.ENTITIES):
            config = _own(config, "_".join(entities))
        for batch in RUNS:
            pipeline.run_batch(spark, config, batch, entities)
        try:
            pipeline.run_batch(spark, config, "batch_7", entities)
        except FileNotFoundError:
            return config
        raise AssertionError("a batch without a folder ran")

    return _once(spark, sf_dir, "runs", entities, runs)


def ingested(spark: SparkSession, sf_dir: str, bronze: bool) -> Config:
    """The landing zone, and with bronze the bronze tables, after the same runs: what a batch does first, for all entities."""

    def runs() -> Config:
        config = _own(delivery(spark, sf_dir), "bronze" if bronze else "landing")
        for batch in RUNS:
            landing, _ = pipeline.land(spark, config, batch)
            if bronze:
                pipeline.ingest(spark, config, batch, landing, pipeline.now())
        return config

    whole = (spark.sparkContext.applicationId, sf_dir, "runs", schemas.ENTITIES)
    return _made.get(whole) or _once(spark, sf_dir, "bronze" if bronze else "landing", (), runs)


def batches(frames: Iterator[DataFrame]) -> DataFrame:
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df)
    return out
