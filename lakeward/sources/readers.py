"""Readers of a batch's files. Schemas are fixed; each row keeps its file's name and its place in the order."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward import schemas
from lakeward.sources import files

#: Texts that stand for a missing value in delimited files.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
PATTERNS = {"patients": (r"patients_.*\.csv$",), "encounters": (r"encounters_.*\.(jsonl|txt)$",), "lab_results": (r"lab_results_.*\.txt$",), "claims": (r"claims_.*\.(xlsx|csv|parquet)$",)}
_CELL = re.compile(r"([A-Z]+)\d+")
#: A cell as programs commonly write it, and a row of such cells; rows of any other form are left to the XML parser.
_TEXT = "[^<\x00-\x08\x0b-\x1f\ufffe\uffff]*"
_PLAIN_CELL = '<c(?: r="{0}[A-Z]+{1}[0-9]+")?(?: s="{0}[0-9]+{1}")?(?: t="{0}[A-Za-z]+{1}")?(?:/>|>(?:<v>{0}' + _TEXT + '{1}</v>|<is><t(?: xml:space="preserve")?>{0}' + _TEXT + "{1}</t></is>)?</c>)"
_PLAIN_CELLS, _PLAIN_ROW = re.compile(_PLAIN_CELL.replace("{0}", "(").replace("{1}", ")")), re.compile('<row(?: [A-Za-z:0-9]+="[^"<>&]*")*>(?:' + _PLAIN_CELL.replace("{0}", "").replace("{1}", "") + ")*")
#: In a sheet of texts alone these stand for the marks between cells and for an empty cell; a sheet that holds them, or line ends, is read otherwise.
_NEXT_CELL, _NO_CELL = b"\x01", b"\x02"
_UNPLAIN = re.compile(b"[\x00-\x08\x0a-\x1f]|\xef\xbf[\xbe\xbf]")


def _found(spark: SparkSession, folder: str, entity: str) -> list[str]:
    found = [f"{folder}/{n}" for n in files.names(spark, folder, folders=False) if any(re.match(p, n) for p in PATTERNS[entity])]
    if not found:
        raise FileNotFoundError(f"no file of {entity} in {folder}")
    return found


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in schema.split(", ")]


def _known(c: Column) -> Column:
    return F.when(~F.trim(c).isin(*NULL_TOKENS), c)


def _typed(df: DataFrame, entity: str) -> DataFrame:
    """Columns of the raw schema: text as it stands, numbers where they can be read, missing columns null."""
    out = []
    for name, kind in _columns(schemas.RAW[entity]):
        c = F.col(f"`{name}`") if name in df.columns else F.lit(None)
        out.append((F.trim(c.cast("string")).try_cast("double") if kind == "double" else c.cast("string")).alias(name))
    return df.select(*out, "__file", "__order")


def _placed(df: DataFrame) -> DataFrame:
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    name = F.when(F.contains(name, F.lit("%")), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)
    return df.select("*", name.alias("__file"), F.monotonically_increasing_id().alias("__order"))


def _broken_lines(spark: SparkSession, paths: list[str]) -> bool:
    """Whether a quoted field spans lines: some line then holds an odd number of quotation marks. Lines are read in parallel."""
    odd = F.contains("value", F.lit('"')) & ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1)
    return not spark.read.text(paths).where(odd).isEmpty()


def _delimited(spark: SparkSession, paths: list[str], entity: str, separator: str) -> DataFrame:
    text = ", ".join(f"{name} string" for name, _ in _columns(schemas.RAW[entity]))
    df = _placed(spark.read.schema(text).option("header", True).option("sep", separator).option("escape", '"').option("multiLine", separator == "," and _broken_lines(spark, paths)).option("enforceSchema", False).csv(paths))
    return df.select(*(_known(F.col(name)).alias(name) for name, _ in _columns(schemas.RAW[entity])), "__file", "__order")


def _json_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    text = ", ".join(f"{name} {'variant' if name == 'diagnosis' else 'string'}" for name, _ in _columns(schemas.RAW["encounters"]) if name != "primary_diagnosis_code")
    df = _placed(spark.read.schema(text).json(paths))
    return df.withColumn("primary_diagnosis_code", F.try_variant_get("diagnosis", "$.primary_code", "string")).withColumn("diagnosis", F.to_json("diagnosis"))


def _plain_cells(xml: bytes) -> list[list[tuple[str, str, str, str, str]]] | None:
    """Cells of each row (column, style, kind, value, text), if the sheet holds nothing but cells of the common form; else None."""
    try:
        head, opened, rest = xml.decode("utf-8").partition("<sheetData>")
    except UnicodeDecodeError:
        return None
    body, closed, tail = rest.rpartition("</sheetData>")
    if not opened or not closed or "<!" in head + tail or "]]>" in body or re.search("""encoding=["'](?!utf-8)""", head, re.IGNORECASE) or re.search(r"[<:]row\b", head + tail):
        return None
    ElementTree.fromstring((head + opened + closed + tail).removeprefix("\ufeff").encode())
    *rows, end = body.split("</row>")
    if end or not all(map(_PLAIN_ROW.fullmatch, rows)):
        return None
    return list(map(_PLAIN_CELLS.findall, rows))


def _parsed_cells(xml: bytes) -> list[list[tuple[str, str, str, str, str]]]:
    """The same for any sheet; values are escaped again, as a plain sheet holds them."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    out = []
    for row in (e for e in ElementTree.fromstring(xml).iter() if local(e) == "row"):
        cells = []
        for cell in (e for e in row if local(e) == "c"):
            at = _CELL.match(cell.get("r", ""))
            cells.append((at[1] if at else "", cell.get("s", ""), cell.get("t", ""), escape(next((e.text for e in cell if local(e) == "v"), None) or ""), escape(text(cell))))
        out.append(cells)
    return out


def _text_table(xml: bytes) -> pa.Table | None:
    """A sheet of nothing but rows of empty cells and texts in place, as many in each, by the names in its first row; else None.

    Marks between cells and rows become single bytes that no text holds; a mark of another form is left over and tells.
    """
    head, opened, rest = xml.partition(b"<sheetData>")
    body, closed, tail = rest.rpartition(b"</sheetData>")
    if not opened or not closed or b"<!" in head + tail or b"]]>" in body or _UNPLAIN.search(body) or re.search(b"""encoding=["'](?!utf-8)""", head, re.IGNORECASE) or re.search(rb"[<:]row\b", head + tail):
        return None
    text, end = b'<c t="inlineStr"><is><t>', b"</t></is></c>"
    body = body.replace(b"<c/>", text + _NO_CELL + end).replace(b'<t xml:space="preserve">', b"<t>").replace(end + text, _NEXT_CELL).replace(end + b"</row><row>" + text, b"\n")
    first, last = b"<row>" + text, end + b"</row>"
    if not body.startswith(first) or not body.endswith(last) or len(body) < len(first) + len(last) or b"<" in (body := body[len(first) : len(body) - len(last)]):
        return None
    ElementTree.fromstring((head + opened + closed + tail).removeprefix(b"\xef\xbb\xbf"))
    names = body[: body.find(b"\n")].split(_NEXT_CELL) if b"\n" in body else []
    if not names or len(set(names)) < len(names) or any(not n or n == _NO_CELL or b"&" in n for n in names):
        return None
    try:
        columns = [n.decode() for n in names]
        table = csv.read_csv(
            pa.BufferReader(body), csv.ReadOptions(use_threads=False, column_names=columns, skip_rows=1, block_size=len(body) + 1),
            csv.ParseOptions(delimiter=_NEXT_CELL.decode(), quote_char=False, double_quote=False, ignore_empty_lines=False), csv.ConvertOptions(column_types=dict.fromkeys(columns, pa.string()), null_values=[_NO_CELL.decode()], strings_can_be_null=True, quoted_strings_can_be_null=True),
        )
    except (pa.ArrowInvalid, UnicodeDecodeError):
        return None
    for k, name in enumerate(columns):
        if pc.any(pc.match_substring(table[name], "&")).as_py():
            clear = [ElementTree.fromstring(f"<t>{x}</t>").text if x and "&" in x else x for x in table[name].to_pylist()]
            table = table.set_column(k, name, pa.array(clear, pa.string()))
    some = reduce(pc.or_, [pc.fill_null(pc.not_equal(c, ""), False) for c in table.columns])
    return table.filter(some)


def sheet_table(content: bytes, sheet: str, columns: list[str]) -> pa.Table:
    """These columns of a workbook's sheet as texts; a column that the sheet lacks is null."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        table = _text_table(_sheet_xml(book, sheet))
    if table is None:
        rows = sheet_rows(content, sheet)
        return pa.table({c: pa.array([row.get(c) for row in rows], pa.string()) for c in columns})
    return pa.table({c: table[c] if c in table.column_names else pa.nulls(len(table), pa.string()) for c in columns})


def _sheet_xml(book: zipfile.ZipFile, sheet: str) -> bytes:
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    load = lambda name: ElementTree.fromstring(book.read(name))
    targets = {e.get("Id"): e.get("Target") for e in load("xl/_rels/workbook.xml.rels")}
    sheets = {e.get("name"): next(v for k, v in e.attrib.items() if k.endswith("}id")) for e in load("xl/workbook.xml").iter() if local(e) == "sheet"}
    if sheet not in sheets:
        raise ValueError(f"no sheet {sheet}")
    target = targets[sheets[sheet]]
    return book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")


def sheet_rows(content: bytes, sheet: str) -> list[dict[str, str | None]]:
    """Rows of a workbook's sheet by the names in its first row; dates as ISO text. Reads the packaged XML alone."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = set(book.namelist())
        load = lambda name: ElementTree.fromstring(book.read(name))
        text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
        shared = [text(e) for e in load("xl/sharedStrings.xml") if local(e) == "si"] if "xl/sharedStrings.xml" in parts else []
        dated: set[int] = set()
        if "xl/styles.xml" in parts:
            styles = load("xl/styles.xml")
            own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iter() if local(e) == "numFmt"}
            for k, xf in enumerate(e for group in styles if local(group) == "cellXfs" for e in group):
                number = int(xf.get("numFmtId", 0))
                if 14 <= number <= 22 or 45 <= number <= 47 or re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(number, ""))):
                    dated.add(k)
        xml = _sheet_xml(book, sheet)
    plain = _plain_cells(xml)
    found = _parsed_cells(xml) if plain is None else plain
    clear = lambda x: ElementTree.fromstring(f"<t>{x}</t>").text if "&" in x else x
    table: list[dict[str, str | None]] = []
    places = [str(k) for k in range(max(map(len, found), default=0))]
    for row in found:
        cells: dict[str, str | None] = {}
        for place, (at, style, kind, value, inline) in zip(places, row):  # noqa: B905
            if kind == "inlineStr":
                raw = clear(inline)
            elif not value:
                raw = None
            elif kind == "s":
                raw = shared[int(value)]
            elif kind in ("", "n") and int(style or 0) in dated:
                moment = datetime(1899, 12, 30) + timedelta(seconds=round(float(value) * 86_400))
                raw = moment.strftime("%Y-%m-%d" if moment.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
            else:
                raw = clear(value)
            cells[at or place] = raw
        table.append(cells)
    if not table:
        return []
    named = [(at, name) for at, name in table[0].items() if name]
    return [{name: cells.get(at) for at, name in named} for cells in table[1:] if any(cells.values())]


def _workbooks(spark: SparkSession, paths: list[str], entity: str, sheet: str) -> DataFrame:
    """A task for each workbook; Spark reads the bytes, from any store."""
    columns = [name for name, _ in _columns(schemas.RAW[entity])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                table = sheet_table(content, sheet, columns)
                table = table.append_column("__file", pa.array([path.rsplit("/", 1)[-1]] * len(table), pa.string())).append_column("__order", pa.array(range(len(table)), pa.int64()))
                yield from table.combine_chunks().to_batches()

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(work, ", ".join(f"{c} string" for c in columns) + ", __file string, __order long")


def read_entity(spark: SparkSession, folder: str, entity: str, batch_id: str, at: str) -> DataFrame:
    """All files of an entity in a batch's folder, in the order of their names, with provenance."""
    paths = _found(spark, folder, entity)
    if entity == "patients":
        df = _delimited(spark, paths, entity, ",")
    elif entity == "encounters":
        df = _json_lines(spark, paths)
    elif entity == "lab_results":
        df = _delimited(spark, paths, entity, "|")
    else:
        readers = {"xlsx": lambda x: _workbooks(spark, x, entity, "claims"), "csv": lambda x: _delimited(spark, x, entity, ","), "parquet": lambda x: _placed(spark.read.parquet(*x))}
        frames = [_typed(read(some), entity) for suffix, read in readers.items() if (some := [p for p in paths if p.endswith(suffix)])]
        df = frames[0]
        for other in frames[1:]:
            df = df.unionByName(other)
    return _typed(df, entity).select("*", F.lit(batch_id).alias("batch_id"), F.col("__file").alias("source_file"), F.lit(at).alias("ingest_timestamp"), F.col("__order").alias("ingest_ordinal")).drop("__file", "__order")


def read_hospitals(spark: SparkSession, folder: str) -> DataFrame:
    if not files.exists(spark, path := f"{folder}/hospitals.csv"):
        raise FileNotFoundError(path)
    return spark.read.schema(schemas.HOSPITALS).option("header", True).option("escape", '"').csv(path)


def read_users(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON array of access entries, of the first file that is there."""
    for name in ("user_access.json", "user_access_json.txt"):
        if files.exists(spark, path := f"{folder}/{name}"):
            return spark.read.schema(schemas.USERS).option("multiLine", True).json(path)
    raise FileNotFoundError(f"no user access file in {folder}")


def batch_folder(spark: SparkSession, root: str, batch_id: str) -> str:
    """The folder named batch_id, else the first whose name begins with it and _, else with it."""
    wanted, there = batch_id.strip().lower(), files.names(spark, root, folders=True)
    for fits in (lambda n: n == wanted, lambda n: n.startswith(f"{wanted}_"), lambda n: n.startswith(wanted)):
        for name in there:
            if fits(name.lower()):
                return f"{root}/{name}"
    raise FileNotFoundError(f"no folder of {batch_id} in {root}")
