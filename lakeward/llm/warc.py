"""WARC archives: writing, normalising of monolithic gzip files, and reading by offset.

write() puts the records of a partition into one gzip stream, as crawlers and re-compressors often leave them.
normalise() inflates such a stream once, from start to end, and rewrites every record as a gzip member of its
own, with a sidecar index of offsets, so that any record can be read alone. read() uses nothing but the index
and the members. Records are streamed: no task holds more than a piece of a record, but for read(), which
holds one record.

Each task names its files by a fresh identifier and returns them as rows; Spark commits rows of one attempt
only, so that files of lost attempts are never referred to.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import map_arrow, raw, shared_dir, written

#: Payloads below this size are always stored.
LEAST_REVISIT = 1000
#: Revisits whose keys a task holds to tell them from responses; beyond that, payloads are shuffled to their decisions.
MOST_KEYS = 1 << 23
#: Records that one row of the work list covers when archives are read back.
RUN = 256
PIECE = 1 << 20
DATE = "2026-01-01T00:00:00Z"
RAW = "file string, records long"
RUNS = "file string, sidecar string, records long, at long, size long, index_at long, index_size long"


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _head(page_id: int | None, url: str | None, n: int, digest: str, refers_to: int | None, revisit: bool) -> tuple[bytes, bytes]:
    """Header of a record, and the HTTP header that begins its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    target = urllib.parse.quote(url or "urn:none", safe="!#$%&'()*+,/:;=?@[]~")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n)}", "", ""]
    return "\r\n".join(lines).encode(), http


def decided(pages: DataFrame, least: int = LEAST_REVISIT, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, DataFrame, str | None]:
    """Pages that may be responses, those that are revisits, and where to find the keys by which write() drops the latter from the former.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response; rows that repeat that
    page_id are all responses. A null page_id counts as smallest. Revisits come from a table of digests, as they
    need no payload, and tasks hold payloads against their keys, 8 bytes each: payloads are shuffled only where
    the keys are more than MOST_KEYS, and then none are given.
    """
    root = shared_dir(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    light = written(rows.select("page_id", "url", "digest", "n").where(F.col("n") >= least), "digests", root)
    groups = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to")
    revisits = written(light.join(groups, "digest").where("page_id is null or page_id < refers_to").select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "refers_to", "n"), "revisits", root)
    responses = rows.select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to"), "n")
    pairs = revisits.select(F.col("page_id").alias("its_id"), F.col("digest").alias("its_digest")).distinct()
    those = F.col("page_id").eqNullSafe(F.col("its_id")) & (F.col("digest") == F.col("its_digest"))
    found = pairs.count()
    if found > MOST_KEYS:
        return responses.join(pairs, those, "left_anti"), revisits, None
    if not found:
        return responses, revisits, None
    others = light.join(pairs, those, "left_anti")
    for salt in itertools.count():  # until no other page of that size has a revisit's key
        keys = written(pairs.select(_key(salt, "its_id", "its_digest")).distinct(), f"keys_{salt}", root)
        if others.select(_key(salt, "page_id", "digest")).join(keys, "key", "left_semi").isEmpty():
            return responses.withColumn("key", F.when(F.col("n") >= least, _key(salt, "page_id", "digest"))), revisits, f"{root}/keys_{salt}"


def _key(salt: int, page_id: str, digest: str) -> Column:
    return F.xxhash64(F.lit(salt), page_id, digest).alias("key")


def _keys(uri: str) -> np.ndarray:
    """Keys of a table of the shared folder, sorted."""
    store, path = fs.FileSystem.from_uri(uri)
    names = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.endswith(".parquet")]
    return np.sort(np.concatenate([parquet.read_table(store.open_input_file(n), columns=["key"])["key"].to_numpy() for n in names]))


def write(records: DataFrame, folder: str, dropped: str | None = None) -> DataFrame:
    """Writes each partition's records as one gzip stream, but those whose key is in the table dropped; gives the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(f"{folder}/{uuid.uuid4().hex}.warc.gz")
        count, out, pack, keys = 0, None, zlib.compressobj(1, zlib.DEFLATED, 31), None
        for batch in batches:
            if dropped:
                keys = _keys(dropped) if keys is None else keys
                own = batch[6].fill_null(0).to_numpy()
                there = keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own
                batch = batch.filter(pa.array(~there | batch[6].is_null().to_numpy(zero_copy_only=False)))
            columns = (batch[0].to_pylist(), batch[1].to_pylist(), raw(batch[2]), batch[3].to_pylist(), batch[4].to_pylist(), batch[5].to_pylist())
            for page_id, url, payload, digest, refers_to, n in zip(*columns, strict=True):
                out = out or store.open_output_stream(path, compression=None)
                head, http = _head(page_id, url, n, digest, refers_to, refers_to is not None)
                body = http if refers_to is not None else http + payload
                out.write(pack.compress(head + body + b"\r\n\r\n"))
                count += 1
        if out:
            out.write(pack.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]]), pa.array([count], pa.int64())], ["file", "records"])

    return map_arrow(records, work, RAW)


class Inflated:
    """Bytes of a gzip stream of one member or several, read in order."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.unpack, self.rest, self.held = stream, zlib.decompressobj(31), b"", bytearray()

    def fill(self) -> bool:
        if self.unpack.eof:
            self.rest = self.unpack.unused_data
            self.unpack = zlib.decompressobj(31)
        data = self.unpack.unconsumed_tail or self.rest or self.stream.read(PIECE)
        self.rest = b""
        if not data:
            return False
        self.held += self.unpack.decompress(data, PIECE)
        return True

    def until(self, end: bytes) -> bytes | None:
        """Through the next ``end``; None at the end of the stream."""
        looked = 0
        while (at := self.held.find(end, max(0, looked - len(end)))) < 0:
            looked = len(self.held)
            if not self.fill():
                if self.held:
                    raise ValueError("a record is cut off")
                return None
        return self.take(at + len(end))

    def take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.fill():
                raise ValueError("a record is cut off")
            if self.held:
                piece = self.take(min(n, PIECE))
                n -= len(piece)
                yield piece


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites each file with a gzip member for each record and a sidecar of offsets; gives runs of records to read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch[0].to_pylist():
                own = f"{uuid.uuid4().hex}"
                runs, at, n = [], 0, 0
                with store.open_input_stream(f"{where}/{name}", compression=None) as file, store.open_output_stream(f"{where}/{own}.members.warc.gz", compression=None) as out, store.open_output_stream(f"{where}/{own}.idx", compression=None) as index:
                    source = Inflated(file)
                    while (head := source.until(b"\r\n\r\n")) is not None:
                        about = fields(head)
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        out.write(pack.compress(head))
                        for piece in source.exactly(int(about["content-length"]) + 4):
                            out.write(pack.compress(piece))
                        out.write(pack.flush())
                        entry = {"offset": at, "length": out.tell() - at, "type": about.get("warc-type"), "id": about.get("warc-record-id"), "uri": about.get("warc-target-uri"), "digest": about.get("warc-payload-digest")}
                        if n % RUN == 0:
                            runs.append([f"{own}.members.warc.gz", f"{own}.idx", 0, at, 0, index.tell(), 0])
                        line = json.dumps(entry).encode() + b"\n"
                        index.write(line)
                        for k, grown in ((2, 1), (4, entry["length"]), (6, len(line))):
                            runs[-1][k] += grown
                        at, n = out.tell(), n + 1
                if runs:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*runs, strict=True)], [x.split()[0] for x in RUNS.split(", ")])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(files.select("file").repartition(parts, "file"), work, RUNS)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(runs: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row for each record, from members found by the index. A response's payload is checked against its digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for run in batch.to_pylist():
                with store.open_input_file(f"{where}/{run['sidecar']}") as file:
                    entries = [json.loads(x) for x in file.read_at(run["index_size"], run["index_at"]).splitlines()]
                rows = []
                with store.open_input_file(f"{where}/{run['file']}") as file:
                    for entry in entries:
                        record = zlib.decompress(file.read_at(entry["length"], entry["offset"]), 31)
                        head, _, block = record.partition(b"\r\n\r\n")
                        about = fields(head)
                        http, _, payload = block[: int(about["content-length"])].partition(b"\r\n\r\n")
                        revisit = about["warc-type"] == "revisit"
                        digest = base64.b32decode(about["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{about['warc-record-id']} does not match its digest")
                        n = int(fields(http)["content-length"]) if revisit else len(payload)
                        refers_to = int(about["refers-to-page-id"]) if revisit else None
                        rows.append((int(about["page-id"]) if about["page-id"] else None, n, digest, about["warc-type"], refers_to, payload if payloads and not revisit else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])

    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(runs.repartition(parts, F.xxhash64("file", "at")), work, READ)


def archive(pages: DataFrame, folder: str | None = None, **columns: object) -> tuple[str, DataFrame]:
    """Writes and normalises the archives of pages; gives their folder and the runs of records for read().

    A null payload counts as empty, a null url as urn:none. Other columns are ignored; empty tables give no
    archive.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc"
    store, where = fs.FileSystem.from_uri(folder)
    store.create_dir(where)
    responses, revisits, keys = decided(pages, **columns)
    files = written(write(responses, folder, keys).unionByName(write(revisits, folder)), "files", folder)
    return folder, written(normalise(files, folder), "runs", folder)
