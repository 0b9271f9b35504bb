"""Exact deduplication by Grace hashing.

Records are partitioned by a hash of their whole content; a bucket that does not fit the memory budget is
partitioned again, into spill files, by other bits of the hash, until it fits an open-addressing table.
The table compares complete contents, so neither a hash nor a digest decides equality.

Two rounds keep hot groups apart: each input partition first reduces its own rows to one representative for
each distinct content, then only representatives are shuffled. A group with a third of all rows thus reaches
its reducer as one row for each input partition.

Spill files belong to one task, lie in Spark's own spill folder and are deleted when the task ends; no other
task reads them. A lost executor only repeats its tasks.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import map_arrow, parts_for, raw, shared_dir, written

#: Bytes of content that one open-addressing table holds before its bucket is partitioned again.
MEMORY_BYTES = 96 << 20
#: Files of one round of partitioning, and bits of the hash that choose among them.
FANOUT_BITS = 4
#: Rows of one table that are held in memory (32 bytes each).
HELD_ROWS = 1 << 20
_HEAD = struct.Struct("<QqqqI")


class OpenTable:
    """Open addressing with linear probing; each slot holds an entry's number, entries hold whole contents."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64).tolist()
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.best: list[tuple] = []
        self.sizes: list[int] = []

    def add(self, h: int, content: bytes, best: tuple, size: int) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                self.best[entry] = max(self.best[entry], best)
                self.sizes[entry] += size
                return entry
            at = (at + 1) & mask
        entry = len(self.contents)
        self.slots[at] = entry
        self.hashes.append(h)
        self.contents.append(content)
        self.best.append(best)
        self.sizes.append(size)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


class Rows:
    """(entry, tag, rank, size) of a table's rows: packed, and beyond HELD_ROWS in a spill file, so that rows of one content are no burden."""

    packed = struct.Struct("<qqqq")

    def __init__(self, folder: str | None) -> None:
        self.folder, self.file, self.held, self.n = folder, None, bytearray(), 0

    def append(self, entry: int, tag: int, rank: int, size: int) -> None:
        self.held += self.packed.pack(entry, tag, rank, size)
        self.n += 1
        if len(self.held) >= HELD_ROWS * self.packed.size:
            self.file = self.file or tempfile.TemporaryFile(prefix="grace-", dir=self.folder)
            self.file.write(self.held)
            self.held.clear()

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[tuple[int, int, int, int]]:
        if self.file:
            self.file.seek(0)
            while part := self.file.read(1000 * self.packed.size):
                yield from self.packed.iter_unpack(part)
        yield from self.packed.iter_unpack(bytes(self.held))


#: A record: (hash, tag, rank, size, content). rank orders equal contents, the largest stays; tag names the row.
Record = tuple[int, int, int, int, bytes]


def _spilled(path: str) -> Iterator[Record]:
    with open(path, "rb") as file:
        while head := file.read(_HEAD.size):
            h, tag, rank, size, n = _HEAD.unpack(head)
            yield h, tag, rank, size, file.read(n)


def grace(records: Iterable[Record], memory: int = MEMORY_BYTES, folder: str | None = None, depth: int = 0) -> Iterator[tuple[OpenTable, Rows]]:
    """Yields tables of distinct contents with their rows as (entry, tag, rank, size).

    Past the memory budget of distinct contents, everything is dealt to spill files by bits of the hash that
    earlier rounds have not used. When all bits are used the contents are equal or collide in 64 bits; the
    table then grows.
    """
    table, rows, held = OpenTable(), Rows(folder), 0
    records = iter(records)
    bits_left = 64 - FANOUT_BITS * (depth + 1) >= 0
    for h, tag, rank, size, content in records:
        known = len(table.contents)
        entry = table.add(h, content, (rank, tag), size)
        rows.append(entry, tag, rank, size)
        held += len(content) + 360 if entry == known else 0
        if held > memory and bits_left and len(table.contents) > 1:
            break
    else:
        yield table, rows
        return
    own = tempfile.mkdtemp(prefix="grace-", dir=folder)
    try:
        shift = 64 - FANOUT_BITS * (depth + 1)
        paths = [os.path.join(own, str(k)) for k in range(1 << FANOUT_BITS)]
        files = [open(path, "wb", buffering=1 << 18) for path in paths]

        def deal(h: int, tag: int, rank: int, size: int, content: bytes) -> None:
            files[h >> shift & (1 << FANOUT_BITS) - 1].write(_HEAD.pack(h, tag, rank, size, len(content)) + content)

        for entry, tag, rank, size in rows:
            deal(table.hashes[entry], tag, rank, size, table.contents[entry])
        del table, rows
        for record in records:
            deal(*record)
        for file in files:
            file.close()
        for path in paths:
            yield from grace(_spilled(path), memory, own, depth + 1)
            os.remove(path)
    finally:
        shutil.rmtree(own, ignore_errors=True)


def _scratch() -> str | None:
    """Spark's spill folder of this executor."""
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return local if local and os.path.isdir(local) else None


_NONE = -(1 << 63)


def _chunks(table: OpenTable, rows: Rows) -> Iterator[list[tuple[int, int, int, int]]]:
    """Rows some at a time: at most 2,000, fewer where contents are long."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(table.contents[row[0]])
        if len(part) == 2000 or size > 8 << 20:
            yield part
            part, size = [], 0
    if part:
        yield part


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each input row; the row that leads its content in this partition carries the content."""

    def records() -> Iterator[Record]:
        for batch in batches:
            for tag, rank, content in zip(batch[0].to_pylist(), batch[1].to_pylist(), raw(batch[2]), strict=True):
                yield xxhash.xxh3_64_intdigest(content), tag, _NONE if rank is None else rank, 1, content

    for table, rows in grace(records(), folder=_scratch()):
        for part in _chunks(table, rows):
            lead = [table.best[entry] == (rank, tag) for entry, tag, rank, _ in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rank if rank != _NONE else None for _, _, rank, _ in part], pa.int64()),
                    pa.array([table.best[entry][1] for entry, *_ in part], pa.int64()),
                    pa.array([table.sizes[entry] if first else None for (entry, *_), first in zip(part, lead, strict=True)], pa.int64()),
                    pa.array([table.contents[entry] if first else None for (entry, *_), first in zip(part, lead, strict=True)], pa.binary()),
                ],
                ["id", "lead", "size", "content"],
            )


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each representative: the class it belongs to."""

    def records() -> Iterator[Record]:
        for batch in batches:
            for rank, lead, size, content in zip(*(batch[k].to_pylist() for k in range(4)), strict=True):
                yield xxhash.xxh3_64_intdigest(content), lead, _NONE if rank is None else rank, size, content

    for table, rows in grace(records(), folder=_scratch()):
        digests = [hashlib.sha256(content).hexdigest() for content in table.contents]
        for part in _chunks(table, rows):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([tag for _, tag, _, _ in part], pa.int64()),
                    pa.array([table.best[entry][0] if table.best[entry][0] != _NONE else None for entry, *_ in part], pa.int64()),
                    pa.array([table.best[entry][1] for entry, *_ in part], pa.int64()),
                    pa.array([table.sizes[entry] for entry, *_ in part], pa.int64()),
                    pa.array([digests[entry] for entry, *_ in part], pa.string()),
                ],
                ["lead", "keep_id", "keep_lead", "group_size", "text_sha256"],
            )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Contents are equal when identical as they stand; a null text counts as empty. Of equal contents the row
    with the largest id stays; a null id counts as smallest. Where several rows repeat the largest id, exactly
    one of them is kept. Other columns are ignored, so their names may clash with anything; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    root = shared_dir(spark)
    tagged = docs.select(F.monotonically_increasing_id().alias("tag"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content"))
    local = written(map_arrow(tagged, _local, "id long, lead long, size long, content binary"), "local", root)
    leaders = local.where("size is not null").select("id", "lead", "size", "content")
    dealt = leaders.repartition(parts_for(leaders), F.xxhash64("content"))
    classes = map_arrow(dealt, _classes, "lead long, keep_id long, keep_lead long, group_size long, text_sha256 string")
    members = local.select("id", "lead", F.col("size").isNotNull().alias("first"))
    return members.join(classes, "lead").select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("first") & (F.col("lead") == F.col("keep_lead"))).alias("kept"), "text_sha256"
    )
