"""Token-ID output: documents as ids in files coded by a range asymmetric numeral system (rans.py).

Layout of a file: units, then the units' places (zlib) and a trailer. A unit holds whole documents, closes at
BLOCK_IDS ids or more, and is what a reader decodes at a time: a directory (zlib) of its documents, with their
ids, flags for null ids and token counts, then one block, or several where a document is very long. One
frequency table, counted over all documents, is a file of its own and serves all blocks.

Each writer task names its file by a fresh identifier and returns a row for each unit; Spark commits rows of
one attempt only, so that files of lost attempts are never referred to.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.llm import rans
from lakeward.llm.common import map_arrow, remove, shared_dir, written

MAGIC = b"LWTOKEN1"
BLOCK_IDS = 1 << 18
#: Entries of a worker's caches of encoded chunks and of encoded words (about 200 bytes each); emptied when full.
CHUNKS, WORDS = 700_000, 1_000_000
#: Characters that stand for the bytes in byte-level vocabularies: printable Latin-1 for itself, others from 256 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OF_BYTE = {b: chr(b) for b in _SELF} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _SELF)}
TRAILER = "<QQ8s"
TRAILER_SIZE = struct.calcsize(TRAILER)
#: Words whose normal form is their lower case: precomposed Latin letters, perhaps a run of common marks behind them.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,#$%&*]*)")


class WordEncoder(dict):
    """Ids (little-endian bytes) of a chunk between spaces, for tokenizers that drop white space.

    Such a tokenizer splits at white space before anything else, so a text's ids are those of its chunks.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.model = self.tokenizer.model
        # a plain word needs neither normaliser nor splitter; the model alone must give the same ids
        self.alone = all(self.word(x) == self.direct(x) for x in ("a", "the", "übergrößen", "élève", "ñandúes", "ingth"))
        # runs of letters and of marks are split apart, and no mark is kept from its neighbours
        self.apart = all(self.direct(f"the{x}") == self.direct("the") + self.direct(x) for x in (".", ",", "#", "$", "%", "&", "*", "###", "$$$", ",%%%", ".&", "*.", "#,$.%*&"))

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def direct(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, text: str) -> bytes:
        try:
            bare = text if text.isascii() else text.encode("utf-8").decode("latin-1").translate(_OF_BYTE)  # printable ASCII stands for itself
            return self.packed([x.id for x in self.model.tokenize(bare)])
        except Exception:  # noqa: BLE001  the model can't take a bare word: the whole tokenizer does
            return b""

    def part(self, text: str) -> bytes:
        if (known := self.parts.get(text)) is None:
            if len(self.parts) >= WORDS:
                self.parts.clear()
            known = self.parts[text] = self.word(text) if self.alone and text.isalpha() else self.direct(text)
        return known

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 64:
            return self.direct(chunk)
        if (plain := _PLAIN.fullmatch(chunk)) and (self.apart or len(plain[2]) < 2):
            ids = self.part(plain[1].lower()) + (self.part(plain[2]) if plain[2] else b"")
        else:
            ids = self.direct(chunk) if chunk else b""
        if len(self) >= CHUNKS:
            self.clear()
        self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian), the end id included. A null text has the end id alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        end, width = np.array([end_id], encoder.kind).tobytes(), np.dtype(encoder.kind).itemsize
        for batch in batches:
            ids = [encoder.text(text or "") + end for text in batch[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, n_tokens long, ids binary")



def frequencies(tokens: DataFrame, vocabulary: int, kind: str) -> np.ndarray:
    """Counts of all ids over all documents. What reaches the driver is bounded by the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch[0].to_pylist()), kind), minlength=vocabulary)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], ["id", "n"])

    total = np.zeros(vocabulary, np.int64)
    for row in map_arrow(tokens.select("ids"), work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[row["id"]] = row["n"]
    return total


UNITS = "part long, file string, at long, size long, n_docs long, first_id long, n_ids long"


def write_files(tokens: DataFrame, folder: str, table: bytes, kind: str) -> DataFrame:
    """Writes ids in ascending doc_id order, null first. Gives the units.

    Rows that repeat a doc_id are ordered by a hash of their ids, then by a row number (tokens has both as h and
    tag), which also lets them go to several files.
    """
    spark = tokens.sparkSession
    ties = ["doc_id", "h", "tag"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder = TaskContext.get().partitionId(), rans.Table.of(table)
        store, path = fs.FileSystem.from_uri(f"{folder}/{part:06d}-{uuid.uuid4().hex}.tok")
        doc_ids, counts, units, n_ids = [], [], [], 0
        with store.open_output_stream(path) as out:
            pending: list[bytes] = []
            held = 0

            def close() -> None:
                nonlocal pending, held, doc_ids, counts
                ids, at, n = np.frombuffer(b"".join(pending), kind), out.tell(), len(counts)
                known = np.array([x is not None for x in doc_ids], np.uint8)
                directory = zlib.compress(known.tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(counts, "<u8").tobytes())
                out.write(struct.pack("<II", n, len(directory)) + directory)
                step = BLOCK_IDS if len(ids) > 4 * BLOCK_IDS else max(1, len(ids))
                for k in range(0, len(ids), step):
                    block = rans.encode(ids[k : k + step], coder)
                    out.write(struct.pack("<Q", len(block)) + block)
                units.append((at, out.tell() - at, n, n_ids - len(ids), len(ids)))
                pending, held, doc_ids, counts = [], 0, [], []

            for batch in batches:
                for doc_id, n, ids in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].to_pylist(), strict=True):
                    if held and held + n > 2 * BLOCK_IDS:
                        close()
                    doc_ids.append(doc_id)
                    counts.append(n)
                    pending.append(ids)
                    held += n
                    n_ids += n
                    if held >= BLOCK_IDS:
                        close()
            if pending:
                close()
            at = out.tell()
            out.write(zlib.compress(np.array(units, "<u8").tobytes()) + struct.pack(TRAILER, at, len(units), MAGIC))
        columns = list(zip(*units, strict=True)) or [[]] * 5
        n = len(units)
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([path.rsplit("/", 1)[1]] * n, pa.string()), *(pa.array(x, pa.int64()) for x in columns)], [x.split()[0] for x in UNITS.split(", ")])

    dealt = tokens.repartitionByRange(parts, *ties).sortWithinPartitions(*ties)
    return map_arrow(dealt.select("doc_id", "n_tokens", "ids"), work, UNITS)


def read_files(units: DataFrame, folder: str, digest: bool = True) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens and ids_crc32, or the ids themselves."""
    spark = units.sparkSession
    before = units.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = units.join(before, "part").repartition(parts, F.xxhash64("file", "at"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{where}/table") as file:
            coder = rans.Table.of(file.read())
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{where}/{row['file']}") as file:
                    if struct.unpack(TRAILER, file.read_at(TRAILER_SIZE, file.size() - TRAILER_SIZE))[2] != MAGIC:
                        raise ValueError(f"{row['file']} is not a token file")
                    data = file.read_at(row["size"], row["at"])
                n_docs, k = struct.unpack_from("<II", data)
                directory, k = zlib.decompress(data[8 : 8 + k]), 8 + k
                known = np.frombuffer(directory, np.uint8, n_docs)
                doc_ids = np.frombuffer(directory, "<i8", n_docs, n_docs)
                counts = np.frombuffer(directory, "<u8", n_docs, 9 * n_docs).astype(np.int64)
                blocks = []
                while k < len(data):
                    size = struct.unpack_from("<Q", data, k)[0]
                    blocks.append(rans.decode(data[k + 8 : k + 8 + size], coder))
                    k += 8 + size
                ids = np.concatenate(blocks)
                ends = np.cumsum(counts)
                texts = [ids[end - n : end].astype("<u4").tobytes() for end, n in zip(ends, counts, strict=True)]
                start = row["base"] + row["first_id"] + ends - counts
                last = pa.array([zlib.crc32(x) for x in texts], pa.int64()) if digest else pa.array(texts, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=known == 0), pa.array(start, pa.int64()), pa.array(counts, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return map_arrow(wanted, work, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Writes the files and gives their folder and units; read_files() reads them back.

    A null text counts as empty; rows that repeat a doc_id are all written, in order of their ids; null
    doc_ids come first. Other columns are ignored. An empty table gives a folder without documents.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens"
    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    scratch = shared_dir(spark)
    tokens = tokenised(docs, tokenizer_path, end_id, id_col, text_col)
    tokens = written(tokens.withColumns({"h": F.xxhash64("ids"), "tag": F.monotonically_increasing_id()}), "ids", scratch)
    table = rans.Table(rans.scaled(frequencies(tokens, size, kind))).bytes()
    store, where = fs.FileSystem.from_uri(folder)
    store.create_dir(where)
    with store.open_output_stream(f"{where}/table") as out:
        out.write(table)
    units = written(write_files(tokens, folder, table, kind), "units", folder)
    remove(spark, scratch)
    return folder, units


def token_digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    folder, units = token_output(docs, tokenizer_path, end_id)
    return read_files(units, folder)
