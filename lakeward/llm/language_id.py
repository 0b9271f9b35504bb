"""Language identification by compression.

For each language a zstandard dictionary of raw content is made of labelled texts. A text is compressed in
pieces with every dictionary; the language whose dictionary gives the smallest total wins, and a prediction
whose margin over the second is narrow is rejected. All words of the whole text are compressed, a repeated word
once; sizes add up over pieces, so a long text does not outgrow its dictionary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.llm.common import map_arrow, sampled, shared_dir, written

#: The fit's bound: distinct labelled texts, whole, for each language.
SAMPLE_DOCS = 300
#: A dictionary holds the language's commonest words up to this many bytes; MOST_WORDS is more than fit.
DICTIONARY_BYTES, MOST_WORDS = 112 << 10, 60_000
#: A piece is short enough for zstandard to search the dictionary in place.
PIECE = 8 << 10
LEVEL, SHORT_LEVEL, SHORT = 3, 19, 512
#: Bytes, and part of the text's bytes, by which the best must beat the second.
MARGIN_BYTES, MARGIN_SHARE = 1, 0.002
UNKNOWN = "und"
#: Begins a short text's piece: a run that compresses to a few bytes, so that zstandard does not store the piece
#: uncompressed, in which case no dictionary would show.
CARRIER = b"." * 1024
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")


def letters(text: str) -> bytes:
    """The whole text's lower-cased words, each at its first place: else repeated lines would outweigh their language."""
    return f" {' '.join(dict.fromkeys(_WORD.findall(text.lower())))} ".encode("utf-8", "surrogatepass")


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language of the rows that ``learn`` marks, the commonest language first.

    Of each language the SAMPLE_DOCS distinct texts with the smallest 64-bit hashes are drawn, or all if there
    are fewer. The dictionary holds the words that most of them hold, the commonest at its end, where zstandard
    refers to them by the shortest offsets. Rows with a null language, and texts that are null or have no
    letter, teach nothing; an empty table gives no dictionaries.
    """
    root = shared_dir(docs.sparkSession)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.rlike(text_col, F.lit(r"\p{L}"))).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit("language"), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    counts = {r["lang"]: (r["n"], r["d"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("d")).collect()}
    if not counts:
        return {}
    drawn = F.lit(False)
    for lang, (_, distinct) in counts.items():
        drawn = drawn | ((F.col("lang") == lang) & sampled(F.col("h"), 4 * SAMPLE_DOCS, distinct))
    texts = written(rows.where(drawn).groupBy("lang", "h").agg(F.min("text").alias("text")), "sample", root)
    few = texts.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "h"))).where(F.col("nth") <= SAMPLE_DOCS)
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))))
    common = few.select("lang", words.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    common = common.withColumn("nth", F.row_number().over(first)).withColumn("bytes", F.sum(F.octet_length("word") + 1).over(first.rowsBetween(Window.unboundedPreceding, 0)))
    found: dict[str, list[str]] = {lang: [] for lang in counts}
    for row in common.where((F.col("nth") <= MOST_WORDS) & (F.col("bytes") <= DICTIONARY_BYTES - 2)).orderBy("lang", "nth").select("lang", "word").collect():
        found[row["lang"]].append(row["word"])
    order = sorted(counts, key=lambda lang: (-counts[lang][0], lang))
    return {lang: f" {' '.join(reversed(found[lang]))} ".encode() for lang in order}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = list(dictionaries)
        self.contents = list(dictionaries.values())

        def made(level: int) -> list[zstandard.ZstdCompressor]:
            raws = [zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in self.contents]
            for x in raws:
                x.precompute_compress(level=level)
            return [zstandard.ZstdCompressor(level=level, dict_data=x, write_content_size=True) for x in raws]

        self.long, self.short = made(LEVEL), made(SHORT_LEVEL)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow. Null, or without a letter: und, 0, rejected."""
        if not text or not _LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0, True
        data = letters(text)
        tools = self.long
        if len(data) <= SHORT:
            data, tools = CARRIER + data, self.short
        view = memoryview(data)
        sizes = [sum(len(tool.compress(view[k : k + PIECE])) for k in range(0, len(data), PIECE)) for tool in tools]
        best = min(sizes)
        tied = [k for k, size in enumerate(sizes) if size == best]
        if len(tied) > 1:  # as small with several: the dictionary that holds more of the words, then the commoner language
            words = data.removeprefix(CARRIER).split()
            tied.sort(key=lambda k: (-sum(b" " + word + b" " in self.contents[k] or (word in self.contents[k]) * 0.5 for word in words), k))
        rest = [size for k, size in enumerate(sizes) if k != tied[0]]
        margin = min(rest) - best if rest else best
        score = 1.0 / (1.0 + sum(2.0 ** -min(1000.0, float(size - best)) for size in rest))
        return self.languages[tied[0]], score, margin < MARGIN_BYTES or margin < MARGIN_SHARE * best


_known: dict[tuple, Classifier] = {}


def _classifier(dictionaries: dict[str, bytes]) -> Classifier:
    key = tuple((lang, hash(x)) for lang, x in dictionaries.items())
    if key not in _known:
        _known.clear()
        _known[key] = Classifier(dictionaries)
    return _known[key]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """All columns of docs as ``doc``, with lang_pred, score and rejected.

    A text that is null or has no letter is und with score 0 and rejected; so is every text if nothing could be
    learned. Sizes that tie go to the dictionary that holds more of the text's words, then to the commoner
    language, and are rejected. Repeated rows are each predicted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    schema = f"doc {docs.select(F.struct('*').alias('doc')).schema['doc'].dataType.simpleString()}, lang_pred string, score double, rejected boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = _classifier(shared.value)
        for batch in batches:
            found = [classifier.predict(text) for text in batch[1].to_pylist()]
            columns = zip(*found, strict=True) if found else ((), (), ())
            made = [pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch[0], *made], ["doc", "lang_pred", "score", "rejected"])

    return map_arrow(docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text")), work, schema)
