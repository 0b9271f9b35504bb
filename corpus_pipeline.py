"""A corpus pipeline: language ID, near-duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet before the next one reads it. All
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.llm import decontaminate, language_id, mixing, simhash, token_files
from lakeward.llm.common import bounded, shared_dir, table, written

#: No stage after the first can be stated without the first, and compression can't be stated in SQL.
ORACLE_SQL = None

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told by a clear margin; dictionaries come from the labelled documents.

    Texts that are null or have no letter have no language and go. Other columns stay as they are, whatever
    their names; an empty table stays empty, and one without labels loses all its rows.
    """
    found = language_id.identify(docs, language_id.fit(docs, F.lit(True)))
    return found.where("not rejected").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: that with the smallest doc_id, of rows that repeat it the first.

    Null doc_ids come last. Texts without words are one group. Other columns stay, whatever their names; an
    empty table stays empty.
    """
    packed = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))  # a text is stored once, within its row
    numbered = written(packed, "numbered", shared_dir(spark)).withColumn("its_id", F.col("doc.doc_id"))
    groups = simhash.near_duplicates(numbered.select("row", "doc.text"), id_col="row").select(F.col("row").alias("its_row"), "component_id")
    named = numbered.select("its_id", "row").join(groups, F.col("row") == F.col("its_row"))
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("its_id").isNull().alias("none"), "its_id", "row"))["row"].alias("kept_row"))
    return marked(numbered, kept).select("doc.*")


def marked(numbered: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of numbered whose row is a kept_row, found in bitmaps of 32,768 rows each, so that texts are not shuffled."""
    bits = kept.groupBy(F.bitmap_bucket_number("kept_row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("kept_row")).alias("bits"))
    bits, at = bounded(written(bits, "kept", shared_dir(kept.sparkSession))), F.bitmap_bit_position("row")
    byte = F.conv(F.hex(F.substr("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = numbered.join(bits, F.bitmap_bucket_number("row") == F.col("bucket"))
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("bucket", "bits")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a window of a benchmark item, each by its own text: doc_ids may be null or repeat.

    Null texts have no words and stay. Other columns stay, whatever their names; an empty table stays empty.
    """
    packed = docs.select(F.struct("*").alias("doc"), "text", F.lit(0).alias("any_id"))
    found = decontaminate.phrase_matches(packed, table(spark, sf_dir, "benchmark"), id_col="any_id", keep=["doc"])
    return found.where(F.size("hits") == 0).select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null texts have no words and are taken as often as their source is as a whole."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and returns the digest of what they hold, a row for each row of docs; a null text is empty."""
    return token_files.token_digests(spark, docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminated), ("mixing sources to target weights", mixed), ("token-ID output", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}", root)
    return docs
