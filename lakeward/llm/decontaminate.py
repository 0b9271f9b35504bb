"""Benchmark decontamination by a distributed positional inverted index. DataFrame operations only.

The index holds postings (term, document, position) of the training tokens for all terms of the test set, in
segments: each input partition writes its own postings, sorted by term, without a shuffle. Frequencies of the
terms come from the index. For each window of a test item the two rarest terms are looked up; their postings,
less the terms' offsets in the item, must agree on the place where the item would begin. Places that survive
the intersection are compared word by word, so that matches are exact.

Words are runs of letters a to z after lower-casing A to Z, digits and characters beyond ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import bounded, remove, shared_dir, written

#: ASCII characters that separate words, before lower-casing.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a window; an item of fewer words is one window.
WINDOW = 10
#: Places to verify are broadcast up to this many bytes of their words, and joined by shuffle beyond.
BROADCAST_BYTES = 8 << 20


def words(text: Column) -> Column:
    """Words in order, in their own case; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased, nothing else; most words are in lower case already and are not rewritten."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def _key(text: Column) -> Column:
    """What postings call a document by: equal texts have the same matches, and texts that share a hash are told apart word by word."""
    return F.xxhash64(text)


@dataclass
class Index:
    """postings: term_id, key (a hash of the document's text), pos; items: item, item_id, words; places: item, p, term_id, freq."""

    postings: DataFrame
    items: DataFrame
    places: DataFrame
    root: str


def build_index(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> Index:
    """The index of docs for the terms of benchmark. Null texts and items have no words; empty tables give an empty index."""
    root = shared_dir(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.transform(words(F.col(text_col)), lower_ascii).alias("words"))
    items = written(items.where(F.size("words") > 0).distinct().withColumn("item", F.monotonically_increasing_id()), "items", root)
    at = items.select("item", F.posexplode("words").alias("p", "term"))
    terms = written(at.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms", root)
    tokens = docs.select(_key(F.col(text_col)).alias("key"), F.posexplode(words(F.col(text_col))).alias("pos", "word")).withColumn("term", lower_ascii(F.col("word")))
    postings = tokens.join(bounded(terms), "term").select("term_id", "key", "pos").sortWithinPartitions("term_id", "key", "pos")
    postings = written(postings, "postings", root)
    freq = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("freq"))
    known = terms.join(freq, "term_id", "left").select("term", "term_id", F.coalesce("freq", F.lit(0)).alias("freq"))
    places = written(at.join(known, "term").select("item", "p", "term_id", "freq"), "places", root)
    return Index(postings, items, places, root)


def rarest(index: Index, window: int = WINDOW) -> DataFrame:
    """item, start, n (words in the window), and its two rarest terms: p1, t1, p2, t2. Windows with an absent term are left out."""
    rows = index.places.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("p", "freq", "term_id"))).alias("w"))
    rows = rows.withColumn("n", F.least(F.size("w"), F.lit(window)))
    starts = rows.select("item", "n", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("start"))
    ranked = F.array_sort(F.transform(F.slice("w", F.col("start") + 1, F.col("n")), lambda x: F.struct(x["freq"].alias("freq"), x["p"].alias("p"), x["term_id"].alias("t"))))
    found = starts.select("item", "start", "n", ranked.alias("r")).where(F.col("r")[0]["freq"] > 0)
    second = F.element_at("r", F.least(F.lit(2), F.size("r")))
    return found.select("item", "start", "n", F.col("r")[0]["p"].alias("p1"), F.col("r")[0]["t"].alias("t1"), second["p"].alias("p2"), second["t"].alias("t2"))


def candidates(index: Index, window: int = WINDOW) -> DataFrame:
    """key, item, shift: where the offset-adjusted lists of a window's two rarest terms meet."""
    pairs = written(rarest(index, window).select("item", "p1", "t1", "p2", "t2").distinct(), "pairs", index.root)
    sought = pairs.select("item", F.col("p1").alias("p"), F.col("t1").alias("term_id")).union(pairs.select("item", "p2", "t2")).distinct()
    sought = written(sought, "sought", index.root)
    hits = index.postings.join(bounded(sought), "term_id").select("key", "item", (F.col("pos") - F.col("p")).alias("shift"), "p")
    met = hits.groupBy("key", "item", "shift").agg(F.collect_set("p").alias("found"))
    wanted = written(pairs.groupBy("item").agg(F.collect_set(F.struct("p1", "p2")).alias("pairs")), "wanted", index.root)
    both = F.exists("pairs", lambda x: F.array_contains("found", x["p1"]) & F.array_contains("found", x["p2"]))
    return met.join(bounded(wanted), "item").where(both).select("key", "item", "shift")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", keep: list[str] | None = None) -> DataFrame:
    """One row for each document: its id, n_words, hits (distinct positions of words in a window's occurrence) and items (sorted).

    A null text has no words, an item without words no window. Items that repeat an item_id count once. Rows
    that repeat a doc_id, or have none, are each matched by their own text. Columns in keep follow as they are,
    others are ignored; empty tables give no matches. Very long texts are matched whole.
    """
    kept = [F.col(c) for c in keep or []]
    index = build_index(docs, benchmark, text_col, item_col)
    places = candidates(index, window).join(index.items.select("item", "item_id", F.col("words").alias("its")), "item")
    places = written(places.groupBy("key").agg(F.collect_list(F.struct("item_id", "shift", "its")).alias("places")), "candidates")
    remove(docs.sparkSession, index.root)  # only the places are read from here on
    size = places.select(F.sum(F.octet_length(F.to_json("places")))).first()[0] or 0
    texts = docs.select(F.col(id_col).alias("doc_id"), _key(F.col(text_col)).alias("its_key"), words(F.col(text_col)).alias("own"), *kept)
    right = F.broadcast(places) if size <= BROADCAST_BYTES else places
    joined = texts.join(right, F.col("its_key") == F.col("key"), "left")
    joined = joined.select("doc_id", F.size("own").alias("n_words"), "places", F.when(F.col("places").isNotNull(), F.transform("own", lower_ascii)).alias("w"), *kept)

    def starts(x: Column) -> Column:
        n = F.least(F.size(x["its"]), F.lit(window))
        inside = lambda s: (x["shift"] + s >= 0) & (x["shift"] + s + n <= F.size("w"))
        same = lambda s: F.slice("w", F.greatest(x["shift"] + s, F.lit(0)) + 1, n) == F.slice(x["its"], s + 1, n)
        return F.filter(F.sequence(F.lit(0), F.size(x["its"]) - n), lambda s: inside(s) & same(s))

    found = F.transform("places", lambda x: F.struct(x["item_id"].alias("item_id"), x["shift"].alias("shift"), F.least(F.size(x["its"]), F.lit(window)).alias("n"), starts(x).alias("starts")))
    matched = joined.select("doc_id", "n_words", F.filter(found, lambda x: F.size(x["starts"]) > 0).alias("m"), *kept)
    positions = F.flatten(F.transform("m", lambda x: F.flatten(F.transform(x["starts"], lambda s: F.sequence(x["shift"] + s, x["shift"] + s + x["n"] - 1)))))
    none, no_item = F.array().cast("array<int>"), F.array().cast("array<string>")
    return matched.select(
        F.col("doc_id").alias(id_col), "n_words", F.coalesce(F.array_sort(F.array_distinct(positions)), none).alias("hits"), F.coalesce(F.sort_array(F.array_distinct(F.transform("m", lambda x: x["item_id"]))), no_item).alias("items"), *kept
    )


def proximity_matches(index: Index, span: int, window: int = WINDOW) -> DataFrame:
    """key, item_id, start: windows whose two rarest terms occur within span words of each other, in any order.

    key is the hash of a document's text that postings have. Null texts and items have no words, and empty
    tables no matches. Positions are dealt into ranges of span words, so that a posting meets only those of its own and the next ranges.
    """
    pairs = rarest(index, window)
    first = index.postings.join(pairs.select("item", "start", F.col("t1").alias("term_id")), "term_id").select("item", "start", "key", "pos", F.floor(F.col("pos") / span).alias("r"))
    near = F.explode(F.sequence(F.floor(F.col("pos") / span) - 1, F.floor(F.col("pos") / span) + 1))
    second = index.postings.join(pairs.select("item", "start", F.col("t2").alias("term_id")), "term_id").select("item", "start", "key", F.col("pos").alias("other"), near.alias("r"))
    met = first.join(second, ["item", "start", "key", "r"], "inner").where(F.abs(F.col("pos") - F.col("other")) <= span)
    return met.join(index.items.select("item", "item_id"), "item").select("key", "item_id", "start").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, **parameters: object) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated for each document."""
    found = phrase_matches(docs, benchmark, **parameters)
    return found.select(
        found.columns[0], F.col("n_words").cast("long").alias("n_words"), F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )
