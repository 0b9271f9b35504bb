"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Terms come from labelled texts: words far commoner in toxic ones. The lexicon is a trie. For each word of a
text an automaton that accepts everything within one edit of it runs along the trie, so that misspelled terms
are found without listing their variants. A term counts by how much likelier a toxic text holds it than a
clean text of that length; near matches count less, the less the more that variant occurs in clean texts. A window of
words around each match weighs it: other matches nearby speak for abuse, and a match between quotation marks,
which are paired over the whole text, for a report of it. The sum is calibrated to a probability on a bounded sample of labelled rows.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import map_arrow, sampled, shared_dir, written

#: Bounds of the fit: terms, and labelled documents (about) from which all of it is learned.
MOST_TERMS, SAMPLE_DOCS = 2000, 40_000
MIN_TOXIC, MIN_RATIO, MIN_PRECISION = 3, 15.0, 0.7
MIN_FUZZY, EDITS = 4, 1
WINDOW, MOST_COUNTED = 8, 6
#: A toxic text holds a misspelled term this much less often than the term itself.
NEAR_SHARE, QUOTED_WORTH, COMPANY = 0.1, 0.25, 0.15
#: The calibration, and it alone, leaves out near matches of terms that all variants together make worth less than this in a text of so many words.
LEAST_NEAR, TYPICAL_WORDS = 2.0, 300
THRESHOLD = 0.7
CACHE = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile("[\"“”«»„]|\n")


class Automaton:
    """Accepts all strings within EDITS edits of a word. A state holds, for each number of edits, a bit for each place."""

    def __init__(self, word: str, edits: int = EDITS) -> None:
        self.size, self.edits = len(word), edits
        self.at: dict[str, int] = {}
        for k, c in enumerate(word):
            self.at[c] = self.at.get(c, 0) | 1 << k
        start, self.start = 1, []
        for _ in range(edits + 1):
            self.start.append(start)
            start |= start << 1

    def step(self, state: list[int], c: str) -> list[int]:
        same, full = self.at.get(c, 0), (1 << self.size + 1) - 1
        after = [(state[0] & same) << 1]
        for k in range(1, self.edits + 1):
            before = state[k - 1]
            # a match; an extra letter of the term; another letter; a letter that the term lacks
            after.append(((state[k] & same) << 1 | before | before << 1 | after[k - 1] << 1) & full)
        return after

    def accepted(self, state: list[int]) -> int | None:
        return next((k for k, bits in enumerate(state) if bits >> self.size & 1), None)


class Lexicon:
    """Trie of terms."""

    def __init__(self, terms: list[str], near: list[int] | None = None) -> None:
        """near: the terms that are also sought misspelled; all if not given."""
        self.terms = terms
        sought = [terms[k] for k in (range(len(terms)) if near is None else near)]
        self.exact = {term: k for k, term in enumerate(terms)}
        self.root: dict = {}
        for term in sought:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = self.exact[term]
        # one edit leaves the first or the last half of a term as it is: halves by the term's length
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        for t in sought:
            if len(t) >= MIN_FUZZY:
                self.heads.setdefault(len(t), set()).add(t[: len(t) // 2])
                self.tails.setdefault(len(t), set()).add(t[-(len(t) // 2) :])
        #: Words searched so far: those without a match, and the first match of the others.
        self.without: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def found(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """The words that match, each with its first (term, edits)."""
        distinct = set(words)
        for word in distinct.difference(self.without, self.hits):
            if matches := self.matches(word):
                self.hits[word] = matches[0]
            else:
                self.without.add(word)
        out = {word: self.hits[word] for word in distinct.intersection(self.hits)}
        if len(self.without) + len(self.hits) > CACHE:
            self.without.clear()
            self.hits.clear()
        return out

    def matches(self, word: str) -> list[tuple[int, int]]:
        """(term, edits) for all terms within reach of the word; an exact term stands alone."""
        if word in self.exact:
            return [(self.exact[word], 0)]
        size = len(word)
        if size < MIN_FUZZY:
            return []
        for n in (size - 1, size, size + 1):
            if n in self.heads and (word[: n // 2] in self.heads[n] or word[-(n // 2) :] in self.tails[n]):
                return self._search(word)
        return []

    def _search(self, word: str) -> list[tuple[int, int]]:
        """Runs the automaton of the word along the trie; its two sets of places are steps of Automaton, written out."""
        automaton = Automaton(word, 1)
        at, size, full = automaton.at.get, automaton.size, (1 << automaton.size + 1) - 1
        found, todo = [], [(self.root, *automaton.start)]
        while todo:
            node, whole, edited = todo.pop()
            for c, below in node.items():
                if not c:
                    if (whole | edited) >> size and len(self.terms[below]) >= MIN_FUZZY:
                        found.append((below, 0 if whole >> size else 1))
                    continue
                same = at(c, 0)
                after = (whole & same) << 1
                near = ((edited & same) << 1 | whole | whole << 1 | after << 1) & full
                if after or near:
                    todo.append((below, after, near))
        return sorted(found)


def quotations(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of what stands between marks: marks pair in order within a line, and one left over pairs with none."""
    starts, ends, opened = [], [], None
    for mark in _QUOTES.finditer(text):
        if mark[0] == "\n":
            opened = None
        elif opened is None:
            opened = mark.end()
        else:
            starts.append(opened)
            ends.append(mark.start())
            opened = None
    return starts, ends


def evidence(text: str, lexicon: Lexicon) -> tuple[int, list[tuple[int, str | None, bool, int]]]:
    """Words of the text, and for each match: term, the word if misspelled, whether it is quoted, other matches in its window."""
    low_text = text.lower()
    words = _WORD.findall(low_text)
    known = lexicon.found(words)
    if not known:
        return len(words), []
    hits = [(k, known[word]) for k, word in enumerate(words) if word in known]
    starts, ends = quotations(low_text)
    places = [m.start() for m in _WORD.finditer(low_text)] if starts else None
    at = [k for k, _ in hits]
    out = []
    for k, (term, edits) in hits:
        low, high = max(0, k - WINDOW), k + WINDOW
        company = bisect_right(at, high) - bisect_left(at, low) - 1
        nth = bisect_right(starts, places[k]) - 1 if starts else -1
        out.append((term, words[k] if edits else None, nth >= 0 and places[k] < ends[nth], company))
    return len(words), out


class Model:
    """terms with their share of toxic texts and rate in clean words; variants found there with both, and the rate of others (unseen); a, b."""

    def __init__(self, told: dict) -> None:
        self.told, self.lexicon = told, Lexicon(told["terms"], told.get("near"))

    def weight(self, term: int, variant: str | None, n: int) -> float:
        share, rate = self.told["share"][term], self.told["rate"][term]
        if variant is not None:
            share, rate = share * NEAR_SHARE, max(rate, self.told["unseen"][term])
            if variant in self.told["variants"]:
                excess, its_rate = self.told["variants"][variant]
                share, rate = min(share, excess), max(rate, its_rate)
        by_chance = -math.expm1(-rate * max(n, 1))
        return math.log((share + (1 - share) * by_chance) / by_chance)

    def strength(self, text: str | None) -> float:
        n, hits = evidence(text or "", self.lexicon)
        best: dict[int, float] = {}
        for term, variant, quoted, company in set(hits):
            worth = self.weight(term, variant, n) * (QUOTED_WORTH if quoted else 1.0) * (1 + COMPANY * min(3, company))
            best[term] = max(best.get(term, 0.0), worth)
        return sum(sorted(best.values(), reverse=True)[:MOST_COUNTED])

    def score(self, text: str | None) -> float:
        z = self.told["a"] + self.told["b"] * self.strength(text)
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


_models: dict[str, Model] = {}


def _model(told: str) -> Model:
    if told not in _models:
        _models.clear()
        _models[told] = Model(json.loads(told))
    return _models[told]


def _calibrated(strength: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic regression on the strength, with a light pull towards a slope of 1."""
    x = np.column_stack([np.ones(len(strength)), np.minimum(strength, 20.0)])
    w = np.array([math.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5)), 1.0])
    pull, towards = np.diag([1e-3, 1.0]), np.array([w[0], 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (toxic - p) - pull @ (w - towards)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, slope)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.05))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> str:
    """The model as JSON, from labelled rows of docs that ``learn`` marks (by the id alone).

    Of these, about SAMPLE_DOCS are drawn by a hash of the id; equal texts count once, as toxic if one of them
    is, and at most twice SAMPLE_DOCS distinct texts count.
    A doc_id with several labels is toxic if one of them says so; null labels and texts are left out. Only the
    sample's labels and row numbers are broadcast.
    """
    spark = docs.sparkSession
    root = shared_dir(spark)
    known = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    known = written(known.withColumn("h", F.xxhash64(F.lit("toxicity"), F.col("id").cast("string"))), "labels", root)
    drawn = known.where(sampled(F.col("h"), SAMPLE_DOCS, known.count())).select("id", "toxic")
    texts = docs.where(learn & F.col(text_col).isNotNull()).select(F.col(id_col).alias("its_id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(drawn), F.col("its_id") == F.col("id")).select("toxic", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("tag"))
    texts = written(texts, "sample", root)
    # rows may repeat a labelled doc_id without bound: of distinct texts those with the smallest hashes are learned from
    firsts = texts.groupBy("h").agg(F.min("tag").alias("tag"), F.max("toxic").alias("toxic")).orderBy("h").limit(2 * SAMPLE_DOCS).select("tag", "toxic")
    rows = written(texts.select("text", "tag").join(F.broadcast(firsts), "tag").select("toxic", "text"), "labelled", root)
    totals = rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars")).collect()
    docs_of = {r["toxic"]: r["docs"] for r in totals}
    n1, n0 = docs_of.get(1, 0), docs_of.get(0, 0)
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    counts = rows.select("toxic", F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.sum("toxic").alias("k1"), F.sum(1 - F.col("toxic")).alias("k0"))
    k1, k0, total = F.col("k1"), F.col("k0"), F.lit(float(max(n1 + n0, 1)))
    expected = (k1 + k0) * (n1 / max(n1 + n0, 1))
    g2 = 2 * (k1 * F.log(k1 / expected) + F.when(k0 > 0, k0 * F.log(k0 / (k1 + k0 - expected))).otherwise(0.0))
    good = counts.where((k1 >= MIN_TOXIC) & (k1 / (k1 + k0) >= MIN_PRECISION)).withColumn("g2", g2).where(F.col("g2") >= MIN_RATIO)
    terms = good.orderBy(F.desc("g2"), "word").limit(MOST_TERMS).collect() if n1 and n0 else []
    clean_words, toxic_words = (max(1.0, sum(r["chars"] for r in totals if r["toxic"] == k) / 6.0) for k in (0, 1))
    told = {
        "terms": [r["word"] for r in terms], "share": [(r["k1"] + 0.5) / (n1 + 1) for r in terms], "rate": [(r["k0"] + 0.5) / clean_words for r in terms],
        "unseen": [0.5 / clean_words for _ in terms], "variants": {}, "a": math.log((n1 + 0.5) / (n0 + 0.5)), "b": 1.0,
    }
    text = json.dumps(told)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = _model(text), {}
        for batch in batches:
            for toxic, doc in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                for found in {(variant, term) for term, variant, _, _ in evidence(doc, model.lexicon)[1] if variant}:
                    seen.setdefault(found, [0, 0])[toxic] += 1
        variants, terms = [x for x, _ in seen], [x for _, x in seen]
        yield pa.RecordBatch.from_arrays([pa.array(variants, pa.string()), pa.array(terms, pa.int64()), *(pa.array([x[k] for x in seen.values()], pa.int64()) for k in (0, 1))], ["variant", "term", "k0", "k1"])

    found = map_arrow(rows, near, "variant string, term long, k0 long, k1 long").groupBy("variant", "term").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1"))
    near_docs = [0] * len(terms)
    for row in found.where("k0 > 0").collect():
        near_docs[row["term"]] += row["k0"]
        # toxic texts that hold it clearly beyond what clean ones lead to expect
        expected = row["k0"] * toxic_words / clean_words
        excess = max(0.0, row["k1"] - expected - 2 * math.sqrt(expected + 1))
        told["variants"][row["variant"]] = ((excess + 0.5) / (n1 + 1), (row["k0"] + 0.5) / clean_words)
        # variants found once tell how often one turns up that was not found
        told["unseen"][row["term"]] += (row["k0"] == 1) / clean_words
    # the calibration does not lean on variants that its own rows have told: all variants of a term have one rate there
    plain = told | {"unseen": [(n + 0.5) / clean_words for n in near_docs], "variants": {}}
    weigh = Model(plain).weight
    text = json.dumps(plain | {"near": [k for k in range(len(terms)) if weigh(k, "", TYPICAL_WORDS) >= LEAST_NEAR]})

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(text)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch[0], pa.array([model.strength(x) for x in batch[1].to_pylist()], pa.float64())], ["toxic", "x"])

    if n1 and n0:
        got = map_arrow(rows, strengths, "toxic int, x double").collect()
        told["a"], told["b"] = _calibrated(np.array([r["x"] for r in got]), np.array([float(r["toxic"]) for r in got]))
    return json.dumps(told)


def score(docs: DataFrame, model: str, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs as ``doc``, with score (0 to 1) and predicted.

    Null and empty texts score as a text without matches. Repeated rows score alike; empty tables give none.
    """
    schema = f"doc {docs.select(F.struct('*').alias('doc')).schema['doc'].dataType.simpleString()}, score double, predicted int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model)
        for batch in batches:
            scores = [own.score(x) for x in batch[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())], ["doc", "score", "predicted"])

    return map_arrow(docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text")), work, schema)
