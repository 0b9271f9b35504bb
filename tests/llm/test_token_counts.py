import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lakeward.llm import token_counts as tc


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_edits_equal_a_fresh_count(counter):
    rng = random.Random(5)
    parts = ["word", "it's", " ", "  ", "\n", "\n\n   ", "don't", "'", "12", "é", "𝄞", "!!", "a", " b", "\t", "x" * 70, " " * 90]
    for case in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 60, 600])))
        own = tc.CountedText(text, counter)
        for _ in range(12):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 0, 1, 3, 30, 400])
            new = "".join(rng.choice(parts) for _ in range(rng.choice([0, 0, 1, 2, 9, 200])))
            own.edit(a, b, new)
            a, b = min(a, len(text)), min(b, len(text))
            text = text[:a] + new + text[b:]
            assert own.text == text
            assert own.tokens == len(counter.encoding.encode_ordinary(text)), (case, text)
            assert own.root.chars == len(text)
            if rng.random() < 0.3:  # a tree built again from its leaves goes on as the one that was kept
                own = tc.CountedText(text, counter, own.leaves())
                assert own.encoded == 0 and own.root.chars == len(text)


def test_only_the_region_is_encoded(counter):
    own = tc.CountedText("some plain words here " * 20_000, counter)
    before = own.encoded
    own.edit(200_000, 200_003, "new")
    assert own.encoded - before < 20


def test_rows(spark):
    rows = [(1, "a text", [(0, 1, "one")]), (2, None, None), (3, "", [(5, 9, "x y")]), (None, "same", []), (None, "same", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,new:string>>")
    got = sorted(map(tuple, tc.edit_counts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()), key=str)
    assert got == sorted([(1, 2, 2, 1, 8, 2, 1), (2, 0, 0, 0, 0, 0, 0), (3, 0, 0, 1, 3, 2, 2), (None, 1, 1, 0, 4, 1, 0), (None, 1, 1, 0, 4, 1, 0)], key=str)
    assert tc.edit_counts(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_versions_in_a_table(spark, counter):
    path = P.path("byte_bpe_50k.tiktoken")
    texts = ["some plain words here " * 2000, "", None, "it's"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("leaves", F.lit(1))
    kept = tc.trees(docs, path, P.PATTERN, keep=["leaves"])
    assert {(r["doc_id"], r["n_tokens"], r["version"]) for r in kept.collect()} == {(k, len(counter.encoding.encode_ordinary(x or "")), 0) for k, x in enumerate(texts)}
    change = F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("new word").alias("new")))
    second = tc.edited(kept, change, path, P.PATTERN)
    third = {r["doc_id"]: r for r in tc.edited(second, change, path, P.PATTERN).collect()}
    for k, x in enumerate(texts):
        text = x or ""
        for _ in range(2):
            text = text[:1] + "new word" + text[2:]
        assert (third[k]["text"], third[k]["n_tokens"], third[k]["version"]) == (text, len(counter.encoding.encode_ordinary(text)), 2)
        assert third[k]["reencoded"] < 12
