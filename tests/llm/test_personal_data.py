import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lakeward.llm import personal_data as pd_
from tests.llm.brute import pii


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    parts = ["a@b.co", "x.y@z-1.org_d@x.yz", "1.2.3.4", "300.1.1.1", "0001.2.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (980) 555-6268", "+12", "+1234567890123456", "é𝄞", "@", ".", "-", " ", "\n", "word", "9", "00000000000000"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    made += ["".join(rng.choice("a@.-+ 0123456789()é") for _ in range(60)) for _ in range(300)]
    return [*made, None, "", "a@b.c " * 700, "1.1.1.1 " * 300, "x" * 10_000, "7" * 5_000, "a." * 2_000 + "@"]


def test_base_spans_match_plain_patterns(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for row in pd_.digests(docs).collect():
        want = pii(texts[row["doc_id"]])
        assert row["base_sha256"] == digest(want), texts[row["doc_id"]][:200]
        assert [row[f"n_{k}"] for k in pd_.KINDS] == [sum(x[0] == k for x in want) for k in pd_.KINDS]
        assert set(f"{k}:{s}:{e}" for k, s, e in want) <= set(row["spans"].split(",")) | {""}


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(k, f"please write to u{k}@mail.example.com for help") for k in range(12)]
    rows += [(100, "please write to bob7(at)mail for help"), (101, "room 7 is free"), (102, "we write to 7 people")]
    rows += [(200, None), (201, "")]
    got = {r["doc_id"]: r for r in pd_.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["spans"] == "email:16:28" and got[100]["n_email"] == 0
    assert got[101]["spans"] == got[102]["spans"] == got[200]["spans"] == got[201]["spans"] == ""
    assert got[3]["spans"].startswith("email:16:")


def test_secrets_are_found_by_their_contexts(spark):
    word = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    rows = [(k, f'some{k} text token = "{word(k)}" more{k}') for k in range(30)]
    rows += [(100, 'other text TOKEN = "aw3someLongPass!"### end'), (101, f"commit {word(99)} by me"), (102, "token = 7"), (103, "version 2.0"), (104, f"x token = {word(3)},")]
    got = {r["doc_id"]: r for r in pd_.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(30):
        at = rows[k][1].index('"') + 1
        assert got[k]["spans"] == f"secret:{at}:{at + 40}" and got[k]["n_spans"] == 1
    assert got[100]["spans"] == "secret:20:35" and got[104]["spans"] == "secret:10:50"
    assert got[101]["spans"] == got[102]["spans"] == got[103]["spans"] == ""


def test_findings_on_the_corpus(spark):
    """Recall on the corpus's tokens, and precision: whatever is found beyond the base patterns is one of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {(k, m.start(1), m.end(1)) for k, text in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', text, re.I)}
    found = pd_.personal_data(docs).select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*").collect()
    assert want and {(r["doc_id"], r["start"], r["end"]) for r in found} == want


@pytest.mark.parametrize(
    "text, units, kinds",
    [
        ("a@" + "b." * 100_000 + "c", 1, (1, 0, 0, 0)),
        (" ".join(str(10_000 + k % 89_999) for k in range(100_000)), 1, (0, 0, 0, 0)),
        (" x ".join(str(10_000 + k) for k in range(30_000)), 30_000, (0, 0, 0, 0)),
        ("1" + "!" * 1_000_000 + "a", 1, (0, 0, 0, 0)),
        ("x" * 300_000 + " 1 " + "y" * 300_000, 1, (0, 0, 0, 0)),
        ("1 " + "( " * 300_000 + "x", 1, (0, 0, 0, 0)),
        ("7" * 300_000, 1, (0, 0, 0, 0)),
    ],
)
def test_long_texts_are_read_in_linear_time(spark, text, units, kinds):
    sizes = pd_.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("occurrences"), *(F.size(k) for k in pd_.KINDS))
    sizes.schema  # the plan is made before the clock starts
    began = time.perf_counter()
    assert tuple(sizes.first()) == (units, *kinds)
    assert time.perf_counter() - began < 15


def test_empty_repeated_and_clashing(spark):
    schema = "doc_id long, text string, tag string, start int, kind string"
    assert pd_.digests(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a@b.co", "t", 1, "k"), (1, "a@b.co", "t", 1, "k"), (None, "1.2.3.4", None, None, None)]
    got = sorted((str(r["doc_id"]), r["spans"]) for r in pd_.digests(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", "email:0:6"), ("1", "email:0:6"), ("None", "ip:0:7")]
