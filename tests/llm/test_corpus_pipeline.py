"""Each stage on its own input, against plain versions; then all of them."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from tests.llm import brute
from tests.llm.test_operators import fp

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k}" for k in range(300))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_stages_are_in_order():
    assert [f.__name__ for _, f in p.STAGES] == ["language", "near_duplicates", "decontaminated", "mixed", "tokens"]


def test_language_keeps_clear_documents(spark, docs):
    kept = p.language(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    odd = docs.limit(20).unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "12 34", None, "s", 0)], docs.schema))
    assert not {r["doc_id"] for r in p.language(spark, odd, DATA).collect()} & {-1, -2, -3}


def test_one_row_of_each_group_stays(spark, docs):
    some = docs.unionByName(spark.createDataFrame([(9001, LONG, "en", "s", 0), (9000, LONG, "en", None, 0), (9000, LONG, "en", "t", 0), (None, LONG, "en", "t", 0), (9005, LONG + " x", "en", "t", 0), (9006, None, "en", "t", 0)], docs.schema))
    rows = some.collect()
    prints = [fp(r["text"] or "") for r in rows]
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group[find(i)] = find(j)
    want = {}
    for k, r in enumerate(rows):
        if r["doc_id"] is not None:
            want[find(k)] = min(want.get(find(k), r["doc_id"]), r["doc_id"])
    got = p.near_duplicates(spark, some, DATA)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(want.values())


def test_contaminated_documents_go(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    some = docs.unionByName(spark.createDataFrame([(9001, "start " + items[0][1], "en", "s", 0), (9002, None, "en", "s", 0), (None, LONG, "en", "s", 0)], docs.schema))
    want = sorted((r["doc_id"] for r in some.collect() if not brute.contamination(r["text"], items)[1]), key=str)
    got = p.decontaminated(spark, some, DATA)
    assert got.columns == docs.columns and sorted((r["doc_id"] for r in got.collect()), key=str) == want and 9001 not in want


def test_rows_of_one_doc_id_are_judged_one_by_one(spark, docs):
    passage = "start " + spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    some = spark.createDataFrame([(k, text, "en", source, 0) for k in (7, None) for text, source in ((LONG, "clean"), (passage, "hit"), (None, "null"), (LONG, "copy"))], docs.schema)
    got = p.decontaminated(spark, some.repartition(3), DATA)
    want = [(k, s) for k in (7, None) for s in ("clean", "copy", "null")]
    assert sorted(((r["doc_id"], r["source"]) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("stage", [f for _, f in p.STAGES[:-1]], ids=lambda f: f.__name__)
def test_other_columns_stay_and_empty_tables_stay_empty(spark, docs, stage):
    names = ["__row", "row", "doc", "its_id", "hits", "key", "any_id", "copies", "size", "rejected", "lead"]
    clash = docs.limit(12).withColumns({name: F.lit(k) for k, name in enumerate(names)})
    got = stage(spark, clash, DATA)
    assert got.columns == clash.columns
    for row in got.limit(3).collect():
        assert [row[name] for name in names] == list(range(len(names)))
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_tokens_of_all_rows(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    some = docs.limit(30).unionByName(docs.limit(5))
    got = sorted((r["doc_id"], r["n_tokens"]) for r in p.tokens(spark, some, DATA).collect())
    assert got == sorted((r["doc_id"], len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in some.collect())


def test_run(spark):
    got = p.run(spark, DATA)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = got.orderBy("start").collect()
    assert all(a["start"] + a["n_tokens"] == b["start"] and a["doc_id"] <= b["doc_id"] for a, b in zip(rows, rows[1:], strict=False))
    again = p.run(spark, DATA)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_kept_rows_are_marked_without_a_shuffle_of_texts(spark):
    """Rows at the edges of bytes, bitmaps and partitions; the texts reach the filter by the scan alone."""
    places = [0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, 65537, 1 << 33, (1 << 33) + 1, (5 << 33) + 40000]
    numbered = spark.createDataFrame([(x, f"text {x}") for x in places], "row long, text string")
    for wanted in (places[::2], places[1::2], places, []):
        kept = spark.createDataFrame([(x,) for x in wanted], "kept_row long")
        found = p.marked(numbered, kept)
        assert sorted(r["row"] for r in found.collect()) == sorted(wanted)
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_store_texts_once(spark, docs, monkeypatch):
    tables, written = {}, p.written
    monkeypatch.setattr(p, "written", lambda df, name="table", root=None: tables.update({name: df.columns}) or written(df, name, root))
    assert p.near_duplicates(spark, docs, DATA).columns == docs.columns
    assert tables["numbered"] == ["doc", "row"]
