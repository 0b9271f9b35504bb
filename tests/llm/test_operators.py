"""The operators against plain versions, on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import tempfile
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from lakeward.llm import decontaminate, exact_dedup, language_id, mixing, simhash, token_files, toxicity, warc
from lakeward.llm.common import held, sampled, words_count
from lakeward.llm.components import components
from tests.llm import brute

WORD = P.path("word_bpe_49k.json")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# exact dedup


def test_grace_recursion_compares_contents():
    records = [(xxhash.xxh3_64_intdigest(c), k, k, 1, c) for k, c in enumerate([b"x" * (k % 50) for k in range(2000)])]
    tables = list(exact_dedup.grace(iter(records), memory=2000))
    assert len(tables) > 1
    found = {}
    for table, members in tables:
        for entry, tag, rank, _ in members:
            found.setdefault((id(table), entry), set()).add(tag)
            assert table.best[entry] == (max(k for k in range(2000) if k % 50 == tag % 50),) * 2
    assert sorted(map(sorted, found.values())) == sorted([k for k in range(2000) if k % 50 == m] for m in range(50))


def test_grace_with_equal_hashes():
    records = [(7, k, k, 1, b"a" if k % 2 else b"b") for k in range(400)]
    (table, members), = [(t, m) for t, m in exact_dedup.grace(iter(records), memory=100) if m]
    assert len(table.contents) == 2 and sorted(table.sizes) == [200, 200] and len(members) == 400


def test_rows_of_one_content_are_spilled(monkeypatch):
    monkeypatch.setattr(exact_dedup, "HELD_ROWS", 1000)
    tracemalloc.start()
    (table, members), = exact_dedup.grace(((5, k, k, 1, b"") for k in range(300_000)), memory=1 << 20)
    parts = exact_dedup._chunks(table, members)
    assert sum(len(part) for part in parts) == len(members) == 300_000 and table.best == [(299_999, 299_999)]
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_chunks_end_where_contents_are_long():
    (table, members), = exact_dedup.grace((k, k, k, 1, bytes([k]) * (5 << 20)) for k in range(5))
    assert [len(part) for part in exact_dedup._chunks(table, members)] == [2, 2, 1]


def test_exact_dedup(spark):
    data = [(1, "a", 9), (2, "a", 9), (3, None, 9), (4, "", 9), (5, "b", None), (6, "A", 9), (None, "b", 1), (7, "a ", 2), (7, "a ", 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, lead int").repartition(5)
    got = exact_dedup.exact_dedup(df)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert rows(got.where("doc_id in (1, 2)")) == [(1, 2, 2, False, sha("a")), (2, 2, 2, True, sha("a"))]
    assert rows(got.where("doc_id in (3, 4)")) == [(3, 4, 2, False, sha("")), (4, 4, 2, True, sha(""))]
    assert rows(got.where("doc_id is null")) == [(None, 5, 2, False, sha("b"))]
    assert sorted(r["kept"] for r in got.where("doc_id = 7").collect()) == [False, True]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


# SimHash


def fp(text):
    w = brute.lower(text).encode().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(monkeypatch):
    rng = random.Random(1)
    texts = ["", " \t", "one", "One two", "a b c", "a b c d", "É é Éé", "x\x1cy z\x0bw"] + [" ".join(rng.choice("ab cd ef GH".split()) for _ in range(300)) for _ in range(20)]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [fp(t) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 40)
    assert [simhash.fingerprint(t.encode()) for t in texts] == [fp(t) for t in texts]


@pytest.mark.parametrize("tile", [2048, 4])
def test_links_have_the_components_of_all_pairs(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 12, dtype=np.int64)
    some = {int(b) ^ int(sum(1 << int(x) for x in rng.integers(0, 62, rng.integers(0, 6)))) for b in base for _ in range(30)} | {0, 1, 3, 15, -1, -2}
    values = sorted(some)
    got = {a: r for a, r in components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 3, tile)).collect()}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {v: got.get(v, v) for v in values} == {v: find(v) for v in values}


def test_long_chains(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    long = " ".join(f"w{k}" for k in range(400))
    data = [(9, long), (4, long.upper()), (5, long + " end"), (6, None), (2, ""), (None, "  "), (8, "other text here"), (8, "other text here")]
    got = rows(simhash.near_duplicates(spark.createDataFrame([(*x, "z") for x in data], "doc_id long, text string, fp string")))
    group = {(r[0], r[2]) for r in got}
    assert {(9, 4), (4, 4), (6, 2), (2, 2), (None, 2), (8, 8)} <= group and len(got) == 8
    assert all(r[1] == "0" * 16 for r in got if r[0] in (6, 2, None))


# decontamination


def test_contamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"t{k}" for k in range(30)] + ["É", "é", "x1"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 10, 11, 25])))) for k in range(12)] + [(90, None), (91, "!!"), (92, "the the the the"), (5, "a second text of item five")]
    docs = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 60]))]
        for _ in range(rng.choice([0, 1, 2])):
            item = (rng.choice(items)[1] or "").split()
            at, cut = rng.randint(0, len(words)), rng.randint(0, 6)
            words[at:at] = item[cut : cut + rng.choice([8, 10, 12, 40])]
        docs.append((k, rng.choice([" ", "; "]).join(w.upper() if rng.random() < 0.3 and w != "É" else w for w in words)))
    docs += [(100, None), (101, "the THE the, the the"), (102, ""), (None, items[0][1]), (3, items[1][1]), (3, "plain")]
    got = rows(decontaminate.contamination(spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, pos int").repartition(3), spark.createDataFrame(items, "item_id long, text string")))
    want = []
    for k, text in docs:
        n, hit, found = brute.contamination(text, items)
        want.append((k, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert got == sorted(want, key=str)
    assert sum(r[5] for r in got) > 10


def test_contamination_without_test_set(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert rows(decontaminate.contamination(docs, items))[0][:4] == (1, 2, 0, 0)
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta x x x x x x x alpha"), (3, "beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta")], "item_id long, text string")
    index = decontaminate.build_index(docs, items)
    named = decontaminate.proximity_matches(index, 3).join(docs.select("doc_id", F.xxhash64("text").alias("key")), "key")
    assert rows(named.select("doc_id", "item_id", "start")) == [(1, "7", 0), (3, "7", 0)]


# token files


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    data = [(3, "Some text, it's HERE."), (1, None), (2, ""), (5, "<|endoftext|> x"), (4, "naïve É 日本 \x85 a\x1cb"), (9, "word " * 3000), (None, "no id"), (7, "same"), (7, "same"), (-2, "below zero")]
    folder, units = token_files.token_output(spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, ids int").repartition(3), WORD)
    got = token_files.read_files(units, folder).orderBy("start").collect()
    order = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [x[0] for x in order]
    start = 0
    for row, (_, text) in zip(got, order, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    whole = {r["start"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read_files(units, folder, digest=False).collect()}
    assert whole[0][-1] == 1
    assert token_files.token_digests(spark, spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


def test_long_documents_take_blocks_of_their_own(spark, monkeypatch):
    from lakeward.llm import rans

    ids = np.arange(700_000, dtype="<u4") % 1000
    table = rans.Table(rans.scaled(np.bincount(ids)))
    parts = [rans.encode(ids[k : k + token_files.BLOCK_IDS], table) for k in range(0, len(ids), token_files.BLOCK_IDS)]
    assert (np.concatenate([rans.decode(x, table) for x in parts]) == ids).all()
    assert (rans.decode(parts[0], table, rans.CHECKPOINT) == ids[rans.CHECKPOINT * rans.LANES : token_files.BLOCK_IDS]).all()
    broken = bytearray(parts[0])
    broken[-5] ^= 1
    with pytest.raises((ValueError, IndexError)):
        rans.decode(bytes(broken), table)


def test_scaled_frequencies():
    from lakeward.llm import rans

    for counts in ([1], [1, 0, 5], [10**12, *[1] * 49_000], [1] * (1 << 20)):
        freq = rans.scaled(np.array(counts))
        assert freq.sum() == 1 << rans.SCALE and ((freq > 0) == (np.array(counts) > 0)).all()


# WARC


def test_archives(spark):
    big = "é" * 600
    data = [(1, "http://a/\r\nX: y", big), (5, None, big), (3, "u", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (8, "u", "x" * 3_000_000), (8, "u", "x" * 3_000_000), (None, "u", big)]
    folder, runs = warc.archive(spark.createDataFrame([(*x, 0) for x in data], "page_id long, url string, html string, at int").repartition(3))
    got = rows(warc.read(runs, folder, payloads=True))
    sha = lambda x: hashlib.sha1((x or "").encode()).hexdigest()
    want = [(p, len((h or "").encode()), sha(h), "revisit" if h == big and p != 5 else "response", 5 if h == big and p != 5 else None, None if h == big and p != 5 else (h or "").encode()) for p, _, h in data]
    assert got == sorted(want, key=str)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))[1].count() == 0


def test_archives_do_not_shuffle_payloads(spark, monkeypatch):
    data = [(k, f"u{k}", (f"{k % 60} " if k % 5 else f"{k} ") * 400 if k % 7 else "short") for k in range(300)] + [(None, None, "1 " * 400), (7, "again", "7 " * 400)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(5)
    last = {}
    for p, _, h in data:
        last[h] = max(last.get(h, -1), -1 if p is None else p)
    want = sorted([(p, "revisit" if len(h) >= 1000 and (p is None or p < last[h]) else "response") for p, _, h in data], key=str)
    for most in (warc.MOST_KEYS, 3):
        monkeypatch.setattr(warc, "MOST_KEYS", most)
        folder, runs = warc.archive(pages)
        assert sorted(((r["page_id"], r["record_type"]) for r in warc.read(runs, folder).collect()), key=str) == want
    monkeypatch.undo()
    path = tempfile.mkdtemp(prefix="spark-")
    pages.write.mode("overwrite").parquet(path)
    responses, _, keys = warc.decided(spark.read.parquet(path))
    assert keys and "Exchange" not in responses._jdf.queryExecution().executedPlan().toString()


# mixing


def test_mixing(spark):
    rng = random.Random(4)
    data = [(k, " ".join(["w"] * rng.choice([1, 3, 10, 40])), rng.choice(["a", "b", "c", "B", None])) for k in range(600)] + [(1000, None, "a"), (1001, "", "b"), (None, "x y", "c"), (5, "x y z", "a"), (5, "x y z", "a")]
    df = spark.createDataFrame([(*x, 7) for x in data], "doc_id long, text string, source string, tag int").repartition(4)
    got = mixing.mix(df).select("doc.*", "size", "source_size", "target", "taken", "copies").collect()
    assert len(got) == len(data)
    sizes, per = {}, {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        per.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        if not full:
            want |= {s: weights[s] * level for s in open_}
            break
        for s in full:
            want[s], left = 2 * sizes[s], left - 2 * sizes[s]
        open_ -= full
    for s, (target, taken) in per.items():
        assert target == pytest.approx(want[s]) and abs(taken - target) <= max(3, 0.01 * target), s
    again = mixing.mix(df.repartition(2)).select("doc.doc_id", "taken").collect()
    assert sorted((str(r[0]), r[1]) for r in again) == sorted((str(r["doc_id"]), r["taken"]) for r in got)
    assert mixing.mixed(df).count() == sum(r["copies"] for r in got) and mixing.mixed(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0
    clash = df.withColumn("__copy", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("copies", F.lit(3))
    assert mixing.mixed(clash).columns == clash.columns


def test_rows_without_an_id_are_ranked_by_their_texts(spark):
    df = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w"), "id", F.lit(" w")).alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(df, total_share=0.25).select("doc.text", "copies").where("copies > 0").collect()
    assert len(got) == 100 and sorted(got) == sorted(mixing.mix(df.repartition(3), total_share=0.25).select("doc.text", "copies").where("copies > 0").collect())
    first = sum(int(r[0][1:-2]) < 100 for r in got)
    assert 10 < first < 45


@pytest.mark.parametrize("at_once", [4096, 1])
def test_documents_far_beyond_the_boundary_fill_the_gap(spark, monkeypatch, at_once):
    monkeypatch.setattr(mixing, "AT_ONCE", at_once)
    data = [(s, s * 5000 + k, n) for s in range(8) for k, n in enumerate([30_000, 9000, 500, 70, 3, 1] + [50] * 1200 + [0] * 100)]
    text = F.when(F.col("n") > 0, F.array_join(F.array_repeat(F.lit("w"), F.col("n")), " "))
    df = spark.createDataFrame(data, "source long, doc_id long, n int").select("doc_id", text.alias("text"), "source").repartition(3)
    got = mixing.mix(df, weights=(1,), total_share=0.25, keep=["doc_id", "source"]).select("doc.*", "size", "target", "copies").collect()
    for s in range(8):
        mine = [r for r in got if r["source"] == s]
        f = mine[0]["target"] / sum(r["size"] for r in mine)
        left, want = mine[0]["target"], set()

        def rank(r, f=f):
            u = (int(hashlib.md5(f"7:{r['doc_id']}:{hashlib.md5(' '.join(['w'] * r['size']).encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            return u * (1 - f) / (u * (1 - f) + (1 - u) * f)

        for r in sorted(mine, key=rank):
            if 0 < r["size"] <= left:
                left -= r["size"]
                want.add(r["doc_id"])
        assert {r["doc_id"] for r in mine if r["copies"]} == want and left < 50


def test_inclusion_follows_the_weights(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    got = mixing.mix(df, total_share=0.2, weight_col="w").select("doc.doc_id", "copies").where("copies > 0").collect()
    assert len(got) == 1200 and 2.2 < sum(r[0] % 2 == 0 for r in got) / sum(r[0] % 2 for r in got) < 3.8


def test_words(spark):
    texts = ["a b", " a\tb\x0bc ", "", None, "\x1c a", "é x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(words_count(F.col("t"))).collect()] == [2, 3, 0, 0, 2, 2]
    assert spark.range(20).where(held(F.col("id"), 3, 1)).count() == sum(zlib.crc32(str(k).encode()) % 3 == 1 for k in range(20))


# classifiers


@pytest.mark.parametrize("n", [0, 1, 300, 10**9, 314_572_801, 10**18])
def test_samples_of_any_table_size(spark, n):
    """Of n hashes spread evenly over their range, about 1,000 are drawn, though n may be far beyond 2**20."""
    most = 1000
    spread = [k * (1 << 64) // n for k in range(min(n, 4 * most))]
    rows_ = spark.createDataFrame([(h - (1 << 64) if h >> 63 else h,) for h in spread], "h long")
    assert abs(rows_.where(sampled(F.col("h"), most, n)).count() - min(n, most)) <= 1


def test_language_id_equals_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").cache()
    learned = language_id.fit(docs, F.lit(True))
    rows_ = docs.collect()
    words = lambda text: re.findall(r"[^\W\d_]+", (text or "").lower())
    for lang, content in learned.items():
        counts = {}
        for text in {r["text"] for r in rows_ if r["lang"] == lang and words(r["text"])}:
            for word in set(words(text)):
                counts[word] = counts.get(word, 0) + 1
        want = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))]
        held_words = content.decode().split()[::-1]
        assert held_words == want[: len(held_words)] and (len(held_words) == len(want) or len(content) > language_id.DICTIONARY_BYTES - 100)

    def size(data, content, level):
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=level)
        return len(zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=True).compress(data))

    for r in language_id.identify(docs, learned).select("doc.text", "lang_pred", "rejected").collect():
        data = f" {' '.join(dict.fromkeys(words(r['text'])))} ".encode()
        short = len(data) <= language_id.SHORT
        data = language_id.CARRIER + data if short else data
        pieces = [data[k : k + language_id.PIECE] for k in range(0, len(data), language_id.PIECE)]
        sizes = {lang: sum(size(x, content, language_id.SHORT_LEVEL if short else language_id.LEVEL) for x in pieces) for lang, content in learned.items()}
        if words(r["text"]):
            first, second = sorted(sizes.values())[:2]
            assert sizes[r["lang_pred"]] == first and r["rejected"] == (second - first < max(1, 0.002 * first))


@pytest.mark.parametrize(
    "text, quoted",
    [
        ('"aa" badword "bb"', False), ('"badword" he said', True), ('he said "' + "w " * 30 + 'badword"', True), ('"' + "w " * 30 + '" badword', False),
        ("„badword“ x", True), ("«x» badword «y»", False), ('a stray " mark\nbadword "x"', False), ('badword "', False), ('" badword', False), ('"a" "badword"', True), ('they said badword', False),
    ],
)
def test_quotations_are_paired_over_the_whole_text(text, quoted):
    (_, _, found, _), = toxicity.evidence(text, toxicity.Lexicon(["badword"]))[1]
    assert found == quoted


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = held(F.col("doc_id"), 4, 2)
    learned = language_id.fit(docs, ~out)
    got = language_id.identify(docs.where(out), learned).select("doc.lang", "lang_pred", "score", "rejected").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !!", 1), (4, "x" * 100_000, 1)], "doc_id int, text string, score int")
    found = {r["doc"]["doc_id"]: r for r in language_id.identify(odd, learned).collect()}
    assert [found[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and found[4]["lang_pred"] in learned
    assert language_id.fit(docs.limit(0), F.lit(True)) == {}
    assert {r["lang_pred"] for r in language_id.identify(odd, {}).collect()} == {"und"}


def test_automaton_is_the_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(2))
        automaton = toxicity.Automaton(a)
        state = automaton.start
        for c in b:
            state = automaton.step(state, c)
        d = distance(a, b)
        assert automaton.accepted(state) == (d if d <= 1 else None), (a, b)


def test_lexicon_finds_all_within_one_edit():
    rng = random.Random(7)
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(60)})
    lexicon = toxicity.Lexicon(terms)
    for _ in range(1500):
        word = list(rng.choice(terms))
        k = rng.randrange(len(word))
        word[k : k + 1] = rng.choice([[], [word[k], "x"], ["x"]])
        word = "".join(word)
        if word not in lexicon.exact and len(word) >= toxicity.MIN_FUZZY:
            want = [(t, 1) for t, term in enumerate(terms) if (a := toxicity.Automaton(term)) and a.accepted(__import__("functools").reduce(a.step, word, a.start)) == 1]
            assert lexicon.matches(word) == want


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    labels = labels.where("doc_id < 3000")
    docs = docs.where("doc_id < 3000").select("doc_id", "text")
    out = held(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, labels, ~out)
    got = toxicity.score(docs.where(out), model).select("doc.doc_id", "score", "predicted").join(labels, "doc_id").collect()
    hit = sum(r["predicted"] == 1 == r["toxic"] for r in got)
    assert hit / sum(r["toxic"] for r in got) > 0.75 and hit / max(1, sum(r["predicted"] for r in got)) > 0.8
    told = toxicity.Model(__import__("json").loads(model))
    assert told.score("you idi0t and go away") >= 0.7 > told.score('they wrote "idiot" on the board') and told.score(None) == told.score("") < 0.5
    odd = spark.createDataFrame([(1, None, 0.1), (1, None, 0.1)], "doc_id int, text string, score double")
    assert toxicity.score(odd, model).count() == 2
    empty = toxicity.fit(docs.limit(0), labels, F.lit(True))
    assert 0 <= toxicity.Model(__import__("json").loads(empty)).score("idiot") <= 1


def test_misspelled_terms_beside_a_corpus_word(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs.where("doc_id < 3000").select("doc_id", "text"), labels.where("doc_id < 3000"), ~held(F.col("doc_id"), 3, 1))
    told = toxicity.Model(__import__("json").loads(model))
    assert "oron" in told.told["variants"] and told.score("an oron is here") < 0.5
    assert told.score("you m0ron") >= 0.7 and told.score("you morron and go away") >= 0.7
