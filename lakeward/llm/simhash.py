"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints within RADIUS bits agree in one of RADIUS + 1 blocks of bits, so a bucket of each block's
value holds every pair that may link. A bucket is compared whole, in order of population counts, with numpy
exclusive-or and bit counts; counts that differ by more than the radius end a comparison, as such
fingerprints differ in more bits. A bucket of more than TILE fingerprints is cut into tiles of one population
count each (and a share of a hash); pairs of tiles whose counts differ beyond the radius are skipped and the
others are dealt to tasks. Nothing is capped: every pair within the radius is compared.

A tile pair gives a spanning forest of its links rather than all pairs. Components of the forests are those of
all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import map_arrow, raw, shared_dir, written
from lakeward.llm.components import components

TILE = 2048
#: Bytes of text that are split into words at a time.
PIECE = 4 << 20
_SPACE = b" \t\n\r\x0b\x0c"


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text cut at white space into pieces of PIECE bytes, or longer where a word is."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[at:end]
        at = end


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' XXH64 values. Without words: 0."""
    counts, total, carry = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for piece in _pieces(text):
        words = carry + piece.lower().split()
        n = len(words) - shingle + 1
        if n > 0:
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            starts = np.cumsum(lengths + 1) - lengths - 1
            ends = (starts + lengths)[shingle - 1 :]
            hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist(), strict=False)), np.uint64, n)
            for k in range(0, n, 1 << 15):
                bits = np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts += bits.sum(axis=0, dtype=np.int64)
            total += n
        carry = words[max(0, n) :] if n > 0 else words
    if not total:
        return digest(b" ".join(carry), seed) if carry else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text, shingle, seed) for text in raw(batch[1])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, fp long")


def _joined(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest labels after linking left to right."""
    while True:
        a, b = labels[left], labels[right]
        if (a == b).all():
            return labels
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _within(groups: np.ndarray, fps: np.ndarray, pops: np.ndarray, radius: int) -> np.ndarray:
    """Labels after linking fingerprints of equal groups; rows are in order of group, then population count."""
    labels, left, right = np.arange(len(fps)), [], []
    at, step, held = np.arange(len(fps)), 0, 0
    while True:
        step += 1
        at = at[at + step < len(fps)]
        at = at[(groups[at + step] == groups[at]) & (pops[at + step] - pops[at] <= radius)]
        if not len(at):
            break
        hit = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= radius]
        left.append(hit)
        right.append(hit + step)
        held += len(hit)
        if held > 1 << 20:
            labels, left, right, held = _joined(labels, np.concatenate(left), np.concatenate(right)), [], [], 0
    return _joined(labels, np.concatenate(left), np.concatenate(right)) if left else labels


def _across(first: np.ndarray, second: np.ndarray, radius: int) -> np.ndarray:
    """Labels over first, then second, after linking between the two tiles."""
    labels = np.arange(len(first) + len(second))
    for k in range(0, len(first), 256):
        i, j = np.nonzero(np.bitwise_count(first[k : k + 256, None] ^ second[None, :]) <= radius)
        labels = _joined(labels, i + k, j + len(first))
    return labels


def links(distinct: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b): links between fingerprints that differ in at most radius bits, as forests with the same components."""
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = radius + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    cut = [F.shiftrightunsigned("fp", lo).bitwiseAND((1 << hi - lo) - 1) if hi - lo < 64 else F.col("fp") for lo, hi in zip(edges, edges[1:], strict=False)]
    rows = distinct.select("fp", F.bit_count("fp").alias("pop"), F.posexplode(F.array(*cut)).alias("block", "value"))
    counted = rows.groupBy("block", "value", "pop").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.groupBy("block", "value").agg(F.sum("n").alias("n"), F.collect_list(F.struct("pop", "n")).alias("pops"))
    large = written(whole.where(F.col("n") > tile), "large", shared_dir(spark))
    sizes = large.select("block", "value", F.explode("pops").alias("x")).select("block", "value", F.col("x.pop").alias("pop"), F.ceil(F.col("x.n") / tile).cast("int").alias("shares"))
    keyed = rows.join(sizes, ["block", "value", "pop"], "left")
    small = keyed.where("shares is null").select("block", "value", F.lit(None).cast("string").alias("pair"), F.lit(0).alias("side"), "pop", "fp")
    # large buckets: each row goes to every pair of tiles that its own tile is in
    tiles = sizes.select("block", "value", "pop", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    this, that = tiles.alias("this"), tiles.alias("that")
    near = (F.col("this.block") == F.col("that.block")) & (F.col("this.value") == F.col("that.value")) & (F.abs(F.col("this.pop") - F.col("that.pop")) <= radius)
    name = lambda t: F.struct(f"{t}.pop", f"{t}.share")
    pairs = this.join(that, near).select(
        "this.block", "this.value", "this.pop", "this.share",
        F.concat_ws(":", F.least(name("this"), name("that")).cast("string"), F.greatest(name("this"), name("that")).cast("string")).alias("pair"),
        F.when(name("this") == name("that"), 0).when(name("this") < name("that"), 1).otherwise(2).alias("side"),
    )
    dealt = keyed.where("shares is not null").withColumn("share", F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int"))
    spread = dealt.join(pairs, ["block", "value", "pop", "share"]).select("block", "value", "pair", "side", "pop", "fp")
    group = F.xxhash64("block", "value", "pair")
    ordered = small.unionByName(spread).select("block", "value", "pair", "side", "pop", "fp", group.alias("g")).repartition(parts, "g").sortWithinPartitions("block", "value", "pair", "side", "pop", "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
            # a group is a run of equal (block, value, pair): equal hashes next to each other
            columns = [np.concatenate([b[k].to_numpy() for b in kept]) for k in range(4)]
            g, side, pop, fp = columns[0], columns[1], columns[2].astype(np.int64), columns[3].view(np.uint64)
            out_a, out_b = [], []
            own = np.flatnonzero(side == 0)
            if len(own):
                labels = _within(g[own], fp[own], pop[own], radius)
                moved = labels != np.arange(len(own))
                out_a.append(fp[own][moved])
                out_b.append(fp[own][labels[moved]])
            cross = np.flatnonzero(side > 0)
            for run in np.split(cross, np.flatnonzero(np.diff(g[cross])) + 1) if len(cross) else []:
                first, second = fp[run[side[run] == 1]], fp[run[side[run] == 2]]
                labels = _across(first, second, radius)
                both, moved = np.concatenate([first, second]), labels != np.arange(len(run))
                out_a.append(both[moved])
                out_b.append(both[labels[moved]])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (out_a, out_b))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        kept: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            batch = batch.select(["g", "side", "pop", "fp"])
            # a chunk ends where a group ends
            g = batch[0].to_numpy()
            ends = np.flatnonzero(np.diff(g)) + 1
            if kept and held > 1 << 16 and (len(ends) or (len(g) and g[0] != kept[-1][0].to_numpy()[-1])):
                at = 0 if g[0] != kept[-1][0].to_numpy()[-1] else int(ends[0])
                yield compared([*kept, batch.slice(0, at)])
                kept, held, batch = [], 0, batch.slice(at)
            if batch.num_rows:
                kept.append(batch)
                held += batch.num_rows
        if kept:
            yield compared(kept)

    return map_arrow(ordered, work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, fingerprint (16 hexadecimal digits), component_id, the smallest id reachable.

    Null and wordless texts have fingerprint zero and are linked like any other; a text of fewer words than a
    shingle is one shingle. Null ids are never a component's id unless all of its ids are null. Other columns
    are ignored; an empty table gives an empty result.
    """
    root = shared_dir(docs.sparkSession)
    marked = written(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints", root)
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes", root)
    roots = components(links(nodes.select("fp"), radius))
    placed = written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "placed", root)
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    moved = placed.join(least, "root").select("fp", "component_id")
    return marked.join(moved, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
