"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of the mix by weight, limited to a multiple of its size; the excess is shared anew
(water filling). A source whose target is r times its size gives floor(r) whole copies of each document; for
the rest, f = r - floor(r), each document has inclusion probability f, and documents are ranked by their
Pareto value q = (u / (1 - u)) / (f / (1 - f)), u a hash of the doc_id and the text. Within a source the sample is a
prefix of that order, fixed by size: as many words as the target leaves. A weight column makes the inclusion
probabilities unequal within a source. The gap that a document too large for it leaves is filled by later
documents of the order that fit, until none is left that does.

No source is ordered as a whole. Ranks are dealt into BINS bins; summed bins locate the one where the target
falls, and only rows of that bin and of the few after it are ordered. What they leave of the target is sought
in the same way among the rows after them that still fit, and so on.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.llm.common import shared_dir, words_count, written

#: Bins of the ranking: at 10**10 documents of one source, about 150,000 rows are ordered together.
BINS = 1 << 16
#: Bins after the boundary are ordered along with it up to this many documents of a source at a time.
AT_ONCE = 4096


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 of seed and key; null counts as an empty key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, most: float) -> DataFrame:
    """source, source_size, target from one row for each source. weights repeat over sources by code point, null last."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    by_need = Window.orderBy("need", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    return (
        sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("need", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(whole) * total_share - F.col("capped")) / F.col("open"))
        # the first source, by need, that the level leaves below its cap fixes the level for all after it
        .withColumn("nth", F.row_number().over(by_need))
        .withColumn("fixed", F.min(F.when(F.col("level") <= F.col("need"), F.struct("nth", "level"))).over(whole)["level"])
        .select("source", "source_size", F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("fixed") * F.col("weight"))).alias("target"))
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    total_share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns of docs (all, or those in keep) under ``doc``, with size, source_size, target, copies and taken = copies * size.

    Sizes are words; a null text has none, and takes no part but for the whole copies of its source. A null
    source is a source of its own, last in order. Rows that repeat a doc_id (null too) are ranked by
    their own texts; rows that repeat both rank alike and are ordered by row number. weight_col scales the inclusion odds within a source (null or below 0 counts as
    1). Empty tables give empty results. Reruns over the same table agree.
    """
    spark = docs.sparkSession
    root = shared_dir(spark)
    own = F.when(F.col(weight_col) > 0, F.col(weight_col).cast("double")).otherwise(1.0) if weight_col else F.lit(1.0)
    carried = F.struct(*(f"`{c}`" for c in (docs.columns if keep is None else keep)))
    rows = docs.select(
        carried.alias("doc"), F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key"), F.col(source_col).cast("string").alias("source"), words_count(F.col(text_col)).alias("size"), own.alias("own"), F.monotonically_increasing_id().alias("tag")
    )
    sized = written(rows, "sized", root)
    plan = written(_plan(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_share, most)), "plan", root)
    ranked = _with(sized, plan, spark).withColumn("v", _pareto(F.col("key"), seed)).withColumn("bin", F.least(F.floor(F.col("v") * BINS), F.lit(BINS - 1)))
    ranges, chosen = _sampled(ranked.where("rest > 0 and size > 0").select("source", "bin", "v", "key", "size", "tag", "rest"), root)
    placed = _with(ranked.drop("v", "rest"), ranges, spark)
    within = lambda test: F.coalesce(F.exists("ranges", lambda r: (F.col("size") > 0) & (F.col("size") <= r["gap"]) & test(r)), F.lit(False))
    placed = placed.withColumn("open", within(lambda r: F.col("bin").between(r["lo"], r["hi"])))
    clear = placed.where("not open").withColumn("copies", F.col("whole") + within(lambda r: (F.col("bin") > r["at"]) & (F.col("bin") < r["lo"])).cast("long"))
    close = placed.where("open").join(chosen, "tag", "left").withColumn("copies", F.col("whole") + F.coalesce("one", F.lit(0)))
    out = ["doc", "size", "source_size", "target", "copies"]
    return clear.select(*out).unionByName(close.select(*out)).withColumn("taken", F.col("copies") * F.col("size"))


#: Tables of one row for each source up to this many rows are broadcast (about 100 bytes a row); larger ones are joined by shuffle.
BROADCAST_SOURCES = 20_000


def _with(rows: DataFrame, by_source: DataFrame, spark: SparkSession) -> DataFrame:
    right = by_source.withColumnRenamed("source", "its")
    if by_source.count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    return rows.join(right, F.col("source").eqNullSafe(F.col("its")), "left").drop("its")


def _plan(targets: DataFrame) -> DataFrame:
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12)
    rest = F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size"))
    return targets.select("source", "source_size", "target", whole.alias("whole"), rest.alias("rest"), F.when(F.col("source_size") > 0, rest / F.col("source_size")).otherwise(0.0).alias("f"))


def _pareto(key: Column, seed: int) -> Column:
    """q / (1 + q), in [0, 1], of the Pareto value q; 1 where nothing is to be sampled."""
    u, f = uniform(key, seed), F.least(F.col("f"), F.lit(1.0 - 1e-9))
    q, scale = u * (1.0 - f), (1.0 - u) * f * F.col("own")
    return F.when(F.col("f") > 0, q / (q + scale)).otherwise(1.0)


def _sampled(rows: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """In the order of each source, every row that fits in what the rows before it leave of rest.

    Gives the ranges of each source, and the tags taken of those rows that were ordered. A range holds rows of
    up to gap words: those in bins between at and lo are all taken, those from lo to hi were ordered. A round
    adds a range to each source that still has rows that fit; a row passed over never fits again.
    """
    spark = rows.sparkSession
    rows = written(rows, "ranked", root)
    state = written(rows.groupBy("source").agg(F.lit(-1).cast("long").alias("at"), F.first("rest").alias("gap")), "start", root)
    rows = rows.drop("rest")
    found, taken = [], []
    for k in count():
        bounds = written(_bounds(_with(rows, state, spark).where("bin > at and size <= gap")), f"bounds{k}", root)
        if k and bounds.isEmpty():
            break
        near = _with(rows, bounds, spark).where("bin between lo and hi and size <= gap").select("source", "v", "key", "size", "tag", "left")
        filled = written(near.groupBy("source").applyInArrow(_fill, "source string, gap double, tags array<bigint>"), f"filled{k}", root)
        found.append(bounds)
        taken.append(filled)
        state = written(_with(bounds.select("source", F.col("hi").alias("at")), filled.select("source", "gap"), spark).where("gap >= 1"), f"state{k}", root)
        if state.isEmpty():
            break
    ranges = reduce(DataFrame.unionByName, found).groupBy("source").agg(F.collect_list(F.struct("at", "lo", "hi", "gap")).alias("ranges"))
    tags = reduce(DataFrame.unionByName, taken).select(F.explode("tags").alias("tag"), F.lit(1).alias("one"))
    return written(ranges, "ranges", root), tags


def _bounds(fitting: DataFrame) -> DataFrame:
    """For each source: at, gap, the bin lo that overshoots the gap, the last bin hi to be ordered with it, and what the bins before lo leave."""
    order = Window.partitionBy("source").orderBy("bin")
    one = Window.partitionBy("source")
    bins = fitting.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"), F.first("at").alias("at"), F.first("gap").alias("gap"))
    return (
        bins.withColumn("through", F.sum("words").over(order))
        .withColumn("lo", F.coalesce(F.min(F.when(F.col("through") > F.col("gap"), F.col("bin"))).over(one), F.lit(BINS)))
        .withColumn("ordered", F.sum(F.when(F.col("bin") >= F.col("lo"), F.col("docs"))).over(order))
        .groupBy("source")
        .agg(
            F.first("at").alias("at"),
            F.first("gap").alias("gap"),
            F.first("lo").alias("lo"),
            F.coalesce(F.max(F.when((F.col("bin") == F.col("lo")) | (F.col("ordered") <= AT_ONCE), F.col("bin"))), F.lit(BINS)).alias("hi"),
            (F.first("gap") - F.coalesce(F.sum(F.when(F.col("bin") < F.col("lo"), F.col("words"))), F.lit(0))).alias("left"),
        )
    )


def _fill(rows: pa.Table) -> pa.Table:
    """The tags of one source that are taken in order, each if it fits, and the gap that remains."""
    rows = rows.sort_by([(c, "ascending") for c in ("v", "key", "size", "tag")])
    gap, tags = rows["left"][0].as_py(), []
    for size, tag in zip(rows["size"].to_pylist(), rows["tag"].to_pylist(), strict=True):
        if size <= gap:
            gap -= size
            tags.append(tag)
    return pa.table([rows["source"].slice(0, 1), pa.array([gap], pa.float64()), pa.array([tags], pa.list_(pa.int64()))], ["source", "gap", "tags"])


def mixed(docs: DataFrame, seed: int = 7, **parameters: object) -> DataFrame:
    """The mix itself: columns of docs, each row as often as it is taken."""
    chosen = mix(docs, seed=seed, **parameters)
    return chosen.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
