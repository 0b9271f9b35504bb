"""Personal data by bootstrapped contextual extraction. DataFrame operations only.

A text is read as units: tokens that hold a digit or @, with the tokens of digits that follow them. Base
patterns find e-mail addresses, IP addresses, card numbers and telephone numbers; every match lies within one
unit. Units that are such a match as a whole seed the method, and so do strings of the shape of generated
secrets (long, of letters and digits), a kind that has no base pattern.

The words around seeds form lexical patterns, and a bipartite graph links patterns to all units without a base
match that they surround anywhere in the corpus. Scores pass between both sides: a pattern is as good as the
share of seeds and confident instances among all that it extracts; an instance is as good as the best pattern
that extracts it, less so if it is far shorter than all seeds of the kind. Units become findings of a seed's
kind where a confident pattern extracts a confident instance; so do the seeds of secrets, which are reported
in no other case. Base findings always stay.

The graph has one edge for each distinct pattern and instance, aggregated before it is shuffled, so that a
unit or a context that fills a third of all rows is one edge. A text is walked once: split pieces carry the
neighbours of units, so that time grows with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import shared_dir, written

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: A run can begin where no character of its class precedes it, or where the last match ended; so no start is
#: tried inside a run, which keeps long runs linear. The matches are those of the plain patterns. Repeated
#: groups are possessive: Java matches other ones recursively.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit or @, and tokens that continue it as cards and telephone numbers may.
UNIT = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:(?<=[0-9().-])\x20[\x20().-]*+[0-9]\S*+)*+"
#: What precedes an identifier within its unit: punctuation, a name with = or :, and more punctuation.
LEAD = r"^[^\p{L}\p{N}+]*+(?:\p{L}[\p{L}\p{N}_.-]*+[=:]++[^\p{L}\p{N}+]*+)?"
TAIL = r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"
#: The shape of a seed of secrets: characters, and letters and digits that it needs at least.
SECRET_CHARS, SECRET_OF_EACH = 20, 4
MIN_SEEDS, ROUNDS, CONFIDENT = 3, 4, 0.8
#: An instance of less than the shortest seed's length over this loses trust in proportion.
SHORTER = 3
#: Longer words of a pattern, and longer instances, are told apart by a digest: nothing is cut off.
LONG_WORD, LONG_INSTANCE = 48, 256
#: Patterns up to this many are broadcast: rows of at most 450 bytes, as their words are bounded. More are joined by shuffle.
BROADCAST_ROWS = 50_000
_STEP = 256
_SPAN = "array<struct<start:int,end:int,m:string>>"


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body of value, with value computed once."""
    return F.transform(F.array(value), body)[0]


def _before(lengths: Column) -> Column:
    """For each of the lengths the sum of those before it, by blocks, so that nothing is appended to."""
    add = lambda x: F.aggregate(x, F.lit(0), lambda total, n: total + n)
    ahead = lambda x: F.transform(x, lambda n, i: add(F.slice(x, 1, i)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / _STEP).cast("int")), lambda k: F.slice(lengths, k * _STEP + 1, _STEP))
    return _let(blocks, lambda x: F.flatten(F.zip_with(x, _let(F.transform(x, add), ahead), lambda block, start: F.transform(ahead(block), lambda n: start + n))))


def _running(rows: Column) -> Column:
    """From array<struct<gap,m>>, gaps in code points: array<struct<start,end,m>>."""
    sums = _let(F.transform(rows, lambda x: x["gap"] + F.length(x["m"])), _before)
    return F.zip_with(rows, sums, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("m")))


def _paired(text: Column, pattern: str) -> Column:
    """array<struct<gap,m>>: all matches, each with the length of the text between it and the one before, in code points."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return _let(found, lambda m: F.zip_with(m, F.slice(between, 1, F.size(m)), lambda one, gap: F.struct(F.length(gap).alias("gap"), one.alias("m"))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substr(digits, n - i + 1, F.lit(1))) - 48
        return total + F.when(i % 2 == 0, digit * 2 - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.lpad(short(p), 3, "0") <= "255"))
    if kind == "card":
        return _let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _standing(kind: str):  # noqa: ANN202  a test of one match
    return lambda x: _valid(kind, x["m"])


#: What a text must hold for a kind's pattern to match.
_CUES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}


def _bases(text: Column) -> Column:
    """An array of the matches that stand for each kind."""
    none = F.array().cast("array<struct<gap:int,m:string>>")
    found = F.array(*(F.when(F.rlike(text, F.lit(_CUES[kind])), _paired(text, PATTERNS[kind])).otherwise(none) for kind in KINDS))
    placed = F.transform(found, lambda rows: F.when(F.size(rows) > 0, _running(rows)).otherwise(F.array().cast(_SPAN)))
    return _let(placed, lambda x: F.struct(*(F.filter(x[k], _standing(kind)).alias(kind) for k, kind in enumerate(KINDS))))


def _short(word: Column, most: int) -> Column:
    return F.when(F.length(word) <= most, word).otherwise(F.concat(F.lit("#"), F.hex(F.xxhash64(word)), F.lit(":"), F.length(word).cast("string")))


def _units(text: Column) -> Column:
    """array<struct<start,end,m,before,after>>: units with the two words before them and the word after, in lower case."""

    def near(gap: Column) -> Column:
        edges = lambda x: F.struct(F.length(gap).alias("gap"), F.substring_index(x, " ", -2).alias("last"), F.substring_index(x, " ", 1).alias("first"))
        return _let(F.trim(F.regexp_replace(F.lower(gap), r"\s+", " ")), edges)

    def told(found: Column, gaps: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            earlier = lambda n: F.coalesce(F.lower(F.get(found, k - n)), F.lit(""))
            last = lambda n: F.coalesce(F.get(gaps, k - n)["last"], F.lit(""))
            # where a gap has fewer than two words, the units before it give them
            before = F.when(F.contains(last(0), F.lit(" ")), last(0)).otherwise(F.substring_index(F.trim(F.concat_ws(" ", earlier(2), last(1), earlier(1), last(0))), " ", -2))
            after = F.coalesce(F.nullif(F.get(gaps, k + 1)["first"], F.lit("")), F.lower(F.substring_index(F.get(found, k + 1), " ", 1)), F.lit("$"))
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), before.alias("before"), after.alias("after"))

        pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, gap: F.struct(gap["gap"].alias("gap"), m.alias("m")))
        return F.transform(_let(pairs, _running), one)

    return _let(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda found: _let(F.transform(F.split(text, UNIT, -1), near), lambda gaps: told(found, gaps)))


def _patterns(words: Column, after: Column) -> Column:
    """The word before a unit; two words before it; the word before and the word after."""
    last = lambda k: _short(F.coalesce(F.nullif(F.get(words, F.size(words) - k), F.lit("")), F.lit("^")), LONG_WORD)
    one = lambda near: F.array(F.concat_ws(" ", F.lit("after"), near["a"]), F.concat_ws(" ", F.lit("after"), near["b"], near["a"]), F.concat_ws(" ", F.lit("within"), near["a"], _short(after, LONG_WORD)))
    return _let(F.struct(last(1).alias("a"), last(2).alias("b")), one)


def _secret(m: Column) -> Column:
    count = lambda others: F.length(F.regexp_replace(m, others, ""))
    return F.when(F.length(m) >= SECRET_CHARS, F.rlike(m, F.lit("^[A-Za-z0-9+/_-]++=*+$")) & (count("[^0-9]") >= SECRET_OF_EACH) & (count("[^A-Za-z]") >= SECRET_OF_EACH)).otherwise(False)


def _marked(kind: str, *fields: str) -> Column:
    """The spans of a kind's column with the kind's name."""
    return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), *(x[f].alias(f) for f in fields)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """tag, doc_id, an array of base spans for each kind, and occurrences: (kind of a seed or null, free, start, end, instance, patterns)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.when(F.rlike("text", F.lit("[0-9@]")), _units(F.col("text"))).otherwise(F.array().cast(_SPAN.replace(">>", ",before:string,after:string>>"))).alias("units"))

    def read(x: Column) -> Column:
        def told(lead: Column) -> Column:
            key = F.lower(F.regexp_extract(lead, r"(\p{L}.*)?[=:]", 1))
            before = F.when(key != "", F.concat_ws(" ", F.substring_index(x["before"], " ", -1), key)).otherwise(x["before"])
            return F.struct(F.length(lead).alias("n"), F.regexp_replace(F.substr(x["m"], F.length(lead) + 1), TAIL, "").alias("core"), F.split(before, " ").alias("words"))

        def whole(y: Column) -> Column:
            return F.struct(
                x["start"].alias("at"), (x["start"] + y["n"]).alias("start"), (x["start"] + y["n"] + F.length(y["core"])).alias("end"), y["core"].alias("m"),
                _patterns(y["words"], x["after"]).alias("patterns"), _bases(x["m"]).alias("base"),
            )

        return _let(_let(F.regexp_extract(x["m"], LEAD, 0), told), whole)

    rows = rows.select("doc_id", F.transform("units", read).alias("units"))
    moved = lambda kind: F.flatten(F.transform("units", lambda u: F.transform(u["base"][kind], lambda x: F.struct((u["at"] + x["start"]).alias("start"), (u["at"] + x["end"]).alias("end")))))

    def told(u: Column) -> Column:
        whole = lambda kind: (F.size(u["base"][kind]) == 1) & (F.get(u["base"][kind], F.lit(0))["m"] == u["m"])
        kind = F.coalesce(*(F.when(whole(kind), kind) for kind in KINDS), F.when(_secret(u["m"]), SECRET))
        bare = F.lit(True)
        for name in KINDS:
            bare = bare & (F.size(u["base"][name]) == 0)
        instance = _short(F.lower(u["m"]), LONG_INSTANCE)
        return F.struct(kind.alias("kind"), bare.alias("free"), u["start"].alias("start"), u["end"].alias("end"), instance.alias("instance"), u["patterns"].alias("patterns"))

    # a unit that holds a base match and more is neither a seed nor an instance
    occurrences = F.filter(F.transform("units", told), lambda x: (x["end"] > x["start"]) & (x["free"] | x["kind"].isin(*KINDS)))
    return rows.select(F.monotonically_increasing_id().alias("tag"), "doc_id", *(moved(kind).alias(kind) for kind in KINDS), occurrences.alias("occurrences"))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def discover(scanned: DataFrame, root: str, min_seeds: int = MIN_SEEDS, rounds: int = ROUNDS, confident: float = CONFIDENT) -> tuple[DataFrame, DataFrame]:
    """Findings beyond the base patterns (tag, kind, start, end), and the patterns with their scores (pattern, as_kind, score)."""
    seen = scanned.select("tag", F.explode("occurrences").alias("o")).select("tag", "o.*")
    links = written(seen.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct(), "links", root)
    seeds = links.where("kind is not null").select("instance", "kind").distinct()
    useful = links.where("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= min_seeds).select("pattern", F.col("kind").alias("as_kind"))
    useful = written(useful, "useful", root)
    edges = links.select("pattern", "instance").distinct().join(_bounded(useful), "pattern")
    known = seeds.groupBy("instance").agg(F.collect_set("kind").alias("kinds"))
    shortest = seeds.groupBy(F.col("kind").alias("as_kind")).agg(F.min(F.length("instance")).alias("shortest"))  # a row for each kind
    edges = edges.join(known, "instance", "left").join(F.broadcast(shortest), "as_kind")
    seed = F.when(F.array_contains("kinds", F.col("as_kind")), 1.0).when(F.col("kinds").isNotNull(), 0.0)
    edges = written(edges.select("pattern", "as_kind", "instance", seed.alias("seed"), F.least(F.lit(1.0), SHORTER * F.length("instance") / F.col("shortest")).alias("fits")), "edges", root)
    trust = None
    for k in range(rounds):
        scored = edges if trust is None else edges.join(trust, ["instance", "as_kind"], "left")
        held = F.lit(0.0) if trust is None else F.when(F.col("trust") >= confident, F.col("trust"))
        worth = F.coalesce("seed", held, F.lit(0.0))
        patterns = written(scored.groupBy("pattern", "as_kind").agg((F.sum(worth) / (F.count(F.lit(1)) + 1)).alias("score")), f"patterns{k}", root)
        trust = edges.where("seed is null or seed = 1").join(_bounded(patterns), ["pattern", "as_kind"]).groupBy("instance", "as_kind").agg(F.max(F.col("score") * F.col("fits")).alias("trust"))
        trust = written(trust, f"trust{k}", root)
    good = patterns.where(F.col("score") >= confident).select("pattern", "as_kind")
    sure = trust.where(F.col("trust") >= confident).select("instance", "as_kind", "trust")
    open_ = seen.where("free").select("tag", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    met = open_.join(_bounded(good), "pattern").join(sure, ["instance", "as_kind"])
    best = F.max(F.struct("trust", "as_kind"))["as_kind"]
    return met.groupBy("tag", "start", "end").agg(best.alias("kind")).select("tag", "kind", "start", "end"), patterns


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters: object) -> DataFrame:
    """One row for each document: its id, an array of base spans for each kind, and ``found``: findings of the method.

    A null text counts as empty and has no spans. Rows that repeat a doc_id each have their own findings; null
    doc_ids are kept. Other columns are ignored, whatever their names; an empty table gives an empty result.
    Very long texts are read in time that grows with their length, and a text of one unit is one instance.
    Findings never overlap base spans.
    """
    root = shared_dir(docs.sparkSession)
    scanned = written(scan(docs, id_col, text_col), "scan", root)
    more = discover(scanned, root, **parameters)[0].groupBy("tag").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return scanned.join(written(more, "found", root), "tag", "left").select(F.col("doc_id").alias(id_col), *KINDS, F.coalesce("found", none).alias("found"))


def digests(docs: DataFrame, **parameters: object) -> DataFrame:
    """The columns of the query: counts and a digest of base spans, all spans as text, and their number."""
    rows = personal_data(docs, **parameters)
    rank = lambda kind: F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), kind)
    name = lambda kind, x: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))
    own = F.concat(*(_marked(kind, "start", "end") for kind in KINDS))
    ranked = lambda x: F.struct(rank(x["kind"]).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    plain = F.array_join(F.transform(own, lambda x: name(x["kind"], x)), ",")
    everything = F.array_join(F.transform(F.sort_array(F.transform(F.concat(own, F.col("found")), ranked)), lambda x: name(x["kind"], x)), ",")
    return rows.select(
        rows.columns[0], *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS), F.sha2(plain.cast("binary"), 256).alias("base_sha256"), everything.alias("spans"),
        (F.size(own) + F.size("found")).cast("long").alias("n_spans"),
    )
