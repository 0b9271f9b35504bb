"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A byte-level BPE encodes each pre-token by itself, so a document's count is the sum over its pre-tokens. The
tree's leaves hold runs of pre-tokens with their lengths and counts, inner nodes sums. An edit finds its place
by the sums, splits the text anew from the pre-token before it until boundaries meet the old ones again,
encodes only that region, and updates the sums above the leaves that it touched.

Trees are kept in a table, a row for each document and version: its text and its leaves. Edits that come later
are applied to that table; a tree is built again from its leaves without encoding anything, and the new version
is a row of the same form.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import map_arrow, shared_dir, written

#: Pre-tokens of a leaf when it is made, and at most.
LEAF, MOST = 64, 128
#: Characters that a split looks at beyond the edit before boundaries are compared.
AHEAD = 64
CACHE = 1_000_000


class Counter(dict):
    """Tokens of a pre-token."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        super().__init__()
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.split = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, pre_token: str) -> int:
        n = len(self.encoding.encode_ordinary(pre_token))
        if len(pre_token) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[pre_token] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.split.findall(text)))


class Node:
    """A run of pre-tokens (a leaf) or two nodes; chars and tokens are sums over all below."""

    __slots__ = ("chars", "counts", "left", "lengths", "right", "tokens")

    def __init__(self, lengths: list[int] | None = None, counts: list[int] | None = None, left: Node | None = None, right: Node | None = None) -> None:
        self.lengths, self.counts, self.left, self.right = lengths, counts, left, right
        self.sum()

    def sum(self) -> None:
        if self.lengths is not None:
            self.chars, self.tokens = sum(self.lengths), sum(self.counts)
        else:
            self.chars, self.tokens = self.left.chars + self.right.chars, self.left.tokens + self.right.tokens


def _built(leaves: list[Node]) -> Node:
    while len(leaves) > 1:
        leaves = [Node(left=leaves[k], right=leaves[k + 1]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0]


def _leaves(lengths: list[int], counts: list[int]) -> list[Node]:
    return [Node(lengths[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(lengths), LEAF)] or [Node([], [])]


class CountedText:
    """A text with its token count, kept under edits. encoded: pre-tokens that had to be counted so far."""

    def __init__(self, text: str, counter: Counter, kept: bytes | None = None) -> None:
        """kept: leaves of the same text, from which the tree is built without encoding it."""
        self.text, self.counter, self.encoded = text, counter, 0
        if kept is None:
            parts = counter.split.findall(text)
            lengths, counts = list(map(len, parts)), [counter[x] for x in parts]
            self.encoded = len(parts)
        else:
            lengths, counts = np.frombuffer(kept, "<u4").reshape(2, -1).tolist()
        self.root = _built(_leaves(lengths, counts))

    def leaves(self) -> bytes:
        """Lengths of all pre-tokens in characters, then their counts, as 32-bit numbers."""
        lengths, counts, above = [], [], [self.root]
        while above:
            node = above.pop()
            if node.lengths is None:
                above += [node.right, node.left]
            else:
                lengths += node.lengths
                counts += node.counts
        return np.array([lengths, counts], "<u4").tobytes()

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def _boundaries(self, at: int) -> Iterator[int]:
        """Boundaries of pre-tokens from the last one at or before ``at`` on."""
        node, start, above = self.root, 0, []
        while node.lengths is None:
            if at < start + node.left.chars or not node.right.chars:
                above.append((node.right, start + node.left.chars))
                node = node.left
            else:
                start += node.left.chars
                node = node.right
        first = True
        while True:
            for n in node.lengths:
                if not first or start + n > at:
                    yield start
                    first = False
                start += n
            if not above:
                yield start
                return
            node, start = above.pop()
            while node.lengths is None:
                above.append((node.right, start + node.left.chars))
                node = node.left

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end]. Places outside the text are moved into it."""
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        # white space before the edit may join or part with what follows: begin at the pre-token before the one touched
        low = next(self._boundaries(max(0, start - 1)))
        low = next(self._boundaries(max(0, low - 1)))
        while low and self.text[low - 1 : low].isspace() and self.text[low : low + 1].isspace():
            low = next(self._boundaries(low - 1))
        old = self._boundaries(end)
        mark, size = next(old), AHEAD
        while True:
            # the last pre-tokens of a cut piece may depend on what follows: use those that end well before the cut
            stop = min(len(text), end + shift + size)
            lengths, parts, at, met = [], [], low, None
            for m in self.counter.split.finditer(text, low, stop):
                if at != m.start():
                    raise ValueError("the pattern leaves gaps")
                if at >= end + shift and (stop == len(text) or at < stop - AHEAD // 2):
                    while mark + shift < at and mark < n:
                        mark = next(old)
                    if mark + shift == at:
                        met = mark
                        break
                lengths.append(len(m[0]))
                parts.append(m[0])
                at = m.end()
            if met is not None:
                break
            if stop == len(text):
                met = n
                break
            old, size = self._boundaries(end), 2 * size
            mark = next(old)
        self.encoded += len(parts)
        self._splice(low, met, lengths, [self.counter[x] for x in parts])
        self.text = text

    def _splice(self, low: int, high: int, lengths: list[int], counts: list[int]) -> None:
        """Replaces the pre-tokens of [low, high), both boundaries, by new ones."""

        def within(node: Node, start: int, lengths: list[int], counts: list[int]) -> Node | None:
            if node.lengths is not None:
                at, before, after = start, ([], []), ([], [])
                for n, c in zip(node.lengths, node.counts, strict=True):
                    if at < low:
                        before[0].append(n)
                        before[1].append(c)
                    elif at >= high:
                        after[0].append(n)
                        after[1].append(c)
                    at += n
                node.lengths, node.counts = before[0] + lengths + after[0], before[1] + counts + after[1]
                if len(node.lengths) > MOST:
                    return _built(_leaves(node.lengths, node.counts))
                node.sum()
                return node if node.lengths else None
            middle = start + node.left.chars
            here = low < middle or not node.right.chars
            left, right = node.left, node.right
            if here:
                left = within(left, start, lengths, counts)
            if high > middle or not here:
                right = within(right, middle, *(([], []) if here else (lengths, counts)))
            if left is None or right is None:
                return left or right
            node.left, node.right = left, right
            node.sum()
            return node

        self.root = within(self.root, 0, lengths, counts) or Node([], [])


_counters: dict[tuple, Counter] = {}


def _counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


#: Edits of a text: (start, end, replacement), each applied to the text that the ones before it left.
Edits = Callable[[str], list[tuple[int, int, str]]]


_TREE = "doc_id long, version int, text string, leaves binary, n_pretokens long, n_tokens long"


def trees(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The first version of each document's tree: doc_id, version, text, leaves, n_pretokens, n_tokens, and columns in keep as ``kept``.

    A null text counts as empty. Repeated rows and null ids each have their own tree; other columns are ignored,
    and an empty table gives none.
    """
    kept = F.struct(F.lit(None).cast("int").alias("_"), *(F.col(c) for c in keep or []))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), kept.alias("kept"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern)
        for batch in batches:
            own = [CountedText(text, counter) for text in batch[1].to_pylist()]
            made = [pa.array([0] * len(own), pa.int32()), batch[1], pa.array([x.leaves() for x in own], pa.binary()), pa.array([x.encoded for x in own], pa.int64()), pa.array([x.tokens for x in own], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch[0], *made, batch[2]], [*(x.split()[0] for x in _TREE.split(", ")), "kept"])

    return map_arrow(rows, work, f"{_TREE}, kept {rows.schema['kept'].dataType.simpleString()}")


def edited(kept_trees: DataFrame, edits: F.Column, path: str, pattern: str) -> DataFrame:
    """The next version of each tree, with n_edits, reencoded (pre-tokens counted anew), and the counts before: old_pretokens, old_tokens.

    edits: array<struct<start,end,new>>, each applied to the text that the ones before it left, in characters;
    places outside a text are moved into it, null edits and null members count as none and as empty.
    """
    schema = f"{_TREE}, n_edits long, reencoded long, old_pretokens long, old_tokens long"
    rows = kept_trees.select("doc_id", "version", "text", "leaves", edits.alias("edits"), "n_pretokens", "n_tokens")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern)
        for batch in batches:
            out = []
            for doc_id, version, text, leaves, changes in zip(*(batch[k].to_pylist() for k in range(5)), strict=True):
                counted = CountedText(text or "", counter, leaves)
                for x in changes or []:
                    if x:
                        counted.edit(x["start"] or 0, x["start"] or 0 if x["end"] is None else x["end"], x["new"] or "")
                made = counted.leaves()
                out.append((doc_id, version + 1, counted.text, made, len(made) // 8, counted.tokens, len(changes or []), counted.encoded))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)] + [batch[5], batch[6]], [x.split()[0] for x in schema.split(", ")])

    return map_arrow(rows, work, schema)


def edit_counts(docs: DataFrame, path: str, pattern: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens, and after the edits: n_edits, edited_chars, edited_tokens, reencoded (pre-tokens counted anew).

    Trees are written as a table, and the edits are applied to what is read back. Nulls, repeated rows and other
    columns are treated as trees and edited do.
    """
    stored = written(trees(docs, path, pattern, id_col, text_col, [edits_col]), "trees", shared_dir(docs.sparkSession))
    after = edited(stored, F.col(f"kept.`{edits_col}`"), path, pattern)
    return after.select(
        "doc_id", F.col("old_pretokens").alias("n_pretokens"), F.col("old_tokens").alias("n_tokens"), "n_edits", F.length("text").cast("long").alias("edited_chars"), F.col("n_tokens").alias("edited_tokens"), "reencoded"
    )


def review_edits(text: str = "text", id_col: str = "doc_id") -> F.Column:
    """A reproducible review of each text: a word put in, a stretch taken out, a stretch replaced, a note at the end."""
    n = F.length(F.coalesce(text, F.lit("")))
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col(id_col)), F.greatest(n, F.lit(1))).cast("int")
    one = lambda start, end, new: F.struct(start.alias("start"), end.alias("end"), F.lit(new).alias("new"))
    return F.array(one(place(1), place(1), " reviewed "), one(place(2), place(2) + 40, ""), one(place(3), place(3) + 12, "it's 2 new\n\nlines  "), one(n + 100, n + 100, "\n(end)"))
