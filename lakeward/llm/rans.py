"""Static range asymmetric numeral system over token ids.

All blocks share one frequency table. A block's ids are dealt round-robin to LANES interleaved coders whose
64-bit states advance together as numpy vectors; words of 32 bits leave a state when it would overflow. A
block is independent of all others. Every CHECKPOINT steps it records the states and the place in the word
stream, so that decoding can begin there as well as at the block's start.

Block layout, little-endian: ids u32, words u32, checkpoints u32, crc32 of the ids as u32, then for each
checkpoint its step u32, place u32 and states u64[LANES], then the words u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LANES = 1024
CHECKPOINT = 128
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<IIII")
_AT = struct.Struct("<II")


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies summing to 2**SCALE, at least 1 for each id that occurs."""
    counts = np.asarray(counts, np.float64)
    total, space = counts.sum(), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > space:
        raise ValueError("more ids occur than the table has slots")
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (space / total))), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    while (over := int(freq.sum()) - space) != 0:
        if over < 0:
            freq[order[0]] -= over
        else:
            spare = freq[order] - 1
            cut = np.minimum(spare, np.maximum(1, spare * over // max(1, spare.sum())))
            cut = np.where(np.cumsum(cut) <= over, cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
            freq[order] -= np.minimum(np.maximum(spare, 0), cut)
    return freq


class Table:
    """What encoder and decoder derive from the shared frequencies."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = np.asarray(freq, np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), np.asarray(freq, np.int64))

    def bytes(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes())

    @classmethod
    def of(cls, data: bytes) -> Table:
        return cls(np.frombuffer(zlib.decompress(data), "<u4"))


def encode(ids: np.ndarray, table: Table) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    crc, steps = zlib.crc32(ids.tobytes()), -(-len(ids) // LANES)
    state, words, points, sent = np.full(LANES, _LOW, np.uint64), [], [], 0
    shift, word = np.uint64(SCALE), np.uint64(32)
    limit = np.uint64(((1 << 31) >> SCALE) << 32)
    if len(ids) and not table.freq[ids].all():
        raise ValueError("an id has no frequency in the shared table")
    for step in range(steps - 1, -1, -1):
        part = ids[step * LANES : (step + 1) * LANES]
        freq, x = table.freq[part], state[: len(part)]
        full = x >= limit * freq
        out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
        x = np.where(full, x >> word, x)
        quotient = x // freq
        state[: len(part)] = (quotient << shift) + (x - quotient * freq) + table.start[part]
        words.append(out)
        sent += len(out)
        if step % CHECKPOINT == 0:
            points.append((step, sent, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    head = _HEAD.pack(len(ids), len(stream), len(points), crc)
    marks = b"".join(_AT.pack(step, len(stream) - at) + states.astype("<u8").tobytes() for step, at, states in points[::-1])
    return head + marks + stream.tobytes()


def decode(block: bytes, table: Table, first_step: int = 0, last_step: int | None = None) -> np.ndarray:
    """The ids of a block, or of its steps from a checkpoint (a multiple of CHECKPOINT) to before last_step.

    The checksum is verified when the whole block is decoded.
    """
    n, n_words, n_points, crc = _HEAD.unpack_from(block)
    size = _AT.size + 8 * LANES
    stream = np.frombuffer(block, "<u4", n_words, _HEAD.size + n_points * size)
    steps = -(-n // LANES)
    last = steps if last_step is None else min(last_step, steps)
    if not n or first_step >= last:
        return np.zeros(0, "<u4")
    base = _HEAD.size + first_step // CHECKPOINT * size
    step, at = _AT.unpack_from(block, base)
    if step != first_step:
        raise ValueError("decoding begins at a checkpoint only")
    state = np.frombuffer(block, "<u8", LANES, base + _AT.size).astype(np.uint64)
    out = np.empty(min(n, last * LANES) - first_step * LANES, "<u4")
    shift, word, mask = np.uint64(SCALE), np.uint64(32), np.uint64((1 << SCALE) - 1)
    wide = stream.astype(np.uint64)
    for k in range(first_step, last):
        width = min(LANES, n - k * LANES)
        x = state[:width]
        slot = x & mask
        ids = table.symbol[slot]
        x = table.freq[ids] * (x >> shift) + slot - table.start[ids]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << word) | wide[at : at + len(low)]
        at += len(low)
        state[:width] = x
        out[(k - first_step) * LANES : (k - first_step) * LANES + width] = ids
    if first_step == 0 and last == steps and zlib.crc32(out.tobytes()) != crc:
        raise ValueError("a block's checksum does not match")
    return out
