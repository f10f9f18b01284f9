"""Vectorised access to the texts of an Arrow batch.

Texts stay in their UTF-8 buffers: words are pairs of byte offsets found with NumPy over many documents at
once, so no Python object is made per word. Work is cut into pieces of a bounded number of bytes; only one
document longer than that bound makes a larger piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

#: ASCII white space, the only characters that separate words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass
class Piece:
    """Some neighbouring rows of a batch: their bytes and where each row starts (one more entry closes the last)."""

    start: int
    stop: int
    data: np.ndarray
    offsets: np.ndarray


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, where, data = texts.buffers()
    if where is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(texts: pa.Array, most_bytes: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a batch of texts into pieces of at most ``most_bytes``, or one longer text. Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    data, offsets = _buffers(texts)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        to = min(to, n)
        yield Piece(at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number of words per row; ``separator`` tells by byte what stands between words."""
    inside = ~separator[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        after[-1] = False
        after[:-1] = inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(inside))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (the SplitMix64 finaliser)."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, equal in every task and run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int((ends - starts).max())
    powers = np.full(longest, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = (data[within + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers[within]
    return mixed(np.add.reduceat(values, first) ^ (lengths.astype(np.uint64) << np.uint64(48)))


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over runs of the given lengths, zero for empty runs."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
