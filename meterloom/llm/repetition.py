"""Quality rules over repeated substrings, found with suffix arrays.

All documents of a piece are sorted together: a suffix is a row of words, and documents never mix because the
document is the first sort key. Prefix doubling refines only suffixes that still tie, so ordinary prose is done
after two or three rounds. Neighbours in the suffix array that tied on the way get their longest common prefix by
binary search over hashed prefixes; all others share fewer words than a repeat must have. The longest prefix that
a suffix shares with either neighbour is the longest interval of the array that holds it; where the word before
cannot be added, that is an occurrence of a maximal repeat. The union of those spans is the covered part.

Memory is bounded by a piece of texts, or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACE, hashes, pieces, row_sums, words

#: Words that a repeat has at least.
LEAST_REPEAT = 5
LEAST_WORDS = 10
#: Percent of words inside repeats, and words of one repeat, that a kept document has at most.
MOST_COVERED = 20
MOST_REPEAT = 100
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)

_MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "n_maximal_repeats")])


def suffix_order(tokens: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array over documents that follow each other, and for each entry the number of leading words (a power
    of two, or zero) that it certainly shares with the entry before it."""
    n = len(tokens)
    order = np.lexsort((tokens, doc))
    tied = np.zeros(n, np.int64)
    if not n:
        return order, tied
    same = np.r_[False, (tokens[order][1:] == tokens[order][:-1]) & (doc[order][1:] == doc[order][:-1])]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    rank = np.empty(n, np.int64)
    rank[order] = head
    slots = np.flatnonzero(same | np.r_[same[1:], False])
    tied[same] = 1
    k = 1
    while len(slots):
        at = order[slots]
        ahead = np.minimum(at + k, n - 1)
        second = np.where((at + k < n) & (doc[ahead] == doc[at]), rank[ahead], -1)
        first = rank[at]
        moved = np.lexsort((second, first))
        at, first, second = at[moved], first[moved], second[moved]
        order[slots] = at
        # A suffix that ends here has no words left to tie on.
        same = np.r_[False, (first[1:] == first[:-1]) & (second[1:] == second[:-1]) & (second[1:] >= 0)]
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(slots))))
        rank[at] = slots[head]
        k *= 2
        tied[slots[same]] = k
        slots = slots[same | np.r_[same[1:], False]]
    return order, tied


def common_prefixes(order: np.ndarray, tied: np.ndarray, tokens: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Words that each entry of a suffix array shares with the one before, exact where that is at least ``least``.

    ``ends`` has, for each word, where its document ends.
    """
    out = np.zeros(len(order), np.int64)
    rows = np.flatnonzero(2 * tied >= least)  # two entries that share k * 2 words or more tied at k * 2
    if not len(rows):
        return out
    powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(tokens), _STEP)])
    prefix = np.r_[np.uint64(0), np.add.accumulate(tokens * powers[:-1])]
    a, b = order[rows - 1], order[rows]
    room = np.minimum(ends[a] - a, ends[b] - b)
    low, high = np.minimum(tied[rows], room), np.minimum(2 * tied[rows], room)
    first, last = np.minimum(a, b), np.maximum(a, b)
    shift = powers[last - first]
    while (low < high).any():
        mid = (low + high + 1) // 2
        equal = (prefix[first + mid] - prefix[first]) * shift == prefix[last + mid] - prefix[last]
        low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
    out[rows] = low
    return out


def repeats(tokens: np.ndarray, counts: np.ndarray, least: int = LEAST_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """For each word the length of the longest repeat that starts there (zero if under ``least``), and whether that
    repeat cannot be extended to the left."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order, tied = suffix_order(tokens, doc)
    ends = np.repeat(np.cumsum(counts), counts)
    shared = common_prefixes(order, tied, tokens, ends, least)
    longest = np.zeros(len(tokens), np.int64)
    longest[order] = np.maximum(shared, np.r_[shared[1:], 0][: len(shared)])
    longest[longest < least] = 0
    grown = np.r_[False, (longest[:-1] > longest[1:]) & (doc[:-1] == doc[1:])] if len(doc) else np.zeros(0, bool)
    return longest, (longest > 0) & ~grown


def covered(longest: np.ndarray) -> np.ndarray:
    """Which words lie in the union of the spans [i, i + longest[i])."""
    reach = np.maximum.accumulate(np.where(longest > 0, np.arange(len(longest)) + longest, 0))
    return reach > np.arange(len(longest))


def _repeated_lines(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines per row that hold a word and equal an earlier line of the row."""
    newline = np.zeros(256, bool)
    newline[10] = True
    starts, ends, per_row = words(raw, offsets, newline)  # empty lines hold no word anyway
    seen = np.r_[0, np.cumsum(~SPACE[raw])]
    full = seen[ends] > seen[starts]
    row = np.repeat(np.arange(len(per_row)), per_row)[full]
    marks = hashes(raw, starts[full], ends[full])
    order = np.lexsort((marks, row))
    same = (marks[order][1:] == marks[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][same], minlength=len(per_row))


def measure(texts: pa.Array, least: int = LEAST_REPEAT) -> dict[str, np.ndarray]:
    """The measures of each text of an Arrow array, see :func:`quality`."""
    found: list[list[np.ndarray]] = []
    for piece in pieces(texts):
        raw = piece.data
        starts, ends, counts = words(raw, piece.offsets)
        inside = ~SPACE[raw]
        lead = (raw & 0xC0) != 0x80
        by_row = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][piece.offsets])  # noqa: E731, B023
        longest, maximal = repeats(hashes(raw, starts, ends), counts, least)
        rows = np.repeat(np.arange(len(counts)), counts)
        top = np.zeros(len(counts), np.int64)
        np.maximum.at(top, rows[longest > 0], longest[longest > 0])
        found.append([counts, by_row(inside & lead), by_row(_SYMBOL[raw]), _repeated_lines(raw, piece.offsets),
                      row_sums(covered(longest), counts), top, row_sums(maximal, counts)])
    columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(len(_MEASURES))]
    return dict(zip(_MEASURES.names, columns, strict=True))


def spans(text: str, least: int = LEAST_REPEAT) -> list[tuple[int, int]]:
    """Word ranges [start, end) of all occurrences of maximal repeats in one text."""
    piece = next(pieces(pa.array([text])))
    starts, ends, counts = words(piece.data, piece.offsets)
    longest, maximal = repeats(hashes(piece.data, starts, ends), counts, least)
    return [(int(i), int(i + longest[i])) for i in np.flatnonzero(maximal)]


def quality(
    docs: DataFrame, text: str = "text", least_repeat: int = LEAST_REPEAT, least_words: int = LEAST_WORDS,
    most_covered: int = MOST_COVERED, most_repeat: int = MOST_REPEAT,
) -> DataFrame:
    """Rows of ``row`` (all columns of ``docs``) and measures of the whole text.

    Words are runs of anything but ASCII white space. ``n_repeat_words`` counts words inside repeats of
    ``least_repeat`` words or more, overlapping occurrences included; ``longest_repeat`` is the longest one in
    words; ``n_maximal_repeats`` counts occurrences that can't be extended to either side. ``base_failed``: fewer
    than ``least_words`` words, or more than ``most_covered`` percent of them repeated. ``kept``: not failed and no
    repeat longer than ``most_repeat`` words. Null and empty texts have no words, so they fail. Repeated rows are
    judged alike; empty tables give no rows.
    """
    packed, place = docs.select(F.struct("*").alias("row")), docs.columns.index(text)
    schema = T.StructType([packed.schema["row"], *_MEASURES.fields])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column("row").field(place), least_repeat)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(v.astype(np.int64)) for v in found.values())], schema.names)

    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_covered * F.col("n_words"))
    measured = packed.mapInArrow(add, schema)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("longest_repeat") <= most_repeat))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that :func:`quality` rejects."""
    return quality(docs, text).where("kept").select("row.*")
