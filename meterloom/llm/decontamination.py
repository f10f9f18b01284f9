"""Benchmark decontamination with spaced seeds.

Texts become lower-case words of letters and digits (whatever isn't ASCII counts as a letter). A mask lies on a window of words and ignores some of its
positions, so a window still gives the same hash if the words there were substituted; several masks ignore
different positions. Windows of benchmark items and of documents that agree on a mask's hash are joined. Around
each hit the two texts are compared word by word on the hit's diagonal, and the best run of agreeing and
substituted words decides: a leak has at least ``least_words`` words (or all of a shorter item) of which at least
``similarity`` agree. A run begins and ends with words that agree; where none is long enough, the words that face a
whole item count as one, so an item's first and last word may be substituted too.

The masks lose nothing: whichever words are substituted, a run of 12 words or more that agrees in 80 % of them fits at
least one of the heavy masks somewhere, and so does a whole item of 4 to 12 words with the light ones (shorter items
must agree in all words). A whole item of 13 words has such a run, or 11 words that agree and fit a heavy mask; longer
ones always have a run. Light masks serve only items of up to ``LEAST_WORDS`` words. Other thresholds need other masks.

The benchmark is cut into blocks of a bounded number of windows. One block after the other is sent to all tasks
and joined with every document there, so no window of a document is ever shuffled, and a benchmark of any size is
handled. Within a block windows are a sorted array; a document's windows are looked up with NumPy. A window that stands in
many items is compared with all of them, some at a time: only hits whose texts agree in enough words are held.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import hashes, mixed, pieces, words

#: Window positions that count; each mask ignores others. The first four are light, the rest heavy: see above.
MASKS = ("1111", "11011", "11101", "10111", "11010111", "1110001011", "11111001", "100110111")
#: Positions that a mask needs to be used on items of more than :data:`LEAST_WORDS` words.
HEAVY = 6
LEAST_WORDS = 12
SIMILARITY = 0.8
#: Words of all benchmark items that are sent to the tasks at once (about 40 bytes each with three masks).
BLOCK_WORDS = 1 << 20
#: Hits, and words of their texts, that are compared at once.
HITS = 1 << 18

#: Bytes that separate words: ASCII other than letters and digits. Letters of other scripts are all words.
_BREAK = np.ones(256, bool)
_BREAK[128:] = False
for _low, _high in ((48, 58), (97, 123)):
    _BREAK[_low:_high] = False
_MULTIPLIER = np.uint64(0xC2B2AE3D27D4EB4F)


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the lower-case rows of a piece and the number of words per row."""
    starts, ends, counts = words(data, offsets, _BREAK)
    return hashes(data, starts, ends), counts


def windows(tokens: np.ndarray, mask: Sequence[int], seed: int) -> np.ndarray:
    """Hash of the window that starts at each word, over the positions of the mask."""
    n = len(tokens) - max(mask)
    out = np.full(max(n, 0), np.uint64(seed))
    for p in mask:
        out = (out + tokens[p : p + len(out)]) * _MULTIPLIER
    return mixed(out)


def _positions(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


class Block:
    """Some benchmark items, ready to be looked up. Items shorter than a mask are windows of their own length."""

    def __init__(self, items: Sequence, texts: Sequence[str], masks: Sequence[str] = MASKS):
        self.items, self.tokens = [], []
        for item, text in zip(items, texts, strict=True):
            piece = next(pieces(pc.utf8_lower(pa.array([text or ""], pa.large_string()))))
            tokens, _ = normal_words(piece.data, piece.offsets)
            if len(tokens):
                self.items.append(item)
                self.tokens.append(tokens)
        span = min(map(len, masks))
        shapes = [_positions(m) for m in masks]
        shapes += [list(range(n)) for n in sorted({len(t) for t in self.tokens if len(t) < span})]
        heavy = any(len(s) >= HEAVY for s in shapes[: len(masks)])
        self.shapes = []
        for seed, shape in enumerate(shapes):
            if seed >= len(masks):
                fits = lambda n, shape=shape: n == len(shape)
            elif len(shape) < HEAVY and heavy:
                fits = lambda n, shape=shape: max(shape) < n <= LEAST_WORDS
            else:
                fits = lambda n, shape=shape: n > max(shape)
            found = [(windows(t, shape, seed), i) for i, t in enumerate(self.tokens) if fits(len(t))]
            if not found:
                continue
            keys = np.concatenate([w for w, _ in found])
            owner = np.concatenate([np.full(len(w), i) for w, i in found])
            at = np.concatenate([np.arange(len(w)) for w, _ in found])
            order = np.argsort(keys, kind="stable")
            self.shapes.append((seed, shape, keys[order], owner[order], at[order]))
        self.flat = np.concatenate([np.zeros(0, np.uint64), *self.tokens])
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def hits(self, tokens: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
        """Blocks of (row, item, diagonal) with an equal window; the diagonal is the item's start in the row. Different
        blocks may repeat a hit."""
        row = np.repeat(np.arange(len(counts)), counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        for seed, shape, keys, owner, at in self.shapes:
            asked = windows(tokens, shape, seed)
            low = np.searchsorted(keys, asked, "left")
            some = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == asked)
            some = some[row[some] == row[some + max(shape)]]  # a window within one row
            low, n = low[some], np.searchsorted(keys, asked[some], "right") - low[some]
            reach = np.cumsum(n)
            for start in range(0, int(reach[-1]) if len(reach) else 0, HITS):
                number = np.arange(start, min(start + HITS, int(reach[-1])))
                who = np.searchsorted(reach, number, "right")
                entry = low[who] + number - (reach - n)[who]
                yield np.unique(np.column_stack([row[some[who]], owner[entry], some[who] - first[some[who]] - at[entry]]), axis=0)

    def likely(self, tokens: np.ndarray, counts: np.ndarray, least: int, similarity: float) -> np.ndarray:
        """Different hits whose texts agree in as many words as the shortest overlap needs."""
        starts = np.cumsum(counts) - counts
        ends = np.cumsum(self.lengths)
        found = [np.zeros((0, 3), np.int64)]
        for hits in self.hits(tokens, counts):
            row, item, diagonal = hits.T
            low = np.maximum(diagonal, 0)
            size = np.minimum(counts[row], diagonal + self.lengths[item]) - low
            mine, theirs = starts[row] + low, ends[item] - self.lengths[item] + low - diagonal
            needed = np.ceil(similarity * np.minimum(least, self.lengths[item]) - 1e-9)
            reach = np.cumsum(size)
            agree = np.zeros(len(hits), np.int64)
            for start in range(0, int(reach[-1]), HITS):
                number = np.arange(start, min(start + HITS, int(reach[-1])))
                who = np.searchsorted(reach, number, "right")
                within = number - (reach - size)[who]
                agree += np.bincount(who[tokens[mine[who] + within] == self.flat[theirs[who] + within]], minlength=len(hits))
            found.append(hits[agree >= needed])
        return np.unique(np.concatenate(found), axis=0)

    def overlaps(self, tokens: np.ndarray, counts: np.ndarray, least: int, similarity: float) -> Iterator[tuple[int, int, int, int, int]]:
        """Verified (row, item, start, words, agreeing words) of every hit."""
        starts = np.cumsum(counts) - counts
        for row, item, diagonal in self.likely(tokens, counts, least, similarity).tolist():
            mine = tokens[starts[row] : starts[row] + counts[row]]
            theirs = self.tokens[item]
            low, high = max(0, diagonal), min(len(mine), diagonal + len(theirs))
            equal = mine[low:high] == theirs[low - diagonal : high - diagonal]
            enough = min(least, len(theirs))
            run = best_run(equal, similarity)
            if run and run[1] - run[0] >= enough:
                yield row, item, low + run[0], run[1] - run[0], run[2]
            elif len(equal) == len(theirs) and equal.sum() >= similarity * len(theirs) - 1e-9:
                yield row, item, diagonal, len(theirs), int(equal.sum())


def best_run(equal: np.ndarray, similarity: float) -> tuple[int, int, int] | None:
    """The longest range that begins and ends with agreeing words and agrees in at least ``similarity`` of its
    words, as (start, end, agreeing words)."""
    if not equal.any():
        return None
    # Agreement above the wanted share, summed up: a range qualifies if its sum ends no lower than it begins.
    scaled = round(similarity * 1_000_000)
    height = np.r_[0, np.cumsum(np.where(equal, 1_000_000 - scaled, -scaled))]
    begins, ends = np.flatnonzero(equal), np.flatnonzero(equal) + 1
    # Candidates for a start are strict new minima from the left, so the first start that is low enough is longest.
    low = np.minimum.accumulate(height[begins])
    first = np.searchsorted(-low, -height[ends], "left")
    length = np.where(first < len(begins), ends - begins[np.minimum(first, len(begins) - 1)], 0)
    best = int(np.argmax(length))
    if length[best] <= 0:
        return None
    start, end = int(begins[first[best]]), int(ends[best])
    return start, end, int(equal[start:end].sum())


def _blocks(benchmark: DataFrame, most_words: int) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of at most ``most_words`` words or one item; the driver holds one block at a time."""
    items, texts, held = [], [], 0
    for r in benchmark.where("text IS NOT NULL").toLocalIterator():
        n = len(r.text) // 2 + 1
        if items and held + n > most_words:
            yield items, texts
            items, texts, held = [], [], 0
        items.append(r.item_id)
        texts.append(r.text)
        held += n
    if items:
        yield items, texts


def leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    masks: Sequence[str] = MASKS, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Rows of ``docs`` (as ``row``, all columns) with ``hits``, their verified overlaps with benchmark items.

    A hit has ``item_id`` (as text), ``start`` and ``words`` (in words of letters and digits) and ``matched``, the
    words that agree. Documents without a hit have an empty array; null, empty and wordless texts too. Items
    without words are ignored, equal items are all reported, a null item id stays null. No benchmark, no hits.
    The documents pass through the first block; each further one reads their texts only, keeps the texts it hits and
    is joined at the end, by two hashes of the text.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    hit = "array<struct<item_id: string, start: int, words: int, matched: int>>"
    out = docs.select(F.struct("*").alias("row"), F.expr(f"cast(array() as {hit})").alias("hits"))
    texts = docs.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b"), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("words", pa.int32()), ("matched", pa.int32())]))
    place, spark = docs.columns.index(text), docs.sparkSession

    def scan(sent, whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                hits = [[] for _ in range(batch.num_rows)]
                for piece in pieces(pc.utf8_lower(batch.column("row").field(place) if whole else batch.column("text"))):
                    tokens, counts = normal_words(piece.data, piece.offsets)
                    for row, item, start, n, equal in block.overlaps(tokens, counts, least_words, similarity):
                        hits[piece.start + row].append({"item_id": block.items[item], "start": start, "words": n, "matched": equal})
                if whole:
                    yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(hits, kind)], ["row", "hits"])
                else:
                    some = pa.array([i for i, h in enumerate(hits) if h], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("a").take(some), batch.column("b").take(some), pa.array(hits, kind).take(some)], ["a", "b", "more"])

        return run

    further = None
    for n, (ids, block_texts) in enumerate(_blocks(items, block_words)):
        sent = spark.sparkContext.broadcast(Block(ids, block_texts, masks))
        if not n:
            out = out.mapInArrow(scan(sent, True), out.schema)
            continue
        found = texts.mapInArrow(scan(sent, False), f"a long, b long, more {hit}")
        found = cut_lineage(found.dropDuplicates(["a", "b"]).withColumn("block", F.lit(n)))
        sent.unpersist()
        further = found if further is None else further.unionByName(found)
    if further is None:
        return out
    parts = F.array_sort(F.collect_list(F.struct("block", "more")))
    joined = further.groupBy("a", "b").agg(F.flatten(F.transform(parts, lambda p: p["more"])).alias("more"))
    keyed = out.withColumn("a", F.xxhash64(f"row.{_quoted(text)}")).withColumn("b", F.xxhash64(F.lit("text"), f"row.{_quoted(text)}"))
    return keyed.join(joined, ["a", "b"], "left").select(
        "row", F.when(F.col("more").isNull(), F.col("hits")).otherwise(F.concat("hits", "more")).alias("hits"))


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    return leaks(docs, benchmark, text).where(F.size("hits") == 0).select("row.*")
