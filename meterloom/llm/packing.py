"""Best-fit packing of tokenised documents by sums of squares.

Documents become ids of a given vocabulary and are cut into pieces no longer than a sequence. Pieces are dealt evenly
over parts, which takes no key and so knows no hot one; each part is sorted by falling length and placed one piece
after the other: of all open sequences with room, that one whose choice makes the sum over all gaps of
(number of open sequences with this gap) squared smallest. A new sequence is opened only where none has room. A part
streams through its task: its state is one count per gap and the open sequences.

Only lengths and checksums are shuffled. Ids travel along where they are asked for.

Ids are those of the tokenizer for the whole text. White space separates all its matches, and so does every change
between ASCII letters and other ASCII characters (but for ``'`` and ``|``, of which contractions and special tokens
are made). So each distinct chunk is encoded once and looked up after that; chunks of Latin letters go to the parts of
the tokenizer's model directly, since nothing splits them or changes more than their case.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..session import cut_lineage
from .text import Piece, pieces

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Pieces per part, and the number of parts beyond which they grow instead.
PART_PIECES = 16_384
MOST_PARTS = 20_000
#: Chunks whose ids a worker remembers; at more it starts anew.
KNOWN_CHUNKS = 1 << 19
#: Bytes of text looked up together.
PIECE_BYTES = 1 << 22

_KIND = np.full(256, 4, np.uint8)
_KIND[:128] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[ord("'")] = 3
_KIND[ord("|")] = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_WRITTEN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Encoder:
    """Ids of many texts at once, equal to the tokenizer's own for each text."""

    def __init__(self, vocabulary: str):
        if os.sep not in vocabulary:
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        if len(self.known) + len(chunks) > KNOWN_CHUNKS:
            self.known.clear()
        known, tokenize, rest = self.known, self.tokenizer.model.tokenize, []
        for chunk in chunks:
            lowered = chunk.lower()
            # Letters up to here are letters to all libraries, in composed form, and lower case is one letter each.
            if lowered.isalpha() and chunk.isalpha() and max(lowered) < "ɐ":
                if not lowered.isascii():
                    lowered = lowered.encode().decode("latin-1").translate(_WRITTEN)
                known[chunk] = array("I", [t.id for t in tokenize(lowered)]).tobytes()
            else:
                rest.append(chunk)
        for chunk, found in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            known[chunk] = array("I", found.ids).tobytes()

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a piece, one after the other, and how many each has."""
        data, offsets = piece.data, piece.offsets
        if b"<|" not in data.tobytes():  # the marks of special tokens, which are no others in upper case
            data = _LOWER[data]
        rows = len(offsets) - 1
        kind = _KIND[data]
        black = kind != 0
        first = np.zeros(len(data), bool)
        if len(data):
            before, after = kind[:-1], kind[1:]
            first[1:] = (before == 0) | (before == 1) & ((after == 2) | (after == 3)) | (before == 2) & (after == 1)
            starts_of_rows = offsets[:-1]
            first[starts_of_rows[starts_of_rows < len(data)]] = True
        starts = np.flatnonzero(first & black)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        place = np.cumsum(black)
        bounds = np.r_[place[starts] - 1, place[-1]].astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[black].tobytes()))
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [c for c in distinct if c not in self.known]
        if len(self.known) + len(new) > KNOWN_CHUNKS:
            new = distinct
        self._learn(new)
        ids = [self.known[c] for c in distinct]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), "<u4")
        which = coded.indices.to_numpy()
        length = sizes[which]
        total = int(length.sum())
        # Position in the pool: 1 more than the one before, but for a jump where a chunk begins.
        step = np.ones(total, np.int32)
        filled = np.flatnonzero(length)
        if total:
            at = (np.cumsum(sizes) - sizes)[which[filled]].astype(np.int32)
            where = (np.cumsum(length) - length)[filled]
            step[where[0]] = at[0]
            step[where[1:]] = at[1:] - (at[:-1] + length[filled[:-1]] - 1)
        flat = pool[np.cumsum(step, dtype=np.int32)]
        summed = np.r_[0, np.cumsum(length, dtype=np.int64)]
        return flat, np.diff(summed[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """The encoder of a worker process; it outlives the tasks of a job."""
    return Encoder(vocabulary)


_PIECE = [
    T.StructField("piece", T.IntegerType(), False), T.StructField("start", T.LongType(), False),
    T.StructField("length", T.LongType(), False), T.StructField("ids_crc32", T.LongType(), False),
]


def tokenised(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY,
    end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Pieces of the documents: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``.

    A document is the ids of its whole text and then ``end_id``. Longer ones than ``capacity`` are cut into pieces of
    that length, the last may be shorter; ``start`` counts the document's ids before a piece. ``vocabulary`` is a path
    all executors have, or a file name of the installed public vocabularies. Null and empty texts are one ``end_id``.
    Null and repeated ids are kept, each row by itself; other columns are not read; empty tables give no rows.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ids = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] if with_ids else []
    schema = T.StructType([source.schema["doc_id"], *_PIECE, *ids])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in pieces(batch.column("text"), PIECE_BYTES):
                flat, counts = encode(part)
                ends = np.cumsum(counts + 1)
                whole = np.full(int(ends[-1]), end_id, "<u4")
                inside = np.ones(len(whole), bool)
                inside[ends - 1] = False
                whole[inside] = flat
                many = (counts + capacity) // capacity  # pieces of counts + 1 ids
                row = np.repeat(np.arange(len(counts)), many)
                number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                begin = number * capacity
                length = np.minimum(capacity, counts[row] + 1 - begin)
                at = (ends - counts - 1)[row] + begin
                marks = [zlib.crc32(whole[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [
                    batch.column("doc_id").take(pa.array(part.start + row)), pa.array(number.astype(np.int32)), pa.array(begin),
                    pa.array(length), pa.array(marks, pa.int64())]
                if with_ids:
                    bounds = np.r_[at, at[-1] + length[-1]].astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(whole.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(cut, schema)


class Bins:
    """Open sequences of one part, by gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        #: Open sequences per gap. A full one is not open; -0.5 makes its change of the sum come out right.
        self.open = np.zeros(capacity + 1)
        self.open[0] = -0.5
        self.names: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """Sequence number and offset of a piece."""
        room = self.open[length:]
        # Half the change of the sum of squares, less a constant: a gap loses one sequence, a smaller one gains it.
        change = np.where(room > 0, self.open[: len(room)] - room, np.inf)
        best = int(change.argmin())
        if change[best] == np.inf:
            gap, name = self.capacity, self.made
            self.made += 1
        else:
            gap = length + best
            self.open[gap] -= 1
            name = self.names[gap].pop()
        if gap > length:
            self.open[gap - length] += 1
            self.names[gap - length].append(name)
        return name, self.capacity - gap


def pack(
    items: DataFrame, length: str = "length", capacity: int = CAPACITY, part_items: int = PART_PIECES, most_parts: int = MOST_PARTS,
) -> DataFrame:
    """Rows of ``row`` (all columns of ``items``), ``sequence_id`` and ``offset``: its place in its sequence.

    Every sequence is filled from offset 0 without gaps up to at most ``capacity``. A null length, one below 1 or
    above ``capacity`` gets no sequence (nulls). Equal rows are interchangeable. Numbers of sequences are unique
    but not dense; empty tables give no rows.
    """
    packed = items.select(F.struct("*").alias("row"), F.col(length).cast("long").alias("length"))
    stored = cut_lineage(packed)
    parts = min(most_parts, max(1, math.ceil(stored.count() / part_items)))
    dealt = stored.repartition(parts).sortWithinPartitions(F.col("length").desc(), F.xxhash64(F.to_json("row")))
    schema = T.StructType([packed.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, part = Bins(capacity), TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [bins.place(n) if n is not None and 1 <= n <= capacity else None for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array([f and part + f[0] for f in found], pa.int64()),
                pa.array([f and f[1] for f in found], pa.int64())], schema.names)

    return dealt.mapInArrow(place, schema)


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves, ``sequence_id`` and ``ids``, from packed pieces that carry their ids."""
    entry = F.struct("offset", F.col("row.ids").alias("ids"))
    grouped = packed.where("sequence_id IS NOT NULL").groupBy("sequence_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return grouped.select("sequence_id", F.flatten(F.col("entries.ids")).alias("ids"))
