"""Near-duplicates by SimHash fingerprints, searched with BK-trees.

A fingerprint has a bit set if more than half of the hashes of a text's word shingles have it set. Two documents
are linked if their fingerprints differ in at most ``radius`` bits; linked documents form a component.

Search: equal fingerprints are one node, so copies cost nothing. Two fingerprints within the radius of three agree on at
least three of six slices of their bits, so each fingerprint goes to one shard per choice of three slices, named by
their 32 bits; with a billion fingerprints a shard still holds one by chance. A shard is indexed by a BK-tree (children keyed by their Hamming distance to the parent) and its
members follow only edges whose key is within the radius of their own distance. A shard larger than
``shard_rows`` is cut into several trees; each tree is sent, by the shuffle and not through the driver, to the
tasks that hold the other parts' members, so a task holds two parts at most and no link is lost. All trees of a
task are built and walked together, level by level, with NumPy.

A task reports its links as stars (each fingerprint with one member of its local component), so n members give
fewer than n rows even where all of them are near each other.

:func:`keep_first` keeps one document of each component, with the same shingles and radius.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .components import components
from .text import pieces, words

SEED = 42
WIDTH = 3
RADIUS = 3
SHARD_ROWS = 2048
#: Pairs of a member and a tree node that are held at once.
FRONTIER = 1 << 20


def _votes(digests: np.ndarray, counts: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """Fingerprint of each run of digests: the bits set in more than half of them."""
    set_bits = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(digests), chunk):
        part, who = digests[at : at + chunk], owner[at : at + chunk]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        set_bits[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _shingles(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingle hashes of some rows after the other, and their number per row."""
    digest = xxhash.xxh64_intdigest
    for piece in pieces(texts):
        raw = piece.data
        lower = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
        starts, ends, counts = words(lower, piece.offsets)
        # Words joined by one blank: a shingle is then one slice of bytes.
        lengths = ends - starts
        to = np.cumsum(lengths + 1) - 1
        joined = np.full(int(to[-1]) + 1 if len(to) else 0, 32, np.uint8)
        shift = np.repeat(to - lengths, lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        joined[shift] = lower[np.repeat(starts, lengths) + np.arange(len(shift)) - np.repeat(np.cumsum(lengths) - lengths, lengths)]
        per_row = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
        first_word = np.cumsum(counts) - counts
        index = np.repeat(first_word, per_row) + np.arange(int(per_row.sum())) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        last = np.minimum(index + width - 1, np.repeat(first_word + counts - 1, per_row))
        buffer = joined.tobytes()
        begin, end = (to - lengths)[index].tolist(), to[last].tolist()
        digests = np.fromiter((digest(buffer[s:e], SEED) for s, e in zip(begin, end, strict=True)), np.uint64, len(begin))
        yield digests, per_row


def fingerprint_array(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text of an Arrow array; null and wordless texts give zero."""
    return np.concatenate([np.zeros(0, np.uint64), *(_votes(digests, counts) for digests, counts in _shingles(texts, width))])


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH, name: str = "simhash") -> DataFrame:
    """``docs`` with a signed 64-bit fingerprint of the whole text in column ``name`` (which replaces one of that
    name). A text of fewer than ``width`` words is one shingle; null, empty and blank texts have fingerprint zero."""
    kept = [c for c in docs.columns if c != name]
    extra = [] if text in kept else [text]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array(fingerprint_array(batch.column(text), width).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), marks], [*kept, name])

    return docs.select(*kept, *extra).mapInArrow(add, schema)


class Forest:
    """BK-trees over several groups of different fingerprints, as arrays; ``group`` must be sorted."""

    def __init__(self, prints: np.ndarray, group: np.ndarray, member: np.ndarray):
        """``member`` tells which fingerprints the trees hold; the others are only looked up."""
        self.prints = prints
        rows = np.flatnonzero(member)
        firsts = np.flatnonzero(np.r_[True, group[rows][1:] != group[rows][:-1]]) if len(rows) else rows
        self.root = np.full(int(group.max()) + 1 if len(group) else 0, -1, np.int64)
        self.root[group[rows[firsts]]] = rows[firsts]
        parents, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left = np.delete(rows, firsts)
        at = self.root[group[left]]
        while len(left):
            step = at * 65 + np.bitwise_count(prints[left] ^ prints[at])
            order = np.argsort(step, kind="stable")
            ordered = step[order]
            head = np.r_[True, ordered[1:] != ordered[:-1]]
            child = left[order[head]]  # the first that takes an edge becomes its node
            parents.append(child)
            keys.append(ordered[head])
            down = child[np.cumsum(head) - 1]
            stays = ~head
            left, at = left[order[stays]], down[stays]
        edges = np.concatenate(keys)
        order = np.argsort(edges, kind="stable")
        self.keys, self.child = edges[order], np.concatenate(parents)[order]

    def near(self, rows: np.ndarray, group: np.ndarray, radius: int, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, tree member) within the radius, for the given rows, in blocks."""
        todo = [(rows[self.root[group[rows]] >= 0], None)]
        while todo:
            who, node = todo.pop()
            if node is None:
                node = self.root[group[who]]
            if len(who) > frontier:
                half = len(who) // 2
                todo += [(who[half:], node[half:]), (who[:half], node[:half])]
                continue
            if not len(who):
                continue
            distance = np.bitwise_count(self.prints[who] ^ self.prints[node]).astype(np.int64)
            hit = distance <= radius
            if hit.any():
                yield who[hit], node[hit]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), "right")
            n = high - low
            reach = np.cumsum(n)
            for s, e in _blocks(reach, frontier):
                part = n[s:e]
                child = np.repeat(low[s:e], part) + np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part)
                if len(child):
                    todo.append((np.repeat(who[s:e], part), self.child[child]))


def _blocks(reach: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs whose sizes add up to ``most`` or are single."""
    at = 0
    while at < len(reach):
        before = reach[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(reach, before + most, "right")))
        yield at, to
        at = to


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the labels of linked rows in place; a label is the smallest row that is known to be linked."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def stars(prints: np.ndarray, group: np.ndarray, member: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the groups as stars: pairs of fingerprints, fewer than there are fingerprints."""
    forest = Forest(prints, group, member)
    label = np.arange(len(prints))
    for a, b in forest.near(np.flatnonzero(asks), group, radius):
        _merge(label, a, b)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return prints[linked], prints[label[linked]]


def _search(radius: int, most: int = 1 << 15):
    """Function for mapInPandas over rows sorted by unit: whole units are searched together, some thousand rows at once."""

    def flush(rows: pd.DataFrame) -> pd.DataFrame:
        unit = rows[["key", "low", "high"]].to_numpy()
        group = np.cumsum(np.r_[False, (unit[1:] != unit[:-1]).any(axis=1)])
        part = rows["part"].to_numpy()
        member, asks = part == unit[:, 1], part == unit[:, 2]
        a, b = stars(rows["simhash"].to_numpy().view(np.uint64), group, member, asks, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            while len(rest):
                unit = rest[["key", "low", "high"]].to_numpy()
                new = np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1
                whole = new[new <= most]
                cut = int(whole[-1]) if len(whole) else int(new[0]) if len(new) else 0
                if not cut or (cut < most // 2 and len(rest) < most):
                    break
                yield flush(rest.iloc[:cut])
                rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield flush(rest)

    return run


def shard_keys(simhash: Column, radius: int = RADIUS) -> list[Column]:
    """Names of the shards of a fingerprint: two within the radius share at least one.

    Of ``2 * radius`` slices such fingerprints agree on ``radius`` at least, so there is a shard for each choice of so
    many slices, named by about half of all bits: 20 shards of 32 bits at a radius of three. Beyond a radius of three the
    choices are too many; one of ``radius + 1`` slices names a shard there.
    """
    if radius == 0:
        return [simhash]
    slices, chosen = (2 * radius, radius) if radius <= 3 else (radius + 1, 1)
    bits = [64 // slices + (i < 64 % slices) for i in range(slices)]
    low = [sum(bits[:i]) for i in range(slices)]
    value = [F.shiftrightunsigned(simhash, low[i]).bitwiseAND(F.lit((1 << bits[i]) - 1)) for i in range(slices)]
    keys = []
    for number, places in enumerate(itertools.combinations(range(slices), chosen)):
        key = F.lit(number).cast("long")
        for i in places:  # 32 to 40 bits of slices below the number of the choice
            key = F.shiftleft(key, bits[i]).bitwiseOR(value[i])
        keys.append(key)
    return keys


def links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``(a, b)`` that join all of the different fingerprints ``simhash`` within the radius into components.

    ``prints`` holds each fingerprint once, without nulls, as a stored table.
    """
    keyed = prints.select(F.explode(F.array(*shard_keys(F.col("simhash"), radius))).alias("key"), "simhash")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / shard_rows).alias("parts"))
    part = F.pmod(F.xxhash64("simhash"), F.col("parts"))
    dealt = keyed.join(sizes, "key").withColumn("part", part)
    # Part p meets every part: in one task with itself, and once with each other.
    other = dealt.select("key", "simhash", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    units = other.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "simhash")
    return (
        units.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        .mapInPandas(_search(radius), "a long, b long").distinct()
    )


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """``prints``, a stored table with each fingerprint once, with ``root``, one fingerprint of its component."""
    roots = components(links(prints.select("simhash"), radius))
    return prints.join(roots, prints["simhash"] == roots["node"], "left").select(
        *(prints[c] for c in prints.columns), F.coalesce("root", "simhash").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row per document: id, ``simhash`` (signed) and ``component_id``, the smallest id reachable over links.

    Rows may repeat, ids too: equal texts share a fingerprint, and so a component. A null id is never a
    ``component_id`` unless the whole component has no other. Null, empty and blank texts have fingerprint zero
    and are linked like any other. Empty tables give no rows; other columns of ``docs`` are not read.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = cut_lineage(fingerprints(source, "text", width).select("doc_id", "simhash"))
    rooted = _rooted(cut_lineage(marked.groupBy("simhash").agg(F.min("doc_id").alias("first"))), radius)
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = cut_lineage(rooted.select("simhash", "root").join(heads, "root").select("simhash", "component_id"))
    return marked.join(known, "simhash").select(F.col("doc_id").alias(doc_id), "simhash", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component of :func:`near_duplicates`, that of the smallest id (a null id
    counts as largest).

    Null and wordless texts have fingerprint zero and are linked like any other. Of several rows with the smallest id
    the one with the smallest hash of all its columns stays, once. An empty table stays empty.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    packed = packed.withColumn("mark", F.xxhash64("row"))
    order = F.struct(F.col("id").isNull().alias("absent"), "id", "mark")
    marked = fingerprints(packed.select("id", "mark", "text"), "text", width)
    # Copies are reduced to one row before the shuffle; only the winners' ids meet the texts again.
    rooted = _rooted(cut_lineage(marked.groupBy("simhash").agg(F.min(order).alias("best"))), radius)
    best = cut_lineage(rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.id", "best.mark"))
    chosen = packed.drop("text").join(best, packed["id"].eqNullSafe(best["id"]) & (packed["mark"] == best["mark"]), "left_semi")
    return chosen.dropDuplicates(["id", "mark"]).select("row.*")
