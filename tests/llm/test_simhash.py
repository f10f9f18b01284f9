import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from meterloom.llm import simhash
from meterloom.llm.components import components
from pyspark.sql import functions as F


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=3):
    label = {p: p for p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= radius:
                label[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in prints}


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(set(prints))
    first = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            first[roots[p]] = min(first.get(roots[p], i), i)
    return sorted(((i, p, first.get(roots[p])) for (i, _), p in zip(rows, prints)), key=str)


def got(df):
    return sorted(((r.doc_id, r.simhash % 2**64, r.component_id) for r in df.collect()), key=str)


def documents():
    rng = random.Random(1)
    base = [" ".join(rng.choice(["ab", "Cd", "éf", "GH", "x"]) + str(rng.randrange(30)) for _ in range(n)) for n in (1, 2, 3, 40, 300, 2000)]
    rows = [(i, t) for i, t in enumerate(base * 2)]
    for k in range(30):
        w = base[5].split()
        for _ in range(k // 3):
            w[rng.randrange(len(w))] = "new"
        rows.append((100 + k, "\n\t ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "\x0b\x1c word"), (None, base[3]), (None, "only here " * 3), (0, base[0]), (0, base[0])]
    return rows


def test_equals_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(simhash.near_duplicates(df)) == brute(rows)


def test_small_shards_lose_no_link(spark):
    rng = random.Random(2)
    center = rng.getrandbits(64)
    prints = {center}
    while len(prints) < 300:
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "simhash long")
    found = simhash.links(df, 3, shard_rows=16)
    roots = {r.node % 2**64: r.root % 2**64 for r in components(found).collect()}
    want = brute_components(prints)
    groups = lambda f: {frozenset(p for p in prints if f(p) == f(q)) for q in prints}
    assert groups(lambda p: roots.get(p, p)) == groups(want.get)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 4), st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 9))
def test_forest_finds_every_pair(radius, values, flips):
    near = {v ^ (1 << (flips * k % 64)) for k, v in enumerate(values)} | set(values)
    prints = np.array(sorted(near), np.uint64)
    group = np.sort(np.arange(len(prints)) % 3)
    forest = simhash.Forest(prints, group, np.ones(len(prints), bool))
    pairs = {(int(a), int(b)) for x, y in forest.near(np.arange(len(prints)), group, radius, frontier=7) for a, b in zip(x, y)}
    want = {(a, b) for a in range(len(prints)) for b in range(len(prints))
            if group[a] == group[b] and int(prints[a] ^ prints[b]).bit_count() <= radius}
    assert pairs == want


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (9, 8)], [(i, i + 1) for i in range(40)] + [(100, i) for i in range(60, 90)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.root for r in components(df).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {k: v for k, v in label.items() if k != v}


def test_keep_first(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (None, "A B C D E"), (7, "other words stand here"), (None, "alone"), (8, None), (9, "")]
    df = spark.createDataFrame([(*r, "x", 5, 6) for r in rows], "doc_id long, text string, mark string, id long, simhash long")
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, "a b c d e"), (7, "other words stand here"), (None, "alone"), (8, None)], key=str)


def test_keep_first_equals_brute_force(spark):
    rows = documents()
    prints = {t: brute_print(t) for _, t in rows}
    roots = brute_components(set(prints.values()))
    groups = {}
    for i, t in rows:
        groups.setdefault(roots[prints[t]], []).append((i is None, i or 0, i, t))
    want = [min(g, key=lambda r: r[:2]) for g in groups.values()]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r[2]) for r in want)
    assert len({r.text for r in kept}) == len(kept) < len(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, simhash string, a long")
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep_first(df).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7])
def test_near_fingerprints_share_a_shard(spark, radius):
    rng = random.Random(radius)
    pairs = []
    for _ in range(300):
        a, b = rng.getrandbits(64), 0
        for bit in rng.sample(range(64), radius):
            b |= 1 << bit
        pairs.append(tuple(v - (1 << 64) if v >> 63 else v for v in (a, a ^ b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    keys = lambda c: F.array(*simhash.shard_keys(F.col(c), radius))
    assert df.where(~F.arrays_overlap(keys("a"), keys("b"))).count() == 0
    far = df.select(keys("a").alias("k")).select(F.explode("k").alias("k"))
    if radius <= 3:
        assert far.distinct().count() > 0.9 * far.count()
