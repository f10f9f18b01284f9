import random

import pytest
from meterloom.llm import mixing


def fill(sizes, weights=(5, 2, 1)):
    """Hand out 150% by weight; what a full source can't take goes to the others, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, closed, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        unit = left / max(1, sum(weight[s] for s in order if s not in closed))
        over = [s for s in order if s not in closed and unit * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: unit * weight[s] for s in order if s not in closed}
        for s in over:
            target[s] = 2.0 * sizes[s]
            closed.add(s)
            left -= target[s]


def documents(seed):
    rng = random.Random(seed)
    rows = []
    for s, n in (("a", 3), ("b", 400), ("Z", 60), ("é", 50), ("a2", 900), (None, 40), ("blank", 5)):
        for _ in range(n):
            k = 0 if s == "blank" else min(5000, int(rng.paretovariate(1.1) * 5))
            rows.append((len(rows), "w " * k, s))
    rows += [(None, "x y z", "b"), (7, None, "b"), (7, None, "b"), (9, "q " * 30_000, "b"), (9, "r " * 7, "a2"), (9, "r " * 7, "a2")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_copies(spark, seed):
    rows = documents(seed)
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, source string, row string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = fill(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        largest = max(len((t or "").split()) for _, t, x in rows if x == s)
        assert abs(taken[s] - want[s]) <= 2 * largest
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: str((r.doc_id, r.source, r.size, r.copies))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_positions_follow_sorted_order(spark):
    rows = documents(3)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, seed=5).collect()
    for source in {r[2] for r in rows}:
        one = [r for r in got if r.source == source and r.size]
        rate = one[0].target / one[0].source_size if one else 0
        one.sort(key=lambda r: r.size)
        # Crossings of a running sum: any leading run of documents has the expected number of copies, to one.
        total = 0
        for i, r in enumerate(one, 1):
            total += r.copies
            if i == len(one) or one[i].size != r.size:
                assert abs(total - i * rate) <= 1.001


def test_repeat_carries_rows(spark):
    df = spark.createDataFrame([(i, "w " * (i % 9), "ab"[i % 2], "k") for i in range(200)], "doc_id long, text string, source string, place string")
    out = mixing.repeat(df)
    assert out.columns == df.columns
    counts = {}
    for r in out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {r.doc_id: r.copies for r in mixing.mix(df).collect() if r.copies}


def test_empty_and_all_blank(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).collect() == [] and mixing.repeat(df).collect() == []
    df = spark.createDataFrame([(1, "", None), (None, None, None)], df.schema)
    assert [(r.target, r.taken) for r in mixing.mix(df).collect()] == [(0.0, 0)] * 2
