import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from meterloom.llm import cotraining as ct


def corpus(n=900, seed=9):
    rng = random.Random(seed)
    good, bad = [f"word{i}" for i in range(60)], [f"junk{i}!!" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        quality = int(rng.random() < 0.7)
        words = [rng.choice((good if quality else bad) if rng.random() < 0.3 else ["of", "the", "and", "a"]) for _ in range(rng.randrange(5, 60))]
        source = rng.choice(["news", "books", None] if quality else ["spam", "ads"]) if rng.random() < 0.9 else "mixed"
        docs.append((i, " ".join(words), "en", source, "x", 5))
        if rng.random() < 0.4:
            labels.append((i, quality, 0))
    return docs, labels


def test_content_features_by_hand():
    texts = ["a a B", None, "", "é9 %% x"]
    bags, shapes = ct.content_features(pa.array(texts))
    assert [len(b) // 2 for b in bags] == [2, 0, 0, 3]
    assert bags[0] == ct.content_features(pa.array(["B a"]))[0][0]
    steps = lambda b: [int(v) - 16 * k for k, v in enumerate(np.frombuffer(b, "<u2"))]
    assert steps(shapes[0]) == [16 * 2 // 3, 16 // 3, 0, 0, 1, 2]
    assert steps(shapes[1]) == steps(shapes[2]) == [0] * 6
    assert steps(shapes[3])[2:4] == [16 // 6, 16 * 2 // 6]


def test_counts_equal_brute_force(spark):
    docs, labels = corpus(120)
    stored = ct.features(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, words string, fold int"),
                         spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "doc_id", "text", ("source", "lang"), "quality")
    rows = stored.collect()
    word, shape, meta = ct._counts(stored, None, 0.95)
    want = [Counter(), Counter(), Counter()]
    for r in rows:
        if r.label is not None and r.fold != 0:
            for counter, places in zip(want, (np.frombuffer(r.words, "<u2"), np.frombuffer(r.shapes, "<u2"), r.meta)):
                counter.update((int(p), r.label) for p in places)
    for got, counter in zip((word, shape, meta), want):
        assert {(int(i), int(c)): int(got[i, c]) for i, c in zip(*np.nonzero(got))} == counter
    # With a model, each view's sure documents count for the other one only.
    models = ct.train(stored, rounds=1)
    models.trust[:] = False
    assert all((a == b).all() for a, b in zip(ct._counts(stored, models, 0.8), (word, shape, meta)))
    models.trust[:] = True
    again = ct._counts(stored, models, 0.8)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in rows], schema=stored.limit(0).toArrow().schema)
    content, place = models.views(batch)
    for got, base, p, column in ((again[0], word, place, "words"), (again[2], meta, content, "meta")):
        extra = Counter()
        for r, x in zip(rows, p):
            if r.label is None and (x >= 0.8 or x <= 0.2):
                extra.update((int(v), int(x >= 0.8)) for v in (np.frombuffer(r[column], "<u2") if column == "words" else r[column]))
        more = got - base
        assert {(int(i), int(c)): int(more[i, c]) for i, c in zip(*np.nonzero(more))} == extra


def test_logistic_meets_its_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.5 + x @ [1.5, -1])))).astype(float)
    fit = ct.logistic(x, y, ridge=0.0)
    p = ct._apply(fit, x)
    assert abs(np.c_[np.ones(500), x].T @ (y - p)).max() < 1e-5
    assert (ct._rising(x, y)[1:] >= 0).all()


def test_trust_needs_precision_and_evidence():
    p = np.r_[np.full(20, 0.99), np.full(20, 0.01), np.full(50, 0.5)]
    y = np.r_[np.ones(19), 0, np.zeros(18), np.ones(2), np.ones(50)]
    assert ct.trusted(p, y, 0.95).tolist() == [False, True]
    assert ct.trusted(p, y, 0.9).tolist() == [True, True]
    assert ct.trusted(p, y, 0.95, evidence=21).tolist() == [False, False]
    assert ct.trusted(p[:0], y[:0], 0.95).tolist() == [False, False]


def test_further_rounds_do_no_harm(spark):
    docs, labels = corpus(700, 4)
    stored = ct.features(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, words string, fold int"),
                         spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "doc_id", "text", ("source", "lang"), "quality")
    held = stored.where("label IS NOT NULL AND fold = 0")

    def loss(rounds):
        rows = ct.score(held, ct.train(stored, rounds)).join(held.select("doc_id", "label"), "doc_id").where("pmod(xxhash64(11, doc_id), 2) = 1").collect()
        return -sum(np.log(r.score if r.label else 1 - r.score) for r in rows) / len(rows)

    assert loss(3) <= loss(1) + 1e-9


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    seen = {d for d, _, _ in labels}
    truth = {d[0]: int("word" in d[1]) if ("word" in d[1]) != ("junk" in d[1]) else None for d in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, words string, fold int")
    got = ct.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    unseen = [r for r in got if r.doc_id not in seen and truth[r.doc_id] is not None]
    assert sum(r.kept == truth[r.doc_id] for r in unseen) / len(unseen) >= 0.95
    by_meta = sum((r.meta_score >= 0.5) == truth[r.doc_id] for r in unseen) / len(unseen)
    assert 0.8 <= by_meta
    assert all(0 <= v <= 1 for r in got for v in (r.content_score, r.meta_score, r.score))


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, 0), (None, 0, 0), (99, 0, 1)]])
def test_odd_rows(spark, labels):
    docs = [(1, "a b", "en", None), (None, None, None, "s"), (2, "", "en", "s"), (2, "", "en", "s"), (3, "long " * 100_000, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert [(r.score, r.kept) for r in ct.classify(df, table).collect()] == [(0.5, True)] * 5
    assert ct.classify(df.limit(0), table).collect() == []


def test_real_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    stored = ct.features(docs, labels, "doc_id", "text", ("source", "lang"), "quality")
    scored = ct.score(stored, ct.train(stored)).join(stored.where("fold = 0 AND label IS NOT NULL").select("doc_id", "label"), "doc_id").collect()
    assert sum((r.score >= 0.5) == r.label for r in scored) / len(scored) >= 0.9
