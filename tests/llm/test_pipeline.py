"""The pipeline against plain Python over the same documents."""

import random
import zlib
from collections import Counter

import corpus_pipeline
from meterloom.session import cut_lineage
from test_decontamination import brute as leak
from test_language import brute_bundle
from test_mixing import fill
from test_repetition import brute as repeated
from test_simhash import brute_components, brute_print


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def fixture():
    rng = random.Random(8)
    words = {"en": "the and with from that house river", "de": "und nicht schöne häuser auch straße", "fr": "où été les maisons rivière avec"}
    prose = lambda k, n: " ".join(rng.choice(words[k].split()) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(n))
    items = [(i, prose("en", 25)) for i in range(3)]
    docs = []
    for i in range(70):
        k = rng.choice(list(words))
        text = prose(k, rng.randrange(5, 90))
        if i % 9 == 0:
            text += " " + items[i % 3][1].upper()
        if i % 10 == 1:
            text = " ".join(["again and again we say"] * 9)
        if i % 10 == 2 and i > 10:
            text = docs[i - 10][1]
        if i % 12 == 3:
            text = "1 2 3 4 5 6 7 8 9 10 11"
        docs.append((i, text, k, rng.choice(["a", "b", "c", None]), len(text)))
    docs += [(None, docs[4][1], "en", "a", 1), (None, None, None, "b", None), (71, "", "fr", "a", 0), docs[5], docs[5]]
    return docs, items


def expected(docs, items):
    """(id, text) pairs that the first four stages keep."""
    good = [d for d in docs if (m := repeated(d[1]))[0] >= 10 and 100 * m[4] <= 20 * m[0] and m[5] <= 100]
    profiles = {}
    for i, text, lang, *_ in good:
        if lang and not (i is not None and zlib.crc32(str(i).encode()) % 3 == 1):
            profiles[lang] = profiles.get(lang, 0) + brute_bundle(text)
    told = [d for d in good if profiles and brute_bundle(d[1]).any()]
    roots = brute_components({brute_print(d[1]) for d in told})
    groups = {}
    for d in told:
        groups.setdefault(roots[brute_print(d[1])], []).append(d)
    first = [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]
    return [d for d in first if not any(leak(d[1], t) for _, t in items)]


def test_stages_equal_brute_force(spark, tmp_path):
    docs, items = fixture()
    write(spark, str(tmp_path), docs, items)
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = kept.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = cut_lineage(stage(spark, kept, str(tmp_path)))
        assert kept.columns == columns and 0 < kept.count() < before
    want = expected(docs, items)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(d[:2] for d in want)
    sizes = Counter()
    for d in want:
        sizes[d[3]] += len(d[1].split())
    target, largest = fill(sizes), max(len(d[1].split()) for d in want)
    taken, copies = Counter(), Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        taken[r.source] += len(r.text.split())
        copies[r.doc_id, r.text] += 1
    assert set(copies) <= {d[:2] for d in want} and max(copies.values()) <= 2
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in sizes)


def test_empty(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
