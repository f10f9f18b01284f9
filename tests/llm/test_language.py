import random
import zlib
from collections import Counter

import numpy as np
import pytest
from meterloom.llm import language
from meterloom.llm.queries import QUERIES


def brute_grams(text):
    out, blank = [], True
    for c in f" {text} ".lower():
        if c.isalpha():
            out.append(c)
            blank = False
        elif not blank or not out:
            out.append(" ")
            blank = True
    return Counter(zip(out, out[1:], out[2:])) if any(c != " " for c in out) else Counter()


def brute_bundle(text):
    total = np.zeros(language.DIMENSIONS)
    for letters, n in brute_grams(text).items():
        vector = np.ones(language.DIMENSIONS)
        for place, c in enumerate(letters):
            vector = vector * np.roll(language.letter_vectors(np.array([ord(c)]))[0], place)
        total += n * vector
    return total


TEXTS = ["", " ", "a", "A b", "1 2 !", "the cat, the CAT; ñandú -- été", "ab" * 700, "日本語 テキスト", "x\n\ny\tz" * 9, "\U0001f600 \U00020000", "İstanbul ß"]


def test_grams_and_bundles_equal_brute_force():
    row, gram, count = language.grams(TEXTS)
    got = [{} for _ in TEXTS]
    for r, g, n in zip(row.tolist(), gram.tolist(), count.tolist()):
        got[r][tuple(chr(g >> 21 * p & (1 << 21) - 1) for p in range(3))] = n
    assert got == [dict(brute_grams(t)) for t in TEXTS]
    assert np.array_equal(language.bundles(TEXTS, block=3), np.array([brute_bundle(t) for t in TEXTS], np.float32))


def test_letters_are_nearly_orthogonal():
    vectors = language.letter_vectors(np.arange(97, 123)).astype(int)
    cosine = vectors @ vectors.T / language.DIMENSIONS
    assert abs(cosine - np.eye(26)).max() < 0.2


def test_equals_brute_force(spark):
    rng = random.Random(5)
    words = {"aa": "the and of with", "bb": "und der die nicht", "cc": "que los del una"}
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(rng.randrange(1, 30))), k) for i in range(60) for k in [rng.choice("abc") * 2]]
    rows += [(100, None, "aa"), (101, "12 !", "bb"), (102, "the of", None), (None, "und die", "bb"), (None, "", None), (3, "x " * 2000, "aa"), (3, "x " * 2000, "aa")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, row string, score int")
    got = language.identify(df).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    profiles = {k: sum((brute_bundle(t) for i, t, x in rows if x == k and t and not out(i)), np.zeros(language.DIMENSIONS)) for k in ("aa", "bb", "cc")}

    def expect(text):
        b = brute_bundle(text or "")
        if not b.any():
            return "und", 0.0
        cosine = {k: b @ v / np.linalg.norm(b) / np.linalg.norm(v) for k, v in profiles.items()}
        best = max(sorted(cosine), key=cosine.get)
        return best, max(0.0, cosine[best])

    assert len(got) == len(rows)
    for r in got:
        lang, score = expect(r.row.text)
        assert (r.lang_pred, r.held_out) == (lang, out(r.row.doc_id))
        assert r.score == pytest.approx(score, abs=1e-5) and 0 <= r.score <= 1
    kept = language.keep_identified(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(expect(t)[0] != "und" for _, t, _ in rows)


def test_nothing_learned_and_empty(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(df).collect()] == [("und", 0.0)]
    assert language.identify(df.limit(0)).collect() == []


def test_held_out_accuracy(spark, folder):
    got = QUERIES["op7_hyperdimensional_language"](spark, folder).where("held_out")
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("lang is not null").collect()
    assert len(rows) > 40
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95


def test_keep_identified_drops_what_no_profile_is_near(spark, folder):
    clean = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    clean = clean.where("size(split(text, ' ')) >= 30 and lang is not null")
    rng = random.Random(9)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in (12, 60, 400)]
    junk += ["Η γλώσσα είναι ένα σύστημα που χρησιμοποιούν οι άνθρωποι για να μιλούν μεταξύ τους",
             "minä olen suomalainen ja puhun suomea koska asun helsingissä talossa järven rannalla"]
    strange = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(junk)], clean.schema)
    kept = [r.doc_id for r in language.keep_identified(clean.unionByName(strange), quantile=language.LEAST_QUANTILE).collect()]
    assert [i for i in kept if i < 0] == []
    assert len(kept) >= 0.99 * clean.count()
