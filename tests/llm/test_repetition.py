import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from meterloom.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    n = len(w)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    best, inside = [0] * n, set()
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and w[i + k] == w[j + k]:
                    k += 1
                best[i] = max(best[i], k)
        if best[i] >= 5:
            inside |= set(range(i, i + best[i]))
    windows = [tuple(w[i : i + 5]) for i in range(n - 4)]
    assert inside == {i + d for i, x in enumerate(windows) if windows.count(x) > 1 for d in range(5)}
    maximal = sum(b >= 5 and not (i and best[i - 1] > b) for i, b in enumerate(best))
    longest = max([0, *(b for b in best if b >= 5)])
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), longest, maximal)


def measured(texts):
    found = repetition.measure(pa.array(texts, pa.string()))
    return [tuple(int(v[i]) for v in found.values()) for i in range(len(texts))]


def texts():
    rng = random.Random(3)
    prose = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    a = prose(30, 1000)
    return [
        None, "", " \n\t", "one", "x " * 80, "é ñ #*$ <a>|%&\n\né ñ #*$ <a>|%&\né ñ x y", prose(200, 3), prose(200, 2), prose(300, 8),
        f"{a} {prose(50, 1000)} {a} {a}", "\n".join([prose(8, 50)] * 9), "a b c d e a b c d e", "a b c d e f a b c d e", "\x1c \x0b\x0c \r\n b",
        "a\nb\na\n \n \na ", prose(400, 4) + " " + prose(400, 4),
    ]


def test_measures_equal_brute_force():
    given_texts = texts()
    assert measured(given_texts) == [brute(t) for t in given_texts]
    assert measured(given_texts[::-1]) == [brute(t) for t in given_texts[::-1]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n#é", max_size=60), max_size=6))
def test_any_text(values):
    assert measured(values) == [brute(t) for t in values]


def test_spans():
    a = "the cat sat on the mat"
    assert repetition.spans(f"{a} x {a} y") == [(0, 6), (7, 13)]


def test_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(1000))
    once = " ".join(f"p{i}" for i in range(101))
    rows = [(1, good), (2, f"{good} {once} x {once}"), (3, "few words"), (4, "x " * 50), (5, None), (None, good), (1, good),
            (6, f"{good} {once[:-5]} x {once[:-5]}"), (7, "many " + "y" * 300_000 + " " + good)]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], "doc_id long, text string, n_words int, row string")
    kept = repetition.keep_good(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.n_words) for r in kept.collect()) == [("1", 9), ("1", 9), ("6", 9), ("7", 9), ("None", 9)]
    assert repetition.quality(df.limit(0)).collect() == []
    failed = {r.row.doc_id: (r.base_failed, r.kept) for r in repetition.quality(df).collect()}
    assert failed[2] == (False, False) and failed[3] == (True, False)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 17, 33])
def test_run_of_one_word(n):
    assert measured(["w " * n]) == [brute("w " * n)]
