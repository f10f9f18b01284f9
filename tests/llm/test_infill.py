import hashlib
import random

import pytest
import regex
from meterloom.llm import infill
from meterloom.llm.queries import QUERIES
from pyspark.sql import functions as F


def brute(doc_id, text):
    """The contract, one code point after the other."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def texts():
    rng = random.Random(4)
    odd = ["", " ", "\n", "a", "é\U0001f600\r\n \x00b", "holds <P> mark", "<S>", "x<M", "<<S", "<P", "P>", "<S><M>", "a<", "M>b<P", "🏳️‍🌈" * 40]
    return odd + ["".join(rng.choices("<>PSM ab\né🎉", k=rng.randrange(1, 40))) for _ in range(300)] + ["ab\n" * 50_000]


@pytest.mark.parametrize("window", [infill.WINDOW, 7])
def test_equals_brute_force(spark, window):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts()) if window > 7 or len(t) < 1000]
    rows += [(None, "no id", "clash", 1), (5, None, "clash", 1), (5, None, "clash", 1), (9, "twice", None, None), (9, "twice", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n int")
    found = infill.transform(df, window=window)
    got = found.select("row.doc_id", "row.text", "row.row", "n", "form", "prefix_chars", "middle_chars", "output",
                       infill.restore(F.col("output"), F.col("form")).alias("restored")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.restored == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_windows_find_the_units_of_one_match():
    unit = regex.compile(r"(\w+\W*|\W+)*")
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices("ab, .", k=rng.randrange(60)))
        places = [0, *unit.fullmatch(text).ends(1)]
        for first, second in ((3, 11), (rng.randrange(99), rng.randrange(99))):
            n = len(places) - 1
            a, b = sorted((first % (n + 1), second % (n + 1)))
            assert infill.cut(unit, text, first, second, window=rng.randrange(1, 30)) == (n, places[a], places[b])


def test_other_units(spark):
    df = spark.createDataFrame([(1, "one two  three"), (2, "...")], "doc_id long, text string")
    rows = infill.transform(df, unit=r"\w+\W*", plain_from=100).orderBy("row.doc_id").collect()
    assert rows[0].n == 3 and rows[0].form != "plain"
    assert rows[0].prefix_chars in (0, 4, 9, 14)
    assert (rows[1].n, rows[1].form, rows[1].output) == (0, "plain", "...")


def test_empty_table(spark):
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op12_repeated_capture_infill"](spark, folder).collect()}
    assert len(got) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for d in docs:
        n, form, prefix, middle, output = brute(d.doc_id, d.text)
        r = got[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert (r.output_sha256, r.restored_sha256) == (sha(output), sha(d.text or ""))
