import hashlib
import os
import re

import pytest
from meterloom.llm import licenses


def canonical(text):
    out = "".join(c.lower() if c.isascii() else c for c in text)
    states = rf"[^\w©]*(copyright([ \t]*:|[ \t:]*(\(c\)|©|[0-9<\[{{])|[ \t]+(?!({licenses.GOES_ON})\b)[^\W\d_])|©|\(c\)[ \t]*[0-9]|all rights reserved\.?[ \t\r]*$)"
    out = "\n".join("" if re.match(states, x) else x for x in out.split("\n"))
    out = re.sub(r"(?m)(^[^\w\n]*)([0-9]{1,2}|[a-z]|[ivx]{2,4})[.)]([ \t\r\n])|([.:;,]['\"”’)]*[ \t]+\(?)[0-9]{1,2}[.)]([ \t\r\n])",
                 lambda m: (m[1] or m[4] or "") + " " + (m[3] or m[5]), out)
    return [freed(" ".join(licenses.SPELLINGS.get(w, w) for w in re.findall(r"[^\W_]+", x))) for x in out.split("\n")]


def freed(text):
    return re.sub(licenses.NAME_SLOT, licenses.NAME_FREE, text)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


MIT, BSD = licenses.KNOWN["MIT"][0], licenses.KNOWN["BSD-3-Clause"][0]
COPYRIGHTS = [f"{line}\n\n{MIT}" for line in ("Copyright Jane Doe", "copyright jane doe and others", "COPYRIGHT: the authors", "# Copyright by Jane", "Copyright The Authors")]
LISTS = [BSD.replace("1. ", f"{a} ").replace("2. ", f"{b} ").replace("3. ", f"{c} ") for a, b, c in ("***", ("(1)", "(2)", "(3)"), ("a.", "b.", "c."), ("i)", "ii)", "iii)"), "•••")]
LISTS += [" ".join(BSD.split()), "\n".join(f" * {x}" for x in BSD.split("\n")), BSD.replace("copyright holder nor", "Example\nproject nor"), BSD.replace("HOLDER", "OWNER")]
TEXTS = [
    MIT, MIT.upper(), "MIT Licence\n\nCopyright (c) 2001 Somebody\nAll rights reserved.\n\n" + MIT.replace(",", " , ").replace(" ", "\n   "),
    "© 1999 X\n (c) 2003 Y\n# Copyright: 2010 Z, inc\n" + BSD.replace('"AS IS"', "``AS IS''"), MIT + " extra", MIT[:-20], "copyright holders\n" + MIT,
    "Some words\n * released UNDER the mit licence!\nmore", "Licensed under CC BY-NC 4.0.\nx\nLicensed under the Apache License, Version 2.0.\nLicensed under CC BY NC 4-0",
    "released under the MIT License really", None, "", " \n.", "licence licence licence", "é Released under the MIT License.", "word " * 50_000 + "\nSPDX-License-Identifier: ISC",
    *COPYRIGHTS, *LISTS, "Copyright holders agree.\ncopyright law, 2. next (a) b", "x. 12) y\n iv. z\n(c) 3\n1.\n#2. \n3.", ". 1. 2. 3) " * 20_000,
]


def test_scan_equals_brute_force(spark):
    rows = [(i if i != 3 else None, t, "x", 7) for i, t in enumerate([*TEXTS, TEXTS[0], TEXTS[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, lines int")
    got = licenses.scan(df, licenses.known_digests(spark)).collect()
    known = {digest(freed(" ".join(x for x in canonical(t) if x))): name for name, texts in licenses.KNOWN.items() for t in texts}
    want = []
    for i, text, *_ in rows:
        lines = canonical(text or "")
        whole = freed(" ".join(x for x in lines if x))
        want.append((i, digest(whole) if whole else None, known.get(digest(whole)) if whole else None, sorted({known[digest(x)] for x in lines if digest(x) in known})))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    found = {r.doc_id: r.license for r in got}
    assert {found[i] for i, t, *_ in rows if t in COPYRIGHTS} == {"MIT"} and {found[i] for i, t, *_ in rows if t in LISTS} == {"BSD-3-Clause"}
    assert [found[i] for i in (0, 1, 2)] == ["MIT"] * 3 and found[None] == "BSD-3-Clause" and found[4] is None and found[5] is None


def test_only_column_expressions(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licenses.scan(df, licenses.known_digests(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("PythonRDD", ""))


def test_empty(spark):
    known = licenses.known_digests(spark)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), known).collect() == []
    got = licenses.scan(spark.createDataFrame([(1, "MIT License")], "doc_id long, text string"), known.limit(0)).collect()
    assert [(r.license, r.line_licenses) for r in got] == [(None, [])]


def test_whole_texts_and_notices_of_more_licenses(spark):
    names = ["Unlicense", "Zlib", "BSL-1.0", "Apache-2.0", "GPL-3.0-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later"]
    rows = [(n, "Copyright 2020 Someone\n\n" + max(licenses.KNOWN[n], key=len).upper()) for n in names] + [("Own-1.0", "The text\nof an own licence.")]
    assert all(len(t) > 500 for _, t in rows[:-1])
    further = spark.createDataFrame([("Own-1.0", "the text of an own license"), (None, "x")], "license string, text string")
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df, licenses.known_digests(spark, further=further)).collect()}
    assert got == {n: n for n, _ in rows}


def test_long_texts_by_their_digests(spark):
    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
             "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0"}
    found = {f: open(f"{folder}/{f}").read() for f in files if os.path.exists(f"{folder}/{f}")}
    if not found:
        pytest.skip("no licence texts on this machine")
    rows = [(files[f], v) for f, t in found.items() for v in (t, "Copyright 2020 Someone\n" + t.upper().replace("\n", "\r\n"))]
    end = "END OF TERMS AND CONDITIONS"
    rows += [(files[f], t[: t.index(end) + len(end)]) for f, t in found.items() if end in t]
    rows += [(None, t + " more") for t in found.values()]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string"), licenses.known_digests(spark)).collect()
    assert len(got) == len(rows)
    assert not [(r.doc_id, r.license) for r in got if r.license != r.doc_id]
