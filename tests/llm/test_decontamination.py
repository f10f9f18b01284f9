import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from meterloom.llm import decontamination as dc
from meterloom.llm.text import pieces


def tokens(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def brute_run(equal, similarity):
    best = 0
    for i in range(len(equal)):
        for j in range(i + 1, len(equal) + 1):
            if equal[i] and equal[j - 1] and sum(equal[i:j]) >= similarity * (j - i) - 1e-9:
                best = max(best, j - i)
    return best


def brute(doc, item, masks=dc.MASKS):
    """Longest overlap over diagonals on which some mask's window agrees."""
    d, b = tokens(doc), tokens(item)
    if not b:
        return 0
    span = len(masks[0])
    shapes = [[i for i, c in enumerate(m) if c == "1"] for m in masks] if len(b) >= span else [list(range(len(b)))]
    best = whole = 0
    for shift in range(-len(b) + 1, len(d)):
        low, high = max(0, shift), min(len(d), shift + len(b))
        equal = [d[k] == b[k - shift] for k in range(low, high)]
        if any(all(equal[s + p] for p in shape) for shape in shapes for s in range(len(equal) - max(shape))):
            best = max(best, brute_run(equal, 0.8))
            whole = max(whole, len(b) if len(equal) == len(b) and sum(equal) >= 0.8 * len(b) - 1e-9 else 0)
    return best if best >= min(12, len(b)) else whole


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=40), st.sampled_from([0.5, 0.8, 1.0]))
def test_best_run(equal, similarity):
    run = dc.best_run(np.array(equal, bool), similarity)
    assert (run[1] - run[0] if run else 0) == brute_run(equal, similarity)
    if run:
        assert run[2] == sum(equal[run[0] : run[1]])


def rows():
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "and"] + [f"w{rng.randrange(300)}" for _ in range(6)])
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate((5, 13, 14, 20, 30, 60, 60))]
    items += [(7, "..."), (8, None), (9, items[4][1]), (None, "Élan vital ÉTÉ one two three"), (11, "")]
    docs = []
    for k in range(120):
        text = prose(rng.randrange(0, 120)).split()
        kind = k % 6
        if kind:
            source = (items[k % 7][1]).split()
            cut = source if kind < 4 else source[rng.randrange(len(source)) :]
            cut = [("X" if rng.random() < (0, 0, 0.05, 0.15, 0.1, 0.3)[kind] else w) for w in cut]
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + rng.choice(["", ",", " --"]) for w in cut]
        docs.append((k, rng.choice([" ", "\n"]).join(text)))
    docs += [(200, None), (201, ""), (202, "?!"), (None, items[5][1]), (203, "elan éLAN  vital Été, ONE two three"), (1, items[1][1]), (1, items[1][1])]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_equals_brute_force(spark, block):
    docs, items = rows()
    df = spark.createDataFrame([(*r, "h", 1) for r in docs], "doc_id long, text string, hits string, row int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.leaks(df, bench, block_words=block).collect()
    found = sorted((str(r.row.doc_id), sorted((str(i), max(h.words for h in r.hits if h.item_id == i)) for i in {h.item_id for h in r.hits})) for r in got)
    want = sorted((str(d), sorted((str(i), n) for i, t in items if (n := brute(text, t)))) for d, text in docs)
    assert found == want
    assert any(w for _, w in want) and any(not w for _, w in want)


def test_without_leaks(spark):
    docs, items = rows()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = dc.without_leaks(df, bench)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in docs if not any(brute(t, i) for _, i in items))


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.hits for r in dc.leaks(df, none).collect()] == [[]]
    assert dc.leaks(df.limit(0), df.select(df.doc_id.alias("item_id"), "text")).collect() == []


def test_masks_lose_no_run():
    """Longest runs that avoid all heavy masks, by dynamic programming over the last words: none agrees in 80 %."""
    heavy = [int(m, 2) for m in dc.MASKS if m.count("1") >= dc.HEAVY]
    size = 1 << (max(m.bit_length() for m in heavy) - 1)
    state, best = np.arange(size), np.full(size, -(10**6))
    best[1] = 1
    for n in range(2, 121):
        after = np.full(size, -(10**6))
        for bit in (0, 1):
            last = 2 * state + bit
            hit = np.any([(last & m) == m for m in heavy], axis=0)
            np.maximum.at(after, last & (size - 1), np.where(hit, -(10**6), best + bit))
        best = after
        assert n < 12 or best[state & 1 == 1].max() < 0.8 * n


def verified(doc, item):
    """Longest run over all diagonals, whatever the masks."""
    d, b = tokens(doc), tokens(item)
    faced = [[d[k] == b[k - s] for k in range(max(0, s), min(len(d), s + len(b)))] for s in range(-len(b) + 1, len(d))]
    whole = any(len(e) == len(b) and sum(e) >= 0.8 * len(b) - 1e-9 for e in faced)
    return best if (best := max((brute_run(e, 0.8) for e in faced), default=0)) >= min(12, len(b)) else len(b) * whole


@pytest.mark.parametrize("length", range(5, 16))
def test_every_place_may_be_substituted(length):
    """Recall by length and place: all, with any choice of as many substituted words as 80 % allows."""
    item = [f"v{i}" for i in range(length)]
    block = dc.Block([0], [" ".join(item)])
    docs = [" ".join(["x", "y", *("s" if i in places else w for i, w in enumerate(item)), "z"])
            for n in range(length // 5 + 1) for places in itertools.combinations(range(length), n)]
    piece = next(pieces(pa.array(docs)))
    found = {row: n for row, _, _, n, _ in block.overlaps(*dc.normal_words(piece.data, piece.offsets), 12, 0.8)}
    assert len(found) == len(docs) and min(found.values()) >= min(12, length)
    piece = next(pieces(pa.array([" ".join(["s"] * (length // 5 + 1) + item[length // 5 + 1 :])])))
    rest = length - length // 5 - 1
    assert bool(list(block.overlaps(*dc.normal_words(piece.data, piece.offsets), 12, 0.8))) == (rest >= 12)


def test_template_windows_are_compared_in_blocks(monkeypatch):
    """Many items with the same opening, asked by many rows: the same result however few hits are held."""
    opening = "choose the best answer to the question below"
    items = [f"{opening} {' '.join(f'i{i}w{k}' for k in range(8))}" for i in range(60)]
    docs = [f"{opening} {' '.join(f'd{i}w{k}' for k in range(9))}" for i in range(40)] + items[:7]
    piece = next(pieces(pa.array(docs)))
    block = dc.Block(range(60), items)
    asked = (*dc.normal_words(piece.data, piece.offsets), 12, 0.8)
    whole = sorted(block.overlaps(*asked))
    assert [w[:2] for w in whole] == [(40 + i, i) for i in range(7)]
    monkeypatch.setattr(dc, "HITS", 13)
    assert sorted(block.overlaps(*asked)) == whole and len(block.likely(*asked)) == 7


def test_no_accepted_pattern_is_lost(spark):
    rng = random.Random(6)
    prose = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    items = [(i, prose(n)) for i, n in enumerate([*range(1, 16), 40, 200])]
    docs = []
    for i, words in items:
        for k in range(12):
            at = rng.randrange(len(words) - 11) if len(words) > 12 and k % 2 else 0
            n = len(words) - at if k % 4 != 1 else min(12 + k // 8, len(words) - at)
            cut = words[at : at + n]
            if k < 3:  # every fifth word
                cut = ["x" if j % 5 == k + 1 else w for j, w in enumerate(cut)]
            else:
                for j in rng.sample(range(n), n // 5):
                    cut[j] = "x"
            docs.append((len(docs), " ".join(prose(15) + cut + prose(15))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = {(r.row.doc_id, int(h.item_id)): h.words for r in dc.leaks(df, bench).collect() for h in r.hits}
    want = {(d, i): n for d, text in docs for i, t in items if (n := verified(text, " ".join(t)))}
    assert got == want and len(want) > 150
