import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from meterloom.llm import packing
from meterloom.llm.queries import QUERIES
from meterloom.llm.text import pieces
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def odd_texts():
    rng = random.Random(7)
    letters = list("abzÀéßŉİǅ ΣςКй中٣٤½'|<>.,-_09\t\n\x0b\x1c\x85\xa0 　́İKﬁ😀\x00") + [
        "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "don't", "O'NEILL's", "é", "ﬁ", "ʼn", "a.'s", "x1y2", "Ångström"]
    return ["", " ", "\n\n", "word"] + ["".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(2500)]


def test_ids_are_the_tokenizers(tokenizer):
    texts = odd_texts() + [t.replace("|", "Q") for t in odd_texts()] + ["<|ENDOFTEXT|> A<|endoftext|>B"]
    encoder = packing.Encoder(packing.VOCABULARY)
    for piece in pieces(pa.array(texts), 4000):
        flat, counts = encoder.encode(piece)
        want = tokenizer.encode_batch(texts[piece.start : piece.stop], add_special_tokens=False)
        for got, right in zip(np.split(flat, np.cumsum(counts)[:-1]), want, strict=True):
            assert got.tolist() == right.ids


def check(rows, documents, capacity, tokenizer):
    """Every piece of every document once, right ids, sequences without gaps; gives the number of sequences."""
    want = Counter()
    for doc_id, text in documents:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 1])
def test_pieces_and_sequences(spark, tokenizer, capacity):
    documents = [(i, t) for i, t in enumerate(odd_texts()[:400])] + [(None, "no id"), (3, None), (3, None), (3, "again"), (8, "many words " * 3000)]
    df = spark.createDataFrame([(*d, "clash", 5) for d in documents], "doc_id long, text string, row string, length int").repartition(3)
    found = packing.pack(packing.tokenised(df, capacity=capacity), capacity=capacity, part_items=2000)
    rows = found.select("row.*", "sequence_id", "offset").collect()
    check(rows, documents, capacity, tokenizer)


def test_query_packs_closely(spark, folder, tokenizer):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = QUERIES["op13_sum_of_squares_packing"](spark, folder).collect()
    used = check(rows, documents, 2048, tokenizer)
    assert used <= 1 + 1.01 * sum(r.length for r in rows) / 2048


def brute(lengths, capacity):
    """Sum of squares over all gaps, written out for each choice."""
    gaps, places = [], []
    for n in lengths:
        def after(i, n=n):
            left = Counter(g - n * (j == i) for j, g in enumerate(gaps))
            return sum(c * c for g, c in left.items() if 0 < g < capacity)

        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            best = min(fits, key=lambda i: (after(i), gaps[i]))
            places.append((gaps[best], after(best)))
            gaps[best] -= n
        else:
            places.append((capacity, None))
            gaps.append(capacity - n)
    return places, gaps


def test_choice_is_the_least_sum_of_squares():
    rng = random.Random(3)
    for capacity in (7, 20, 50):
        lengths = [rng.randrange(1, capacity + 1) for _ in range(60)]
        bins = packing.Bins(capacity)
        places = [bins.place(n) for n in lengths]
        want, gaps = brute(lengths, capacity)
        assert [capacity - offset for _, offset in places] == [gap for gap, _ in want]
        assert bins.made == len(gaps)
        assert Counter({g: int(c) for g, c in enumerate(bins.open) if g and c}) == Counter(g for g in gaps if g)


def test_lengths_that_fit_nowhere(spark):
    df = spark.createDataFrame([(None, 1), (0, 2), (-3, 3), (11, 4), (10, 5), (4, 6), (6, 7)], "length int, sequence_id int")
    rows = {r.row.sequence_id: r for r in packing.pack(df, capacity=10).collect()}
    assert [k for k, r in sorted(rows.items()) if r.sequence_id is None and r.offset is None] == [1, 2, 3, 4]
    assert len({r.sequence_id for r in rows.values()}) == 3
    assert packing.pack(df.where("false")).count() == 0
    assert packing.tokenised(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sequences_hold_their_ids(spark, tokenizer):
    df = spark.createDataFrame([(1, "a few words"), (2, "and more, many more words"), (3, None)], "doc_id long, text string")
    packed = packing.pack(packing.tokenised(df, capacity=8, with_ids=True), capacity=8)
    rows = packing.assemble(packed).collect()
    ids = lambda t: [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
    want = Counter(ids("a few words") + ids("and more, many more words") + [0])
    assert Counter(i for r in rows for i in r.ids) == want
    assert max(len(r.ids) for r in rows) <= 8
