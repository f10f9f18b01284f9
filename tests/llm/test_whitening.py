import math
import random
from fractions import Fraction

import numpy as np
import pytest
from meterloom.llm import whitening
from meterloom.llm.queries import QUERIES


def spectrum(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    matrix = (q * values) @ q.T
    return (matrix + matrix.T) / 2


SPECTRA = {
    "spread": np.linspace(1, 2, 64), "falling": 0.8 ** np.arange(200), "one": np.array([3.0]), "small": np.arange(1.0, 6),
    "tied": np.r_[[3.0] * 20, np.linspace(0, 1, 20)], "close": 1 + 1e-9 * np.arange(64), "close and far": np.r_[50.0, 7 + 1e-8 * np.arange(12), np.linspace(0.1, 1, 30)],
    "rank 5": np.r_[np.zeros(25), np.arange(1.0, 6)], "tiny": 1e-9 * np.linspace(1, 2, 30), "equal": np.ones(12),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_pairs(name):
    matrix = spectrum(SPECTRA[name])
    values, vectors = whitening.leading(matrix)
    want = np.linalg.eigvalsh(matrix)[::-1]
    assert len(values) == min(16, (SPECTRA[name] > 0).sum())
    top = want[0]
    assert np.abs(values - want[: len(values)]).max() < 1e-13 * top
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_inertia_counts():
    values = np.array([-2.0, -1, 0.5, 0.5, 3, 8])
    form = whitening.tridiagonal(spectrum(values))
    for point in (-3, -1.5, 0, 0.49, 0.51, 2, 7.99, 9):
        assert whitening.above(form, point) == (values > point).sum()


def test_a_missed_eigenvalue_is_seen():
    matrix = spectrum(np.arange(1.0, 9))
    with pytest.raises(ArithmeticError):
        whitening.feast(matrix, 4.5, 8.5, 5)


def brute(rows, components=16):
    """The contract with dense decompositions and exact sums over Python numbers."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, dims = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centred = [[Fraction(n * a - s, n) for a, s in zip(x, sums, strict=True)] for x in fit]
    exact = np.array([[float(a) for a in x] for x in centred])
    values, vectors = np.linalg.eigh(exact.T @ exact / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    good = values > 1e-9 * values[0]
    values, vectors = values[good], vectors[:, good]
    trace = (exact**2).sum() / n
    out = {}
    for i, x in kept:
        white = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)]) @ vectors / np.sqrt(values)
        out.setdefault(i, []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), white, values / trace))
    return out


def same(got, want, rows):
    assert len(got) == rows
    signs = None
    for r in got:
        n, deviation, white, explained = want[r.row.vec_id][0]
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert np.allclose(r.explained, explained, rtol=1e-10)
        mine = np.array(r.whitened)
        assert np.allclose(np.abs(mine), np.abs(white), atol=1e-7)
        big = (np.abs(white) > 1e-3)
        signs = np.zeros(len(white)) if signs is None else signs
        now = np.sign(mine * white)
        assert np.all((signs[big] == 0) | (signs[big] == now[big]))
        signs[big] = now[big]
        assert r.identity_error < 1e-10


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vector = lambda: [rng.gauss(0, 1 + j) for j in range(6)]
    rows = [(i, vector()) for i in range(300)]
    rows += [(400 + i, list(rows[i % 3][1])) for i in range(200)]
    broken = [(900, None), (901, []), (902, [1.0] * 5 + [None]), (903, [1.0] * 5 + [float("nan")]), (904, [float("inf")] + [0.0] * 5), (905, [1.0, 2.0])]
    same_id = [(7777, rows[0][1])]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows + broken + same_id], "vec_id long, embedding array<double>, row string, whitened double")
    got = whitening.whiten(df.repartition(5)).collect()
    want = brute([r for r in rows + same_id])
    same(got, want, 501)


def test_large_entries_stay_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1e11, 1e11) for _ in range(3)]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    same(got, brute(rows), 40)
    huge = spark.createDataFrame([(1, [1e308, 0.0]), (2, [-1e308, 1.0])], "vec_id long, embedding array<double>")
    assert [len(r.whitened) for r in whitening.whiten(huge).collect()] == [1, 1]


def test_one_distinct_vector_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert [r.whitened for r in whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()] == [[], []]
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0


def test_query(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows)
    got = QUERIES["op11_feast_whitening"](spark, folder).collect()
    assert len(got) == 16 * sum(map(len, want.values()))
    for r in got:
        n, deviation, white, explained = want[r.vec_id][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(abs(white[r.component - 1]), abs=1e-8)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
        assert r.identity_error <= 1e-10
