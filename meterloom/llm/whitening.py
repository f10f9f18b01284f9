"""Whitening of embeddings with eigenvectors found by FEAST contour integration.

Spark counts: distinct vectors, their exact sums and exact products (each task multiplies its own rows, centred by the
whole numbers nearest to the means; products are whole numbers and add up to the same matrix in any order). What is
left is one covariance matrix of dimensions x dimensions, whose leading eigenvectors are found interval by interval:

* inertia counts (signs of the pivots of a shifted tridiagonal form) tell how many eigenvalues lie above any point;
  the intervals are chosen by them, each with few eigenvalues and an end in a gap;
* for one interval, the quadrature of complex shifted solves around it projects random vectors onto its eigenspace,
  Rayleigh-Ritz extracts eigenpairs, and both repeat until the residuals reach the limit of double precision;
* an interval is done only if it gave as many eigenpairs as its inertia counts say.

Projecting the rows is one pass over the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
#: Quadrature points on the upper half of a contour, and eigenvalues an interval should hold at most.
NODES = 8
MOST_IN_INTERVAL = 8
ROUNDS = 30
#: Dimensions up to which the covariance, which the driver holds, is accepted.
MOST_DIMENSIONS = 4096
#: Scaled entries beyond this count as it; doubles hold whole numbers up to here exactly.
BOUND = float(2**52)


# ---- one matrix ---------------------------------------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of a symmetric one (reflections)."""
    a = matrix.astype(float).copy()
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v /= length
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        p = 2 * (p - v * (v @ p))
        rest -= np.outer(v, p) + np.outer(p, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(form: tuple[np.ndarray, np.ndarray], point: float) -> int:
    """Inertia count: eigenvalues above ``point``, as the positive pivots of the shifted tridiagonal form."""
    diagonal, beside = form
    tiny = np.finfo(float).tiny
    pivot, count = 1.0, 0
    for i in range(len(diagonal)):
        pivot = diagonal[i] - point - (beside[i - 1] ** 2 / pivot if i else 0.0)
        if pivot == 0:
            pivot = -tiny
        count += pivot > 0
    return count


def intervals(form: tuple[np.ndarray, np.ndarray], wanted: int, most: int = MOST_IN_INTERVAL) -> list[tuple[float, float, int]]:
    """Neighbouring intervals from the top that hold the ``wanted`` largest eigenvalues: (low, high, count).

    Bisection stops at points between which the counts differ by at most ``most``; ends are then moved to the middle
    of the gap they lie in, so no eigenvalue is near a contour. Eigenvalues closer than rounding stay together, so an
    interval may hold more than ``most`` and the last may end below the wanted ones.
    """
    diagonal, beside = form
    reach = np.abs(np.r_[beside, 0]) + np.abs(np.r_[0, beside])
    top, bottom = float((diagonal + reach).max()), float((diagonal - reach).min())
    size = max(abs(top), abs(bottom), np.finfo(float).tiny)
    top, bottom = top + size * 1e-3, bottom - size * 1e-3

    def eigenvalue(place: int) -> float:
        """The ``place``-th largest eigenvalue, to rounding."""
        low, high = bottom, top
        while high - low > 4 * np.finfo(float).eps * size:
            middle = (low + high) / 2
            low, high = (middle, high) if above(form, middle) >= place else (low, middle)
        return (low + high) / 2

    n, found, done = len(diagonal), [], 0
    values = [eigenvalue(i) for i in range(1, min(n, wanted + most) + 1)]
    least = 64 * np.finfo(float).eps * size
    high = None
    while done < wanted:
        # Among the next cuts, the one in the relatively widest gap; at equal eigenvalues the cut moves on.
        stop = done
        options = [k for k in range(done + 1, min(done + most, len(values)) + 1) if k < len(values) and values[k - 1] - values[k] > least]
        needed = [k for k in options if k >= min(wanted, done + most // 2)] or options
        if needed:
            stop = max(needed, key=lambda k: values[k - 1] - values[k])
            low = (values[stop - 1] + values[stop]) / 2
        else:
            stop, low = len(values), bottom
            while stop < n:
                values.append(eigenvalue(stop + 1))
                if values[stop - 1] - values[stop] > least:
                    low = (values[stop - 1] + values[stop]) / 2
                    break
                stop += 1
        if high is None:  # as far above the first eigenvalue as the low end is below it
            high = values[0] + max(values[0] - low, least)
        found.append((low, high, stop - done))
        high, done = low, stop
    return found


def feast(matrix: np.ndarray, low: float, high: float, count: int, nodes: int = NODES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of a symmetric matrix in (low, high), by falling eigenvalue.

    The basis grows where close neighbours outside slow the projection down. Raises where quadrature and
    Rayleigh-Ritz do not come to as many eigenpairs as the inertia counts say.
    """
    n = len(matrix)
    size = min(n, count + max(4, count // 2))
    points, weights = np.polynomial.legendre.leggauss(nodes)
    angles = np.pi / 2 * (1 - points)
    centre, radius = (low + high) / 2, (high - low) / 2
    turns = radius * np.exp(1j * angles)
    inverses = [np.linalg.inv((centre + z) * np.eye(n) - matrix) for z in turns]
    scale = np.abs(matrix).sum(1).max()
    start = np.random.default_rng(n).standard_normal((n, n))
    while True:
        basis, best = start[:, :size], (np.inf, np.zeros(0), np.zeros((n, 0)))
        for _ in range(rounds):
            # The contour is symmetric about the real axis, so its upper half gives twice the real part.
            projected = sum(w / 2 * (z * (inverse @ basis)).real for inverse, z, w in zip(inverses, turns, weights, strict=True))
            columns = np.linalg.svd(projected, full_matrices=False)[0]
            values, turn = np.linalg.eigh(columns.T @ matrix @ columns)
            basis = columns @ turn
            inside = (values > low) & (values < high)
            if inside.sum() != count:
                continue
            kept, pairs = values[inside][::-1], basis[:, inside][:, ::-1]
            residual = np.linalg.norm(matrix @ pairs - pairs * kept, axis=0).max(initial=0.0)
            done = best[0] <= 1e-13 * scale and residual >= best[0] / 2
            best = min(best, (residual, kept, pairs), key=lambda b: b[0])
            if done:
                break
        if best[0] <= 1e-13 * scale:
            return best[1], best[2]
        if size == n:
            raise ArithmeticError(f"the interval ({low}, {high}) holds {count} eigenvalues, not all of which were found")
        size = min(n, 2 * size)


def leading(matrix: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, by falling size, and unit eigenvectors (columns) of a covariance: ``wanted`` or as many as its rank."""
    size = np.abs(matrix).max(initial=0.0)
    if size == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    scaled = matrix / size
    form = tridiagonal(scaled)
    least = 64 * len(matrix) * np.finfo(float).eps
    wanted = min(wanted, above(form, least))
    found = [feast(scaled, low, high, count) for low, high, count in intervals(form, wanted)]
    values, vectors = np.concatenate([v for v, _ in found]), np.hstack([p for _, p in found])
    # Intervals are solved apart; one factorisation makes their vectors orthogonal to the last digit.
    order = np.argsort(-values, kind="stable")[:wanted]
    straight, upper = np.linalg.qr(vectors[:, order])
    straight = straight * np.sign(np.diag(upper))
    return np.einsum("ij,ij->j", straight, scaled @ straight) * size, straight


# ---- the table ----------------------------------------------------------------------------------------------------


def quantised(column: pa.Array, scale: int = SCALE, shift: int = SHIFT) -> pa.ListArray:
    """Vectors as whole numbers ``floor(scale * c) + shift``; null where :func:`whiten` leaves a row out."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    ends = np.cumsum(lengths)
    good = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    with np.errstate(over="ignore"):
        whole = np.floor(np.clip(flat[np.repeat(good, lengths)] * scale, -BOUND, BOUND)).astype(np.int64) + shift
    offsets = np.r_[0, np.cumsum(np.where(good, lengths, 0))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole), mask=pa.array(~good))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def products(rows: np.ndarray) -> np.ndarray:
    """Exact products of whole-number columns, as Python integers where 53 bits could be too few."""
    top = int(np.abs(rows).max(initial=0))
    if top * top * max(1, len(rows)) < 2**53:
        floats = rows.astype(float)
        return (floats.T @ floats).astype(np.int64)
    whole = rows.astype(object)
    return whole.T.dot(whole)


@dataclass(frozen=True)
class Fit:
    """What the fit list says: size, per-dimension sums, trace, leading eigenvalues and vectors of its covariance."""

    n: int
    sums: tuple[int, ...]
    trace: float = 0.0
    values: np.ndarray | None = None
    components: np.ndarray | None = None

    @property
    def centre(self) -> np.ndarray:
        """Whole numbers nearest to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def beyond(self) -> np.ndarray:
        """``n`` times the means less ``centre``, whole numbers."""
        return np.array([s - self.n * int(c) for s, c in zip(self.sums, self.centre, strict=True)], object)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows less the means, projected on the components, over the roots of the eigenvalues."""
        means = np.array([float(Fraction(int(b), self.n)) for b in self.beyond])
        return ((x - self.centre).astype(float) - means) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - sum)^2, exact."""
        centred, beyond = x - self.centre, self.beyond
        if (int(np.abs(centred).max(initial=0)) * self.n + self.n) ** 2 * len(self.sums) < 2**63:
            return pa.array(((self.n * centred - beyond.astype(np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
        exact = self.n * centred.astype(object) - beyond
        return pa.array([Decimal(int(v)) for v in (exact * exact).sum(1)], pa.decimal128(38, 0))


def _summed(distinct: DataFrame, dims: int, add: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over the tasks of ``add`` of their rows. Decimals add up to the same sum in any order."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + add(_matrix(batch.column("x"), dims)).astype(object)
        if isinstance(total, np.ndarray):
            cells = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array([str(v) for v in cells])], ["i", "value"])

    parts = distinct.select("x").mapInArrow(multiply, "i bigint, value string")
    found = parts.groupBy("i").agg(F.sum(F.col("value").cast(kind)).alias("value")).collect()
    size = max((r.i for r in found), default=-1) + 1
    total = np.zeros(size, object)
    for r in found:
        total[r.i] = r.value
    return total


def fit(distinct: DataFrame, dims: int, components: int = COMPONENTS) -> Fit:
    """Fit whitening to a table of at least one distinct vector ``x`` of ``dims`` whole numbers.

    The driver gets sums and products, at most ``MOST_DIMENSIONS`` squared numbers whatever the number of rows.
    """
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"{dims} dimensions; a covariance of at most {MOST_DIMENSIONS} is held")
    upper = np.triu_indices(dims)
    counted = _summed(distinct, dims, lambda x: np.r_[len(x), x.astype(object).sum(0) if int(np.abs(x).max()) * len(x) >= 2**62 else x.sum(0)], "decimal(38,0)")
    start = Fit(int(counted[0]), tuple(int(v) for v in counted[1:]))
    n, centre, beyond = start.n, start.centre, start.beyond
    gram = np.zeros((dims, dims), object)
    gram[upper] = [int(v) for v in _summed(distinct, dims, lambda x: products(x - centre)[upper], "decimal(38,0)")]
    gram.T[upper] = gram[upper]
    # n * products - sums * sums is exact; one division rounds it.
    exact = n * gram - np.outer(beyond, beyond)
    covariance = np.array([[float(Fraction(int(v), n * n)) for v in line] for line in exact]).reshape(dims, dims)
    values, found = leading(covariance, components)
    return Fit(n, start.sums, float(Fraction(sum(int(exact[i, i]) for i in range(dims)), n * n)), values, found)


def identity_error(distinct: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    count, dims = len(model.values), len(model.sums)
    means = [float(v) / model.n for v in _summed(distinct, dims, lambda x: model.whiten(x).sum(0), "decimal(38,15)")]

    def centred(x: np.ndarray) -> np.ndarray:
        white = model.whiten(x) - means
        return white.T @ white

    total = np.array([float(v) for v in _summed(distinct, dims, centred, "decimal(38,15)")]).reshape(count, count)
    return float(np.abs(total / model.n - np.eye(count)).max())


def whiten(
    rows: DataFrame, embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT,
) -> DataFrame:
    """Rows of ``row`` (all columns), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    The fit list holds each distinct vector once, ``n`` in all. ``whitened`` and ``explained`` are arrays over the
    components by falling eigenvalue: ``components`` or as many as the rank of the covariance, so none for a table of
    one distinct vector. ``deviation`` is the sum over dimensions of (n x - sum)^2, exact as a decimal. Left out are
    rows whose vector is null, empty, holds a null or non-finite entry or is shorter than the longest. Entries beyond
    2^52 after scaling count as that bound. Repeated rows and null ids come out each by itself; empty tables give no
    rows.
    """
    @F.arrow_udf("array<bigint>")
    def whole(column: pa.Array) -> pa.Array:
        return quantised(column, scale, shift)

    whole = whole.asNondeterministic()  # or the filter on its result would run it once more
    packed = rows.select(F.struct("*").alias("row"))
    distinct = cut_lineage(packed.select(whole(F.col(f"row.`{embedding}`")).alias("x")).where("x IS NOT NULL").distinct())
    dims = distinct.agg(F.max(F.size("x"))).first()[0] or 0
    distinct = distinct.where(F.size("x") == dims)
    model = fit(distinct, dims, components) if dims else Fit(0, ())
    count = 0 if model.values is None else len(model.values)
    error = identity_error(distinct, model) if count else 0.0

    @F.arrow_udf("struct<deviation: decimal(38,0), whitened: array<double>>")
    def project(column: pa.Array) -> pa.Array:
        vectors = quantised(column, scale, shift)
        used = pc.equal(pc.list_value_length(vectors), dims).fill_null(False)
        x = _matrix(vectors.filter(used), dims) if dims else np.zeros((0, 0), np.int64)
        # Row numbers among the used; null takes give nulls.
        place = np.cumsum(used.to_numpy(zero_copy_only=False)) - 1
        take = pa.array(place, mask=~used.to_numpy(zero_copy_only=False))
        white = model.whiten(x) if count and len(x) else np.zeros((len(x), 0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]), pa.array(white.ravel()))
        deviation = model.deviation(x) if len(x) else pa.array([], pa.decimal128(38, 0))
        return pa.StructArray.from_arrays([deviation.take(take), lists.take(take)], ["deviation", "whitened"])

    project = project.asNondeterministic()
    found = packed.withColumn("found", project(F.col(f"row.`{embedding}`"))).where("found.whitened IS NOT NULL")
    shares = [float(v / model.trace) for v in model.values] if count else []
    return found.select(
        "row", F.lit(model.n).cast("long").alias("n"), "found.deviation", "found.whitened",
        F.array(*[F.lit(s) for s in shares]).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))
