"""Quality classifier by co-training.

Two views of a document are classified apart: its content (which words it has, and their shape: repetition, capitals,
symbols) and its metadata (source, language, length, lines). Each view is a naive Bayes model over hashed features.
In every round both models are fitted on the labelled documents and on those that the *other* view has labelled
with confidence; then they are calibrated. At last the calibrated views are combined and score all documents. A view
passes on labels of a class only if those it was sure of prove right often enough on labelled documents that no fit
has seen, and the round whose combination fits such documents best is the one that scores.

Naive Bayes needs counts only, so a fit is one aggregation over all documents: tasks add up what they see in arrays
of a fixed size, which is all that is shuffled or sent to the driver. Features are written once; rounds read a few
bytes per word instead of texts. Calibration fits a handful of numbers on a bounded number of labelled documents
that no fit has seen: the views on one half of them, their combination and the tests of trust on the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import SPACE, hashes, pieces, row_sums, words

#: Hashed features of a view. Words fill the first part of the content's, shapes the rest.
BUCKETS = 1 << 16
SHAPES = 256
META = 1 << 12
ROUNDS = 3
#: Probability from which a view labels a document for the other.
CONFIDENT = 0.95
SMOOTHING = 1.0
#: Labelled documents that calibration is fitted on, about this many at most, chosen by hash.
CALIBRATION_ROWS = 20_000
#: Sure and labelled documents without which a view is not trusted with a class.
EVIDENCE = 10

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = ~(_ALPHA | _DIGIT | SPACE)
_FEATURES = "doc_id, fold, label, words, shapes, meta"


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Step from 0 to 15 of a share."""
    return np.minimum(15, (16 * part / np.maximum(whole, 1)).astype(np.int64))


def _steps(n: np.ndarray) -> np.ndarray:
    """Half powers of two of a count, 0 to 47."""
    return np.minimum(47, np.round(2 * np.log2(np.maximum(n, 0) + 1.0)).astype(np.int64))


def content_features(texts: pa.Array) -> tuple[list[bytes], list[bytes]]:
    """Per text the different word buckets and the shape buckets, as packed 16-bit numbers."""
    bags, shapes = [], []
    for piece in pieces(texts):
        starts, ends, counts = words(piece.data, piece.offsets)
        marks = hashes(piece.data, starts, ends)
        row = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((marks, row))
        first = np.ones(len(order), bool)
        first[1:] = (marks[order][1:] != marks[order][:-1]) | (row[order][1:] != row[order][:-1])
        different = np.bincount(row[order][first], minlength=len(counts))
        pairs = np.unique(row[order][first] * BUCKETS + (marks[order][first] % np.uint64(BUCKETS)).astype(np.int64))
        cut = np.searchsorted(pairs, np.arange(len(counts) + 1) * BUCKETS)
        buckets = (pairs % BUCKETS).astype("<u2")
        bags += [buckets[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        by_row = lambda table: np.diff(np.r_[0, np.cumsum(table[piece.data])][piece.offsets])  # noqa: E731, B023
        visible = by_row(~SPACE)
        alpha = by_row(_ALPHA)
        length = row_sums(ends - starts, counts) / np.maximum(counts, 1)
        kinds = [_share(different, counts), _share(by_row(_UPPER), alpha), _share(by_row(_DIGIT), visible), _share(by_row(_MARK), visible),
                 np.minimum(15, length.astype(np.int64)), np.minimum(15, _steps(counts) // 2)]
        table = np.stack([16 * k + v for k, v in enumerate(kinds)], axis=1).astype("<u2")
        shapes += [r.tobytes() for r in table]
    return bags, shapes


def features(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, metadata: tuple[str, ...], label: str) -> DataFrame:
    """Stored ``doc_id, fold, label, words, shapes, meta`` of every document. Fold 0 is kept for calibration."""
    hashed = [F.pmod(F.xxhash64(F.lit(i), F.col(c).cast("string")), F.lit(META)) for i, c in enumerate(metadata)]
    counted = [F.length(text), F.length(F.regexp_replace(F.col(text), "[^\n]+", ""))]
    hashed += [F.pmod(F.xxhash64(F.lit(-1 - i), F.round(2 * F.log2(F.coalesce(c, F.lit(-0.5)) + 1)).cast("int")), F.lit(META)) for i, c in enumerate(counted)]
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.array(*hashed).alias("meta"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags, shapes = content_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("meta"), pa.array(bags, pa.binary()), pa.array(shapes, pa.binary())], ["doc_id", "meta", "words", "shapes"])

    kind = given.schema["doc_id"].dataType.simpleString()
    described = given.mapInArrow(describe, f"doc_id {kind}, meta array<bigint>, words binary, shapes binary")
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(F.when(F.col(label) > 0, 1).otherwise(0)).alias("label"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int")
    # Labels grow with the documents, so the join is the same shuffle at every size.
    return cut_lineage(described.join(known.hint("shuffle_merge"), "doc_id", "left").withColumn("fold", fold).select(*_FEATURES.split(", ")))


@dataclass
class Models:
    """Log odds per feature and the calibration of each view; sent to the tasks, a megabyte at most."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    shapes: np.ndarray = field(default_factory=lambda: np.zeros(SHAPES))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(META))
    content_fit: np.ndarray | None = None
    meta_fit: np.ndarray | None = None
    both_fit: np.ndarray | None = None
    #: Whether content (first row) and metadata may label bad (first column) and good documents for the other view.
    trust: np.ndarray = field(default_factory=lambda: np.zeros((2, 2), bool))

    def raw(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the calibrations: mean log odds of words and sum of shapes' log odds; sum of metadata's."""
        bags, owner = _unpack(batch.column("words"))
        n = np.bincount(owner, minlength=batch.num_rows)
        word = np.bincount(owner, self.words[bags], batch.num_rows) / np.maximum(n, 1)
        shape, whose = _unpack(batch.column("shapes"))
        content = np.stack([word, np.bincount(whose, self.shapes[shape], batch.num_rows)], axis=1)
        place, of = _listed(batch.column("meta"))
        return content, np.bincount(of, self.meta[place], batch.num_rows)[:, None]

    def views(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality from content and from metadata."""
        content, meta = self.raw(batch)
        return _apply(self.content_fit, content), _apply(self.meta_fit, meta)


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(v) for v in column.to_pylist()), np.int64, len(column)) // 2
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").astype(np.int64), np.repeat(np.arange(len(column)), sizes)


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def _apply(fit: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(fit[0] + x @ fit[1:], -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Intercept and coefficients of a logistic regression by Newton steps; inputs are few."""
    a = np.c_[np.ones(len(x)), x]
    fit = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ fit, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ fit)
        fit += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return fit


def _counts(stored: DataFrame, models: Models | None, confident: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents per feature and class (two columns) of words, shapes and metadata. Labelled documents outside of
    the calibration fold count for both views, documents that one view is sure of for the other."""
    sent = stored.sparkSession.sparkContext.broadcast(models)
    sizes = (BUCKETS, SHAPES, META)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        sums = np.zeros((sum(sizes), 2), np.int64)
        for batch in batches:
            label = batch.column("label").fill_null(-1).to_numpy().astype(np.int64)
            known = label >= 0
            teaches = np.where(known & (batch.column("fold").fill_null(1).to_numpy() != 0), label, -1)
            by_content = by_meta = np.full(batch.num_rows, -1)
            if model is not None:
                content, meta = model.views(batch)
                by_content, by_meta = (np.where(known, -1, np.where((p >= confident) & good, 1, np.where((p <= 1 - confident) & bad, 0, -1)))
                                       for p, (bad, good) in zip((content, meta), model.trust, strict=True))
            content_label, meta_label = np.where(known, teaches, by_meta), np.where(known, teaches, by_content)
            base = 0
            for size, (place, owner), to in zip(sizes, (_unpack(batch.column("words")), _unpack(batch.column("shapes")), _listed(batch.column("meta"))),
                                                (content_label, content_label, meta_label), strict=True):
                for c in (0, 1):
                    sums[base : base + size, c] += np.bincount(place[to[owner] == c], minlength=size)
                base += size
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some, 0]), pa.array(sums[some, 1])], ["place", "bad", "good"])

    summed = stored.mapInArrow(count, "place long, bad long, good long").groupBy("place").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    out = np.zeros((sum(sizes), 2))
    rows = summed.toPandas()  # one row per feature bucket at most
    out[rows["place"].to_numpy(np.int64)] = rows[["bad", "good"]].to_numpy(np.float64)
    return tuple(np.split(out, np.cumsum(sizes)[:-1]))


def _log_odds(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    share = (counts + smoothing) / (counts.sum(axis=0) + smoothing * len(counts))
    return np.log(share[:, 1]) - np.log(share[:, 0])


def _raw_scores(held: DataFrame, models: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels and the calibrations' inputs of the held-out documents, and which half each belongs to: five numbers each."""
    sent = held.sparkSession.sparkContext.broadcast(models)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, meta = sent.value.raw(batch)
            yield pa.RecordBatch.from_arrays([batch.column("label"), *map(pa.array, (content[:, 0].copy(), content[:, 1].copy(), meta[:, 0].copy())), batch.column("half")],
                                             ["label", "word", "shape", "meta", "half"])

    halved = held.withColumn("half", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(2)))
    rows = halved.mapInArrow(rate, "label int, word double, shape double, meta double, half long").toPandas()
    return rows["label"].to_numpy(np.float64), rows[["word", "shape"]].to_numpy(), rows[["meta"]].to_numpy(), rows["half"].to_numpy()


def trusted(p: np.ndarray, y: np.ndarray, confident: float, evidence: int = EVIDENCE) -> np.ndarray:
    """Whether what a view is sure of is right in a share of ``confident`` or more, for bad and for good documents."""
    right = ((y == 0)[p <= 1 - confident], (y == 1)[p >= confident])
    return np.array([len(r) >= evidence and r.mean() >= confident for r in right])


def train(stored: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, calibration_rows: int = CALIBRATION_ROWS) -> Models | None:
    """Models of the best of the given number of rounds, or None if the labels don't show both classes in either part.

    Rounds are compared by the mean log loss of their combination on the half of the calibration's rows that did not
    calibrate the views; the earliest wins a tie. If a half lacks a class, all these rows serve for both halves.
    """
    held = stored.where("label IS NOT NULL AND fold = 0")
    share = calibration_rows / max(1, held.count())
    if share < 1:
        held = held.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    models, best, least = None, None, np.inf
    for _ in range(rounds):
        word, shape, meta = _counts(stored, models, confident)
        if not shape.sum(axis=0).all():
            return None
        models = Models(_log_odds(word), _log_odds(shape), _log_odds(meta))
        y, content, place, half = _raw_scores(held, models)
        if len(set(y)) < 2:
            return None
        first, second = half == 0, half == 1
        if min(len(set(y[first])), len(set(y[second]))) < 2:
            first = second = np.ones(len(y), bool)
        models.content_fit, models.meta_fit = logistic(content[first], y[first]), logistic(place[first], y[first])
        views = _apply(models.content_fit, content[second]), _apply(models.meta_fit, place[second])
        models.trust = np.stack([trusted(p, y[second], confident) for p in views])
        models.both_fit = _rising(_logits(*views), y[second])
        p = np.clip(_apply(models.both_fit, _logits(*views)), 1e-9, 1 - 1e-9)
        loss = -np.where(y[second] == 1, np.log(p), np.log(1 - p)).mean()
        if loss < least:
            best, least = models, loss
        if not models.trust.any():  # further rounds would fit the same counts again
            break
    return best


def _rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression in which no input counts against its own direction."""
    used = list(range(x.shape[1]))
    while True:
        fit = logistic(x[:, used], y)
        against = [i for i, c in zip(used, fit[1:], strict=True) if c < 0]
        if not against:
            break
        used = [i for i in used if i not in against]
    out = np.zeros(1 + x.shape[1])
    out[[0, *(1 + i for i in used)]] = fit
    return out


def _logits(content: np.ndarray, meta: np.ndarray) -> np.ndarray:
    odds = lambda p: np.log(p + 1e-12) - np.log(1 - p + 1e-12)
    return np.stack([odds(content), odds(meta)], axis=1)


def score(stored: DataFrame, models: Models | None) -> DataFrame:
    """``doc_id``, ``content_score``, ``meta_score`` and ``score``, all probabilities of good quality."""
    sent = stored.sparkSession.sparkContext.broadcast(models)
    kind = stored.schema["doc_id"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            content = meta = both = np.full(batch.num_rows, 0.5)
            if model is not None and batch.num_rows:
                content, meta = model.views(batch)
                both = _apply(model.both_fit, _logits(content, meta))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(content), pa.array(meta), pa.array(both)], ["doc_id", "content_score", "meta_score", "score"])

    return stored.mapInArrow(rate, f"doc_id {kind}, content_score double, meta_score double, score double")


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ("source", "lang"),
    label: str = "quality", rounds: int = ROUNDS, confident: float = CONFIDENT, least: float = 0.5,
) -> DataFrame:
    """One row per document: ``doc_id``, the two views' scores, their combination ``score`` and ``kept``, whether
    that is at least ``least``.

    Labels above zero are good. A document with several labels has the smallest; null labels, null ids and labels
    of unknown documents teach nothing. If the labels don't show both classes, every score is 0.5 and all documents
    are kept. Null and empty texts have no words and are judged by shape and metadata; nulls in metadata are values
    of their own. Repeated rows are judged alike; empty tables give no rows.
    """
    stored = features(docs, labels, doc_id, text, metadata, label)
    return score(stored, train(stored, rounds, confident)).withColumn("kept", F.col("score") >= least)
