"""Language identification with hyperdimensional profiles.

Every letter has a random vector of plus and minus ones, derived from its code point. An n-gram of letters is the
product (binding) of its letters' vectors, each permuted by its place in the n-gram; a text or a language is the
sum (bundle) of its n-grams' vectors. A document has the language whose profile makes the smallest angle with it.

A bundle is linear in n-gram counts, so learning counts n-grams per language over all labelled texts, which
aggregates before the shuffle, and only the distinct n-grams are turned into vectors. Sums are whole numbers, so
profiles don't depend on the layout of tasks. Documents are bundled in batches, n-gram counts times n-gram vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .text import mixed, pieces

DIMENSIONS = 1024
ORDER = 3
SEED = 42
#: The answer where a text is null or has no letters.
UNDETERMINED = "und"
#: Languages that are learned at most: their profiles are sent to all tasks (8 KB each).
MOST_LANGUAGES = 4096
#: Distinct n-grams turned into vectors at once.
GRAMS = 2048
#: A language is told if the cosine is at least this share of a low quantile of held-out documents' cosines. The rest
#: leaves room for short documents; letters at random and languages that were not learned stay below.
LEAST_SHARE, LEAST_QUANTILE = 0.4, 0.01
#: Held-out documents that a quantile needs.
LEAST_ROWS = 20

_BITS = 21  # of a code point


def letter_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """A row of random signs per code point."""
    words = np.arange(-(-dimensions // 64), dtype=np.uint64)
    bits = mixed(mixed(codes.astype(np.uint64) + np.uint64(seed << 32))[:, None] + words * np.uint64(0x9E3779B97F4A7C15))
    signs = np.unpackbits(bits.view(np.uint8).reshape(len(codes), -1), axis=1)[:, :dimensions]
    return signs.astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, order: int = ORDER, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """A row of signs per n-gram: the product of its letters' vectors, each rolled by its place."""
    out = None
    for place in range(order):
        codes = (grams >> np.uint64(_BITS * place)) & np.uint64((1 << _BITS) - 1)
        different, where = np.unique(codes, return_inverse=True)
        vectors = np.roll(letter_vectors(different, dimensions, seed), place, axis=1)[where]
        out = vectors if out is None else out * vectors
    return out


_LETTER_PAGES: dict[int, np.ndarray] = {}


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters or marks on them."""
    pages = codes >> 8
    out = np.zeros(len(codes), bool)
    for page in np.flatnonzero(np.bincount(pages)):
        if page not in _LETTER_PAGES:
            _LETTER_PAGES[page] = np.array([chr(c).isalpha() for c in range(page << 8, (page + 1) << 8)])
        here = slice(None) if len(pages) and (pages == page).all() else pages == page
        out[here] = _LETTER_PAGES[page][codes[here] & 0xFF]
    return out


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and count of the lower-case letters of each text. Anything between letters counts as one blank,
    and a text begins and ends with one, so every text with a letter has an n-gram. Rows come in order."""
    lowered = [f" {t.lower()} " for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), lengths)
    letter = _letters(codes)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first of a run of others stays, as the blank
    kept[np.cumsum(lengths) - lengths] = True
    codes, row = np.where(letter, codes, 32)[kept].astype(np.uint64), row[kept]
    n = max(0, len(codes) - order + 1)
    packed = np.zeros(n, np.uint64)
    for place in range(order):
        packed |= codes[place : place + n] << np.uint64(_BITS * place)
    whole = row[:n] == row[order - 1 :]
    packed, row = packed[whole], row[:n][whole]
    different, number = np.unique(packed, return_inverse=True)
    pairs, counts = np.unique(row * np.int64(max(1, len(different))) + number, return_counts=True)
    return pairs // max(1, len(different)), different[pairs % max(1, len(different))] if len(different) else packed, counts


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Some texts of a batch at once, and where they begin; null counts as empty."""
    for piece in pieces(texts):
        yield piece.start, [t or "" for t in texts.slice(piece.start, piece.stop - piece.start).to_pylist()]


def bundles(texts: list[str], order: int = ORDER, dimensions: int = DIMENSIONS, seed: int = SEED, block: int = 256) -> np.ndarray:
    """One bundle per text; zero for texts without letters."""
    out = np.zeros((len(texts), dimensions), np.float32)
    row, gram, count = grams(texts, order)
    for low in range(0, len(texts), block):
        s, e = np.searchsorted(row, [low, low + block])
        different, number = np.unique(gram[s:e], return_inverse=True)
        by_gram = np.argsort(number, kind="stable")
        number, who, much = number[by_gram], row[s:e][by_gram] - low, count[s:e][by_gram]
        for first in range(0, len(different), GRAMS):
            a, b = np.searchsorted(number, [first, first + GRAMS])
            counts = np.zeros((min(block, len(texts) - low), min(GRAMS, len(different) - first)), np.float32)
            counts[who[a:b], number[a:b] - first] = much[a:b]
            out[low : low + block] += counts @ gram_vectors(different[first : first + GRAMS], order, dimensions, seed).astype(np.float32)
    return out


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: the checksum of the id's text leaves one when divided by three."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Profiles ``(lang, place, value)`` of all languages, ``dimensions`` rows each, from every labelled text.

    Null languages and null or letterless texts teach nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoded = batch.column("lang").dictionary_encode()
            langs, names = encoded.indices.to_numpy(), encoded.dictionary
            for begin, texts in _pieces(batch.column("text")):
                row, gram, n = grams(texts, order)
                key = langs[begin + row].astype(np.int64)
                together = np.lexsort((gram, key))
                key, gram, n = key[together], gram[together], n[together]
                heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (gram[1:] != gram[:-1])]) if len(key) else np.zeros(0, np.int64)
                sums = np.add.reduceat(n, heads) if len(heads) else n
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(key[heads])), pa.array(gram[heads].view(np.int64)), pa.array(sums.astype(np.int64))], ["lang", "gram", "n"])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            n, gram = batch.column("n").to_numpy(), batch.column("gram").to_numpy().view(np.uint64)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for at in range(0, len(gram), GRAMS):
                vectors = gram_vectors(gram[at : at + GRAMS], order, dimensions, seed).astype(np.int64)
                for name in set(langs[at : at + GRAMS]):
                    here = langs[at : at + GRAMS] == name
                    sums[name] = sums.get(name, 0) + n[at : at + GRAMS][here] @ vectors[here]
            if len(sums) > 256:
                yield flat(sums)
                sums = {}
        if sums:
            yield flat(sums)

    def flat(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(list(sums), object), dimensions), pa.string()),
             pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(sums))), pa.array(np.concatenate(list(sums.values())))], ["lang", "place", "value"])

    known = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(project, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))


def collected(profiles: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Language names and unit profiles on the driver, refused beyond :data:`MOST_LANGUAGES`."""
    profiles = cut_lineage(profiles)
    if profiles.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; is the language column the right one?")
    rows = profiles.toPandas()
    names = sorted(set(rows["lang"]))
    matrix = np.zeros((len(names), dimensions))
    matrix[np.searchsorted(np.array(names, object), rows["lang"]) if names else [], rows["place"].astype(int)] = rows["value"]
    return names, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray, text: str = "text", order: int = ORDER, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """``row`` (all columns of ``docs``), ``lang_pred`` and ``score``, the cosine with its profile (0 at least).

    Null and letterless texts are ``und`` with score zero, and so is every text where nothing was learned. Equal
    cosines go to the first name. Whole texts count; repeated rows are answered alike.
    """
    packed, place = docs.select(F.struct("*").alias("row")), docs.columns.index(text)
    schema = T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    profiles = matrix.astype(np.float32)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for begin, texts in _pieces(batch.column("row").field(place)):
                bundle = bundles(texts, order, dimensions, seed)
                size = np.linalg.norm(bundle, axis=1)
                full = np.flatnonzero(size > 0)
                if len(full) and len(names):
                    cosine = (bundle[full] @ profiles.T) / size[full, None]
                    best[begin + full] = cosine.argmax(axis=1)
                    score[begin + full] = np.clip(cosine.max(axis=1), 0.0, 1.0)
            langs = np.array([*names, UNDETERMINED], object)[best]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(langs, pa.string()), pa.array(score)], schema.names)

    return packed.mapInArrow(answer, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the labelled documents that aren't held out, and answer for all; adds ``held_out`` to
    :func:`predict`'s columns. A null id is not held out."""
    names, matrix = collected(learn(docs.where(~held_out(F.col(doc_id))), text, lang))
    return predict(docs, names, matrix, text).withColumn("held_out", held_out(F.col("row").getField(doc_id)))


def least_scores(judged: DataFrame, share: float = LEAST_SHARE, quantile: float = LEAST_QUANTILE, least_rows: int = LEAST_ROWS) -> tuple[dict[str, float], float]:
    """Least score by language and for languages that are too rare: ``share`` of the low ``quantile`` of the scores
    ``(lang_pred, score)`` of documents that were not learned from and were answered rightly. Fewer than
    ``least_rows`` such documents of a language leave it to those of all, and fewer of all set no bound."""
    rows = judged.rollup("lang_pred").agg(F.count("*").alias("n"), F.percentile_approx("score", quantile, 10000).alias("low")).collect()
    bounds = {r["lang_pred"]: share * r["low"] for r in rows if r["n"] >= least_rows}
    return {k: v for k, v in bounds.items() if k is not None}, bounds.get(None, 0.0)


def keep_identified(
    docs: DataFrame, least_score: float = 0.0, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float | None = None,
) -> DataFrame:
    """``docs`` without those whose language cannot be told, or is told with less than ``least_score``; with a
    ``quantile``, also without those that are further from every profile than held-out documents (:func:`least_scores`).

    The held-out documents that bounds come from are answered twice instead of storing all answers.
    """
    names, matrix = collected(learn(docs.where(~held_out(F.col(doc_id))), text, lang))
    if quantile is None:
        return predict(docs, names, matrix, text).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).select("row.*")
    tried = predict(docs.where(held_out(F.col(doc_id)) & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang")), names, matrix)
    bounds, other = least_scores(tried.where(F.col("row.lang") == F.col("lang_pred")), quantile=quantile)
    least = F.lit(other)
    if bounds:
        least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), F.col("lang_pred")), least)
    return predict(docs, names, matrix, text).where(
        (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= F.greatest(least, F.lit(float(least_score))))).select("row.*")
