"""Fill-in-middle transformation by repeated-capture matching.

The regex library keeps every repetition of a captured group. One ``fullmatch`` of ``(unit)*`` over a text therefore
holds the end of each unit: ``match.ends(1)`` gives the number of units and, looked up at two drawn counts, both cut
offsets. Python sees the texts and two draws a row and returns three numbers a row; outputs are built and taken
apart again by column expressions.

A match keeps about 110 bytes per unit, so a text longer than ``WINDOW`` code points is matched window by window:
each window starts where the last whole unit ended, so the units found are those of one match over the whole text.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One code point, line breaks included.
UNIT = r"(?s:.)"
WINDOW = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90
SPM_BELOW = 20


def ends(unit: regex.Pattern, text: str, window: int = WINDOW) -> tuple[int, list[tuple[int, int, int]]]:
    """Number of units in ``text`` and, per window, (units before it, its first and its last position).

    ``unit`` is the compiled pattern ``(unit)*``. No units at all if the text is not a run of whole units.
    """
    if len(text) <= window:
        match = unit.fullmatch(text)
        return (len(match.ends(1)), [(0, 0, len(text))]) if match else (0, [])
    at, count, parts = 0, 0, []
    while at < len(text):
        stop = min(len(text), at + window)
        while True:
            match = unit.match(text, at, stop)
            found = match.ends(1) if match else []
            # The last unit of a window that ends inside the text may go on behind it.
            if stop < len(text):
                found = found[:-1]
            if found or stop == len(text):
                break
            stop = min(len(text), at + 2 * (stop - at))
        if not found or stop == len(text) and found[-1] != stop:
            return 0, []
        parts.append((count, at, found[-1]))
        count, at = count + len(found), found[-1]
    return count, parts


def offset(unit: regex.Pattern, text: str, parts: list[tuple[int, int, int]], units: int) -> int:
    """Where the first ``units`` units of a text end."""
    if units == 0:
        return 0
    before, start, stop = parts[bisect_right([p[0] for p in parts], units - 1) - 1]
    return unit.fullmatch(text, start, stop).ends(1)[units - before - 1]


def cut(unit: regex.Pattern, text: str, first: int, second: int, window: int = WINDOW) -> tuple[int, int, int]:
    """Number of units n, and the two offsets behind ``first % (n + 1)`` and ``second % (n + 1)`` units, in order."""
    if len(text) <= window:
        match = unit.fullmatch(text)
        places = match.ends(1) if match else []
        low, high = sorted((first % (len(places) + 1), second % (len(places) + 1)))
        return len(places), places[low - 1] if low else 0, places[high - 1] if high else 0
    count, parts = ends(unit, text, window)
    low, high = sorted((first % (count + 1), second % (count + 1)))
    return count, offset(unit, text, parts, low), offset(unit, text, parts, high)


def draw(doc_id: Column, place: int, seed: int = 1) -> Column:
    """The ``place``-th (from 1) 32-bit number of a document: eight digits of the SHA-256 of seed and id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digits, 8 * place - 7, 8), 16, 10).cast("long")


def _cuts(pattern: str, window: int):
    @F.arrow_udf("struct<n: bigint, first: bigint, second: bigint>")
    def cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        unit = regex.compile(f"({pattern})*")
        rows = [cut(unit, t.as_py(), a, b, window) for t, a, b in zip(texts, first.to_pylist(), second.to_pylist(), strict=True)]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "first", "second"])

    return cuts


def transform(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = UNIT, seed: int = 1,
    plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, window: int = WINDOW,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (all its columns), ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    ``n`` counts the units of the whole text, matched from the left. Prefix and middle end behind the smaller and the
    larger of two drawn numbers of units. ``form`` is ``plain`` (output is the text, lengths are null) if the text is
    empty, holds one of the three marks, is no run of whole units (then n is 0), or by the third draw; else ``spm`` or
    ``psm`` by the fourth. Null texts count as empty; a null id draws like an empty one; equal ids draw alike, so
    repeated rows come out alike; empty tables give no rows.
    """
    id_, body = F.col(f"row.`{doc_id}`"), F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    found = docs.select(F.struct("*").alias("row")).select("row", body.alias("body"))
    found = found.withColumn("cuts", _cuts(unit, window)("body", draw(id_, 1, seed), draw(id_, 2, seed)))
    body, first, second = F.col("body"), F.col("cuts.first").cast("int"), F.col("cuts.second").cast("int")
    marked = body.contains(PREFIX) | body.contains(SUFFIX) | body.contains(MIDDLE)
    plain = (F.col("cuts.n") == 0) | marked | (draw(id_, 3, seed) % 100 >= plain_from)
    form = F.when(plain, "plain").when(draw(id_, 4, seed) % 100 < spm_below, "spm").otherwise("psm")
    found = found.withColumn("form", form)
    prefix, middle, suffix = F.substring(body, F.lit(1), first), F.substring(body, first + 1, second - first), F.substring(body, second + 1, F.length(body))
    output = F.when(F.col("form") == "plain", body).when(
        F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    ).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut_ = F.col("form") != "plain"
    return found.select(
        "row", F.col("cuts.n").alias("n"), "form", F.when(cut_, F.col("cuts.first")).alias("prefix_chars"),
        F.when(cut_, F.col("cuts.second") - F.col("cuts.first")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. Marks start with ``<`` and end with ``>`` and stand nowhere else in it."""
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    middle = F.substring_index(output, MIDDLE, -1)
    front = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(body, SUFFIX, 1), middle, F.substring_index(front, SUFFIX, -1))
    spm = F.concat(F.substring_index(front, PREFIX, -1), middle, F.substring_index(body, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
