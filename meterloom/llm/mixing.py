"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; each of its documents is expected ``target / size`` times. Documents
are put in order of size, their expected copies are summed up, one random offset per source is added, and a
document is emitted once for each integer that the running sum crosses. Order by size makes the words that are
taken follow the target closely, since neighbours are nearly interchangeable.

The running sum is a position times a constant, so only positions are needed. They are found without a window
over a source: rows are range-partitioned by (source, size, hash), which cuts a hot source into many parts, each
part numbers its own rows, and the small table of rows per part and source gives every part the number at which
it begins. Texts never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_COPIES = 2
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text) -> F.Column:
    """Words of a text, zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset_of(source, seed: int = SEED) -> F.Column:
    """Random offset of a source in [0, 1), the same in every run; SQL engines with MD5 can repeat it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES) -> DataFrame:
    """For a table ``(source, source_size)`` with one row per source, add ``weight`` and ``target``.

    Sources by code point, null last, take the weights in turn. Targets are ``level * weight`` but at most
    ``most_copies`` times the size, with the level at which they add up to ``share_percent`` of all sizes: what
    a full source cannot take is shared by the others by weight, again and again. Sums stay whole numbers until
    the last division, so targets don't depend on the order of rows.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    full = F.col("source_size") * most_copies
    order = Window.orderBy(full / F.col("weight"), F.col("source").isNull(), "source")
    table = sizes.withColumn("weight", weight)
    table = table.withColumn("_taken", F.coalesce(F.sum(full).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    table = table.withColumn("_open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.partitionBy()
    table = table.withColumn("_all", F.sum("source_size").over(everything))
    level = (F.col("_all") * (share_percent / 100.0) - F.col("_taken")) / F.col("_open")
    # The first source, by fullness, that its level doesn't fill sets the level of itself and all that follow.
    table = table.withColumn("_level", F.min(F.when(level * F.col("weight") <= full, F.struct("_taken", level.alias("level")))).over(everything)["level"])
    target = F.least(full.cast("double"), F.coalesce(F.col("_level") * F.col("weight"), full.cast("double")))
    return table.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES, seed: int = SEED, carry: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``copies`` is at most ``most_copies``; ``taken`` is ``copies * size``. With ``carry`` each row also has ``row``,
    all columns of ``docs`` (texts then move through the sort). Null and blank texts have size zero and take
    nothing; a null source is a source of its own; null and repeated ids are kept, each row by itself, and equal
    rows are interchangeable. Empty tables give no rows.
    """
    named = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"),
        *([F.struct("*").alias("row")] if carry else []))
    if not carry:
        named = cut_lineage(named)  # range partitioning reads its input twice
    named = named.withColumn("mark", F.xxhash64("row") if carry else F.lit(0))
    named = named.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    order = ["source", "size", "turn", "doc_id", "mark"]
    placed = named.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "mark")
    # The id counts the rows of a sorted part in its lower 33 bits and the parts in those above.
    numbered = placed.withColumn("id", F.monotonically_increasing_id())
    part, index = F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("index")
    stored = cut_lineage(numbered).select("*", part, index)
    parts = stored.groupBy("source", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("words"), F.min("index").alias("first"))
    parts = cut_lineage(parts.withColumn("before", F.coalesce(
        F.sum("rows").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    goals = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share_percent, most_copies)
    goals = goals.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goals = goals.withColumn("offset", offset_of(F.col("source"), seed))
    begin = parts.alias("p").join(goals.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select(
        F.col("p.source").alias("of"), F.col("part").alias("in"), (F.col("before") - F.col("first")).alias("shift"), "source_size", "target", "rate", "offset")
    joined = stored.join(cut_lineage(begin), F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    position = F.col("shift") + F.col("index")
    crossed = F.floor((position + 1) * F.col("rate") + F.col("offset")) - F.floor(position * F.col("rate") + F.col("offset"))
    return joined.withColumn("copies", F.when(F.col("size") > 0, crossed).otherwise(0).cast("long")).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        *(["row"] if carry else []))


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it."""
    mixed = mix(docs, carry=True, **options)
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
