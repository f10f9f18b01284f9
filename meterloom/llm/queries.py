"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from . import (
    cotraining, decontamination, extraction, infill, language, licenses, mixing, packing, repetition, simhash, urls, warc, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query()
def op1_cotraining_quality(spark: SparkSession, folder: str) -> DataFrame:
    return cotraining.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    """The scan in SQL, with documents and known texts made canonical side by side."""
    form = f"translate(text, '{licenses._UPPER}', '{licenses._LOWER}')"
    form = f"regexp_replace({form}, {_quoted('(?m)' + licenses.HELD_LINE)}, '\\1{licenses._HELD}\\2', 'g')"
    form = f"replace(regexp_replace({form}, {_quoted('(?m)' + licenses.COPYRIGHT_LINE)}, '', 'g'), '{licenses._HELD}', '')"
    form = f"regexp_replace({form}, {_quoted('(?m)' + licenses.LIST_MARK)}, '\\1\\2 \\3', 'g')"
    form = f"'  ' || regexp_replace({form}, '[^\\p{{L}}\\p{{N}}\\n]+', '  ', 'g') || '  '"
    form = f"replace({form}, chr(10), '  ' || chr(10) || '  ')"
    for old, new in licenses.SPELLINGS.items():
        form = f"replace({form}, ' {old} ', ' {new} ')"
    known = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, texts in licenses.KNOWN.items() for text in texts)
    long = ", ".join(f"({_quoted(name)}, {_quoted(d)})" for name, ds in licenses.LONG_DIGESTS.items() for d in ds)
    joined = lambda c: f"regexp_replace(trim(regexp_replace({c}, '[ \\n]+', ' ', 'g')), '{licenses.NAME_SLOT}', '{licenses.NAME_FREE}', 'g')"
    return f"""
        WITH k AS (SELECT license, {form} AS lines FROM (VALUES {known}) v(license, text)),
        t AS (SELECT min(license) AS license, digest FROM (SELECT license, sha256({joined("lines")}) AS digest FROM k UNION ALL VALUES {long}) GROUP BY 2),
        d AS (SELECT doc_id, row_number() OVER () AS n, {form} AS lines FROM documents),
        w AS (SELECT doc_id, n, lines, CASE WHEN {joined("lines")} <> '' THEN sha256({joined("lines")}) END AS text_digest FROM d),
        l AS (SELECT n, sha256({joined("line")}) AS digest FROM (SELECT n, unnest(string_split(lines, chr(10))) AS line FROM w)),
        f AS (SELECT n, list_sort(list(DISTINCT license)) AS found FROM l JOIN t USING (digest) GROUP BY n)
        SELECT doc_id, text_digest, t.license AS license, coalesce(array_to_string(found, ','), '') AS line_licenses
        FROM w LEFT JOIN t ON t.digest = text_digest LEFT JOIN f USING (n)
    """


@_query(_license_sql())
def op2_license_digests(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(_table(spark, folder, "documents"), licenses.known_digests(spark))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


@_query()
def op3_simhash_bktree(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


@_query()
def op4_tag_path_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = extraction.extract(_table(spark, folder, "pages"))
    return found.select("row.page_id", "row.url", "text", "n_chars")


@_query()
def op5_spaced_seed_leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.leaks(docs, _table(spark, folder, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("long"))))
    return found.select(
        "row.doc_id", (F.size("hits") > 0).alias("contaminated"), items.alias("item_ids"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["words"])), F.lit(0)).alias("longest_overlap"))


@_query("""
    WITH d AS (
        SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
        FROM documents
    ), s AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
    ), w AS (
        SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INTEGER) + 1] AS weight FROM s
    ), o AS (
        SELECT *, CAST(coalesce(sum(2 * source_size) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source IS NULL, source
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS taken,
               CAST(sum(weight) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source IS NULL, source
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open,
               CAST(sum(source_size) OVER () AS DOUBLE) AS everything
        FROM w
    ), l AS (
        SELECT *, (everything * CAST(1.5 AS DOUBLE) - taken) / open AS level FROM o
    ), g AS (
        SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE),
                   coalesce((SELECT arg_min(level, taken) FROM l WHERE level * weight <= 2 * source_size) * weight,
                            CAST(2 * source_size AS DOUBLE))) AS target,
               CAST(CAST('0x' || substr(md5('42:' || coalesce('s' || source, 'n')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS start
        FROM l
    ), p AS (
        SELECT d.doc_id, d.size, g.source_size, g.target, g.start,
               CASE WHEN g.source_size > 0 THEN g.target / CAST(g.source_size AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rate,
               row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id NULLS FIRST) - 1 AS place
        FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
    )
    SELECT doc_id, size, source_size, target,
           CAST(CASE WHEN size > 0 THEN floor((place + 1) * rate + start) - floor(place * rate + start) ELSE 0 END AS BIGINT) * size AS taken
    FROM p
""")
def op6_systematic_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query()
def op7_hyperdimensional_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select("row.doc_id", "held_out", "lang_pred", "score")


@_query("""
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
    ), o AS (
        SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY html) AS best
        FROM p
    )
    SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
           array_to_string(flatten(list_transform(range(0, 8), lambda g: list_transform([32768, 1024, 32, 1], lambda unit:
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST('0x' || substr(hex, CAST(5 * g + 1 AS INTEGER), 5) AS INTEGER) // unit % 32 + 1 AS INTEGER), 1)))), '') AS payload_digest,
           CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN place > 1 THEN best END AS refers_to
    FROM o
""")
def op8_content_addressed_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "archive")
    warc.write(_table(spark, folder, "pages"), path)
    found = warc.describe(spark, path)
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@_query()
def op9_suffix_array_repetition(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return repetition.quality(docs).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "longest_repeat", "n_maximal_repeats")


@_query()
def op10_segmented_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"))


@_query()
def op11_feast_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(_table(spark, folder, "embeddings").select("vec_id", "embedding"))
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "part")
    found = found.select("row.vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", parts)
    return found.select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("part.whitened").alias("whitened"),
        F.col("part.explained").alias("explained"), "identity_error")


def _digits(place: int) -> str:
    return f"CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * place - 7}, 8) AS BIGINT)"


@_query(f"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
               {_digits(1)} AS h1, {_digits(2)} AS h2, {_digits(3)} AS h3, {_digits(4)} AS h4
        FROM documents
    ), c AS (
        SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM d
    ), p AS (
        SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p
""")
def op12_repeated_capture_infill(spark: SparkSession, folder: str) -> DataFrame:
    found = infill.transform(_table(spark, folder, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


@_query()
def op13_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    found = packing.pack(packing.tokenised(_table(spark, folder, "documents")))
    return found.select("row.doc_id", "row.piece", "row.start", "row.length", "row.ids_crc32", "sequence_id", "offset")
