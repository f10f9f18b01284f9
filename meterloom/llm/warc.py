"""Content-addressed web archive.

A page becomes a WARC record, but the archive keeps it in two tables: ``payloads`` holds each different payload
once under its SHA-256, ``headers`` holds the exact bytes of every record's headers with the digest they belong
to. A join on the digest gives the records back byte for byte, or as ``.warc`` files. Every payload is checked
against its digest when it is read.

Pages are reduced to digests before anything is grouped; payload bytes are shuffled twice, after equal ones of a
task have been merged: once to find equal ones, once to meet the header of their response again. A payload that a
third of all pages share costs as little as any other, and rows that share it meet it by a broadcast of hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A revisit record needs a payload of this many bytes.
LEAST_BYTES = 0
#: Records carry one fixed capture date, so that reruns write the same bytes.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A key is hot with more than this many rows, and than one in so many of all rows; so there are fewer hot ones than that.
HOT_ROWS = 10_000
MOST_HOT = 1_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a binary column's SHA-1: eight times twenty bits are four letters each."""
    digits = F.sha1(payload)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def _uuid(*parts: Column) -> Column:
    """Record id from the record's content, the same in every run."""
    digits = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]).cast("binary"))
    cuts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _one_line(value: Column) -> Column:
    """Text that cannot end a header line."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _escaped(value: Column) -> Column:
    """Text of an id as one line; :func:`_plain` gives it back."""
    return _one_line(F.replace(value.cast("string"), F.lit("%"), F.lit("%25")))


def _plain(value: Column) -> Column:
    for code, sign in (("%0A", "\n"), ("%0D", "\r"), ("%25", "%")):
        value = F.replace(value, F.lit(code), F.lit(sign))
    return value


def join_one(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS, most_hot: int = MOST_HOT) -> DataFrame:
    """Inner join with a table of one row per key, where one key may hold a third of ``left`` (a stored table).

    Rows of hot keys meet their row of ``right`` by a broadcast of fewer than ``most_hot`` rows; only the others are
    shuffled.
    """
    counts = cut_lineage(left.groupBy(key).agg(F.count("*").alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = cut_lineage(right.join(counts.where(F.col("_n") > max(hot_rows, total // most_hot)).select(key), key))
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key)
    return left.join(F.broadcast(hot), key).unionByName(cold)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Archive every row of ``pages`` below ``path``.

    The payload is the text in UTF-8, or the bytes of a binary column; null counts as empty. Of records with equal
    payloads of at least ``least_bytes`` bytes the one with the largest id (null is smallest, then the largest url)
    is a response and the others revisit it; of equal rows exactly one is the response. Null ids and urls are left
    out of the headers. Line breaks in urls and ids are percent-encoded; those of ids are decoded on reading. Empty tables
    give an empty archive.
    """
    content = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    named = pages.select(F.col(page_id).alias("id"), _one_line(F.col(url)).alias("url"), content.alias("payload"))
    digested = named.select("id", "url", "payload", F.sha2("payload", 256).alias("digest"))
    digested.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    rows = cut_lineage(digested.select("id", "url", "digest", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")))
    # Equal rows are one row with a number of copies, so nothing below has to order them.
    rows = rows.groupBy("id", "url", "digest", "sha1", "bytes").agg(F.count("*").alias("copies"))
    best = cut_lineage(rows.groupBy("digest").agg(F.max(F.struct("id", "url")).alias("best")))
    rows = join_one(cut_lineage(rows), best, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    first = F.col("id").eqNullSafe(F.col("best.id")) & F.col("url").eqNullSafe(F.col("best.url")) & (F.col("copy") == 1)
    rows = rows.withColumn("response", first | (F.col("bytes") < least_bytes))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("bytes").cast("string"), F.lit(_END * 2))
    rows = rows.withColumn("http", http)
    on_revisit = lambda value: F.when(~F.col("response"), value)
    length = F.octet_length("http") + F.when(F.col("response"), F.col("bytes")).otherwise(0)
    header = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _line("WARC-Type", F.when(F.col("response"), "response").otherwise("revisit")),
        _line("WARC-Record-ID", _uuid(F.col("id"), F.col("url"), F.col("digest"), F.col("copy"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Profile", on_revisit(F.lit(PROFILE))),
        _line("WARC-Refers-To", on_revisit(_uuid(F.col("best.id"), F.col("best.url"), F.col("digest"), F.lit(1)))),
        _line("WARC-Refers-To-Target-URI", on_revisit(F.col("best.url"))),
        _line("X-Page-Id", _escaped(F.col("id"))),
        _line("X-Refers-To-Page-Id", on_revisit(_escaped(F.col("best.id")))),
        F.lit(f"Content-Type: application/http;msgtype=response{_END}Content-Length: "), length.cast("string"), F.lit(_END * 2))
    rows.select("digest", header.cast("binary").alias("header"), F.col("http").cast("binary").alias("http")).write.parquet(f"{path}/headers")


def _field(name: str, header: str = "header") -> Column:
    """Value of a header line, null if the record has none."""
    text = F.col(header).cast("string")
    return F.when(F.contains(text, F.lit(f"{_END}{name}: ")), F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1))


def _checked(spark: SparkSession, path: str) -> DataFrame:
    """Payloads whose bytes still have their digest; a damaged one ends the job."""
    stored = spark.read.parquet(f"{path}/payloads")
    intact = F.sha2("payload", 256) == F.col("digest")
    fail = F.raise_error(F.concat(F.lit("payload does not match its digest "), "digest"))
    return stored.select("digest", F.when(intact, F.col("payload")).otherwise(fail.cast("binary")).alias("payload"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: ``page_id`` (text), ``url``, ``record_type``, ``refers_to`` (text) and ``record``, all bytes
    of the record but its closing line breaks. A revisit has no payload of its own, so only responses are joined."""
    headers = spark.read.parquet(f"{path}/headers")
    is_response = _field("WARC-Type") == "response"
    full = headers.where(is_response).join(_checked(spark, path), "digest").select("header", F.concat("header", "http", "payload").alias("record"))
    rebuilt = full.unionByName(headers.where(~is_response).select("header", F.concat("header", "http").alias("record")))
    return rebuilt.select(
        _plain(_field("X-Page-Id")).alias("page_id"), _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("record_type"),
        _plain(_field("X-Refers-To-Page-Id")).alias("refers_to"), "record")


def export(spark: SparkSession, path: str, to: str) -> None:
    """Write the records as WARC files (texts in UTF-8) into the folder ``to``, one per task."""
    records(spark, path).select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END * 2).text(to)


def parsed(found: DataFrame) -> DataFrame:
    """What the bytes of a column ``record`` say, next to all columns: ``record_id``, ``target_id``, ``said`` (its payload
    digest), and ``payload``. A record whose block has another length than its header says ends the job."""
    def head(of: str) -> Column:
        return F.concat(F.substring_index(F.col(of).cast("string"), _END * 2, 1), F.lit(_END * 2))

    rest = lambda of, part: F.substring(F.col(of), F.octet_length(part) + 1, F.octet_length(of))
    cut = found.withColumn("head", head("record")).withColumn("block", rest("record", F.col("head")))
    whole = F.octet_length("block") == _field("Content-Length", "head").cast("long")
    fail = F.raise_error(F.concat(F.lit("a record is cut off: "), "head")).cast("binary")
    return cut.withColumn("block", F.when(whole, F.col("block")).otherwise(fail)).select(
        *found.columns, _field("WARC-Record-ID", "head").alias("record_id"), _field("WARC-Refers-To", "head").alias("target_id"),
        _field("WARC-Payload-Digest", "head").alias("said"), rest("block", head("block")).alias("payload"))


def describe(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the archive: ``page_id``, ``refers_to`` (both as text), ``record_type``, ``payload_bytes`` and
    ``payload_digest`` (base32 SHA-1), all from the rebuilt records.

    Payloads of responses are cut out of their bytes; a revisit takes those of the response that it refers to. Digests
    that a record names are compared with its payload's; one that differs ends the job.
    """
    read = parsed(records(spark, path))
    short = cut_lineage(read.select(
        "page_id", "record_type", "refers_to", "record_id", "target_id", "said",
        F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1")))
    responses = short.where("record_type = 'response'")
    own = responses.select("page_id", "record_type", "refers_to", "said", "bytes", "sha1")
    meant = responses.select(F.col("record_id").alias("target_id"), "bytes", "sha1")
    others = join_one(short.where("record_type = 'revisit'").drop("bytes", "sha1", "record_id"), meant, "target_id")
    agrees = F.col("said") == F.concat(F.lit("sha1:"), "sha1")
    fail = F.raise_error(F.concat(F.lit("record and payload disagree on "), "said")).cast("string")
    return own.unionByName(others.select(own.columns)).select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.when(agrees, F.col("sha1")).otherwise(fail).alias("payload_digest"),
        "record_type", "refers_to")
