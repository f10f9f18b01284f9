import base64
import glob
import hashlib
from collections import Counter

import pytest
from meterloom.llm import warc


def rows():
    big = "é€ \r\n\r\nWARC/1.1\r\n" * 2000
    return [
        (1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://a/9", "same"), (9, "http://a/9", "same"), (9, "http://b/9", "same"),
        (3, None, None), (4, "http://a/\r\nX-Page-Id: 77", ""), (None, "http://a/n", "same"), (None, None, "alone"), (5, "u", big), (6, "v", big), (7, "w", "short"),
    ]


def expected(data, least=0):
    out, groups = [], {}
    for r in data:
        groups.setdefault(r[2] or "", []).append(r)
    for text, group in groups.items():
        payload = text.encode()
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
        for k, r in enumerate(group):
            response = k == 0 or len(payload) < least
            out.append((r[0], len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if response else "revisit", None if response else group[0][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_describe_equals_brute_force(spark, tmp_path, least):
    df = spark.createDataFrame([(*r, "clash", "x") for r in rows()], "page_id long, url string, html string, digest string, payload string")
    warc.write(df, f"{tmp_path}/archive", least_bytes=least)
    number = lambda x: None if x is None else int(x)
    got = [(number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in warc.describe(spark, f"{tmp_path}/archive").collect()]
    assert sorted(got, key=str) == expected(rows(), least)
    assert spark.read.parquet(f"{tmp_path}/archive/payloads").count() == len({r[2] or "" for r in rows()})


def parse(data):
    """Records of a WARC file, by their lengths."""
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        block, data = data[:n], data[n:]
        assert data[:4] == b"\r\n\r\n"
        data = data[4:]
        yield fields, block


def test_files_round_trip(spark, tmp_path):
    data = rows()
    warc.write(spark.createDataFrame(data, "page_id long, url string, html string"), f"{tmp_path}/archive")
    warc.export(spark, f"{tmp_path}/archive", f"{tmp_path}/files")
    found, ids, refers = [], {}, []
    for name in glob.glob(f"{tmp_path}/files/part-*"):
        with open(name, "rb") as file:
            for fields, block in parse(file.read()):
                http, _, payload = block.partition(b"\r\n\r\n")
                assert http.startswith(b"HTTP/1.1 200 OK")
                ids[fields["WARC-Record-ID"]] = payload
                if fields["WARC-Type"] == "response":
                    assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                else:
                    assert payload == b""
                refers.append((fields, payload))
    assert len(ids) == len(data)
    for fields, payload in refers:
        full = ids[fields["WARC-Refers-To"]] if fields["WARC-Type"] == "revisit" else payload
        found.append((fields.get("X-Page-Id"), fields.get("WARC-Target-URI"), full.decode()))
    safe = lambda u: u and u.replace("\r", "%0D").replace("\n", "%0A")
    assert Counter(found) == Counter((None if i is None else str(i), safe(u), t or "") for i, u, t in data)


def test_damage_is_noticed(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), f"{tmp_path}/a")
    spark.read.parquet(f"{tmp_path}/a/payloads").selectExpr("digest", "cast('other' as binary) payload").write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.describe(spark, f"{tmp_path}/b").collect()


def test_records_cut_off_are_noticed(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), f"{tmp_path}/a")
    found = warc.records(spark, f"{tmp_path}/a").selectExpr("substring(record, 1, length(record) - 1) record")
    with pytest.raises(Exception, match="a record is cut off"):
        warc.parsed(found).collect()


def test_ids_with_line_breaks(spark, tmp_path):
    data = [("a\r\nX-Page-Id: b", "u\nv", "t"), ("50%0A", "u", "t"), ("%", "w", "other"), ("", None, "x")]
    warc.write(spark.createDataFrame(data, "page_id string, url string, html string"), f"{tmp_path}/a")
    got = {r.page_id: r for r in warc.describe(spark, f"{tmp_path}/a").collect()}
    assert set(got) == {d[0] for d in data}
    assert got["50%0A"].refers_to == "a\r\nX-Page-Id: b" and got["a\r\nX-Page-Id: b"].record_type == "response"


def test_hot_keys_meet_by_broadcast(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 50 + list("abcde") + [None])], "k string, i int")
    right = spark.createDataFrame([(k, k.upper()) for k in ("hot", "a", "b", "z")], "k string, v string")
    got = sorted(tuple(r) for r in warc.join_one(left, right, "k", hot_rows=10).collect())
    assert got == sorted([("hot", i, "HOT") for i in range(50)] + [("a", 50, "A"), ("b", 51, "B")])
    assert warc.join_one(left.where("false"), right, "k").count() == 0


def test_payloads_that_look_like_records(spark, tmp_path):
    data = [(1, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n"), (2, "v", "\r\n\r\n"), (3, "w", "é" * 10 + "\r\n\r\n")]
    warc.write(spark.createDataFrame(data, "page_id long, url string, html string"), f"{tmp_path}/a")
    got = {r.page_id: bytes(r.payload) for r in warc.parsed(warc.records(spark, f"{tmp_path}/a")).collect()}
    assert got == {str(i): t.encode() for i, _, t in data}


def test_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/a")
    assert warc.describe(spark, f"{tmp_path}/a").collect() == [] and warc.records(spark, f"{tmp_path}/a").collect() == []
