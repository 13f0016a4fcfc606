"""Round trip, push-down and skipped decoding."""

import base64
import gzip
import hashlib
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith
from pyspark.sql.types import StringType, StructField, StructType

from gleanery.llm import warc

BIG = "<html>" + "é" * 60 + "</html>"
ROWS = [(1, "http://a/x y\r\nEvil: 1", BIG), (2, None, BIG), (3, "http://b/", BIG + "z"), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", BIG), (2, None, BIG), (0, "u", "x" * 3_000_000)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark, tmp_path):
    warc.archive(pages(spark), f"{tmp_path}/w")
    got = warc.read_warc(spark, f"{tmp_path}/w", verify=True).collect()
    assert len(got) == len(ROWS)
    for i, _, html in ROWS:
        if i is None:
            continue
        mine = [r for r in got if r.record_id == f"urn:page:{i}"]
        body = (html or "").encode()
        for r in mine:
            assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
            if html == BIG and i > 1:
                assert (r.record_type, r.refers_to, r.payload) == ("revisit", "urn:page:1", None)
            else:
                assert (r.record_type, r.refers_to, r.payload) == ("response", None, body)
    assert sum(r.record_type == "revisit" for r in got) == 2
    assert len([r for r in got if r.record_id.startswith("urn:page:") and r.record_id[9:].isdigit()]) == len(ROWS) - 1


def test_predicates_reach_the_reader(spark, tmp_path):
    warc.archive(pages(spark), f"{tmp_path}/w")
    df = warc.read_warc(spark, f"{tmp_path}/w")
    assert df.where("record_type = 'revisit'").count() == 2
    assert df.where(F.col("target_uri").startswith("http://b")).select("record_id").collect()[0].record_id == "urn:page:3"
    reader = warc.WarcReader(f"{tmp_path}/w", StructType([StructField("record_id", StringType())]), False)
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringStartsWith(("record_id",), "urn:"), EqualTo(("payload_bytes",), 3)]))
    assert len(left) == 1 and len(reader.wanted) == 2


def test_unwanted_payloads_are_not_decoded(spark, tmp_path, monkeypatch):
    warc.archive(pages(spark), f"{tmp_path}/w")
    decoded = []
    monkeypatch.setattr(warc, "_bodies", lambda block, http: decoded.append(1) or [b""])
    schema = StructType([StructField("record_id", StringType()), StructField("record_type", StringType())])
    reader = warc.WarcReader(f"{tmp_path}/w", schema, False)
    rows = pa.Table.from_batches([b for p in reader.partitions() for b in reader.read(p)])
    assert rows.num_rows == len(ROWS) and decoded == []


def test_only_the_manifest_counts_and_empty(spark, tmp_path):
    warc.archive(pages(spark), f"{tmp_path}/w")
    (tmp_path / "w" / "part-left-behind.warc").write_bytes(warc.encode({"record_type": "response", "record_id": "urn:x", "target_uri": None, "payload_digest": "", "payload_bytes": 0, "payload": b"", "refers_to": None}))
    assert warc.read_warc(spark, f"{tmp_path}/w", "record_id string").count() == len(ROWS)
    warc.archive(pages(spark, []), f"{tmp_path}/e")
    assert warc.read_warc(spark, f"{tmp_path}/e").count() == 0


def foreign(kind, block, *headers, content="application/http;msgtype=response"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{kind}:{len(block)}>", *headers, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_makers(spark, tmp_path):
    """Members of a .warc.gz, chunked and compressed bodies, SHA-1 in base 32, no digest at all, folded headers, records without HTTP."""
    page = b"<html>" + b"x" * 300 + b"</html>"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
    packed = gzip.compress(page)
    chunked = b"".join(b"%x;note\r\n%s\r\n" % (len(c), c) for c in (packed[:20], packed[20:])) + b"0\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(chunked).digest()).decode()
    raw = zlib.compressobj(wbits=-15)
    records = [
        foreign("warcinfo", b"software: other\r\n", content="application/warc-fields"),
        foreign("response", head + b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked, f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Target-URI: http://a/", " folded"),
        foreign("response", head + b"Content-Encoding: deflate\r\n\r\n" + raw.compress(page) + raw.flush(), "WARC-Target-URI: http://b/"),
        foreign("response", head + b"Content-Encoding: gzip\r\n\r\nnot gzip", "WARC-Target-URI: http://c/"),
        foreign("resource", page, "WARC-Target-URI: http://d/", content="text/html"),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[:3]))
    (tmp_path / "w" / "two.warc").write_bytes(b"".join(records[3:]))
    rows = {r.target_uri: r for r in warc.read_warc(spark, f"{tmp_path}/w", verify=True).collect()}
    assert len(rows) == 5 and rows[None].record_type == "warcinfo"
    digest = hashlib.sha256(page).hexdigest()
    for uri in ("http://a/ folded", "http://b/", "http://d/"):
        assert (bytes(rows[uri].payload), rows[uri].payload_digest, rows[uri].payload_bytes) == (page, digest, len(page))
    assert bytes(rows["http://c/"].payload) == b"not gzip"
    df = warc.read_warc(spark, f"{tmp_path}/w")
    assert df.where(F.col("payload_digest") == digest).count() == 3  # known only from the payloads
    assert df.where("payload_bytes = 8").select("target_uri").first().target_uri == "http://c/"


def test_a_wrong_digest_is_found(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(foreign("response", b"HTTP/1.1 200 OK\r\n\r\nbody", "WARC-Payload-Digest: sha1:" + "A" * 32))
    assert warc.read_warc(spark, f"{tmp_path}/w").count() == 1
    with pytest.raises(Exception, match="has not the digest"):
        warc.read_warc(spark, f"{tmp_path}/w", verify=True).collect()


def test_many_repeated_digests(spark, tmp_path, monkeypatch):
    """Repeated digests too many to broadcast are joined, with the same records."""
    rows = lambda: sorted(map(str, warc.page_records(pages(spark)).where("record_id NOT LIKE '%-%'").collect()))
    few = rows()
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    assert rows() == few
