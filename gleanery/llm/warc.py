"""WARC archives as a PySpark data source, and duplicate payloads as revisits.

The reader plans one partition for each archive (small ones together), takes
predicates on header columns from Spark, parses a record's headers first and
seeks past the payload of a record that is not wanted. Payloads are decoded
only if the asked schema has ``payload``, ``verify`` is set, or a digest or
length is asked for that the headers do not tell. Archives of other makers are
read, too: ``.warc`` and ``.warc.gz``, chunked and compressed bodies, digests of
any usual kind. The writer gives each task files of its own and lists the finished ones in a manifest,
so what a lost executor left behind is never read.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from gleanery.session import cut, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
MANIFEST = "_manifest.json"
#: Bytes after which a task opens its next archive; bytes of archives read as one partition.
ROLL_BYTES, GROUP_BYTES = 64 << 20, 16 << 20
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from this size on may be revisits.
MIN_BYTES = 100
#: Repeated digests up to which they are broadcast (some 100 bytes each).
BROADCAST_DIGESTS = 200_000


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def encode(record: dict) -> bytes:
    """One record. A revisit carries headers only."""
    lines = ["WARC/1.1", f"WARC-Type: {record['record_type']}", f"WARC-Record-ID: <{record['record_id']}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if record["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {quote(record['target_uri'], safe=''.join(chr(c) for c in range(33, 127)))}")
    lines.append(f"WARC-Payload-Digest: sha256:{record['payload_digest']}")
    lines.append(f"X-Payload-Length: {record['payload_bytes']}")
    block = b""
    if record["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: <{record['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    else:
        body = gzip.compress(record["payload"] or b"", 1, mtime=0)
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
        lines.append("Content-Type: application/http;msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(stream) -> dict[str, str] | None:
    """Headers of the next record; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found, name = {}, ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:  # a folded line
            found[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        found[name] = value.strip()
    return found


def _unchunked(body: bytes) -> bytes:
    """A chunked body put together; what follows a broken chunk is taken as it stands."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].partition(b";")[0], 16)
        except ValueError:
            break
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join([*parts, body[at:]])


def _bodies(block: bytes, http: bool) -> list[bytes]:
    """The payload of a block, then as it was before decoding: digests of archives are of one of these.

    A content coding that is unknown or broken is left on.
    """
    if not http:
        return [block]
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, _, body = block.partition(b"\n\n")
    fields = dict((k.strip().lower(), v.strip().lower()) for k, _, v in (line.partition(b":") for line in head.splitlines()[1:]))
    found = [body]
    if b"chunked" in fields.get(b"transfer-encoding", b""):
        found.append(_unchunked(body))
    for coding in reversed(fields.get(b"content-encoding", b"").replace(b" ", b"").split(b",")):
        try:
            if coding in (b"gzip", b"x-gzip"):
                found.append(gzip.decompress(found[-1]))
            elif coding == b"deflate":
                found.append(zlib.decompressobj(zlib.MAX_WBITS if found[-1][:1] == b"x" else -zlib.MAX_WBITS).decompress(found[-1]))
        except (OSError, EOFError, zlib.error):
            break
    return found[::-1]


def _digest(header: str | None) -> tuple[str, bytes] | None:
    """(algorithm, bytes) of a digest in hexadecimal or base 32; None for others."""
    kind, _, text = (header or "").rpartition(":")
    kind = kind.strip().lower().replace("-", "") or "sha256"
    if kind not in hashlib.algorithms_guaranteed or kind.startswith("shake"):
        return None
    size = hashlib.new(kind).digest_size
    for decode in (bytes.fromhex, lambda t: base64.b32decode(t.upper() + "=" * (-len(t) % 8))):
        try:
            if len(raw := decode(text.strip())) == size:
                return kind, raw
        except (ValueError, binascii.Error):
            pass
    return None


def _matches(row: dict, wanted: list) -> bool:
    for f in wanted:
        if f.attribute[0] not in row:  # not known yet
            continue
        value = row[f.attribute[0]]
        if isinstance(f, IsNotNull):
            ok = value is not None
        elif value is None:
            ok = False
        elif isinstance(f, EqualTo):
            ok = value == f.value
        elif isinstance(f, In):
            ok = value in f.value
        else:
            ok = value.startswith(f.value)
        if not ok:
            return False
    return True


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, verify: bool):
        self.path, self.columns, self.verify = path, schema.fieldNames(), verify
        self.arrow = pa.schema([(f.name, pa.int64() if f.name == "payload_bytes" else pa.binary() if f.name == "payload" else pa.string()) for f in schema.fields])
        self.wanted: list = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and f.attribute[0] not in ("payload", "payload_bytes") and len(f.attribute) == 1:
                self.wanted.append(f)
            else:
                yield f

    def partitions(self):
        system, path = _at(self.path)
        try:
            with system.open_input_stream(f"{path}/{MANIFEST}") as f:
                files = json.loads(f.read())
        except FileNotFoundError:
            found = system.get_file_info(fs.FileSelector(path))
            files = [[f.base_name, f.size] for f in found if f.base_name.endswith((".warc", ".warc.gz"))]
        groups, size = [[]], 0
        for name, n in sorted(files):
            if groups[-1] and size + n > GROUP_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(f"{path}/{name}")
            size += n
        return [_Files(g) for g in groups if g] or [_Files([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        system, _ = _at(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 20) as stream:
                while (head := _headers(stream)) is not None:
                    row, read = self._record(stream, head)
                    if row:
                        rows.append(row)
                        size += read
                    if len(rows) >= 2000 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, self.arrow)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, self.arrow)

    def _record(self, stream, head: dict[str, str]) -> tuple[dict | None, int]:
        bare = lambda k: head[k].strip("<>") if k in head else None
        row = {"record_id": bare("warc-record-id"), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "refers_to": bare("warc-refers-to")}
        digest = _digest(head.get("warc-payload-digest"))
        empty = row["record_type"] == "revisit"  # what it revisits has the payload
        if empty or (digest and digest[0] == "sha256"):
            row["payload_digest"] = digest[1].hex() if digest and digest[0] == "sha256" else None
        if empty or head.get("x-payload-length", "").isdigit():
            row["payload_bytes"] = int(head["x-payload-length"]) if head.get("x-payload-length", "").isdigit() else None
        length, asked = int(head.get("content-length", 0)), {*self.columns, *(f.attribute[0] for f in self.wanted)}
        if not _matches(row, self.wanted):
            stream.seek(length, 1)
            return None, 0
        if empty or not (self.verify or "payload" in asked or asked & ({"payload_digest", "payload_bytes"} - set(row))):
            stream.seek(length, 1)
            return {k: row.get(k) for k in self.columns}, 0
        bodies = _bodies(stream.read(length), head.get("content-type", "").lower().startswith("application/http"))
        if self.verify and digest and not any(hashlib.new(digest[0], b).digest() == digest[1] for b in bodies):
            raise ValueError(f"record {row['record_id']}: the payload has not the digest {head['warc-payload-digest']}")
        row["payload"] = bodies[0]
        if "payload_digest" not in row or self.verify:
            row["payload_digest"] = hashlib.sha256(bodies[0]).hexdigest()
        if "payload_bytes" not in row or self.verify:
            row["payload_bytes"] = len(bodies[0])
        if not _matches(row, self.wanted):
            return None, 0
        return {k: row.get(k) for k in self.columns}, len(bodies[0])


class _Written(WriterCommitMessage):
    def __init__(self, files: list[list]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, path = _at(self.path)
        system.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for record in batch.to_pylist():
                if out is None or size >= ROLL_BYTES:
                    if out:
                        out.close()
                        files[-1][1] = size
                    files.append([f"part-{uuid.uuid4().hex}.warc", 0])
                    out, size = system.open_output_stream(f"{path}/{files[-1][0]}"), 0
                raw = encode(record)
                out.write(raw)
                size += len(raw)
        if out:
            out.close()
            files[-1][1] = size
        return _Written(files)

    def commit(self, messages) -> None:
        system, path = _at(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages) -> None:
        system, path = _at(self.path)
        for name, _ in (x for m in messages if m for x in m.files):
            system.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    """``format("warc")``: option ``verify`` decodes and checks every payload that has a digest.

    ``payload_digest`` is the SHA-256 of the decoded payload, whatever digest
    the archive has. All records come out, also those without a target;
    ``record_type`` tells them apart, and a revisit has no payload.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, str(self.options.get("verify", "false")).lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known and let Spark hand predicates to it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame) -> DataFrame:
    """A record for each (page_id, url, html) row.

    Of rows with equal payloads of ``MIN_BYTES`` or more, those of the
    smallest page_id are responses and the others revisit it; rows without
    page_id are responses. A null html is an empty payload. Digests are summed
    up first. While few of them repeat, these are broadcast and no payload is
    shuffled; beyond that pages join them by digest. Of rows that repeat a
    page_id each is a record of its own. An empty table gives no records;
    other columns are not looked at.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = cut(
        rows.where(F.octet_length("payload") >= MIN_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where(F.col("first") < F.col("last"))
        .drop("last")
    )
    few = first.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    rows = rows.join(F.broadcast(first) if few else first, "digest", "left").withColumn("again", F.coalesce(F.col("page_id") > F.col("first"), F.lit(False)))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.uuid()))
    return rows.select(
        name("page_id").alias("record_id"),
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(F.col("again"), name("first")).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str) -> None:
    """Write the pages as WARC archives into a new folder."""
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).option("verify", str(verify)).load(path)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Archive every page, read all archives back and check every payload."""
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = read_warc(spark, path, "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long", verify=True)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= {MIN_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON payload_digest = d
"""
