"""Zstandard WARC archives (operator 8): written and read through Spark's own file sources.

Archive layout: a skippable frame (magic 0x184D2A5D) with the dictionary, then one Zstandard frame per record. Writing goes
through the text sink, whose commit protocol makes retried tasks harmless and which reaches any file system Spark
does; its line separator is an empty skippable frame, which readers pass over. Reading goes through the binaryFile source.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import shared_dir, small_batches, table

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = "P*M\x18\0\0\0\0"  # magic 0x184D2A50 and length 0: an empty skippable frame
VERSION, VERSIONS = "WARC/1.1", ("WARC/1.0", "WARC/1.1")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Payload bytes in one archive, and samples and size for its dictionary.
ARCHIVE_BYTES, SAMPLES, DICTIONARY_BYTES = 64 << 20, 200, 16 << 10
MIN_REVISIT_BYTES = 1000


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: response with its payload, or revisit without; the digest is of the full payload in both."""
    kind, block = ("response", payload) if refers_to is None else ("revisit", b"")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\r\n\x00]+", " ", url or ""), "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Payload-Length": len(payload),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head |= {"Content-Type": "text/html", "Content-Length": len(block)}
    return f"{VERSION}\r\n{''.join(f'{k}: {v}\r\n' for k, v in head.items())}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The headers, by lower-cased names, and the block of one record of WARC 1.0 or 1.1; folded header lines are joined.

    Raises ValueError if version, headers or lengths are not right, or a digest is given that the block does not have. The
    payload digest and this writer's payload length are optional; a record of any type passes.
    """
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or lines[0] not in VERSIONS:
        raise ValueError("not a WARC record")
    fields, name = {}, ""
    for line in lines[1:]:
        if line[:1] in " \t" and name:
            fields[name] = f"{fields[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header without a colon: {line[:60]!r}")
        name = name.strip().lower()
        fields[name] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields):
        raise ValueError(f"headers missing: {sorted(missing)}")
    if not fields["content-length"].isdigit():
        raise ValueError(f"record of {fields['warc-record-id']}: Content-Length is no number")
    size, kind = int(fields["content-length"]), fields["warc-type"].lower()
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record of {fields['warc-record-id']}: Content-Length {size} does not fit")
    block = rest[:size]
    payload = _payload(block, fields.get("content-type", "")) if kind == "response" else block
    if kind != "revisit":
        if "warc-payload-length" in fields and int(fields["warc-payload-length"]) != len(payload):
            raise ValueError(f"record of {fields['warc-record-id']}: payload does not fit its length")
        for digest, of in (("warc-payload-digest", payload), ("warc-block-digest", block)):
            if digest in fields and not _fits(fields[digest], of):
                raise ValueError(f"record of {fields['warc-record-id']}: payload does not fit its digest")
    elif "warc-payload-digest" not in fields and "warc-refers-to" not in fields:
        raise ValueError(f"record of {fields['warc-record-id']}: not a revisit")
    return fields | {"block": block, "payload": payload}


def _payload(block: bytes, kind: str) -> bytes:
    """What an HTTP response carries behind its headers; any other block is its own payload."""
    if "application/http" in kind.lower():
        return block.partition(b"\r\n\r\n")[2]
    return block


def _fits(stated: str, data: bytes) -> bool:
    """Whether data has a stated SHA-1 digest, in hex or base 32; other algorithms are not tested."""
    algorithm, _, value = stated.rpartition(":")
    if algorithm.lower() not in ("sha1", "sha-1", ""):
        return True
    digest = hashlib.sha1(data)
    return value.lower() == digest.hexdigest() or value.upper() == base64.b32encode(digest.digest()).decode()


def make_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the last sample as raw content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (samples or [b""])[-1][:DICTIONARY_BYTES]


def dictionary_of(content: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary in the leading skippable frame, and where the frame ends."""
    if len(content) < 8:
        raise ValueError("archive without a dictionary frame")
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC or len(content) < 8 + size:
        raise ValueError("archive without a dictionary frame")
    raw = bytes(content[8 : 8 + size])
    if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return (zstandard.ZstdCompressionDict(raw) if raw else None), 8 + size


def frames(content: memoryview):
    """The record frames of an archive, decoded one at a time."""
    known, at = dictionary_of(content)
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(content):
        magic = struct.unpack_from("<I", content, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        one = reader.decompressobj()
        parts, step = [], at
        while not one.eof:  # feed in pieces, so that what follows the frame is not copied for each record
            if step >= len(content):
                raise ValueError("archive ends inside a record")
            parts.append(one.decompress(content[step : step + 8192]))
            step += 8192
        at = min(step, len(content)) - len(one.unused_data)
        yield b"".join(parts)


def _archive(batches):
    """Arrow batches of (page_id, url, html, digest, refers_to) to rows of archive bytes; the first is the dictionary's."""
    writer = None
    for batch in batches:
        rows = batch.to_pydict()
        records = [record_bytes(p, u, (h or "").encode(), d, r) for p, u, h, d, r in zip(*(rows[c] for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True)]
        if writer is None and records:
            raw = make_dictionary([x[:65536] for x in records[:SAMPLES]])
            yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw], pa.binary())], ["value"])
            writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([writer.compress(x) for x in records], pa.binary())], ["value"])


def _records(batches):
    """Archives to rows (page_id, payload_bytes, payload_digest, record_type, refers_to, url), in bounded batches."""
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for data in frames(memoryview(content.as_buffer())):
                r = parse_record(data)
                kind, payload = r["warc-type"].lower(), r["payload"]
                text = payload.decode("utf-8", "replace") if kind != "revisit" else None
                size = int(r.get("warc-payload-length") or len(payload)) if kind != "revisit" or "warc-payload-length" in r else None
                digest = r.get("warc-payload-digest", "").removeprefix("sha1:") or hashlib.sha1(payload).hexdigest()
                rows.append((number(r["warc-record-id"]), size, digest, kind, number(r.get("warc-refers-to")), r.get("warc-target-uri", ""), text))
                held += len(data)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the records that are revisits, from pages(page_id, html).

    Among equal payloads of at least 1000 bytes the record with the largest page_id is the response; a page without an id is
    a response, too. Only the narrow digests meet, reduced map-side before the shuffle.
    """
    large = pages.where((F.octet_length("html") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", F.sha1("html").alias("digest"))
    first = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return large.join(first, "digest").where("page_id != refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str) -> None:
    """One archive per partition of pages(page_id, url, html), of about ARCHIVE_BYTES of payload. The pages are shuffled once,
    to their archive; what is a revisit joins them there."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    key = ["page_id", "digest"]
    rows = pages.withColumn("digest", F.sha1("html")).repartition(max(spark.sparkContext.defaultParallelism, -(-total // ARCHIVE_BYTES)), *key)
    packed = rows.join(revisits(pages), key, "left").select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_archive, "value binary")
    with small_batches(spark):
        packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: page_id, payload_bytes, payload_digest, record_type, refers_to, url, html.

    html is null for revisits; payload_bytes is null where a revisit does not state it; page_id and refers_to are null for
    record ids that are not this writer's. Records of all types come back (warcinfo, request and others). A record that does
    not validate fails the job; an empty file is no archive and is passed over.
    """
    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(_records, shape)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html counts as empty; null urls are written empty; a page without an id comes back without one."""
    path = f"{shared_dir(spark)}/loam/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM d
"""
