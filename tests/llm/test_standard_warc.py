"""The WARC reader on records that other writers make; licenses with common words and with many templates."""

import base64
import hashlib
import random

import pytest
from loam.llm import licenses, warc


def record(version="WARC/1.0", block=b"abc", tail=b"\r\n\r\n", **headers):
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Length": len(block)} | {k.replace("_", "-"): v for k, v in headers.items()}
    return f"{version}\r\n{''.join(f'{k}: {v}\r\n' for k, v in head.items() if v is not None)}\r\n".encode() + block + tail


def test_records_of_other_writers():
    assert warc.parse_record(record())["payload"] == b"abc"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x"
    sha = base64.b32encode(hashlib.sha1(b"<p>x").digest()).decode()
    got = warc.parse_record(record(block=http, **{"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha}", "WARC-Block-Digest": f"sha1:{hashlib.sha1(http).hexdigest()}"}))
    assert got["payload"] == b"<p>x" and got["block"] == http
    for kind in ("warcinfo", "request", "metadata", "resource"):
        assert warc.parse_record(record(WARC_Type=kind))["warc-type"] == kind
    folded = record().replace(b"WARC-Date: ", b"warc-date:\r\n  ")
    assert warc.parse_record(folded)["warc-date"] == "2024-01-01T00:00:00Z"
    assert warc.parse_record(record(WARC_Type="revisit", block=b"", WARC_Payload_Digest="sha1:x"))["block"] == b""
    bad = [record(version="WARC/0.9"), record(WARC_Date=None), record(tail=b"\r\n"), record(WARC_Payload_Digest=f"sha1:{'0' * 40}"), record(WARC_Type="revisit", block=b""), record(**{"Content-Length": "x"}), record().replace(b": response", b" response")]
    for data in bad:
        with pytest.raises(ValueError):
            warc.parse_record(data)


def test_common_words_are_no_notice(spark):
    text = "she reserved a table early, and for once all the animal rights people came"
    docs = spark.createDataFrame([(1, text), (2, "(c) 2020. All rights\nreserved."), (3, "all rights not reserved")], "doc_id long, text string")
    got = {x.doc_id: {n.label for n in x.notices} for x in licenses.scan_licenses(docs).collect()}
    assert got == {1: set(), 2: {"notice:all-rights-reserved"}, 3: set()}


def test_many_templates_in_parts(spark, monkeypatch):
    r = random.Random(2)
    templates = [(f"t{k}", " ".join(f"w{r.randrange(300)}" for _ in range(12))) for k in range(30)]
    docs = spark.createDataFrame([(k, f"x {t} y") for k, (_, t) in enumerate(templates)], "doc_id long, text string")
    seen = lambda: {x.doc_id: sorted((n.label, round(n.containment, 6)) for n in x.notices) for x in licenses.scan_licenses(docs, templates).collect()}
    whole = seen()
    monkeypatch.setattr(licenses, "MAX_TOKENS", 70)
    assert len(licenses.template_parts(licenses.template_table(spark, templates))) > 3
    assert seen() == whole and all(f"t{k}" in dict(v) for k, v in whole.items())
