"""Operators 4, 5, 8, 9 and 10 against brute force on whole small tables, and on odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loam.llm import decontaminate, exact_dedup, licenses, sanitise, warc

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    n = lambda m: len(re.sub("[^0-9]", "", m))
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= n(m) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= n(m) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, r, ok in rules for m in re.finditer(r, text or "") if ok(m[0])]


TRICKY = [
    "a@b.c_d@e.f", "a@b.c@d.e", "..@x.y-z.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004 0000000255.1.1.1", "99999999999999999999.1.1.1", "4111-1111-1111-1111 4111111111111112", "4111 1111  1111 1111", "+1 2", "+123456789 +1.2.3.4.5.6.7.8.9 +1(234)567--",
    "é@x.org ünder@ü.de x@y", "a.b.c@d", "\U0001f600 mail \U0001f600a@b.co\U0001f600 1.1.1.1", "+" * 50 + "1234567890", "a" * 3000, "1." * 3000, "a@" + "b." * 3000, "12345678901234567890123 4012888888881881",
]


def test_base_spans(spark):
    rows = [(k, t) for k, t in enumerate(TRICKY)] + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.rank < 4] == base(want[r.doc_id]), want[r.doc_id][:80]


def test_disclosing_terms(spark):
    rows = [(k, f"Nothing here but filler number{k} words") for k in range(30)]
    rows += [(100 + k, f"Please ask Zebulon or the desk, write z@corp.org for number{k} words") for k in range(4)]
    rows += [(200 + k, f"Please the desk, filler{k} or write") for k in range(20)]
    got = {r.doc_id: r for r in sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[30][1]
    spans = {(s.kind, text[s.start : s.end]) for s in got[100].spans}
    assert ("removed", "Zebulon") in spans and ("email", "z@corp.org") in spans
    assert not any(t in ("words", "the") for _, t in spans)
    assert "Zebulon" not in got[100].text and "[EMAIL]" in got[100].text
    assert got[0].text == rows[0][1] and not got[205].spans
    # against counts over the whole table
    import math
    df = Counter(t for _, x in rows for t in set(re.findall(r"[^\W\d_][^\W_]{2,}", x.lower())))
    share = math.log2(4 * len(rows) / (4 * df["zebulon"])) / math.log2(len(rows) / 4)
    assert share >= 0.9


def test_sanitise_odd(spark, odd, empty):
    got = sanitise.sanitise(odd).collect()
    assert len(got) == odd.count()
    assert {len([s for s in r.spans if s.rank < 4]) for r in got if r.doc_id == 4} == {4}
    assert [r.text for r in got if r.doc_id is None] == ["a row without an id here"]
    assert sanitise.sanitise(empty).count() == 0


def blocks_brute(docs, templates, share=0.8):
    out = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            have = set(words(line))
            for label, t in templates:
                t = set(words(t))
                if len(t) >= licenses.LINE_WORDS and len(have & t) * 10 >= 8 * len(t):
                    out.setdefault(d, {}).setdefault(label, 0)
                    out[d][label] = max(out[d][label], len(have & t) / len(t))
        w = words(text)
        for label, t in templates:
            span, t = len(words(t)), set(words(t))
            for a in range(max(1, len(w) - span + 1)):
                if t and len(common := set(w[a : a + span]) & t) * 10 >= 8 * len(t):
                    out.setdefault(d, {})[label] = max(out.get(d, {}).get(label, 0), len(common) / len(t))
    return out


def test_license_scan(spark):
    r = random.Random(3)
    pool = [w for _, t in licenses.TEMPLATES for w in words(t)] + ["lorem", "ipsum", "dolor"]
    docs = [(k, "\n".join(" ".join(r.choices(pool, k=r.randint(0, 40))) for _ in range(3))) for k in range(150)]
    docs += [(1000 + k, t) for k, (_, t) in enumerate(licenses.TEMPLATES)] + [(2000, "the MIT  license, apache-license MIT License CC-BY cc by gnu general public license"), (2001, None), (2002, "")]
    docs += [(r.doc_id + 3000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want, texts = blocks_brute(docs, licenses.TEMPLATES), dict(docs)
    assert len(got) == len(docs)
    for x in got:
        w = words(texts[x.doc_id])
        assert x.n_words == len(w)
        assert sorted((p.at, p.label) for p in x.places) == sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        assert {n.label: round(n.containment, 9) for n in x.notices} == {k: round(v, 9) for k, v in want.get(x.doc_id, {}).items()}
        assert 0 <= x.score <= 1


def test_license_odd(spark, odd, empty):
    assert licenses.scan_licenses(odd).count() == odd.count()
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(odd, templates=[("none", None)]).count() == odd.count()


def window_brute(docs, bench, size=10):
    grams = {}
    for i, t in bench:
        w = words(t)
        k = min(size, len(w))
        for a in range(len(w) - k + 1) if w else []:
            grams.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if (g := tuple(w[a : a + k])) in grams:
                    hit |= set(range(a, a + k))
                    items |= grams[g]
        out[d] = (len(w), len(hit), sorted(items))
    return out


@pytest.mark.parametrize("chars", [10**7, 40])
def test_contamination(spark, chars):
    r = random.Random(5)
    bench = [(k, " ".join(r.choices("abcdef", k=r.randint(0, 14)))) for k in range(12)] + [(50, None), (51, "Solo")]
    docs = [(k, " ".join(r.choices("abcdefgh", k=r.randint(0, 60))) + (" " + bench[k % 12][1]) * (k % 3)) for k in range(60)] + [(90, "x SOLO, y"), (91, None)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), broadcast_bytes=chars).collect()
    assert {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in got} == window_brute(docs, bench)
    assert len(got) == len(docs) and all(x.contaminated == (x.n_hit > 0) for x in got)


def test_spans_cut(spark):
    docs = spark.createDataFrame([(1, "Keep this. A b c d e f g h i j k! And that."), (2, "clean"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert [r.text for r in decontaminate.without_spans(docs, bench).orderBy("doc_id").collect()] == ["Keep this. k! And that.", "clean", None]
    assert [r.doc_id for r in decontaminate.clean_documents(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_contamination_odd(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(None, "one two"), (2, "one two"), (2, "one two")], "item_id long, text string")
    assert decontaminate.contamination(odd, none).where("contaminated").count() == 0
    got = decontaminate.contamination(odd, some).collect()
    assert len(got) == odd.count() and [(x.doc_id, x["items"]) for x in got if x.contaminated] == [(3, ["2"])]
    assert decontaminate.contamination(empty, some).count() == 0


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_exact_duplicates(spark, block):
    r = random.Random(7)
    docs = [(k, "".join(r.choices("ab", k=r.randint(0, 7)))) for k in range(80)] + [(100, None), (101, "éé"), (102, "éé"), (103, "ab" * 9), (104, "ab" * 9 + "a")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block).collect()
    groups = {}
    for d, t in docs:
        groups.setdefault(t or "", []).append(d)
    texts = dict(docs)
    assert len(got) == len(docs)
    for x in got:
        g = groups[texts[x.doc_id] or ""]
        assert (x.keep_id, x.group_size, x.kept) == (max(g), len(g), x.doc_id == max(g))
        assert x.text_sha256 == hashlib.sha256((texts[x.doc_id] or "").encode()).hexdigest()


def test_exact_odd(spark, odd, empty):
    got = exact_dedup.exact_duplicates(odd, 64).collect()
    assert len(got) == odd.count()
    assert {(x.doc_id, x.keep_id, x.group_size, x.kept) for x in got} >= {(1, 2, 2, False), (2, 2, 2, True), (4, 4, 2, True), (5, 6, 2, False), (8, 9, 2, False), (None, None, 1, True)}
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1000
    pages = [(1, "http://a/", big), (2, "http://a/\r\nX: y", big), (3, None, "é" * 400), (4, "u", None), (5, "u", ""), (6, "v", "<p>\r\n\r\n</p>" * 5000), (None, "n", "small"), (7, "w", "é" * 500), (8, "w", "é" * 500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    warc.write_archives(df, f"file://{tmp_path}/a")
    got = warc.read_archives(spark, f"file://{tmp_path}/a").collect()
    assert len(got) == len(pages)
    html = {p: h or "" for p, _, h in pages}
    for r in got:
        payload = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r.record_type, r.refers_to) == {1: ("revisit", 2), 7: ("revisit", 8)}.get(r.page_id, ("response", None))
        assert r.html == (None if r.record_type == "revisit" else html[r.page_id])
    warc.write_archives(df.limit(0), f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_warc_validation():
    good = warc.record_bytes(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parse_record(good)["block"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"Content-Length: 3", b"Content-Length: 2"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Dat")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    with pytest.raises(ValueError):
        list(warc.frames(memoryview(b"no archive at all")))
