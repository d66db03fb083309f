"""Collocations against counting every phrase at every place."""

import random
import re
from collections import Counter

import pytest
from loam.llm import collocations as C


def brute(rows, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(low)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for lang in n:
        kept = [(-s, -a, " ".join(p).encode(), l, r) for (g, p), (s, a, l, r) in found.items() if g == lang and not any(h == lang and inside(p, q) and 100 * b[1] >= 80 * a for (h, q), b in found.items())]
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("period", "held"), [(8, 200_000), (1, 5), (1 << 60, 200_000)])
def test_against_all_places(spark, monkeypatch, period, held):
    monkeypatch.setattr(C, "HELD", held)
    monkeypatch.setattr(C, "BYTES", 100 if period == 1 else 1 << 20)
    r = random.Random(period)
    words = ["Alpha", "beta", "Γamma", "délta", "e", "F", "\x0bg", "z\x00z", "\U0001f600", "￮"]
    text = lambda: "".join(r.choice(words) + r.choice([" "] * 12 + ["  ", "\t", ", ", ".", "\n", "!", "\f"]) for _ in range(r.randrange(0, 60)))
    rows = [(r.choice(["en", "en", "en", "de", None, "und", ""]), text()) for _ in range(200)] + [("en", None), ("en", ""), ("fr", "x " * 4000), (None, " ., ")]
    rows += [("en", "new york city hall is in new york city")] * 30 + [("en", "los angeles")] * 40
    docs = spark.createDataFrame([(*x, 1, "a", 2) for x in rows], "lang string, text string, rank int, phrase string, f int")
    got = sorted(tuple(x) for x in C.collocations(docs, 12, 25, period).collect())
    assert got == brute(rows, 12, 25) and len(got) > 40
    assert C.collocations(docs.limit(0), 12, 25, period).collect() == []


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    rows = [("en", "a b c d e a b c"), ("en", "b c d e f")] * 9
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(C, "KEYS", 0)
    assert sorted(tuple(x) for x in C.collocations(docs, 3).collect()) == brute(rows, 3, 2000)


def test_chunks_overlap_and_own_each_place_once():
    r = random.Random(1)
    words = [str(r.randrange(50)).encode() for _ in range(400)]
    inner, last = C._inner(words, 1, {})
    parts = [*inner, last]
    assert len(parts) > 20
    joined = parts[0].split()
    for part in parts[1:]:
        assert joined[-3:] == part.split()[:3]
        joined += part.split()[3:]
    assert joined == words


def test_counts_beyond_a_long(spark):
    f = [("en", "a b", 4_000_000_000_000_000_000), ("en", "a", 4_000_000_000_000_000_001), ("en", "b", 9_000_000_000_000_000_000)]
    got = C.scored(spark.createDataFrame(f, "lang string, phrase string, f long")).collect()
    assert [x["score"] for x in got] == [2_000_000 * f[0][2] // (f[1][2] + f[2][2])]
