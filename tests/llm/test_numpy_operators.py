"""Operators 2, 3 and 7 against brute force and round trips."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loam.llm import maxent, near_dedup, packing, wordhash

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_word_hashes():
    texts = ["", None, "A b\tÉ é\x0b a", " lead", "trail ", "x" * 5000 + " y", "a\x00b a", "ab ba", " wide "]
    for limit in (1, 10, 1 << 20):
        seen, got = {}, []
        for row, n, h, bounds in wordhash.hashed_words(pa.array(texts), limit):
            for r in range(n):
                own = words(texts[row + r])
                got.append(row + r)
                assert len(own) == bounds[r + 1] - bounds[r]
                for w, x in zip(own, h[bounds[r] : bounds[r + 1]], strict=True):
                    assert seen.setdefault(w, x) == x
        assert got == list(range(len(texts))) and len(set(seen.values())) == len(seen)


def near_brute(docs):
    sets = {}
    for d, t in docs:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)) and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_near_duplicates(spark):
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(500)]
    docs = documents(spark)
    for base in range(6):
        text = r.choices(vocabulary, k=r.choice([8, 30, 80, 200]))
        for k in range(25):  # chains: each drifts on from the one before
            text = list(text)
            text[r.randrange(len(text))] = r.choice(vocabulary)
            docs.append((1000 + base * 100 + k, " ".join(text).upper() if k % 2 else "\t".join(text)))
    docs += [(2000 + k, " ".join(vocabulary[:k])) for k in range(9)] + [(2100, None), (2101, ""), (2102, "   "), (2103, "w0 w1"), (2104, "W0  W1")]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == near_brute(docs) and len(got) == len(docs)


def test_near_odd(spark, odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {x.doc_id: x for x in got}
    assert by[6].component_id == 5 and by[9].component_id == 8 and by[2].component_id == 2 and by[None].kept
    assert near_dedup.near_duplicates(empty).count() == 0


def test_sketch():
    r = np.random.default_rng(1)
    for n in (1, 5, 100, 5000):
        x = np.sort(wordhash.mix(np.arange(n, dtype=np.uint64) + np.uint64(r.integers(1 << 40))))
        regs = near_dedup.registers(x)
        low = {}
        for v in map(int, x):
            low[v >> 57] = min(low.get(v >> 57, 1 << 64), v & ((1 << 57) - 1))
        for b in range(128):
            if b not in low:
                assert regs[b] == near_dedup.EMPTY
            else:
                rest = low[b]
                zeros = 57 - rest.bit_length()
                mantissa = ((rest << zeros << 1) & ((1 << 57) - 1)) >> 47
                assert int(regs[b]) == zeros << 10 | mantissa
        assert (near_dedup.filled(regs[None]) != near_dedup.EMPTY).all()
    both = wordhash.mix(np.arange(3000, dtype=np.uint64))
    a, b = np.sort(both[:2800]), np.sort(both[200:])
    j, _ = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([2800]), np.array([2800]))
    assert abs(j[0] - 2600 / 3000) < 0.15


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.tokenizer_path())
    docs = documents(spark) + [(5000, None), (5001, ""), (5002, "<|endoftext|> x"), (5012, "a<|endoftext|>b <|endoftext|><|end"), (5003, " \n\n  a　b 12345 don't " * 50), (5004, "z" * 20000)]
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for d, t in docs:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start : at].tobytes())
        assert at == len(ids)
    total = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        total += at
    assert total >= 0.97 * 2048 * len(sequences)
    assert packing.pack_documents(odd).count() >= odd.count()
    assert packing.pack_documents(empty).count() == 0


def test_cuts():
    for n in range(1, 7000):
        parts = packing.cuts(n)
        assert sum(p for p, _ in parts) == n and all(p * k <= 2048 for p, k in parts)


def test_language_model(spark):
    docs = documents(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    train = [(d, t) for d, t in docs if zlib.crc32(str(d).encode()) % 5 != 1]
    counts = Counter(w for _, t in train for w in [*words(t), None])
    total, v = sum(counts.values()), len(counts)
    got = maxent.score_documents(df, df.where(df.doc_id.isin([d for d, _ in train]))).collect()
    texts = dict(docs)
    assert len(got) == len(docs)
    held = [0.0, 0.0]
    for x in got:
        w = [*words(texts[x.doc_id]), None]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(k in counts for k in w), total)
        assert math.isclose(x.base_score, sum(math.log10((counts.get(k, 0) + 0.5) / (total + 0.5 * (v + 1))) for k in w), rel_tol=1e-9)
        assert x.score < 0
        if x.doc_id not in dict(train):
            held[0] += x.base_score
            held[1] += x.score
    assert held[1] > held[0]  # better on texts it has not seen


@pytest.mark.parametrize("limit", [0, 40])
def test_rare_tokens_join(spark, limit, monkeypatch):
    monkeypatch.setattr(maxent, "BROADCAST_TOKENS", limit)
    df = spark.createDataFrame([(k, f"a a b b c{k % 3} d{k}") for k in range(30)], "doc_id long, text string")
    got = {x.doc_id: x for x in maxent.score_documents(df, df.where("doc_id < 20")).collect()}
    counts = Counter(w for k in range(20) for w in ["a", "a", "b", "b", f"c{k % 3}", f"d{k}", None])
    for k in range(30):
        w = ["a", "a", "b", "b", f"c{k % 3}", f"d{k}", None]
        assert math.isclose(got[k].base_score, sum(math.log10((counts.get(x, 0) + 0.5) / (140 + 0.5 * (len(counts) + 1))) for x in w), rel_tol=1e-9)
        assert got[k].n_known == sum(x in counts for x in w)


def test_language_model_odd(spark, odd, empty):
    assert maxent.score_documents(odd, odd).count() == odd.count()
    assert {x.base_score for x in maxent.score_documents(odd, empty).collect()} == {0.0}
    assert maxent.score_documents(empty, empty).count() == 0
