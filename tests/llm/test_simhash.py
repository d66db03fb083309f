"""Fingerprints, the trie join and its components against plain Python over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from loam.llm import simhash as S


def plain_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, budget=4):
    """The smallest member reachable, by all pairs."""
    root = list(range(len(keys)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (keys[i] ^ keys[j]).bit_count() <= budget:
                a, b = up(i), up(j)
                root[max(a, b)] = min(a, b)
    return [up(i) for i in range(len(keys))]


@pytest.mark.parametrize("text", ["", None, "One", "a b c", "A b C d", "x " * 500, "\x0bé\tÜ Ä \x85 b\r\nc d", " ".join(map(str, range(9000)))])
def test_fingerprint(text):
    assert S.fingerprint((text or "").encode()) == plain_print(text)


def near(r, n, centres):
    """Fingerprints around a few centres, 0 to 5 bits away, and others anywhere."""
    middle = [r.getrandbits(64) for _ in range(centres)]
    out = {r.getrandbits(64) for _ in range(n // 2)}
    while len(out) < n:
        x = r.choice(middle)
        for b in r.sample(range(64), r.randrange(6)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("frontier", [3, 1 << 16])
def test_trie_against_all_pairs(monkeypatch, frontier):
    monkeypatch.setattr(S, "FRONTIER", frontier)
    r = random.Random(frontier)
    keys = near(r, 220, 4)
    links = []
    for trie, cap in enumerate(S.CAPS):
        path = np.array(keys, np.uint64)
        path = np.sort(S.swapped(path) if trie else path)
        back = [int(S.swapped(x)) if trie else int(x) for x in path]
        links += [(keys.index(back[a]), keys.index(back[b])) for a, b in S.trie_links(path, path, 0, cap)]
    want, got = classes(keys), list(range(len(keys)))
    for _ in keys:
        for a, b in links:
            got[a] = got[b] = min(got[a], got[b])
    assert got == want and len(set(want)) < len(keys)
    assert all((keys[a] ^ keys[b]).bit_count() <= 64 for a, b in links) and len(links) < 2 * len(keys)


@pytest.mark.parametrize(("bits", "block"), [(0, 1 << 15), (0, 40), (5, 1 << 15), (5, 8)])
def test_groups_and_blocks_meet_all_links(spark, bits, block):
    r = random.Random(11)
    keys = near(r, 260, 3)
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    groups = S.grouped(spark.createDataFrame([(k,) for k in signed], "fp long"), bits, block).groupBy("trie", "lo", "lo_block", "hi", "hi_block")
    links = [(signed.index(x["a"]), signed.index(x["b"])) for x in groups.applyInArrow(S._meet(bits), "a long, b long").collect()]
    got = list(range(len(keys)))
    for _ in keys:
        before = list(got)
        for a, b in links:
            got[a] = got[b] = min(got[a], got[b])
        if got == before:
            break
    assert got == classes(keys)


def test_documents_against_all_pairs(spark, odd, empty):
    assert S.simhash_duplicates(empty).collect() == []
    r = random.Random(2)
    base = [f"w{r.randrange(300)}" for _ in range(400)]
    texts = []
    for _ in range(40):
        words = list(base)
        for _ in range(r.randrange(0, 12)):
            words[r.randrange(400)] = f"v{r.randrange(9)}"
        texts.append(" ".join(words))
    rows = [(k, t) for k, t in enumerate([*texts, None, "", " \n", "one", "ONE", *texts[:3]], 1)]
    rows += [(x["doc_id"], x["text"]) for x in odd.collect()]
    keys = [plain_print(t) for _, t in rows]
    group = classes(keys)
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted(((i, f"{k:016x}", least.get(g)) for (i, _), k, g in zip(rows, keys, group, strict=True)), key=repr)
    got = S.simhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(x) for x in got), key=repr) == want
    assert len({g for g in group}) < len(rows) - 8
