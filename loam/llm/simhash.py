"""Near-duplicate documents by SimHash and a self-join of binary tries (operator 12).

A fingerprint's bits are the branches of a trie. A trie is joined with itself from the root down: a pair of nodes keeps the
number of bits in which the paths to them differ, its four pairs of children add the next bit, and a pair goes as soon as its
bits exceed the budget. Two texts with at most BUDGET differing bits have few of them in one half of the bits: at most 2 in
the first, or else at most 1 in the second. So there are two tries, one with the halves swapped, each with that smaller budget
down to its half and the whole one below it; what a single trie would visit near its root is many times more.

The first levels of a trie are the shuffle: a pair of prefixes within the budget is a group, a fingerprint goes to the groups of
its prefix, and prefixes with more than BLOCK fingerprints are split by hash, each pair of blocks being a group. So a group's
size is bounded, whatever the fingerprints. Equal fingerprints are one before all that. Within a group a pair of nodes that
hold a single component already goes too, and only links that join two components come out, fewer than the group has members.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import checked, components, discard, table, written

SHINGLE, SEED, BUDGET = 4, 42, 4
HALF = 32
#: Differing bits allowed in the first half of each trie's order: as given, and with the halves swapped.
CAPS = (2, 1)
#: Fingerprints that a prefix has on average, and the most that one side of a group holds.
BUCKET, BLOCK = 4096, 32_768
MOST_PREFIX_BITS = 16
#: Node pairs that are worked on at a time, and pairs of members below which a pair of nodes is compared outright.
FRONTIER, LEAF = 1 << 16, 8


def fingerprint(text: bytes) -> int:
    """64 bits, each set where more than half of the hashes of the four-word shingles have it; 0 without words."""
    words = text.lower().split()  # A-Z, and the six white-space bytes, as on ASCII
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(ends) - SHINGLE])]
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    hashes = np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=True)), np.uint64, len(starts))
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        count += np.unpackbits(hashes[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text").cast(pa.large_binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def swapped(x):
    """The halves of 64 bits in the other order: of a column or an array."""
    if isinstance(x, Column):
        return F.shiftleft(x, HALF).bitwiseOR(F.shiftrightunsigned(x, HALF))
    return (x << np.uint64(HALF)) | (x >> np.uint64(HALF))


def _masks(bits: int, cap: int) -> list[int]:
    """All numbers of that many bits with at most cap ones."""
    return [sum(1 << b for b in on) for n in range(min(cap, bits) + 1) for on in combinations(range(bits), n)]


def grouped(fps: DataFrame, bits: int, block: int = BLOCK) -> DataFrame:
    """(trie, lo, lo_block, hi, hi_block, low, path): the fingerprints fps(fp) in every group of two prefixes that they are in."""
    trie = F.explode(F.array(*[F.struct(F.lit(k).alias("trie"), path.alias("path")) for k, path in enumerate((F.col("fp"), swapped(F.col("fp"))))]))
    rows = fps.select(trie.alias("t")).select("t.*").withColumn("prefix", F.shiftrightunsigned("path", 64 - bits).cast("int") if bits else F.lit(0))
    sizes = written(rows.groupBy("trie", "prefix").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))  # 2 << bits rows at most
    own = rows.join(F.broadcast(sizes), ["trie", "prefix"]).withColumn("own", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int")).drop("blocks")
    near = F.when(F.col("trie") == 0, F.lit(_masks(bits, CAPS[0]))).otherwise(F.lit(_masks(bits, CAPS[1])))
    other = own.withColumn("mask", F.explode(near)).withColumn("other", F.col("prefix").bitwiseXOR(F.col("mask")))
    other = other.join(F.broadcast(sizes.withColumnsRenamed({"prefix": "other"})), ["trie", "other"]).withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    here, there = F.struct(F.col("prefix").alias("p"), F.col("own").alias("b")), F.struct(F.col("other").alias("p"), F.col("other_block").alias("b"))
    lo, hi = F.least(here, there), F.greatest(here, there)
    return other.select("trie", lo["p"].alias("lo"), lo["b"].alias("lo_block"), hi["p"].alias("hi"), hi["b"].alias("hi_block"), (lo == here).alias("low"), "path")


class _Sets:
    """Components of numbered members; root names each member's, fully looked up after each call of join."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        x, y = self.root[x], self.root[y]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return
        root = self.root
        for p, q in np.unique(np.stack((np.minimum(x, y)[apart], np.maximum(x, y)[apart])), axis=1).T.tolist():
            while root[p] != p:
                p = int(root[p])
            while root[q] != q:
                q = int(root[q])
            if p != q:
                root[max(p, q)] = min(p, q)
                self.links.append((p, q))
        while not np.array_equal(root, up := root[root]):
            root = up
        self.root = root


def trie_links(u: np.ndarray, v: np.ndarray, depth: int, cap: int, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Links between members of two subtrees, of 64-bit paths in order, each with its first `depth` bits the same; u is v for one
    subtree with itself. A member of v counts from len(u) on, unless u is v. The links join what all pairs within the budget would."""
    one = u is v
    shift = 0 if one else len(u)
    sets = _Sets(len(u) + (0 if one else len(v)))
    if not len(u) or not len(v):
        return []
    first = int(np.bitwise_count((u[0] ^ v[0]) >> np.uint64(64 - depth))) if depth else 0
    stack = [(depth, *(np.array([x]) for x in (0, len(u), 0, len(v), first)))]
    seen = None
    while stack:
        t, a, b, c, e, d = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(t, *(x[half:] for x in (a, b, c, e, d))), (t, *(x[:half] for x in (a, b, c, e, d)))]
            continue
        if seen is not sets.root:
            seen = sets.root
            turns = np.cumsum(np.concatenate(([False], seen[1:] != seen[:-1])))
        whole = (turns[a] == turns[b - 1]) & (turns[c + shift] == turns[e - 1 + shift]) & (seen[a] == seen[c + shift])
        few = ~whole & ((b - a) * (e - c) <= LEAF)
        if few.any():
            n = ((b - a) * (e - c))[few]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat((e - c)[few], n)
            x, y = np.repeat(a[few], n) + place // wide, np.repeat(c[few], n) + place % wide
            near = np.bitwise_count(u[x] ^ v[y]) <= budget
            sets.join(x[near], y[near] + shift)
        a, b, c, e, d = (x[~whole & ~few] for x in (a, b, c, e, d))
        if not len(a):
            continue
        bit = np.uint64(1 << (63 - t))
        above = ~np.uint64((1 << (64 - t)) - 1) if t else np.uint64(0)
        m, n = np.searchsorted(u, (u[a] & above) | bit), np.searchsorted(v, (v[c] & above) | bit)
        most = cap if t < HALF else budget
        far = (d < most, d < most) if not one else (d < most, (d < most) & (a != c))  # a node with itself has each pair of children once
        sides = (((a, m, n, e, d + 1), far[0]), ((m, b, c, n, d + 1), far[1])), (((a, m, c, n, d), True), ((m, b, n, e, d), True))
        for level in sides:  # near ones are taken first: they make components
            kept = []
            for (i, j, k, l, bits), ok in level:
                full = (i < j) & (k < l) & ok
                kept.append([x[full] for x in (i, j, k, l, bits)])
            if sum(len(x[0]) for x in kept):
                stack.append((t + 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))
    return sets.links


def _meet(bits: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        trie, lo, lo_block, hi, hi_block = (k.as_py() for k in key)
        path, low = rows.column("path").to_numpy().view(np.uint64), rows.column("low").to_numpy()
        if (lo, lo_block) == (hi, hi_block):
            u = v = members = np.unique(path)
        else:
            u, v = np.unique(path[low]), np.unique(path[~low])
            members = np.concatenate((u, v))
        at = np.array(trie_links(u, v, bits, CAPS[trie]), np.int64).reshape(-1, 2)
        ends = [members[at[:, k]] for k in (0, 1)]
        return pa.table([pa.array((swapped(x) if trie else x).view(np.int64)) for x in ends], ["a", "b"])

    return run


def prefix_bits(n: int) -> int:
    """Levels of the tries that the shuffle takes, for n fingerprints."""
    return min(MOST_PREFIX_BITS, max(0, math.ceil(math.log2(max(n, 1) / BUCKET))))


def simhash_duplicates(docs: DataFrame, bits: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints link where they differ in 4 bits or fewer; component_id is the smallest doc_id reachable. Null and empty texts,
    and texts without words, have fingerprint zero and link like any other; fewer than four words are one shingle. Rows that
    repeat get a row each; a null id gets its row, but names a component (null) only where no other id is in it. Other columns
    are not read; an empty table gives an empty result. bits: prefix bits that are shuffled by, from the number of
    fingerprints if not given.
    """
    rows = written(fingerprints(docs))
    found = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    bits = prefix_bits(found.count()) if bits is None else bits
    groups = grouped(found.select("fp"), bits, block).groupBy("trie", "lo", "lo_block", "hi", "hi_block")
    labels = components(groups.applyInArrow(_meet(bits), "a long, b long"))
    named = found.join(labels, F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = written(named.join(heads, "component").select("fp", "component_id"))
    discard(found, labels)
    return rows.join(checked(classes), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))
