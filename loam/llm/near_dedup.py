"""Near-duplicate documents by HyperMinHash (operator 2).

A document's distinct 5-word shingles are hashed to 64 bits. The top bits choose one of 128 buckets; of the smallest rest
in a bucket the sketch keeps the number of leading zeros and 10 mantissa bits, 16 bits in all. Bands of five compressed
registers (an empty bucket borrows from another, chosen by hash) name the candidates, the registers' Jaccard estimate, corrected
for the collisions that compression brings, drops those that are far off, and the full shingle sets decide.

Equal sets are collapsed first, so copies cost nothing. In a band's bucket documents meet two leaders, not each other: the
central one, whose buckets hold the most members (the text that the others were made from, where there is one), and one
chosen by hash, another in each bucket. What could still be missing are links between components that share a bucket: documents
of such buckets are then compared across components where they share one of their rarest shingles, which every link does,
so no link between different texts is lost to the stars, and texts that only share what is common in their group never meet. At similarity 0.85 a pair misses all 25 bands of 5
with probability below 1e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import checked, components, discard, table, text_print, written
from loam.llm.wordhash import hashed_words, mix

SHINGLE = 5
BUCKET_BITS, MANTISSA_BITS = 7, 10
BANDS, ROWS = 25, 5
#: Link where PERCENT * |union| <= 100 * |intersection|.
PERCENT = 85
#: Standard deviations that the estimate may be off before a pair is dropped unverified.
SLACK = 6.0
EMPTY = 0xFFFF
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GROW = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(column: pa.Array):
    """The sorted distinct shingle hashes of each row. Rows with 1 to 4 words have one shingle, without words none."""
    for _, n, words, bounds in hashed_words(column):
        rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            rolled = rolled * _GROW + words[k : k + len(rolled)]
        rolled = mix(rolled)
        for r in range(n):
            a, b = bounds[r], bounds[r + 1]
            if b - a >= SHINGLE:
                x = np.sort(rolled[a : b - SHINGLE + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif b > a:
                x = np.array([b - a], np.uint64) * _STEP
                for w in words[a:b]:
                    x = x * _GROW + w
                yield mix(x)
            else:
                yield np.zeros(0, np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits: 6 bits of leading zeros and 10 of mantissa of each bucket's minimum; EMPTY without one."""
    out = np.full(1 << BUCKET_BITS, EMPTY, np.uint16)
    bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    rest = shingles[first] << np.uint64(BUCKET_BITS)
    top = (rest >> np.uint64(12)).astype(np.float64)  # 52 bits: exact in a double
    zeros = np.where(top > 0, 51 - np.floor(np.log2(np.maximum(top, 1))), 52).astype(np.uint64)
    mantissa = ((rest << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    out[bucket[first]] = (zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    return out


def filled(sketches: np.ndarray) -> np.ndarray:
    """Registers for banding: an empty bucket takes the value of the first non-empty one in an order of its own."""
    out, n = sketches.copy(), sketches.shape[1]
    empty = sketches == EMPTY
    live = ~empty.all(1)
    attempt = 0
    while (todo := empty & live[:, None]).any():
        attempt += 1
        pick = (mix(np.arange(n, dtype=np.uint64) * _STEP + np.uint64(attempt)) % np.uint64(n)).astype(np.int64)
        got = sketches[:, pick]
        use = todo & (got != EMPTY)
        out[use] = got[use]
        empty &= ~use
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    full = filled(sketches).astype(np.uint64)
    keys = np.zeros((len(full), BANDS), np.uint64)
    for k in range(ROWS):
        keys = keys * _GROW + full[:, k : BANDS * ROWS : ROWS] + np.uint64(1)
    return mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP).astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate, number of buckets it rests on) from registers and set sizes: equal registers, less those that
    different sets of these sizes share by chance, over the buckets that either fills."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(1)
    big, small = np.maximum(n, m).astype(float), np.minimum(n, m).astype(float)
    ratio = big / np.maximum(small, 1)
    chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    count = np.maximum(used.sum(1), 1)
    return (same - chance) / count, count


def _sketch(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sketch", pa.binary())])
    for batch in batches:
        sets = list(shingle_sets(batch.column("text")))
        n = np.array([len(s) for s in sets], np.int64)
        total = lambda salt: np.array([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
        columns = [batch.column("doc_id"), batch.column("print"), pa.array(n), pa.array(total(0x51)), pa.array(total(0xA7C3)), pa.array([registers(s).tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _bands(batches):
    for batch in batches:
        if batch.num_rows:
            sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, 1 << BUCKET_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), BANDS)), pa.array(band_keys(sketches).ravel())], ["id", "key"])


def _near(percent: int):
    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                side = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, 1 << BUCKET_BITS)
                n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                j, count = estimate(side("sa"), side("sb"), n, m)
                low = percent / 100 - SLACK * np.sqrt(percent / 100 * (1 - percent / 100) / count)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(j >= low))

    return keep


def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())], ["id", "shingles"])


def _linked(percent: int):
    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _sets_of(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, sorted shingle hashes) of the texts of docs(doc_id, print, text) that chosen(id, first), a written table, names."""
    wanted = chosen.select("id", F.col("first.doc_id").alias("own"), F.col("first.print").alias("own_print"))
    here = checked(wanted)
    texts = docs.join(here, docs["doc_id"].eqNullSafe(here["own"]) & (docs["print"] == here["own_print"])).select("id", "text")
    sets = written(texts.mapInArrow(_sets, "id long, shingles binary"))
    return written(sets.dropDuplicates(["id"])) if sets.count() > chosen.count() else sets  # rows may repeat


def _verified(pairs: DataFrame, chosen: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the estimate and then the comparison of their full sets."""
    side = lambda s: chosen.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    close = F.col("na") * 100 >= F.col("nb") * percent
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(close & (F.col("nb") * 100 >= F.col("na") * percent))
    near = written(near.mapInArrow(_near(percent), "a long, b long"))
    both = checked(near).join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    out = written(both.mapInArrow(_linked(percent), "a long, b long"))
    discard(near)
    return out


def _exploded(batches):
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
        if sets:
            size = np.array([len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), size)), pa.array(np.concatenate(sets))], ["id", "shingle"])


def _across(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents in different components that may be linked; mixed: (id, n, component).

    A link takes percent of the larger set, so it shows among each side's rarest shingles, one more than a link may lack.
    Shingles of one document only meet nothing: they just use up their document's share of rare ones. As both sides are in
    one order, a meeting at place i of n leaves at most n - i common shingles: it counts where that is enough for a link.
    """
    rows = sets.mapInArrow(_exploded, "id long, shingle long")  # read twice: cheaper than a table of all shingles
    often = rows.groupBy("shingle").agg(F.count("*").alias("f")).where("f > 1")
    rare = rows.join(often, "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("known"))
    rare = rare.join(mixed, "id").withColumn("alone", F.col("n") - F.size("known")).withColumn("share", F.expr(f"int(n - ceil(n * {percent} / 100.0) + 1 - alone)"))
    rare = rare.where("share > 0").select("id", "n", "component", "alone", F.posexplode(F.expr("slice(known.shingle, 1, share)")).alias("place", "shingle"))
    rare = written(rare.select("shingle", "id", "n", "component", (F.col("n") - F.col("alone") - F.col("place")).alias("left")))
    # only where the group has documents small enough for what is left, and of two components
    least = rare.groupBy("shingle").agg(F.min("n").alias("least"), F.count("*").alias("f")).where("f > 1").drop("f")
    able = written(rare.join(least, "shingle").where((100 + percent) * F.col("left") >= percent * (F.col("n") + F.col("least"))).drop("least"))
    spread = able.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("shingle")
    able = able.join(spread, "shingle", "left_semi")
    second = able.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "component", "left")))
    fit = (100 + percent) * F.least("left", "left2") >= percent * (F.col("n") + F.col("n2"))
    return able.join(second, "shingle").where(fit).where("id < id2 AND component != component2").select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept; print, stays.

    Documents are linked where 100 * |intersection| >= percent * |union| of their distinct 5-word shingles; component_id is
    the smallest doc_id reachable over links, kept says that it is the document's own. Null and empty texts, and texts
    without words, have no shingles and stand alone. A document is a row: texts that share an id are told apart, repeated
    rows get a row each, and a null id only names a component where nothing else is there. print is the hash of the text;
    stays marks one text of each component (repeated rows alike), the smallest id's, and every text without words. Other
    columns are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_print().alias("print"), "text")
    rows = written(docs.mapInArrow(_sketch, "doc_id long, print long, n long, k1 long, k2 long, sketch binary"))
    same = ["n", "k1", "k2"]
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    reps = rows.where("n > 0").groupBy(*same).agg(F.min(place).alias("first"), F.min("sketch").alias("sketch"))
    reps = written(reps.withColumn("id", F.monotonically_increasing_id()))
    bands = written(reps.select("id", "sketch").mapInArrow(_bands, "id long, key long"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(bands.join(sizes, "key"))
    discard(bands)
    degree = written(shared.groupBy("id").agg(F.sum("size").alias("degree")))
    chosen = written(reps.join(checked(degree), "id").select("id", "n", "first", "sketch", "degree"))
    discard(degree)
    members = written(shared.drop("size").join(chosen.select("id", "n", "degree"), "id"))
    discard(shared)
    first = lambda *order: F.min(F.struct(*order, F.col("id").alias("leader")))["leader"]
    leaders = members.groupBy("key").agg(first(-F.col("degree")).alias("central"), first(F.xxhash64("id", "key")).alias("other"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = members.join(leaders, "key").select("id", F.explode(F.array("central", "other")).alias("leader")).where("id != leader").select(*pair(F.col("id"), F.col("leader"))).distinct()
    sets = _sets_of(chosen, docs)
    links = _verified(star, chosen, sets, percent)
    labels = components(links)
    # links the stars may have missed: members of one bucket that are in different components
    named = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spread = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    mixed = written(named.join(spread, "key", "left_semi").select("id", "n", "component").distinct())
    discard(members)
    more = _verified(_across(mixed, sets.join(checked(mixed.select("id")), "id", "left_semi"), percent), chosen, sets, percent)
    discard(sets, chosen, mixed)
    if more.limit(1).count():
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    linked = labels.unionByName(labels.select(F.col("component").alias("id"), "component").distinct())
    heads = linked.join(reps.select("id", "first"), "id").groupBy("component").agg(F.min("first").alias("head"))
    heads = written(linked.join(heads, "component").select("id", "head"))
    classes = reps.select(*same, "id", "first").join(checked(heads), "id", "left").select(*same, F.coalesce("head", "first").alias("head"))
    out = rows.select("doc_id", "print", *same).join(classes, same, "left")
    component = F.when(F.col("n") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "print", ((F.col("n") == 0) | (place == F.col("head"))).alias("stays"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
