"""Hard-negative mining with an STR-packed R-tree (operator 13).

All rows are packed into a tree of three levels by sort-tile-recursive order: by label and then by coordinates, into parts of
about PART rows (two range shuffles) and, inside a part, into pages of PAGE rows. A node holds its minimum bounding box, and
the box gives an interval for the inner product with an anchor, coordinate by coordinate: a positive component meets the
box's ends as they are, a negative one the other way round. A box is left out where its labels or its interval are outside of
what is asked for; the others are queued, best upper bound first, and the queue ends at a box strictly below the k-th score.

Anchors are a stated query set, and meet the tree in blocks: a part's pages and a block of the anchors that reach it are a
task, which passes on k rows for an anchor. First come the positives, then the score windows that follow from them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam.llm.common import discard, table, written

#: Rows in a page and in a part, parts whose boxes are looked at in one task, and anchors in a block.
PAGE, PART, DIRECTORY, BLOCK = 256, 8192, 1024, 4096
#: Coordinates, those of the widest spread, by which the pages of a part are tiled, after the label.
TILED = 3
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's share of the positive's score, in hundredths.
LOW, HIGH = 50, 95
SCALE = 256
_NODE = "part int, vecs binary, ids binary, uids binary, labels binary, lo binary, hi binary, label_lo long, label_hi long"


def usable(rows: DataFrame) -> DataFrame:
    """(uid, vec_id, label, vec) of the rows that take part: vec holds whole numbers, in doubles; uid numbers the rows."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    down = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  a larger double is whole
    vec = F.transform("embedding", lambda x: down(SCALE * x.cast("double")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    return kept.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vec.alias("vec"))


def matrix(vectors: list[np.ndarray], width: int = 0) -> np.ndarray:
    """Vectors as rows, the shorter ones filled up with zeros, which add nothing to an inner product."""
    out = np.zeros((len(vectors), max([width, *map(len, vectors)])))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def same_width(*arrays: np.ndarray) -> list[np.ndarray]:
    width = max(a.shape[1] for a in arrays)
    arrays = [np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in arrays]
    most = [float(np.abs(a).max(initial=0)) for a in arrays]
    if most[0] * max(most[1:]) * max(width, 1) < 2.0**53:
        return arrays  # products and sums are exact in doubles
    whole = np.vectorize(int, otypes=[object])
    return [whole(a) if a.size else a.astype(object) for a in arrays]


def interval(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest inner product of each anchor with what may be in each box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


def pages(labels: np.ndarray, vectors: np.ndarray, size: int = PAGE) -> list[np.ndarray]:
    """Row numbers of each page: sort-tile-recursive by label and the coordinates of the widest spread."""
    spread = vectors.var(0) if len(vectors) else np.zeros(0)
    keys = [labels, *(vectors[:, c] for c in np.argsort(-spread, kind="stable")[:TILED])]

    def tile(rows: np.ndarray, level: int) -> list[np.ndarray]:
        if len(rows) <= size:
            return [rows]
        left = len(keys) - level
        rows = rows[np.argsort(keys[level][rows], kind="stable")]
        count = -(-len(rows) // size)
        slab = size * (-(-count // max(2, round(count ** (1 / left)))) if left > 1 else 1)
        parts = [rows[k : k + slab] for k in range(0, len(rows), slab)]
        return parts if left == 1 else [p for part in parts for p in tile(part, level + 1)]

    return tile(np.arange(len(labels)), 0) if len(labels) else []


def _packed(batches):
    """A partition as pages; then the box of the whole part, without rows."""
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    rows = pa.concat_tables(tables)
    ids, uids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "uid", "label"))
    vectors = matrix([np.asarray(v.values) for chunk in rows.column("vec").chunks for v in chunk])
    out = [(p, vectors[p].tobytes(), ids[p].tobytes(), uids[p].tobytes(), labels[p].tobytes()) for p in pages(labels, vectors)]
    out.append((np.arange(len(ids)), None, None, None, None))
    part = rows.column("part")[0].as_py()
    for p, *held in out:
        box = vectors[p].min(0).tobytes(), vectors[p].max(0).tobytes(), int(labels[p].min()), int(labels[p].max())
        kinds = (pa.int32(), *[pa.binary()] * 6, pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, *held, *box), kinds, strict=True)], [f.split()[0] for f in _NODE.split(", ")])


def tree(rows: DataFrame, part: int = PART) -> DataFrame:
    """The nodes of the tree over rows(uid, vec_id, label, vec), a written table: pages, and a part's box with null vecs."""
    parts = max(1, -(-rows.count() // part))
    slabs = int(np.ceil(np.sqrt(parts)))
    first = lambda k: F.when(F.size("vec") > k, F.col("vec")[k])
    dealt = rows.repartitionByRange(slabs, "label", first(0), "uid").withColumn("slab", F.spark_partition_id())
    dealt = written(dealt).repartitionByRange(parts, "slab", first(1), "uid").withColumn("part", F.spark_partition_id())
    return written(dealt.select("part", "uid", "vec_id", "label", "vec").mapInArrow(_packed, _NODE))


def _doubles(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.float64) for x in column]


def _boxes(nodes: pa.Table) -> tuple[np.ndarray, ...]:
    lo, hi = matrix(_doubles(nodes.column("lo"))), matrix(_doubles(nodes.column("hi")))
    return lo, hi, nodes.column("label_lo").to_numpy(), nodes.column("label_hi").to_numpy()


def _vectors(anchors: pa.Table) -> np.ndarray:
    return matrix([np.asarray(v.values) for chunk in anchors.column("vec").chunks for v in chunk])


def _windows(anchors: pa.Table) -> list[list[tuple[int, int, int]]]:
    """(number of the positive, least score, largest score) for each anchor's positives; empty windows are left out."""
    spans = [[(w["k"], -(-w["score"] * LOW // 100), w["score"] * HIGH // 100) for w in held] for held in anchors.column("positives").to_pylist()]
    return [[w for w in held if w[1] <= w[2]] for held in spans]


def _reaches(anchors: pa.Table, nodes: pa.Table, negative: bool) -> tuple[np.ndarray, np.ndarray]:
    """(whether a node can hold what an anchor looks for, upper bounds), anchors by nodes."""
    lo, hi, label_lo, label_hi = _boxes(nodes)
    vectors, lo, hi = same_width(_vectors(anchors), lo, hi)
    lower, upper = interval(vectors, lo, hi)
    own = anchors.column("label").to_numpy()[:, None]
    if not negative:
        return (label_lo <= own) & (own <= label_hi), upper
    inside = np.zeros(upper.shape, bool)
    for row, spans in enumerate(_windows(anchors)):
        for _, least, most in spans:
            inside[row] |= (upper[row] >= least) & (lower[row] <= most)
    return inside & ~((label_lo == own) & (label_hi == own)), upper


def _best(held: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id), score first, then the smaller id."""
    if len(scores) > k:
        at = np.argpartition(-scores.astype(np.float64), k - 1)
        near = scores >= scores[at[k - 1]]  # ties are settled by id
        scores, ids = scores[near], ids[near]
    return sorted([*held, *zip(map(int, scores), map(int, ids), strict=True)], key=lambda x: (-x[0], x[1]))[:k]


def _search(negative: bool, many: int) -> Callable:
    def run(key: tuple, nodes: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if nodes.num_rows and anchors.num_rows:
            reach, upper = _reaches(anchors, nodes, negative)
            page = [tuple(np.frombuffer(nodes.column(c)[i].as_buffer(), np.int64) for c in ("ids", "uids", "labels")) for i in range(nodes.num_rows)]
            flat = _doubles(nodes.column("vecs"))
            vectors, *data = same_width(_vectors(anchors), *(f.reshape(len(p[0]), -1) for f, p in zip(flat, page, strict=True)))
            windows = _windows(anchors) if negative else [[(0, None, None)]] * anchors.num_rows
            for row, (uid, label) in enumerate(zip(anchors.column("uid").to_pylist(), anchors.column("label").to_pylist(), strict=True)):
                held = [[] for _ in windows[row]]
                order = np.flatnonzero(reach[row])
                for node in order[np.argsort(-upper[row][order].astype(np.float64), kind="stable")]:
                    # the largest scores that may still count, by window; a full one ends at its k-th score
                    floors = [h[-1][0] if len(h) == many else least for h, (_, least, _) in zip(held, windows[row], strict=True)]
                    if None not in floors and upper[row, node] < min(floors):
                        break
                    ids, uids, labels = page[node]
                    scores = data[node] @ vectors[row]
                    fit = labels != label if negative else (labels == label) & (uids != uid)
                    for w, (floor, (_, least, most)) in enumerate(zip(floors, windows[row], strict=True)):
                        good = fit if floor is None else fit & (scores >= floor)
                        good = good if most is None else good & (scores <= most)
                        if good.any():
                            held[w] = _best(held[w], scores[good], ids[good], many)
                out += [(uid, k, score, i) for (k, _, _), h in zip(windows[row], held, strict=True) for score, i in h]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["uid", "k", "score", "id"])

    return run


def _found(nodes: DataFrame, anchors: DataFrame, blocks: int, negative: bool, many: int) -> DataFrame:
    """(uid, k, score, id, rank) of anchors(uid, label, vec, positives, block): the first `many` for each uid and k."""
    lots = max(1, -(-nodes.where("vecs IS NULL").count() // DIRECTORY))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    def route(key: tuple, boxes: pa.Table, asked: pa.Table) -> pa.Table:
        if not boxes.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int64())], ["part", "uid"])
        at, node = np.nonzero(_reaches(asked, boxes, negative)[0])
        return pa.table([boxes.column("part").take(pa.array(node)), asked.column("uid").take(pa.array(at))], ["part", "uid"])

    directory = nodes.where("vecs IS NULL").select(F.pmod("part", F.lit(lots)).alias("lot"), each(blocks, "block"), "part", "lo", "hi", "label_lo", "label_hi")
    reached = directory.groupBy("lot", "block").cogroup(anchors.select(each(lots, "lot"), "block", "uid", "label", "vec", "positives").groupBy("lot", "block")).applyInArrow(route, "part int, uid long")
    asked = anchors.join(reached, "uid")
    held = nodes.where("vecs IS NOT NULL").select("*", each(blocks, "block"))
    found = held.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(_search(negative, many), "uid long, k long, score long, id long")
    rank = F.row_number().over(Window.partitionBy("uid", "k").orderBy(F.desc("score"), "id"))
    return written(found.withColumn("rank", rank).where(F.col("rank") <= many))


def hard_negatives(rows: DataFrame, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows(vec_id, embedding, label).

    Rows with a null label, vector or component, or one that is not finite, take no part, nor do rows without vec_id, which
    could not be named. Anchors are rows with vec_id divisible by 50; the positives of one are the 5 best other rows of its
    label, its negatives for one positive the 3 best rows of other labels with 50 to 95 hundredths of the positive's score, by
    inner product of the vectors times 256, rounded down; equal scores in the order of vec_id. Rows that repeat are rows of
    their own, also as anchors. Where vectors differ in length, missing components are zero. Scores beyond 64 bits are an
    error. Other columns are not read; an empty table, or one without anchors, gives an empty result.
    """
    data = written(usable(rows))
    nodes = tree(data, part)
    anchors = data.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    blocks = max(1, -(-anchors.count() // block))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    none = F.lit(None).cast("array<struct<k:long,score:long>>").alias("positives")
    positives = _found(nodes, anchors.select("*", none), blocks, False, POSITIVES)
    windows = positives.groupBy("uid").agg(F.collect_list(F.struct(F.col("rank").cast("long").alias("k"), "score")).alias("positives"))  # POSITIVES each
    negatives = _found(nodes, anchors.join(windows, "uid"), blocks, True, NEGATIVES)
    discard(nodes)
    of = positives.select("uid", F.col("rank").cast("long").alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.select("uid", "k", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["uid", "k"])
    return out.join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


#: The same by scoring every anchor against every row.
OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.uid, a.vec_id AS anchor_id, v.vec_id AS id, v.label = a.label AS same, list_dot_product(a.e, v.e)::BIGINT AS score
  FROM v a JOIN v ON v.uid <> a.uid WHERE a.vec_id % 50 = 0),
p AS (SELECT uid, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.uid, p.k ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.uid = p.uid AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
  QUALIFY rank <= 3)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n"""
