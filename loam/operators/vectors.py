"""Embedding chunks, keeping points by key, and exact similarity search for many queries at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BATCH = 100
#: Queries and points that meet in one task.
QUERY_BLOCK, POINT_PART = 2000, 50_000
#: Points that are scored at a time in a task.
TILE = 2048


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder for tests: signed counts of hashed words, at unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embedded(rows: DataFrame, embed: Callable[[list[str]], np.ndarray], text: str = "text", batch: int = BATCH) -> DataFrame:
    """rows with a column embedding; embed gets lists of at most batch texts. Retries are Spark's, back-off is the embedder's."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            vectors = [v for a in range(0, len(texts), batch) for v in embed(texts[a : a + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32()))], [*b.schema.names, "embedding"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def synced(points: DataFrame, payload: DataFrame, embed, text: str = "text") -> DataFrame:
    """payload with vectors: known point ids keep theirs, only new ones are embedded."""
    have = points.select("point_id", "embedding")
    known = payload.join(have, "point_id")
    return known.unionByName(embedded(payload.join(have.select("point_id"), "point_id", "left_anti"), embed, text))


def top_similar(points: DataFrame, queries: DataFrame, k: int, point: str = "point_id", query: str = "query_id", exclude_self: bool = False) -> DataFrame:
    """The k points nearest to each query by cosine: columns of points but the vector, and query_id, cosine, pos (1 to k).

    queries: query_id, embedding, and optionally version, category (null: any) and min_tier, against the points' versions,
    category and tier. A version of "all", "any" or "" asks for any. Ties go to the smaller point id. Points are dealt into parts,
    queries into blocks, of bounded size; each pair of part and block meets in one task, which keeps the k best for each query,
    so k rows for a query and part go on, not all pairs. Nothing passes through the driver.
    """
    payload = [f for f in points.schema.fields if f.name != "embedding"]
    shape = T.StructType([*payload, T.StructField(query, queries.schema[query].dataType), T.StructField("cosine", T.DoubleType())])
    blocks, parts = -(-queries.count() // QUERY_BLOCK) or 1, max(points.sparkSession.sparkContext.defaultParallelism, -(-points.count() // POINT_PART))
    number = lambda df, key, n: df.withColumn(key[0], F.pmod(F.xxhash64(key[1]), F.lit(n)).cast("int"))
    left = number(points, ("_part", point), parts).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = number(queries, ("_block", query), blocks).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    search = _nearest(k, point, query, exclude_self)

    def meet(key: tuple[pa.Scalar, ...], some: pa.Table, asked: pa.Table) -> pa.Table:
        return search(some.drop_columns(["_part", "_block"]), asked.drop_columns(["_part", "_block"]).sort_by(query).to_pydict(), asked.schema.field(query).type)

    found = left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(meet, shape)
    order = Window.partitionBy(query).orderBy(F.desc("cosine"), point)
    return found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def as_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate([np.zeros(0), *flat]).reshape(len(column), width)


def _fits(rows: pa.Table, want: tuple) -> np.ndarray:
    """Which rows a (version, category, min_tier) allows; null: any."""
    mask = lambda values: np.fromiter(values, bool, rows.num_rows)  # noqa: E731  also of no rows
    ok, (version, category, tier) = np.ones(rows.num_rows, bool), want
    if version is not None:
        ok &= mask(bool(v) and (version in v or "all" in v) for v in rows.column("versions").to_pylist())
    if category is not None:
        ok &= mask(c == category for c in rows.column("category").to_pylist())
    if tier is not None:
        ok &= mask(t is not None and t >= tier for t in rows.column("tier").to_pylist())
    return ok


def _nearest(k: int, point: str, query: str, exclude_self: bool):
    """The k best rows of a table for each query: in tiles of TILE rows, so that the scores held at a time are queries by TILE."""

    def run(b: pa.Table, asked: dict, kind: pa.DataType) -> pa.Table:
        n = len(asked[query])
        width = max([0, *(len(v) for v in asked["embedding"][:1])])
        matrix = unit(np.array(asked["embedding"], np.float64).reshape(n, width))
        b = (b if n else b.slice(0, 0)).sort_by(point)  # ties are settled by id: the first row wins
        ids = b.column(point).to_pylist()
        none = [None] * n
        wanted: dict[tuple, list[int]] = {}
        for q, (v, c, t) in enumerate(zip(asked.get("version", none), asked.get("category", none), asked.get("min_tier", none), strict=True)):
            wanted.setdefault((None if str(v or "").lower() in ("", "all", "any") else v, c, t), []).append(q)
        row, of, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, b.num_rows, TILE):
            tile = b.slice(start, TILE)
            scores = matrix @ unit(as_matrix(tile.column("embedding"), width)).T
            for want, those in wanted.items():
                if want != (None, None, None):
                    scores[np.ix_(those, ~_fits(tile, want))] = -np.inf
            if exclude_self:
                own: dict = {}
                for i, name in enumerate(ids[start : start + TILE]):
                    own.setdefault(name, []).append(i)
                for q, name in enumerate(asked[query]):
                    scores[q, own.get(name, [])] = -np.inf
            least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(n, -np.inf)
            q, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            row, of, value = np.concatenate((row, at + start)), np.concatenate((of, q)), np.concatenate((value, scores[q, at]))
            order = np.lexsort((row, -value, of))
            row, of, value = row[order], of[order], value[order]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            row, of, value = row[place < k], of[place < k], value[place < k]
        kept = b.drop_columns(["embedding"]).take(pa.array(row, pa.int64()))
        kept = kept.append_column(query, pa.array([asked[query][q] for q in of], kind))
        return kept.append_column("cosine", pa.array(value, pa.float64()))

    return run
