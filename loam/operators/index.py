"""An index for similarity search: inverted lists around centres, exact scores inside the lists that a query probes.

The centres are fitted on a bounded sample (SAMPLE rows, in the order of a hash of the id); every row is put into the list of
its nearest centre. The lists are dealt out once, when they are written: a file folder for each lot of lists, and a list of more
than LIST_BLOCK rows in blocks. A search sends each query to its `probes` nearest centres, meets the blocks of those lists only,
and keeps the k best of their exact cosines; with all lists probed it is the exact search.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loam.operators.vectors import QUERY_BLOCK, _nearest, as_matrix, unit

#: Numbers that a task holds at a time where it looks for the lists of rows.
CELLS = 4_000_000
#: Rows that centres are fitted on, rounds of the fit, the most lists, and the rows of a list that are in one block.
SAMPLE, ROUNDS, MOST_LISTS, LIST_BLOCK = 20_000, 8, 4096, 50_000


@dataclass
class ListIndex:
    """centres: lists by dimensions; rows: the points with list and block, as written; sizes: (list, blocks), at most MOST_LISTS rows."""

    centres: np.ndarray
    rows: DataFrame
    sizes: DataFrame


def fitted_centres(points: DataFrame, lists: int, point: str = "point_id", sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on at most `sample` rows; a list that loses all rows keeps its centre."""
    rows = points.select(point, "embedding").orderBy(F.xxhash64(point), point).limit(sample).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0))
    vectors = unit(as_matrix(rows.column("embedding"), len(rows.column("embedding")[0])))
    centres = vectors[:lists].copy()
    for _ in range(rounds):
        near = np.argmax(vectors @ centres.T, axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = vectors[near == c].sum(0)
        centres = unit(centres)
    return centres


def _in_slices(b: pa.RecordBatch, centres: np.ndarray, probes: int, cells: int = CELLS):
    """Batches of the rows with list, from slices of b: at most `cells` scores, and numbers of copied vectors, at a time (or one row's)."""
    lists, width = centres.shape
    step = max(1, cells // max(lists, min(probes, lists) * (width + 1)))
    for start in range(0, b.num_rows, step):
        t = pa.Table.from_batches([b.slice(start, step)])
        scores = unit(as_matrix(t.column("embedding"), width)) @ centres.T
        near = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
        t = t.take(pa.array(np.repeat(np.arange(t.num_rows), near.shape[1])))
        yield from t.append_column("list", pa.array(near.ravel().astype(np.int32))).to_batches()


def _near_lists(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """rows with list, once for each of the `probes` nearest centres; centres are bounded by MOST_LISTS."""

    def run(batches):
        for b in batches:
            yield from _in_slices(b, centres, probes)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())]))


def built(points: DataFrame, path: str, lists: int | None = None, point: str = "point_id", sample: int = SAMPLE, block: int = LIST_BLOCK) -> ListIndex:
    """Index points(point_id, embedding, ...) under path, a folder that driver and executors share. lists: four times the
    square root of the number of points if not given. Points without a vector are not indexed."""
    points = points.where(F.col("embedding").isNotNull())
    lists = min(MOST_LISTS, lists or max(1, 4 * math.isqrt(points.count())))
    centres = fitted_centres(points, lists, point, sample)
    spark = points.sparkSession
    placed = _near_lists(points, centres, 1) if len(centres) else points.withColumn("list", F.lit(0))
    salt = F.pmod(F.xxhash64(point), F.lit(64)).alias("_salt")
    placed.select("*", salt).repartition("list", "_salt").drop("_salt").write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes.write.mode("overwrite").parquet(f"{path}/sizes")
    return ListIndex(centres, rows, spark.read.schema("list int, blocks int").parquet(f"{path}/sizes"))


def search(index: ListIndex, queries: DataFrame, k: int, probes: int, point: str = "point_id", query: str = "query_id", exclude_self: bool = False) -> DataFrame:
    """The k best points of the `probes` lists nearest to each query: columns as vectors.top_similar, with the same filters.

    A list's block meets the queries that probe its list, in blocks of QUERY_BLOCK; only probed lists are read on.
    """
    payload = [f for f in index.rows.schema.fields if f.name not in ("embedding", "list")]
    shape = T.StructType([*payload, T.StructField(query, queries.schema[query].dataType), T.StructField("cosine", T.DoubleType())])
    if not len(index.centres):
        return queries.sparkSession.createDataFrame([], T.StructType([*shape.fields, T.StructField("pos", T.IntegerType())]))
    rows = index.rows.join(F.broadcast(index.sizes), "list").withColumn("block", F.pmod(F.xxhash64(point), F.col("blocks")).cast("int")).drop("blocks")
    asked = _near_lists(queries, index.centres, probes)
    many = -(-queries.count() // QUERY_BLOCK) or 1
    asked = asked.withColumn("part", F.pmod(F.xxhash64(query), F.lit(many)).cast("int")).join(F.broadcast(index.sizes), "list")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    if many == 1:  # then the probed lists are a row a list at most
        rows = rows.join(F.broadcast(asked.select("list").distinct()), "list", "left_semi").withColumn("part", F.lit(0))
    else:
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    near = _nearest(k, point, query, exclude_self)
    drop = ["list", "block", "part"]

    def meet(key: tuple, some: pa.Table, wanted: pa.Table) -> pa.Table:
        return near(some.drop_columns(drop), wanted.drop_columns(drop).sort_by(query).to_pydict(), wanted.schema.field(query).type)

    found = rows.groupBy("list", "block", "part").cogroup(asked.groupBy("list", "block", "part")).applyInArrow(meet, shape)
    order = Window.partitionBy(query).orderBy(F.desc("cosine"), point)
    return found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def recall(found: DataFrame, exact: DataFrame, point: str = "point_id", query: str = "query_id") -> DataFrame:
    """(queries, recall): the share of the exact hits that were found, over all queries."""
    hit = exact.select(query, point).join(found.select(query, point, F.lit(1).alias("hit")), [query, point], "left")
    return hit.agg(F.countDistinct(query).alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
