"""Pieces that several operators share: shared storage, checked broadcasts, row keys, components, ASCII case folding."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources.storage import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows that may be broadcast, of a few numbers each; a larger side is joined by shuffling.
BROADCAST_ROWS = 1 << 19
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Bound the documents in one Arrow batch, so that a worker's memory does not depend on how long they are on average, for
    what runs inside the block; the session's setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, batch: int = 256) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and is not computed twice. batch:
    rows in an Arrow batch meanwhile; documents may be long."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loam/{uuid.uuid4().hex}"
    with small_batches(spark, batch):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing reads any more: all that came from them is written itself."""
    for df in tables:
        if path := _folders.pop(df, None):
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has at most that many rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like that one which df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_print(df: DataFrame | None = None) -> Column:
    """64-bit hash of the text, null as empty: with doc_id it names a row's content."""
    return F.xxhash64(F.coalesce(df["text"] if df is not None else F.col("text"), F.lit("")))


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose id and text are those of dropped(doc_id, print); null ids count as equal. All columns."""
    gone = checked(written(dropped.select(F.col("doc_id").alias("gone_id"), F.col("print").alias("gone_print")).distinct()))
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (text_print(docs) == gone["gone_print"])
    return docs.join(gone, same, "left_anti")


def ascii_lower(text):
    """A-Z to a-z; no other character changes."""
    return F.translate(text, UPPER, UPPER.lower())


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def held_out(remainder: int, parts: int = 5):
    """True where crc32 of doc_id as text has that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) by alternating large and small stars, each a grouped minimum and an equi-join.

    Returns (id, component) for every vertex that is not the smallest of its component. The edges stay distributed; each
    round is a checkpoint, and the number of rounds grows with the logarithm of the longest path.
    """
    shared_dir(edges.sparkSession)
    a, b = F.col("a"), F.col("b")
    e = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().transform(written)
    mark = None
    while True:
        seen = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = seen
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        last, e = e, small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().transform(written)
        discard(last)
