"""Queries on tables kept by key and on the resumable ingest stream, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loam.operators import chunks as K
from loam.operators import vectors as V
from loam.plans.common import table
from loam.plans.corpus_queries import CHUNKS, articles
from loam.plans.registry import query
from loam.sources.keyed import KeyedTable
from loam.streaming import ingest as I
from loam.sources.storage import shared_dir


class Stopped(Exception):
    """What ends a run on purpose."""


def folder(spark) -> str:
    return f"{shared_dir(spark)}/loam/{uuid.uuid4().hex}"


@query("""SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN n_chars + 2 WHEN doc_id % 2 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents
UNION ALL SELECT -doc_id, 'second', 0 FROM documents WHERE doc_id % 2 = 0 AND doc_id > 0""")
def k1_keyed_runs(spark, d):
    """Two runs, of which one overtakes the other between its reading and its commit, a run that fails in its rows, and a replay."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    kept = KeyedTable(spark, folder(spark), ["doc_id"], docs.schema, 16)
    kept.upsert(docs, "first")
    twos = docs.where("doc_id % 2 = 0")
    second = twos.withColumn("n_chars", F.col("n_chars") + 1).unionByName(twos.where("doc_id > 0").select((-F.col("doc_id")).alias("doc_id"), F.lit("second").alias("source"), F.lit(0).alias("n_chars")))
    third = docs.where("doc_id % 3 = 0").withColumn("n_chars", F.col("n_chars") + 2)
    kept._commit = _overtaken(kept, lambda: KeyedTable(spark, kept.path, kept.key, kept.schema, kept.buckets).upsert(second, "second"))
    kept.upsert(third, "third")
    try:
        kept.upsert(docs.withColumn("source", F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("stopped")))), "failed")
    except Exception as e:
        if "stopped" not in str(e):
            raise
    kept.upsert(second, "second")
    return kept.read()


def _overtaken(kept: KeyedTable, other):
    commit, todo = kept._commit, [other]

    def late(manifest):
        if todo:
            todo.pop()()
        return commit(manifest)

    return late


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, len(embedding) AS width, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 5 <> 0
UNION ALL SELECT vec_id, label, 64, NULL FROM embeddings WHERE vec_id % 5 = 0""")
def k6_keyed_refresh(spark, d):
    """Points whose payload is refreshed keep their vectors; points that the table lacks are embedded."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    points = KeyedTable(spark, folder(spark), ["vec_id"], rows.schema, 16)
    points.upsert(rows.where("vec_id % 5 <> 0"), "load")
    points.refresh(rows.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label")), ["label"], "refresh")
    fresh = rows.select("vec_id", "label", F.concat(F.lit("point "), "vec_id").alias("text")).join(points.read().select("vec_id"), "vec_id", "left_anti")
    points.insert_new(V.embedded(fresh, V.hashing_embedder()).drop("text"), "embed")
    first = F.when(F.col("vec_id") % 5 != 0, F.round(F.col("embedding")[0].cast("double"), 6))
    return points.read().select("vec_id", "label", F.size("embedding").cast("long").alias("width"), first.alias("first"))


@query(f"WITH {CHUNKS} SELECT chunk_id, 64 AS width FROM chunks")
def m6_resumed_ingest(spark, d):
    """The ingest stream, stopped after its second micro-batch and started again: every chunk is a point, by its key."""
    base = folder(spark)
    K.chunk_articles(articles(spark, d)).repartition(4, "chunk_id").write.parquet(f"{base}/chunks")
    rows = spark.readStream.schema(spark.read.parquet(f"{base}/chunks").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/chunks")
    points = KeyedTable(spark, f"{base}/points", ["point_id"], I.point_schema(spark.read.parquet(f"{base}/chunks")), 16)
    progress = KeyedTable(spark, f"{base}/progress", ["batch", "part", "slice"], I.PROGRESS, 4)
    insert = points.insert_new

    def stopping(changes, run):
        if run == "ingest-2":
            raise Stopped
        return insert(changes, run)

    points.insert_new = stopping
    try:
        I.ingest(rows, points, progress, V.hashing_embedder(), f"{base}/state").awaitTermination()
    except Exception as e:
        if "Stopped" not in str(e):
            raise
    points.insert_new = insert
    I.ingest(rows, points, progress, V.hashing_embedder(), f"{base}/state").awaitTermination()
    return points.read().select("chunk_id", F.size("embedding").cast("long").alias("width"))


@query(f"WITH {CHUNKS} SELECT count(*) AS chunks, true AS bounded FROM chunks")
def k7_progress_marks(spark, d):
    """The progress rows of the ingest of all chunks: none of more than a hundred, all of them together everything."""
    base = folder(spark)
    K.chunk_articles(articles(spark, d)).write.parquet(f"{base}/chunks")
    schema = spark.read.parquet(f"{base}/chunks").schema
    points, progress = KeyedTable(spark, f"{base}/points", ["point_id"], I.point_schema(spark.read.parquet(f"{base}/chunks")), 16), KeyedTable(spark, f"{base}/progress", ["batch", "part", "slice"], I.PROGRESS, 4)
    I.ingest(spark.readStream.schema(schema).parquet(f"{base}/chunks"), points, progress, V.hashing_embedder(), f"{base}/state").awaitTermination()
    return progress.read().agg(F.sum("chunks").alias("chunks"), (F.max("chunks") <= V.BATCH).alias("bounded"))
