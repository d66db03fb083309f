"""The ingest job as a stream: a micro-batch embeds what the table of points lacks, puts it in by key, and marks its progress.

A micro-batch is applied to each table under its own number, once: one that is replayed after a stop between the table and the
stream's checkpoint finds itself applied and embeds nothing. What an earlier micro-batch has put in is not embedded again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.operators import chunks as K
from loam.operators import vectors as V
from loam.sources.keyed import KeyedTable

PROGRESS = "batch long, part int, slice long, chunks long, first_id string, last_id string"


def point_schema(chunks: DataFrame) -> T.StructType:
    return T.StructType([*K.payloads(chunks).schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])


def marks(chunk_ids: DataFrame, number: int, batch: int = V.BATCH) -> DataFrame:
    """PROGRESS rows of a micro-batch, one for each `batch` chunks of a partition."""
    place = F.monotonically_increasing_id()
    rows = chunk_ids.sortWithinPartitions("chunk_id").select("chunk_id", F.shiftright(place, 33).cast("int").alias("part"), F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / batch).alias("slice"))
    return rows.groupBy(F.lit(number).cast("long").alias("batch"), "part", "slice").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"))


def ingest(chunks: DataFrame, points: KeyedTable, progress: KeyedTable, embed: Callable[[list[str]], np.ndarray], checkpoint: str, name: str = "ingest", batch: int = V.BATCH):
    """Start the stream over all input there is; the query. chunks as operators.chunks.chunk_articles, points keyed by point_id
    with point_schema, progress keyed by batch, part and slice. Saving an article again repeats its chunks: the newest of a
    micro-batch counts, and a point that is there stays."""

    def apply(rows: DataFrame, number: int) -> None:
        once = K.newest(rows, ["chunk_id"], "scraped_at")
        # by chunk_id, by which the newest are dealt already, so that the texts are not moved again
        known = points.read().where("point_id IS NOT NULL").select("chunk_id")
        todo = K.payloads(once.join(known, "chunk_id", "left_anti"))
        points.insert_new(V.embedded(todo, embed, batch=batch), f"{name}-{number}")
        progress.insert_new(marks(once.select("chunk_id"), number, batch), f"{name}-{number}")

    return chunks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()
