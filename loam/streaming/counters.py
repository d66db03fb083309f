"""Streaming counters: event-time rates and last-wins feedback, in update mode, with the state bounded by a watermark.

A sink writes each micro-batch's changed rows under its batch id, so that a replayed batch overwrites itself and a reader
takes the newest row of each key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam.functions import text as X
from loam.operators.accounting import rates
from loam.sources.storage import shared_dir


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet file or folder as a stream. The source lists folders; a pattern that only the name itself fits lets it take a lone file."""
    head, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{head}/[{name[0]}]{name[1:]}")


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows of a Parquet file or folder as a stream, ts as an instant."""
    rows = parquet_stream(spark, path, files_per_batch)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(changes: DataFrame, key: list[str]) -> DataFrame:
    """Run a streaming aggregate over all input there is; the newest row of each key as a batch table."""
    spark = changes.sparkSession
    base = f"{shared_dir(spark)}/loam/{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    query = changes.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in changes.columns if c not in key]
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in changes.schema)}, batch long").parquet(f"{base}/rows")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("m")).select(*key, "m.*")


@contextmanager
def only_with_data(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside the block run no batches without input: one whose state has a processing-time timeout would
    otherwise go on for ever after all input there is."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def appended(rows: DataFrame) -> DataFrame:
    """Run a stream that only appends rows over all input there is; its rows as a batch table."""
    base = f"{shared_dir(rows.sparkSession)}/loam/{uuid.uuid4().hex}"
    with only_with_data(rows.sparkSession):
        query = rows.writeStream.outputMode("append").format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{base}/rows")


def stream_rates(events: DataFrame, label: str, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rates of a stream; rows later than the delay are dropped and their windows' state is freed."""
    return rates(events.withWatermark("ts", delay), label, width, slide)


def stream_last_feedback(events: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The last value of each key: the state is one row a key."""
    return events.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def stream_buckets(events: DataFrame, label: str, value: str, bounds: list[float]) -> DataFrame:
    """(label, le, n): how many values fall into each bucket, the last without a bound; the state is one row a label and bucket."""
    v = F.col(value)
    le = F.lit(float("inf"))
    for b in sorted(bounds, reverse=True):
        le = F.when(v <= b, F.lit(float(b))).otherwise(le)
    every = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), (le == float(b)).cast("long").alias("n")) for b in [*bounds, float("inf")]]))
    return events.where(v.isNotNull()).select(label, every.alias("b")).groupBy(label, F.col("b.le").alias("le")).agg(F.sum("b.n").alias("n"))


def cumulative(buckets: DataFrame, label: str) -> DataFrame:
    """Bucket counts to counts of values at most each bound; a label has as many rows as there are bounds."""
    upto = Window.partitionBy(label).orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    return buckets.withColumn("n", F.sum("n").over(upto))


def tagged(messages: DataFrame) -> DataFrame:
    """messages(text, ...) with personal data replaced and the kind of abuse: without state, on a batch or a stream."""
    return messages.withColumn("abuse", X.abuse_kind("text")).withColumn("text", X.redacted("text")[0])
