"""The ingest job: embed what is new, keep points by key, and start again where it stopped.

The list of embedded chunks is a table (chunk_id); a run reads it, so a run that was stopped embeds only the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators import chunks as K
from loam.operators import vectors as V
from loam.operators.corpus import not_yet


def dedupe_chunks(chunks: DataFrame, order: str = "scraped_at") -> DataFrame:
    """Saving an article again appends its chunks again: the newest of each chunk_id."""
    return K.newest(chunks, ["chunk_id"], order)


def appended_chunks(current: DataFrame, more: DataFrame) -> DataFrame:
    """The chunk table after an append: nothing is keyed, repeats stay (see dedupe_chunks)."""
    return current.unionByName(more, allowMissingColumns=True).select(current.columns)


def pending(chunks: DataFrame, done: DataFrame | None, mode: str = "incremental", limit: int | None = None) -> DataFrame:
    """The chunks that a run embeds. incremental: those not in done(chunk_id); full: all; limit: the first by chunk_id."""
    rows = dedupe_chunks(chunks)
    if mode == "incremental" and done is not None:
        rows = not_yet(rows, done, "chunk_id")
    return rows if limit is None else rows.orderBy("chunk_id").limit(limit)


def ingested(points: DataFrame | None, chunks: DataFrame, done: DataFrame | None, embed, mode: str = "incremental", limit: int | None = None, reset: bool = False) -> tuple[DataFrame, DataFrame]:
    """(points, done) after a run: chunks embedded in batches, put in by point id; reset forgets points and progress first."""
    points, done = (None, None) if reset else (points, done)
    todo = pending(chunks, done, mode, limit)
    rows = K.payloads(todo).where("point_id IS NOT NULL")
    fresh = V.embedded(rows, embed)
    # the keys are those of the rows before they are embedded, so that nothing is embedded to know its key
    after = fresh if points is None else points.join(rows.select("point_id"), "point_id", "left_anti").unionByName(fresh)
    marks = todo.select("chunk_id")
    return after, (marks if done is None else done.select("chunk_id").unionByName(marks).distinct())


def dry_run(chunks: DataFrame, done: DataFrame | None, mode: str = "incremental", limit: int | None = None) -> DataFrame:
    """(chunks, tokens, usd): what a run would embed, without doing so."""
    from loam.operators.corpus import embed_cost

    return embed_cost(pending(chunks, done, mode, limit))


def run_record(attempts: DataFrame, step: str, started: Column, ended: Column) -> DataFrame:
    """One row for the table of runs: step, times, and the number of attempts(outcome) by outcome."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return attempts.agg(n("saved"), n("skipped"), n("failed"), n("filtered")).select(F.lit(step).alias("step"), started.alias("started"), ended.alias("ended"), "saved", "skipped", "failed", "filtered")


def transcripts(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, transcript): one line a message, who said it and the text, in order."""
    line = F.format_string("[%s] %s", "role", "text")
    return messages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("transcript"))
