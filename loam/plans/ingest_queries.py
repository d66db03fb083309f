"""Queries on the ingest job, judgments and blind labels, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loam.operators import chunks as K
from loam.operators import evaluation as E
from loam.operators import ingest as I
from loam.operators import turns as U
from loam.operators import vectors as V
from loam.plans.common import table
from loam.plans.corpus_queries import CHUNKS, articles
from loam.plans.registry import query
from loam.sources.storage import shared_dir

ODD = "regexp_matches(chunk_id, '[13579]$')"


def chunks(spark, d):
    return K.chunk_articles(articles(spark, d))


def saved(spark, rows):
    """rows as a written table: what asks for some columns again reads these, and makes no chunks."""
    path = f"{shared_dir(spark)}/loam/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def odd(df):
    return df.where(F.col("chunk_id").rlike("[13579]$"))


SOME = f"WITH {CHUNKS}, c AS (SELECT chunk_id, text FROM chunks)"


@query(f"{SOME} SELECT chunk_id, count(*) AS n FROM (SELECT chunk_id FROM c UNION ALL SELECT chunk_id FROM c WHERE {ODD}) GROUP BY 1")
def k2_append(spark, d):
    """Saving again appends again: the chunks of a second save are there twice."""
    c = chunks(spark, d)
    return I.appended_chunks(c, odd(c)).groupBy("chunk_id").agg(F.count("*").alias("n"))


@query(f"{SOME} SELECT chunk_id FROM c")
def k2_dedupe(spark, d):
    c = chunks(spark, d)
    return I.dedupe_chunks(I.appended_chunks(c, odd(c))).select("chunk_id")


@query(f"{SOME} SELECT chunk_id FROM c WHERE NOT {ODD}")
def j3_pending(spark, d):
    c = chunks(spark, d)
    return I.pending(c, odd(c).select("chunk_id")).select("chunk_id")


@query(f"{SOME} SELECT chunk_id, true AS done FROM c")
def c10_ingest(spark, d):
    """A run after another that had embedded every chunk with an odd number."""
    c, embed = saved(spark, chunks(spark, d)), V.hashing_embedder()
    points, done = I.ingested(None, odd(c), None, embed)
    points, done = I.ingested(points, c, done, embed)
    return points.select("chunk_id").join(done.withColumn("done", F.lit(True)), "chunk_id", "left")


@query(f"{SOME} SELECT chunk_id FROM c ORDER BY chunk_id LIMIT 30")
def k8_reset(spark, d):
    """A run with a limit that first forgets points and progress."""
    c, embed = chunks(spark, d), V.hashing_embedder()
    points, done = I.ingested(None, odd(c), None, embed)
    return I.ingested(points, c, done, embed, limit=30, reset=True)[0].select("chunk_id")


@query(f"{SOME} SELECT chunk_id FROM c WHERE {ODD} UNION SELECT chunk_id FROM (SELECT chunk_id FROM c WHERE NOT {ODD} ORDER BY chunk_id LIMIT 20)")
def k7_progress(spark, d):
    c, embed = chunks(spark, d), V.hashing_embedder()
    return I.ingested(None, c, odd(c).select("chunk_id"), embed, limit=20)[1]


@query("SELECT 'crawl' AS step, count(*) FILTER (event_id % 4 = 0) AS saved, count(*) FILTER (event_id % 4 = 1) AS skipped, count(*) FILTER (event_id % 4 = 2) AS failed, count(*) FILTER (event_id % 4 = 3) AS filtered FROM events")
def k4_run_record(spark, d):
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("saved", "skipped", "failed", "filtered")]), (1 + F.col("event_id") % 4).cast("int"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return I.run_record(table(spark, d, "events").select(outcome.alias("outcome")), "crawl", now, now).drop("started", "ended")


@query("SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1")
def k9_transcripts(spark, d):
    return I.transcripts(table(spark, d, "conversations"))


@query("""WITH r AS (SELECT event_id, event_id % 9 - 2 AS a, event_id % 4 AS b, event_id % 13 = 0 AS bad, ['A', 'B', 'C'][1 + event_id % 3] AS best FROM events),
s AS (SELECT event_id, bad, best, u.l AS label, CASE WHEN bad THEN 0 ELSE greatest(0, least(5, u.v)) END::INT AS correctness, CASE WHEN bad OR u.l = 'B' THEN 0 ELSE 1 END AS actionability FROM (SELECT *, unnest([{'l': 'A', 'v': a}, {'l': 'B', 'v': b}]) AS u FROM r))
SELECT event_id, label, correctness, actionability, CASE WHEN bad THEN NULL WHEN best IN ('A', 'B') THEN best ELSE first_value(label) OVER (PARTITION BY event_id ORDER BY correctness + actionability DESC, label) END AS best, bad AS parse_error FROM s""")
def x41_judgments(spark, d):
    e = F.col("event_id")
    best = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (1 + e % 3).cast("int"))
    raw = F.format_string('```json\n{"scores": {"A": {"correctness": %d, "actionability": 1}, "B": {"correctness": %d}}, "best": "%s"}\n```', e % 9 - 2, e % 4, best)
    rows = table(spark, d, "events").select("event_id", F.when(e % 13 == 0, "no judgment").otherwise(raw).alias("raw"))
    return E.judgments(rows, ["A", "B"]).select("event_id", "label", "correctness", "actionability", "best", "parse_error")


@query("SELECT doc_id AS question, c.name AS contestant, chr(64 + row_number() OVER (PARTITION BY doc_id ORDER BY sha256(doc_id || '|' || c.name))::INT) AS label FROM documents, (SELECT unnest(['own', 'other', 'third']) AS name) c")
def w10_blind_labels(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("question"), F.explode(F.array(F.lit("own"), F.lit("other"), F.lit("third"))).alias("contestant"))
    return E.blind_labels(rows)


@query("""WITH l AS (SELECT doc_id AS question, c.name AS contestant, chr(64 + row_number() OVER (PARTITION BY doc_id ORDER BY sha256(doc_id || '|' || c.name))::INT) AS label FROM documents, (SELECT unnest(['own', 'other', 'third']) AS name) c)
SELECT contestant, count(*) AS n, sum((length(text) + ascii(label)) % 6)::BIGINT AS correctness FROM l JOIN documents ON doc_id = question GROUP BY 1""")
def j8_unblinded(spark, d):
    """Scores of judges that saw labels only, from the lengths of the texts, summed by the contestants behind them."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("question"), F.length("text").alias("n"))
    labels = E.blind_labels(docs.select("question", F.explode(F.array(F.lit("own"), F.lit("other"), F.lit("third"))).alias("contestant")))
    scores = docs.select("question", "n", F.explode(F.array(*map(F.lit, "ABCD"))).alias("label")).withColumn("correctness", (F.col("n") + F.ascii("label")) % 6)
    return E.unblinded(scores, labels).groupBy("contestant").agg(F.count("*").alias("n"), F.sum("correctness").alias("correctness"))


@query("SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(l, lower(x)) = i), '|') AS seen FROM (SELECT doc_id, w, list_transform(w, lambda x: lower(x)) AS l FROM (SELECT doc_id, string_split(left(text, 200), ' ') AS w FROM documents))")
def w8_first_seen(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(U.first_seen(F.split(F.left("text", F.lit(200)), " ", -1), F.lower), "|").alias("seen"))
