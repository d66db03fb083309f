"""Corpus, chunk and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text as X
from loam.operators import chunks as K
from loam.operators import corpus as C
from loam.operators import vectors as V
from loam.plans.common import PRIORITY, SQUEEZE, TOPICS, table
from loam.plans.registry import query
from loam.plans.text_queries import PACK, scored_sql

FLAT = SQUEEZE.format("text")


def articles(spark, d):
    """documents as articles: the first line is the title, each other line a section, every fourth has steps."""
    lines = F.split("text", "\n", -1)
    sections = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, i: F.struct(F.when(i % 2 == 0, F.concat(F.lit("Part "), i.cast("string"))).otherwise("").alias("heading"), x.alias("body")))
    category = F.when(F.col("doc_id") % 3 == 0, F.lit("general")).when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.lit("disk"))
    versions = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("all"))).otherwise(F.array(F.lit("14"), F.lit("13")))
    return table(spark, d, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"), F.col("doc_id").cast("string").alias("article_id"), F.lit("en-us").alias("locale"), F.left(lines[0], F.lit(80)).alias("title"), F.concat(F.lit("https://example.org/en-us/"), "doc_id").alias("url"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("scraped_at"), F.lit(None).cast("string").alias("last_modified"), F.array("lang").alias("affected_devices"), versions.alias("macos_versions"), (1 + F.col("doc_id") % 3).cast("int").alias("difficulty_tier"),
        category.alias("category"), F.array("source").alias("categories"), F.left("text", F.lit(300)).alias("summary"), sections.alias("sections"), F.when(F.col("doc_id") % 4 == 0, F.slice(lines, 1, 3)).otherwise(F.array()).alias("steps"),
        X.embed_text("text", "lang", "source").alias("embed_text"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"), "doc_id", "text", "lang",
    )


ARTICLES = """a AS (SELECT doc_id, text, lang, 'doc_' || doc_id AS id, left(string_split(text, chr(10))[1], 80) AS title, CASE WHEN doc_id % 3 = 0 THEN 'general' WHEN doc_id % 7 = 0 THEN NULL ELSE 'disk' END AS category,
 CASE WHEN doc_id % 2 = 0 THEN ['all'] ELSE ['14', '13'] END AS versions, CAST(1 + doc_id % 3 AS INT) AS tier, CASE WHEN doc_id % 5 <> 0 THEN source END AS source, string_split(text, chr(10)) AS lines FROM documents)"""
TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
CHUNKS = rf"""{ARTICLES},
s AS (SELECT doc_id, i, CASE WHEN i % 2 = 0 THEN 'Part ' || i ELSE '' END AS heading, {TRIM.format('lines[i + 2]')} AS body FROM (SELECT doc_id, lines, unnest(range(len(lines) - 1)) AS i FROM a)),
f AS (SELECT doc_id, i, heading, CASE WHEN heading <> '' THEN heading || ': ' || body ELSE body END AS t FROM s WHERE body <> ''),
r AS (SELECT doc_id, i, heading, t, {PACK.format('t', 1000)} AS r FROM f),
p AS (SELECT doc_id, i, heading, CASE WHEN len(t) <= 1000 THEN [t] WHEN r.open <> '' THEN list_append(r.done, trim(r.open)) ELSE r.done END AS parts FROM r),
pieces AS (SELECT doc_id, -1 AS i, 0 AS j, 'Summary' AS heading, left(text, 300) AS t FROM a WHERE text <> ''
 UNION ALL SELECT doc_id, i, j, heading, parts[j] FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM p)
 UNION ALL SELECT doc_id, 1000000, 0, 'Steps', 'How to: ' || title || chr(10) || array_to_string(list_transform(lines[1:3], lambda x, k: k || '. ' || x), chr(10)) FROM a WHERE doc_id % 4 = 0),
flat AS (SELECT doc_id, i, j, heading, title, CASE WHEN a.category = 'disk' THEN 'disk' ELSE 'general' END AS category, {SQUEEZE.format('t')} AS t FROM pieces JOIN a USING (doc_id)),
padded AS (SELECT doc_id, i, j, heading, category, left(CASE WHEN len(t) < 100 THEN trim(t || ' ' || trim(concat_ws(' ', nullif(title, ''), category))) ELSE t END, 2000) AS t FROM flat),
chunks AS (SELECT doc_id, 'doc_' || doc_id || '_' || (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1) AS chunk_id, heading AS section_heading, category, t AS text FROM padded WHERE len(t) >= 100)"""


@query(f"WITH {CHUNKS} SELECT chunk_id, section_heading, category, text FROM chunks")
def x14_chunks(spark, d):
    return K.chunk_articles(articles(spark, d)).select("chunk_id", "section_heading", "category", "text")


@query(f"WITH {CHUNKS} SELECT CAST(a.doc_id AS VARCHAR) AS article_id, a.title, coalesce(n, 0) AS chunk_count FROM a LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) USING (doc_id)")
def k3_index(spark, d):
    a = articles(spark, d)
    return K.index_of(a, K.chunk_articles(a)).select("article_id", "title", "chunk_count")


@query("SELECT source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def k1_newest(spark, d):
    return K.newest(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id").select("source", "doc_id", "n_chars")


@query("SELECT doc_id, n_chars, 'new' AS state FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, n_chars, 'old' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")
def k5_upsert(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return K.upserted(docs.where("doc_id % 2 = 0").withColumn("state", F.lit("old")), docs.where("doc_id % 3 = 0").withColumn("state", F.lit("new")), ["doc_id"])


@query(f"WITH {ARTICLES} SELECT id, coalesce(source, 'unknown') AS source, tier AS difficulty_tier, coalesce(versions, ['all']) AS macos_versions FROM a")
def f18_payload(spark, d):
    rows = articles(spark, d).withColumn("chunk_id", F.col("id")).withColumn("section_heading", F.lit(""))
    return K.payloads(rows).select(F.col("chunk_id").alias("id"), "source", "difficulty_tier", "macos_versions")


@query(f"WITH {ARTICLES} SELECT doc_id FROM a WHERE lang = 'fr' AND list_has_any(versions, ['14', 'all']) AND tier <= 2")
def f9_search(spark, d):
    return C.search_articles(articles(spark, d), device="fr", locale="", version="14", tier=2).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE len({FLAT}) >= 100")
def f12_long_enough(spark, d):
    return C.long_enough(table(spark, d, "documents"), "text").select("doc_id")


@query("SELECT event_type, count(*) > 0 AS ran FROM (SELECT 'click' AS event_type, ts FROM events WHERE event_type = 'click' AND CAST(ts AS DATE) = DATE '2024-01-05') GROUP BY event_type")
def f15_ran_today(spark, d):
    runs = table(spark, d, "events").select(F.col("event_type").alias("step"), "ts")
    return C.ran_today(runs, "click", F.lit("2024-01-05").cast("date")).select(F.lit("click").alias("event_type"), "ran")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def f16_subset(spark, d):
    return C.subset(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN len(text) > 400 THEN 'too long' END AS rejected FROM conversations")
def f17_message_checks(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", C.message_fault("text", 400).alias("rejected"))


@query("SELECT doc_id, left(text, 280) AS snippet, source FROM documents")
def f19_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", C.snippet("text").alias("snippet"), "source")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j2_not_stored(spark, d):
    return C.not_yet(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query(f"WITH {ARTICLES} SELECT coalesce(source, 'unknown') AS source, count(*) AS articles FROM a GROUP BY 1")
def a1_by_source(spark, d):
    return C.by_source(articles(spark, d))


@query(f"WITH {CHUNKS} SELECT (SELECT count(*) FROM a) AS articles, (SELECT count(*) FROM chunks) AS chunks")
def a2_totals(spark, d):
    a = articles(spark, d)
    return C.totals(a, K.chunk_articles(a))


RELABEL = f"""{ARTICLES}, b AS (SELECT *, {scored_sql('lower(text)')} AS best FROM a),
n AS (SELECT coalesce(category, 'general') AS old, CASE WHEN coalesce(category, 'general') = 'general' THEN CASE WHEN best.score > 0 THEN best.category ELSE 'general' END ELSE category END AS new, versions, CASE WHEN versions = ['all'] AND contains(text, '1') THEN ['1'] ELSE versions END AS new_versions FROM b)"""


def relabelled(spark, d):
    found = F.when(F.contains("text", F.lit("1")), F.array(F.lit("1"))).otherwise(F.array(F.lit("all")))
    return C.relabelled(articles(spark, d), X.scored_category("text", TOPICS, PRIORITY), found)


@query(f"WITH {RELABEL} SELECT category, sum(b)::BIGINT AS before, sum(1 - b)::BIGINT AS after, round(100.0 * sum(b) / (SELECT count(*) FROM n), 1)::DOUBLE AS before_pct, round(100.0 * sum(1 - b) / (SELECT count(*) FROM n), 1)::DOUBLE AS after_pct FROM (SELECT old AS category, 1 AS b FROM n UNION ALL SELECT new, 0 FROM n) GROUP BY category")
def a3_relabel_report(spark, d):
    return C.relabel_report(relabelled(spark, d))


@query(f"WITH {RELABEL} SELECT count(*) AS articles, count(*) FILTER (old <> new) AS relabelled, count(*) FILTER (new = 'general') AS still_general, count(*) FILTER (versions <> ['all']) AS versions_before, count(*) FILTER (new_versions <> ['all']) AS versions_after FROM n")
def c9_relabel_summary(spark, d):
    return C.relabel_summary(relabelled(spark, d))


@query("SELECT source AS step, count(*) FILTER (doc_id % 4 = 0) AS saved, count(*) FILTER (doc_id % 4 = 1) AS skipped, count(*) FILTER (doc_id % 4 = 2) AS failed, count(*) FILTER (doc_id % 4 = 3) AS filtered FROM documents GROUP BY source")
def a5_step_stats(spark, d):
    status = F.element_at(F.array(*[F.lit(s) for s in ("saved", "skipped", "failed", "filtered")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return C.step_stats(table(spark, d, "documents").select(F.col("source").alias("step"), status.alias("status")))


@query("SELECT count(*) AS chunks, sum(len(text)) / 4 AS tokens, sum(len(text)) / 4 * 0.02 / 1e6 AS cost_usd FROM documents")
def a6_embed_cost(spark, d):
    return C.embed_cost(table(spark, d, "documents"))


@query(f"WITH {CHUNKS} SELECT category, count(*) AS chunks FROM chunks GROUP BY category")
def c8_rebuild(spark, d):
    _, chunks, _ = C.rebuilt(articles(spark, d).withColumn("category", F.coalesce("category", F.lit("general"))))
    return chunks.groupBy("category").agg(F.count("*").alias("chunks"))


@query("SELECT vec_id, vec_id % 3 = 0 AS kept FROM embeddings")
def k6_sync(spark, d):
    points = table(spark, d, "embeddings")
    have = points.where("vec_id % 3 = 0").select(F.col("vec_id").alias("point_id"), "embedding")
    out = V.synced(have, points.select(F.col("vec_id").alias("point_id"), F.col("label").cast("string").alias("text")), V.hashing_embedder(64))
    same = points.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("old"))
    return out.join(same, "point_id").select(F.col("point_id").alias("vec_id"), (F.col("embedding") == F.col("old")).alias("kept"))
