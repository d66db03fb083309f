"""Articles to chunks, and chunk tables kept by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.functions.rows import once
from loam.schemas import PAYLOAD

TARGET, LEAST, MOST = 1000, 100, 2000


def _pieces(title: str, summary: str, sections: str, steps: str, target: int) -> Column:
    """(heading, text) of the summary, each section (cut at sentences beyond target), and the steps as one."""
    piece = lambda h, t: F.struct(h.alias("heading"), t.alias("text"))
    first = F.when(F.col(summary) != "", F.array(piece(F.lit("Summary"), F.col(summary)))).otherwise(F.array())

    def of_section(s):
        body, heading = F.regexp_replace(s["body"], r"(?U)^\s+|\s+$", ""), F.coalesce(s["heading"], F.lit(""))
        parts = lambda whole: F.when(F.length(whole) <= target, F.array(whole)).otherwise(X.packed_sentences(whole, target))
        whole = lambda body: F.when(heading != "", F.concat(heading, F.lit(": "), body)).otherwise(body)
        none = F.array().cast("array<struct<heading:string,text:string>>")
        return X.let(body, lambda b: F.when(F.coalesce(b, F.lit("")) == "", none).otherwise(F.transform(X.let(whole(b), parts), lambda p: piece(heading, p))))

    numbered = F.array_join(F.transform(F.col(steps), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    last = F.when(F.size(F.coalesce(F.col(steps), F.array())) > 0, F.array(piece(F.lit("Steps"), F.concat(F.lit("How to: "), F.col(title), F.lit("\n"), numbered)))).otherwise(F.array())
    return F.concat(first, F.flatten(F.transform(F.coalesce(F.col(sections), F.array()), of_section)), last)


def chunk_articles(articles: DataFrame, target: int = TARGET, least: int = LEAST, most: int = MOST) -> DataFrame:
    """The chunks of articles, numbered in order among those that are long enough; narrow, without a shuffle."""
    category = X.normal_category("category")
    pieces = F.transform(_pieces("title", "summary", "sections", "steps", target), lambda p: F.struct(p["heading"].alias("heading"), X.embed_text(p["text"], "title", category, least, most).alias("text")))
    rows = once(articles, _pieces=F.filter(pieces, lambda p: F.length(p["text"]) >= least)).select("*", F.posexplode("_pieces").alias("n", "piece"))
    return rows.select(
        F.concat_ws("_", "id", F.col("n").cast("string")).alias("chunk_id"), F.col("piece.heading").alias("section_heading"), F.col("piece.text").alias("text"), "article_id", "locale", "title", "url", "affected_devices",
        F.coalesce("macos_versions", F.array(F.lit("all"))).alias("macos_versions"), F.coalesce("difficulty_tier", F.lit(1)).alias("difficulty_tier"), category.alias("category"), F.coalesce("source", F.lit("unknown")).alias("source"), "scraped_at",
    )


def newest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, the newest: a grouped maximum, so that a hot key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("row")).select(*key, "row.*").select(rows.columns)


def upserted(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """current with rows of changes put in by key; one row per key of changes is expected."""
    return current.join(changes.select(*key), key, "left_anti").unionByName(changes)


def index_of(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """The index: article metadata and the number of its chunks."""
    counts = chunks.groupBy("article_id").agg(F.count("*").alias("chunk_count"))
    meta = articles.select("article_id", "title", "url", "locale", "affected_devices", "macos_versions", "difficulty_tier", "category", "source", "scraped_at")
    return meta.join(counts, "article_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long")))


def payloads(chunks: DataFrame) -> DataFrame:
    """Point id and the payload columns with their defaults."""
    empty = F.array().cast("array<string>")
    defaults = {"affected_devices": empty, "macos_versions": F.array(F.lit("all")), "difficulty_tier": F.lit(1), "category": F.lit("general"), "source": F.lit("unknown"), "scraped_at": F.lit(None).cast("timestamp")}
    return chunks.select(X.uuid5(F.concat(F.lit("macos_kb."), "chunk_id")).alias("point_id"), *[F.coalesce(c, defaults.get(c, F.lit(""))).alias(c) for c in PAYLOAD])
