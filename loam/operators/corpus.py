"""Corpus bookkeeping: what is new, what a filter finds, statistics, relabelling, rebuilding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.functions.rows import once
from loam.operators.chunks import chunk_articles, index_of


def not_yet(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known: articles not yet stored, chunks not yet embedded."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def ran_today(runs: DataFrame, step: str, now: Column) -> DataFrame:
    """One row (ran): whether the step has a run on the day of now."""
    return runs.where((F.col("step") == step) & (F.to_date("ts") == F.to_date(now))).agg((F.count("*") > 0).alias("ran"))


def search_articles(articles: DataFrame, device=None, locale=None, version=None, tier=None) -> DataFrame:
    """Filters that are given, only; a version also finds articles for all versions."""
    out = articles
    if device:
        out = out.where(F.array_contains("affected_devices", device))
    if locale:
        out = out.where(F.col("locale") == locale)
    if version:
        out = out.where(F.arrays_overlap("macos_versions", F.array(F.lit(version), F.lit("all"))))
    if tier:
        out = out.where(F.coalesce("difficulty_tier", F.lit(1)) <= tier)
    return out


def long_enough(rows: DataFrame, text: str = "embed_text", least: int = 100) -> DataFrame:
    """Rows whose text, which is made once, has enough characters."""
    return once(rows, **{text: F.col(text)}).where(F.length(X.squeeze(text)) >= least)


def by_source(articles: DataFrame) -> DataFrame:
    return articles.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "source")


def totals(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    one = lambda df, name: df.select(F.lit(name).alias("what"))
    both = one(articles, "articles").unionByName(one(chunks, "chunks")).groupBy("what").agg(F.count("*").alias("n"))
    return both.agg(*[F.coalesce(F.max(F.when(F.col("what") == w, F.col("n"))), F.lit(0).cast("long")).alias(w) for w in ("articles", "chunks")])


def step_stats(attempts: DataFrame) -> DataFrame:
    """Counts by step and status (saved, skipped, failed, filtered), with zeros."""
    return attempts.groupBy("step").agg(*[F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("saved", "skipped", "failed", "filtered")])


def embed_cost(chunks: DataFrame, chars_per_token: int = 4, price: float = 0.02) -> DataFrame:
    tokens = F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)) / chars_per_token
    return chunks.agg(F.count("*").alias("chunks"), tokens.alias("tokens"), (tokens * price / 1e6).alias("cost_usd"))


def relabelled(articles: DataFrame, category: Column, found: Column, default: str = "general") -> DataFrame:
    """articles with new_category and new_versions; labels only ever improve: a default category and ["all"] may be replaced."""
    old = F.coalesce("category", F.lit(default))
    open_version = F.coalesce(F.col("macos_versions"), F.array(F.lit("all"))) == F.array(F.lit("all"))
    return articles.withColumn("new_category", F.when(old == default, category).otherwise(old)).withColumn("new_versions", F.when(open_version, found).otherwise(F.col("macos_versions")))


def relabel_report(rows: DataFrame, default: str = "general") -> DataFrame:
    """Counts of each category before and after, with percents of all to one decimal."""
    old = F.coalesce("category", F.lit(default))
    both = rows.select(F.explode(F.array(F.struct(F.lit(0).alias("after"), old.alias("category")), F.struct(F.lit(1).alias("after"), F.col("new_category").alias("category")))).alias("x"))
    out = both.groupBy("x.category").agg(F.sum(1 - F.col("x.after")).alias("before"), F.sum("x.after").alias("after"))
    total = rows.agg(F.count("*").alias("total"))
    share = lambda c: F.round(100.0 * F.col(c) / F.col("total"), 1)
    return out.join(F.broadcast(total)).select("category", "before", "after", share("before").alias("before_pct"), share("after").alias("after_pct"))


def relabel_summary(rows: DataFrame, default: str = "general") -> DataFrame:
    any_version = lambda c: F.sum((F.coalesce(F.col(c), F.array(F.lit("all"))) != F.array(F.lit("all"))).cast("long"))
    old = F.coalesce("category", F.lit(default))
    return rows.agg(
        F.count("*").alias("articles"), F.sum((old != F.col("new_category")).cast("long")).alias("relabelled"), F.sum((F.col("new_category") == default).cast("long")).alias("still_general"),
        any_version("macos_versions").alias("versions_before"), any_version("new_versions").alias("versions_after"),
    )


def rebuilt(articles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, chunks, index) after missing sources and categories are filled in."""
    blob = F.concat_ws(" ", "title", "summary", "embed_text")
    patched = articles.withColumn("source", F.coalesce("source", X.source_of_id("article_id"))).withColumn("category", F.coalesce("category", X.scored_category(blob)))
    chunks = chunk_articles(patched)
    return patched, chunks, index_of(patched, chunks)


def subset(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the ids, each once however often an id is listed."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def message_fault(text, most: int = 16_000) -> Column:
    """Why a message is refused before anything else: empty or too long; null where it is not."""
    text = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.trim(text) == "", "empty").when(F.length(text) > most, "too long")


def snippet(text, most: int = 280) -> Column:
    return F.left(F.coalesce(F.col(text), F.lit("")), F.lit(most))
