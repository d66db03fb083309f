"""Batch retrieval: many queries in one plan, from filter to fallback; merging with web results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam import rules
from loam.functions import text as X
from loam.operators.vectors import top_similar

CONFIDENCE, MARGINAL_TOP1, MEAN_TOP5, OVERFETCH, MANUAL_PROBE = 0.52, 0.58, 0.50, 3, 6
VERSION_BOOST, CATEGORY_BOOST, MANUAL_BOOST = 0.02, 0.0, 0.25
MERGED = 6
POINT = "point_id"


def with_manual_pages(pool: DataFrame, pages: DataFrame) -> DataFrame:
    """The pool of each query, then manual pages that it does not hold yet, in their own order behind it."""
    size = pool.groupBy("query_id").agg(F.max("pos").alias("size"))
    fresh = pages.join(pool.select("query_id", POINT), ["query_id", POINT], "left_anti").join(size, "query_id", "left")
    return pool.unionByName(fresh.withColumn("pos", F.col("pos") + F.coalesce("size", F.lit(0))).drop("size"))


def confidence(pool: DataFrame) -> DataFrame:
    """(query_id, top1, mean5) over the best five cosines of a pool, however many there are."""
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "pos")
    ranked = pool.withColumn("r", F.row_number().over(best)).where("r <= 5")
    return ranked.groupBy("query_id").agg(F.max("cosine").alias("top1"), F.avg("cosine").alias("mean5"))


def retrieve(points: DataFrame, queries: DataFrame, n: int = 5, weights: dict | None = None, threshold=CONFIDENCE, marginal=MARGINAL_TOP1, mean=MEAN_TOP5, overfetch=OVERFETCH, manual_source: str | None = None, commands=rules.MANUAL_COMMANDS, exclude_self=False, category_hard: bool = False) -> DataFrame:
    """Hits of each query: query_id, rank, point_id, article_id, source, tier, raw_score, score.

    points: point_id, embedding, article_id, source, category, versions, tier, title; queries: query_id, embedding, text and
    optionally version, category, min_tier. Pool of overfetch * n by cosine; for queries that name a command, manual pages
    join the pool; a query whose pool is weak falls back to nothing; then source weights and boosts, rounding to 4 digits, the
    best chunk of each article, n per query, and tier 1 last where the query says that the basics were tried.
    """
    if "category" in queries.columns:
        queries = queries.withColumn("category", F.when(F.trim("category") != "", X.normal_category("category")))
    filters = queries if category_hard or "category" not in queries.columns else queries.drop("category")
    pool = top_similar(points, filters, overfetch * n, POINT, exclude_self=exclude_self)
    asked = queries.select("query_id", "text", *[c for c in ("version", "category") if c in queries.columns])
    named = X.named_commands("text", commands)
    sure = None
    if manual_source:
        probe = queries.where(F.size(named) > 0).select("query_id", "embedding")  # by source alone: no other filter may hide the page
        pages = top_similar(points.where(F.col("source") == manual_source), probe, MANUAL_PROBE, POINT, exclude_self=exclude_self)
        sure = pages.where(F.col("cosine") >= threshold).select("query_id").distinct()  # a page near enough settles it
        pool = with_manual_pages(pool, pages)
    rows = pool.join((asked.select("query_id", "text", named.alias("named"), *[F.col(c).alias(f"asked_{c}") for c in asked.columns[2:]])), "query_id")
    strong = _manual_match(manual_source) if manual_source else F.lit(False)
    rows = rows.withColumn("manual", strong)
    weak = (F.col("top1") < threshold) | ((F.col("top1") < marginal) & (F.col("mean5") < mean))
    trusted = confidence(pool).where(~weak).select("query_id")
    sure = trusted if sure is None else trusted.unionByName(sure).distinct()
    table = rules.SOURCE_WEIGHTS if weights is None else weights
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("source")], F.lit(1.0))
    score = F.col("cosine") * weight + F.when(F.col("manual"), MANUAL_BOOST).otherwise(0.0)
    if "asked_version" in rows.columns:
        score = score + F.when(F.array_contains("versions", F.col("asked_version")), VERSION_BOOST).otherwise(0.0)
    if "asked_category" in rows.columns:
        score = score + F.when(F.col("category") == F.col("asked_category"), CATEGORY_BOOST).otherwise(0.0)
    scored = rows.join(sure, "query_id", "left_semi").withColumn("score", F.bround(score, 4))
    key = F.when(F.coalesce("article_id", F.lit("")) != "", F.col("article_id")).otherwise(F.col(POINT).cast("string"))
    best = F.row_number().over(Window.partitionBy("query_id", key).orderBy(F.desc("score"), "pos"))
    first = scored.withColumn("b", best).where("b = 1").drop("b")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    kept = first.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= n)
    deeper = F.when(X.tried_basics("text") & (F.col("tier") == 1), 1).otherwise(0)
    order = Window.partitionBy("query_id").orderBy(deeper, "rank")
    kept = kept.withColumn("place", F.row_number().over(order))
    return kept.select("query_id", F.col("place").alias("rank"), POINT, "article_id", "source", "tier", F.bround("cosine", 4).alias("raw_score"), "score")


def _manual_match(source: str) -> Column:
    """A manual page whose title starts with, or holds as a word, a command that the query names."""
    title = F.lower(F.coalesce("title", F.lit("")))
    return (F.col("source") == source) & F.exists("named", lambda c: F.startswith(title, c) | F.regexp_like(title, F.concat(F.lit(r"\b\Q"), c, F.lit(r"\E\b"))))


def merged(kb: DataFrame, web: DataFrame, relevance: DataFrame | None = None, most: int = MERGED) -> DataFrame:
    """Sources of each query: kb(query_id, pos, title, url, text, source, score) before web(query_id, pos, title, url, content, score).

    Where both sides have rows, the relevance table (query_id, place, relevance; missing: 1) filters and reorders them,
    without ever emptying a query; where one side has rows they pass through. Columns: origin, place and path besides.
    """
    left = kb.select("query_id", F.lit("kb").alias("origin"), "pos", "title", "url", "text", "source", "score")
    right = web.select("query_id", F.lit("web").alias("origin"), "pos", "title", "url", F.coalesce("content", F.lit("")).alias("text"), F.lit("web_search").alias("source"), "score")
    rows = left.unionByName(right)
    whole = Window.partitionBy("query_id")
    rows = rows.withColumn("place", F.row_number().over(whole.orderBy("origin", "pos"))).withColumn("both", F.size(F.collect_set("origin").over(whole)) == 2)
    if relevance is not None:
        rows = rows.join(relevance.select("query_id", "place", "relevance"), ["query_id", "place"], "left").withColumn("relevance", F.when(F.col("both"), F.coalesce("relevance", F.lit(1))))
    else:
        rows = rows.withColumn("relevance", F.lit(None).cast("int"))
    none = F.max(F.coalesce("relevance", F.lit(1))).over(whole) == 0
    rows = rows.withColumn("none", none).where((F.coalesce("relevance", F.lit(1)) > 0) | F.col("none"))
    order = whole.orderBy(F.when(F.col("none"), 0).otherwise(-F.coalesce("relevance", F.lit(0))), "place")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    has = lambda o: F.max((F.col("origin") == o).cast("int")).over(whole) == 1
    path = F.when(has("kb") & has("web"), "hybrid").when(has("web"), "web_search").otherwise("knowledge_base")
    return rows.withColumn("path", path).select("query_id", "rank", "origin", "title", "url", "text", "source", "score", "relevance", "path", (~has("kb")).alias("used_fallback"))


def context_quality(rows: DataFrame, weak: float = 0.55) -> DataFrame:
    """(query_id, quality) from the best score of its sources: WEAK below the floor, else GOOD; a query without rows has NONE."""
    return rows.groupBy("query_id").agg(F.when(F.coalesce(F.max("score"), F.lit(0.0)) < weak, "WEAK").otherwise("GOOD").alias("quality"))


def context_block(rows: DataFrame) -> DataFrame:
    """(query_id, context): the attributed text of a query's sources, in order of rank."""
    tier = F.when(F.col("tier").isNotNull(), F.concat(F.lit(", tier="), F.col("tier").cast("string"))).otherwise("")
    head = F.format_string("[Source %d] (%s, source=%s%s)\nTitle: %s\nURL: %s\n%s", "rank", F.when(F.col("origin") == "kb", "KB").otherwise("WEB"), "source", tier, "title", "url", "text")
    ordered = F.array_sort(F.collect_list(F.struct("rank", head.alias("block"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda r: r["block"]), "\n\n---\n\n").alias("context"))
