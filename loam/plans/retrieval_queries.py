"""Retrieval, evaluation and judging queries."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from loam.operators import evaluation as E
from loam.operators import index as X
from loam.operators import retrieval as R
from loam.operators import vectors as V
from loam.plans.common import WEIGHTS, table
from loam.plans.registry import query
from loam.sources.storage import shared_dir

LOW = {"threshold": 0.30, "marginal": 0.40, "mean": 0.33}


def points(spark, d):
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        v.alias("point_id"), "embedding", "label", F.floor(v / 3).cast("string").alias("article_id"), F.concat(F.lit("s"), (v % 10).cast("string")).alias("source"), F.col("label").cast("string").alias("category"),
        F.when(v % 2 == 0, F.array(F.lit("all"))).otherwise(F.array(F.lit("14"))).alias("versions"), (1 + v % 3).cast("int").alias("tier"), F.concat(F.lit("page "), F.when(v % 11 == 0, "pmset").otherwise("other")).alias("title"),
    )


def queries_of(spark, d):
    """The stated query set: every vector whose id is divisible by 50."""
    q = table(spark, d, "embeddings").where("vec_id % 50 = 0")
    return q.select(F.col("vec_id").alias("query_id"), "embedding", F.when(F.col("vec_id") % 100 == 0, "still not fine").otherwise("plain").alias("text"), F.col("label").alias("query_label"))


BASE = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, label AS query_label FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT vec_id AS point_id, embedding::DOUBLE[] AS pv, label, CAST(vec_id // 3 AS VARCHAR) AS article_id, 's' || (vec_id % 10) AS source, CAST(1 + vec_id % 3 AS INT) AS tier, CASE WHEN vec_id % 2 = 0 THEN ['all'] ELSE ['14'] END AS versions FROM embeddings)"""
RANKED = f"""{BASE}, c AS (SELECT query_id, point_id, label, query_label, article_id, source, tier, list_cosine_similarity(qv, pv) AS cosine FROM q, p WHERE query_id <> point_id),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, point_id) AS pos FROM c QUALIFY pos <= 15),
sure AS (SELECT query_id, max(cosine) AS top1, avg(cosine) FILTER (pos <= 5) AS mean5 FROM pool GROUP BY query_id)"""
WEIGHT = "CASE " + " ".join(f"WHEN source = '{s}' THEN {w}" for s, w in WEIGHTS.items()) + " ELSE 1.0 END"
HITS = f"""{RANKED},
scored AS (SELECT *, round_even(cosine * {WEIGHT}, 4) AS score FROM pool WHERE query_id IN (SELECT query_id FROM sure WHERE NOT (top1 < 0.30 OR (top1 < 0.40 AND mean5 < 0.33)))),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, article_id ORDER BY score DESC, pos) = 1),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r FROM best QUALIFY r <= 5),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id % 100 = 0 AND tier = 1 THEN 1 ELSE 0 END, r) AS rank FROM kept)"""


@query(f"WITH {RANKED} SELECT query_id, point_id, pos, round(cosine, 6) AS cosine FROM pool WHERE pos <= 10")
def j4_top_similar(spark, d):
    q = queries_of(spark, d).select("query_id", "embedding")
    return V.top_similar(points(spark, d).select("point_id", "embedding"), q, 10, exclude_self=True).select("query_id", "point_id", F.col("pos").cast("long").alias("pos"), F.round("cosine", 6).alias("cosine"))


def list_index(spark, d, name):
    return X.built(points(spark, d).select("point_id", "embedding"), f"{shared_dir(spark)}/loam/{name}-{uuid.uuid4().hex}")


@query(f"WITH {RANKED} SELECT query_id, point_id, pos, round(cosine, 6) AS cosine FROM pool WHERE pos <= 10")
def j4_index_all_lists(spark, d):
    """The index with every list probed: the exact search, so that no row is missing from the lists."""
    found = X.search(list_index(spark, d, "all"), queries_of(spark, d).select("query_id", "embedding"), 10, X.MOST_LISTS, exclude_self=True)
    return found.select("query_id", "point_id", F.col("pos").cast("long").alias("pos"), F.round("cosine", 6).alias("cosine"))


#: Share of the lists that a query probes. These vectors have no clusters, so it takes many.
PROBED = 0.6


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def j4_index_recall(spark, d):
    """Whether the index finds nine tenths of the ten nearest of all rows, measured against the exact search."""
    index, q = list_index(spark, d, "recall"), queries_of(spark, d).select("query_id", "embedding")
    found = X.search(index, q, 10, math.ceil(PROBED * len(index.centres)), exclude_self=True)
    exact = V.top_similar(points(spark, d).select("point_id", "embedding"), q, 10, exclude_self=True)
    return X.recall(found, exact).select("queries", (F.col("recall") >= 0.9).alias("reached"))


@query(f"""WITH {BASE}, c AS (SELECT query_id, point_id, list_cosine_similarity(qv, pv) AS cosine FROM q, p WHERE list_has_any(versions, ['14', 'all']) AND tier >= 2 AND label = query_label)
SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, point_id) AS pos FROM c QUALIFY pos <= 5""")
def f10_filtered_search(spark, d):
    q = queries_of(spark, d).select("query_id", "embedding", F.lit("14").alias("version"), F.col("query_label").cast("string").alias("category"), F.lit(2).alias("min_tier"))
    return V.top_similar(points(spark, d), q, 5).select("query_id", "point_id", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {RANKED} SELECT query_id, round(top1, 6) AS top1, round(mean5, 6) AS mean5 FROM sure")
def a37_confidence(spark, d):
    pool = V.top_similar(points(spark, d), queries_of(spark, d), 15, exclude_self=True)
    return R.confidence(pool).select("query_id", F.round("top1", 6).alias("top1"), F.round("mean5", 6).alias("mean5"))


def hits(spark, d):
    return R.retrieve(points(spark, d), queries_of(spark, d).drop("query_label"), 5, WEIGHTS, **LOW, exclude_self=True)


@query(f"WITH {HITS} SELECT query_id, rank, point_id, article_id, source, tier, round_even(cosine, 4) AS raw_score, score FROM hits")
def r1_retrieval(spark, d):
    return hits(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {RANKED}, mp AS (SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, point_id) AS pos FROM c WHERE source = 's3' QUALIFY pos <= 6),
pool5 AS (SELECT * FROM pool WHERE pos <= 5), fresh AS (SELECT * FROM mp WHERE (query_id, point_id) NOT IN (SELECT query_id, point_id FROM pool5))
SELECT query_id, point_id, pos FROM pool5 UNION ALL SELECT query_id, point_id, pos + 5 FROM fresh""")
def j5_manual_pages(spark, d):
    p, q = points(spark, d), queries_of(spark, d)
    pool = V.top_similar(p, q, 5, exclude_self=True)
    both = R.with_manual_pages(pool, V.top_similar(p.where("source = 's3'"), q, 6, exclude_self=True))
    return both.select("query_id", "point_id", F.col("pos").cast("long").alias("pos"))


def pmset_queries(spark, d):
    """Every fifth query vector names a command; half of them ask for version 14, half for any."""
    q = queries_of(spark, d).drop("query_label")
    i = F.col("query_id")
    return q.withColumn("text", F.when(i % 100 == 0, "run pmset now").otherwise("plain")).withColumn("version", F.when(i % 150 == 0, "any").otherwise("14")).withColumn("category", F.lit("7"))


@query(f"""WITH {RANKED}, mp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, point_id) AS pos FROM c WHERE source = 's3' AND query_id % 100 = 0 QUALIFY pos <= 6),
whole AS (SELECT query_id, point_id, article_id, source, tier, cosine, pos FROM pool UNION ALL SELECT query_id, point_id, article_id, source, tier, cosine, pos + 15 FROM mp WHERE (query_id, point_id) NOT IN (SELECT query_id, point_id FROM pool)),
trusted AS (SELECT query_id FROM (SELECT query_id, max(cosine) AS top1, avg(cosine) FILTER (r <= 5) AS mean5 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, pos) AS r FROM whole) GROUP BY 1) WHERE NOT (top1 < 0.34 OR (top1 < 0.45 AND mean5 < 0.36)) UNION SELECT query_id FROM mp WHERE cosine >= 0.34),
scored AS (SELECT *, round_even(cosine * {WEIGHT} + CASE WHEN source = 's3' AND query_id % 100 = 0 AND point_id % 11 = 0 THEN 0.25 ELSE 0 END + CASE WHEN query_id % 150 <> 0 AND point_id % 2 = 1 THEN 0.02 ELSE 0 END, 4) AS score FROM whole WHERE query_id IN (SELECT query_id FROM trusted)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, article_id ORDER BY score DESC, pos) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank, point_id, score FROM best QUALIFY rank <= 5""")
def x22_manual_retrieval(spark, d):
    """Manual pages join and lift, a near one overrides a weak pool, versions filter and lift, the category only would lift."""
    found = R.retrieve(points(spark, d), pmset_queries(spark, d), 5, WEIGHTS, threshold=0.34, marginal=0.45, mean=0.36, manual_source="s3", commands=["pmset"], exclude_self=True)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "point_id", "score")


HIDDEN = f"""WITH {BASE}, c AS (SELECT query_id, point_id, article_id, source, CASE WHEN source = 's3' THEN 1 ELSE tier END AS tier, source = 's3' OR list_has_any(versions, ['14', 'all']) AS any_version, list_cosine_similarity(qv, pv) AS cosine FROM q, p WHERE query_id <> point_id),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, point_id) AS pos FROM c WHERE tier >= 2 AND (any_version OR query_id % 150 = 0) QUALIFY pos <= 20),
mp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, point_id) AS pos FROM c WHERE source = 's3' AND query_id % 100 = 0 QUALIFY pos <= 6),
whole AS (SELECT query_id, point_id, article_id, source, cosine, pos FROM pool UNION ALL SELECT query_id, point_id, article_id, source, cosine, pos + (SELECT coalesce(max(pos), 0) FROM pool WHERE pool.query_id = mp.query_id) FROM mp),
scored AS (SELECT *, round_even(cosine * {WEIGHT} + CASE WHEN source = 's3' AND point_id % 11 = 0 THEN 0.25 ELSE 0 END + CASE WHEN query_id % 150 <> 0 AND point_id % 2 = 1 AND source <> 's3' THEN 0.02 ELSE 0 END, 4) AS score FROM whole),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, article_id ORDER BY score DESC, pos) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank, point_id, source, score FROM best QUALIFY rank <= 20"""


@query(HIDDEN)
def x22_manual_behind_filters(spark, d):
    """Manual pages of another version and of the first tier, which the filters of the pool exclude: the probe goes by source alone."""
    manual = F.col("source") == "s3"
    p = points(spark, d).withColumn("versions", F.when(manual, F.array(F.lit("12"))).otherwise(F.col("versions"))).withColumn("tier", F.when(manual, 1).otherwise(F.col("tier")))
    q = pmset_queries(spark, d).withColumn("min_tier", F.lit(2))
    found = R.retrieve(p, q, 20, WEIGHTS, threshold=-1.0, marginal=-1.0, mean=-1.0, overfetch=1, manual_source="s3", commands=["pmset"], exclude_self=True)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "point_id", "source", "score")


GRADED = f"{HITS}, g AS (SELECT query_id, rank, tier, CASE WHEN label = query_label THEN 3 WHEN abs(label - query_label) = 1 THEN 1 ELSE 0 END AS grade FROM hits)"
PADDED = f"{GRADED}, pad AS (SELECT q.query_id, r.rank, coalesce(g.grade, 0) AS grade FROM q CROSS JOIN (SELECT unnest(range(1, 6)) AS rank) r LEFT JOIN g ON g.query_id = q.query_id AND g.rank = r.rank)"
METRICS = f"""{PADDED},
k AS (SELECT query_id, k, rank, grade, CAST(grade >= 2 AS INT) AS rel FROM pad, (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k),
w AS (SELECT *, sum(rel) OVER (PARTITION BY query_id, k ORDER BY rank) AS seen, row_number() OVER (PARTITION BY query_id, k ORDER BY grade DESC, rank) AS ideal FROM k),
m AS (SELECT query_id, k, coalesce(1.0 / min(rank) FILTER (rel = 1), 0) AS mrr, coalesce(avg(seen / rank) FILTER (rel = 1), 0) AS map, coalesce(sum(grade / log2(rank + 1)) / nullif(sum(grade / log2(ideal + 1)), 0), 1) AS ndcg, sum(rel) / k AS precision, max(rel)::DOUBLE AS hit FROM w GROUP BY query_id, k),
on_domain AS (SELECT query_id FROM q WHERE query_label <> 0)"""


def graded(spark, d):
    q = queries_of(spark, d).select("query_id", "query_label")
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), "label")
    grades = F.when(F.col("label") == F.col("query_label"), 3).when(F.abs(F.col("label") - F.col("query_label")) == 1, 1).otherwise(0)
    rows = hits(spark, d).join(q, "query_id").join(labels, "point_id").withColumn("query", F.col("query_id").cast("string")).withColumn("title", F.concat(F.lit("title of "), "point_id"))
    table_of = rows.where(grades > 0).select("query", F.left("title", F.lit(80)).alias("title_key"), grades.alias("grade"))
    return E.graded(rows, table_of)


def eval_queries(spark, d):
    return queries_of(spark, d).select("query_id", F.when(F.col("query_label") != 0, F.col("query_label")).alias("category"))


def metrics(spark, d):
    return E.query_metrics(E.padded(graded(spark, d), eval_queries(spark, d)))


@query(f"WITH {GRADED} SELECT query_id, rank, grade FROM g")
def j7_graded(spark, d):
    return graded(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "grade")


@query(f"WITH {PADDED} SELECT query_id, rank, grade FROM pad")
def a12_padded(spark, d):
    return E.padded(graded(spark, d), eval_queries(spark, d)).select("query_id", F.col("rank").cast("long").alias("rank"), "grade")


@query(f"WITH {METRICS} SELECT query_id, k, mrr, map, ndcg, precision, hit FROM m")
def a7_a11_query_metrics(spark, d):
    return metrics(spark, d)


@query(f"WITH {METRICS} SELECT k, metric, mean FROM (SELECT k, avg(mrr) AS mrr, avg(map) AS map, avg(ndcg) AS ndcg, avg(precision) AS precision, avg(hit) AS hit FROM m WHERE query_id IN (SELECT query_id FROM on_domain) GROUP BY k) UNPIVOT (mean FOR metric IN (mrr, map, ndcg, precision, hit))")
def a13_metric_means(spark, d):
    return E.metric_means(metrics(spark, d), eval_queries(spark, d))


@query(f"WITH {HITS}, x AS (SELECT query_id, query_label <> 0 AS dom, query_id NOT IN (SELECT query_id FROM hits) AS fell FROM q) SELECT count(*) FILTER (dom) AS on_domain, count(*) FILTER (dom AND fell) AS fallbacks, count(*) FILTER (dom AND fell) * 100 // count(*) FILTER (dom) AS fallback_pct, count(*) FILTER (NOT dom) AS off_domain, count(*) FILTER (NOT dom AND fell) AS deflected FROM x")
def a14_fallback_rates(spark, d):
    return E.fallback_rates(eval_queries(spark, d), hits(spark, d))


@query(f"WITH {PADDED} SELECT CAST(v AS INT) AS grade, count(pad.grade) AS n FROM (SELECT unnest(range(0, 4)) AS v) LEFT JOIN pad ON pad.grade = v GROUP BY v")
def a15_grade_distribution(spark, d):
    return E.with_zeros(E.padded(graded(spark, d), eval_queries(spark, d)), "grade", 0, 3)


@query(f"WITH {METRICS} SELECT query_label AS category, avg(ndcg) AS ndcg, count(*) AS n FROM m JOIN q USING (query_id) WHERE k = 5 AND query_label <> 0 GROUP BY query_label")
def a16_ndcg_by_category(spark, d):
    rows = metrics(spark, d).where("k = 5").join(eval_queries(spark, d).where("category IS NOT NULL"), "query_id")
    return rows.groupBy("category").agg(F.avg("ndcg").alias("ndcg"), F.count("*").alias("n"))


@query(f"WITH {HITS} SELECT CAST(v AS INT) AS tier, count(h.tier) AS n FROM (SELECT unnest(range(1, 4)) AS v) LEFT JOIN (SELECT tier FROM hits WHERE rank <= 3) h ON h.tier = v GROUP BY v")
def a17_tier_distribution(spark, d):
    return E.with_zeros(hits(spark, d).where("rank <= 3"), "tier", 1, 3)


@query(f"""WITH {METRICS}, s AS (SELECT round(avg(ndcg) FILTER (k = 1), 4) AS ndcg_1, round(avg(ndcg) FILTER (k = 3), 4) AS ndcg_3, round(avg(ndcg) FILTER (k = 5), 4) AS ndcg_5, round(avg(mrr) FILTER (k = 5), 4) AS mrr_5, round(avg(map) FILTER (k = 5), 4) AS map_5,
 round(avg(precision) FILTER (k = 5), 4) AS precision_5, round(avg(hit) FILTER (k = 1), 4) AS hit_1, round(avg(hit) FILTER (k = 3), 4) AS hit_3 FROM m WHERE query_id IN (SELECT query_id FROM on_domain))
SELECT *, {', '.join(f"CASE WHEN {n} >= {a} THEN 'excellent' WHEN {n} >= {b} THEN 'good' WHEN {n} >= {c} THEN 'fair' ELSE 'poor' END AS band_{n}" for n, (a, b, c) in (('ndcg_5', (.85, .70, .55)), ('mrr_5', (.80, .65, .50)), ('hit_3', (.90, .75, .60))))} FROM s""")
def e1_evaluation(spark, d):
    return E.summary(metrics(spark, d), eval_queries(spark, d))


@query(f"""WITH {HITS}, rows AS (SELECT query_id, 'kb' AS origin, rank AS pos, point_id FROM hits WHERE query_id % 150 <> 0 UNION ALL SELECT query_id, 'web', pos, point_id FROM pool WHERE pos <= 3 AND query_id % 100 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY origin, pos) AS place, count(DISTINCT origin) OVER (PARTITION BY query_id) = 2 AS two FROM rows),
r AS (SELECT *, CASE WHEN two THEN CASE WHEN place % 2 = 0 THEN (query_id // 50 + place) % 4 ELSE 1 END END AS relevance FROM n),
z AS (SELECT *, max(coalesce(relevance, 1)) OVER (PARTITION BY query_id) = 0 AS none FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN none THEN 0 ELSE -coalesce(relevance, 0) END, place) AS rank FROM z WHERE none OR coalesce(relevance, 1) > 0 QUALIFY rank <= 6)
SELECT query_id, rank, origin, point_id, CASE WHEN bool_or(origin = 'kb') OVER w AND bool_or(origin = 'web') OVER w THEN 'hybrid' WHEN bool_or(origin = 'web') OVER w THEN 'web_search' ELSE 'knowledge_base' END AS path, NOT bool_or(origin = 'kb') OVER w AS used_fallback FROM o WINDOW w AS (PARTITION BY query_id)""")
def r2_merge(spark, d):
    side = lambda rows, *more: rows.select("query_id", "pos", F.lit("t").alias("title"), F.col("point_id").cast("string").alias("url"), *more)
    kb = side(hits(spark, d).where("query_id % 150 != 0").withColumn("pos", F.col("rank")), F.lit("x").alias("text"), "source", "score")
    web = side(V.top_similar(points(spark, d), queries_of(spark, d), 3, exclude_self=True).where("query_id % 100 != 0"), F.lit("y").alias("content"), F.lit(0.5).alias("score"))
    places = queries_of(spark, d).select("query_id", F.explode(F.array(*[F.lit(p) for p in (2, 4, 6, 8)])).alias("place"))
    out = R.merged(kb, web, places.withColumn("relevance", ((F.floor(F.col("query_id") / 50) + F.col("place")) % 4).cast("int")))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "origin", F.col("url").cast("long").alias("point_id"), "path", "used_fallback")


@query(f"WITH {HITS} SELECT query_id, CASE WHEN max(score) < 0.45 THEN 'WEAK' ELSE 'GOOD' END AS quality FROM hits GROUP BY query_id")
def a38_context_quality(spark, d):
    return R.context_quality(hits(spark, d), 0.45)


@query(f"WITH {HITS} SELECT query_id, string_agg('[Source ' || rank || '] (KB, source=' || source || ', tier=' || tier || ')' || chr(10) || 'Title: t' || chr(10) || 'URL: ' || point_id || chr(10) || 'x', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id")
def x40_context_block(spark, d):
    rows = hits(spark, d).select("query_id", "rank", F.lit("kb").alias("origin"), "source", "tier", F.lit("t").alias("title"), F.col("point_id").cast("string").alias("url"), F.lit("x").alias("text"))
    return R.context_block(rows)


def judgments(spark, d):
    """orders as judgments: question = customer, judge = year parity, contestant by order key, scores by arithmetic."""
    k = F.col("o_orderkey")
    label = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (k % 3 + 1).cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("question"), F.concat(F.lit("judge"), (k % 2).cast("string")).alias("judge"), label.alias("label"), *[(F.pmod(F.floor(k / m), F.lit(8)) - 1).cast("int").alias(n) for n, m in zip(E.DIMENSIONS, (1, 3, 7, 11), strict=True)], k.alias("k"))
    first = rows.groupBy("question", "judge", "label").agg(F.min(F.struct("k", *E.DIMENSIONS)).alias("r")).select("question", "judge", "label", "r.*")
    return E.clamped(first.withColumn("contestant", F.concat(F.lit("c"), "label")).withColumn("chosen", F.when(F.col("question") % 4 == 0, "Z").otherwise("A")))


JUDGED = """o AS (SELECT o_custkey AS question, 'judge' || (o_orderkey % 2) AS judge, ['A', 'B', 'C'][1 + o_orderkey % 3] AS label, o_orderkey AS k FROM orders QUALIFY row_number() OVER (PARTITION BY question, judge, label ORDER BY k) = 1),
s AS (SELECT question, judge, label, 'c' || label AS contestant, CASE WHEN question % 4 = 0 THEN 'Z' ELSE 'A' END AS chosen, least(5, greatest(0, k % 8 - 1)) AS correctness, least(5, greatest(0, (k // 3) % 8 - 1)) AS actionability, least(5, greatest(0, (k // 7) % 8 - 1)) AS depth_triage, least(5, greatest(0, (k // 11) % 8 - 1)) AS grounding FROM o),
j AS (SELECT *, correctness + actionability + depth_triage + grounding AS overall FROM s),
c AS (SELECT question, judge, coalesce(max(contestant) FILTER (label = chosen), arg_min(contestant, {'less': -overall, 'label': label})) AS best FROM j GROUP BY question, judge)"""


@query(f"WITH {JUDGED} SELECT j.judge, j.contestant AS baseline, count(*) FILTER (m.overall > j.overall) AS wins, count(*) FILTER (m.overall = j.overall) AS ties, count(*) FILTER (m.overall < j.overall) AS losses, count(*) AS n FROM j JOIN j m ON m.question = j.question AND m.judge = j.judge AND m.contestant = 'cA' WHERE j.contestant <> 'cA' GROUP BY 1, 2")
def e2_win_rates(spark, d):
    return E.win_rates(judgments(spark, d), "cA")


@query(f"WITH {JUDGED} SELECT contestant, round(avg(correctness), 2) AS correctness, round(avg(actionability), 2) AS actionability, round(avg(depth_triage), 2) AS depth_triage, round(avg(grounding), 2) AS grounding FROM j GROUP BY contestant")
def a21_dimension_means(spark, d):
    return E.dimension_means(judgments(spark, d))


@query(f"WITH {JUDGED} SELECT j.judge, j.contestant, count(DISTINCT CASE WHEN c.best = j.contestant THEN c.question END) AS n FROM j JOIN c USING (question, judge) GROUP BY 1, 2")
def a22_best_counts(spark, d):
    return E.best_counts(judgments(spark, d))


@query(f"WITH {JUDGED}, p AS (SELECT question, min(best) = max(best) AS same FROM c GROUP BY question HAVING count(*) = 2) SELECT count(*) AS questions, (SELECT count(DISTINCT judge) FROM c) AS judges, round(avg(CAST(same AS INT)), 3) AS agreement FROM p")
def a23_agreement(spark, d):
    return E.agreement(E.best_choices(judgments(spark, d)))


def verdicts(spark, d):
    """labels as verdicts of two judges on two arms."""
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("scenario"), F.explode(F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), 1 - F.col("toxic"))).alias("judge", "vote"))
    return rows.select("scenario", "judge", F.when(F.col("scenario") % 2 == 0, "one").otherwise("two").alias("arm"), (F.col("vote") == 1).alias("resolved"))


def arm_runs(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("scenario"), F.when(F.col("doc_id") % 2 == 0, "one").otherwise("two").alias("arm"), (1 + F.col("doc_id") % 5).alias("turns"))


ARMS = "v AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'one' ELSE 'two' END AS arm, 1 + doc_id % 5 AS turns, quality = 1 AS a, toxic = 0 AS b FROM labels), r AS (SELECT arm, count(*) AS n, round(avg(CAST(a AND b AS INT)), 3) AS resolution_rate, round(avg(CAST(a OR b AS INT)), 3) AS either_rate, round(avg(turns), 2) AS mean_turns FROM v GROUP BY arm)"


@query(f"WITH {ARMS} SELECT * FROM r")
def a24_resolution(spark, d):
    return E.resolution(arm_runs(spark, d), verdicts(spark, d))


@query(f"WITH {ARMS} SELECT 'quality' AS judge, arm, count(*) FILTER (a) AS resolved FROM v GROUP BY arm UNION ALL SELECT 'toxic', arm, count(*) FILTER (b) FROM v GROUP BY arm")
def a25_resolved_by_judge(spark, d):
    return E.resolved_by_judge(verdicts(spark, d))


@query(f"WITH {ARMS}, x AS (SELECT max(resolution_rate) FILTER (arm = 'one') AS system_rate, max(resolution_rate) FILTER (arm = 'two') AS rival_rate FROM r) SELECT *, system_rate + 1e-9 >= 0.35 AS kept, system_rate + 1e-9 >= rival_rate AS beats, system_rate + 1e-9 >= 0.35 AND system_rate + 1e-9 >= rival_rate AS passed FROM x")
def e3_gate(spark, d):
    return E.gate(E.resolution(arm_runs(spark, d), verdicts(spark, d)), "one", "two", 0.5, 0.15)
