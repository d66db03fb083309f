"""Ranking metrics over graded hits, judge win-rates and agreement, resolution rates and the regression gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RELEVANT, DEPTH, CUTS = 2, 5, (1, 3, 5)
DIMENSIONS = ["correctness", "actionability", "depth_triage", "grounding"]
BANDS = {"ndcg@5": (0.85, 0.70, 0.55), "mrr@5": (0.80, 0.65, 0.50), "hit@3": (0.90, 0.75, 0.60)}


def graded(hits: DataFrame, grades: DataFrame) -> DataFrame:
    """hits(query, title, ...) with grade from grades(query, title_key, grade): the title's first 80 characters, 0 if missing, 0 to 3."""
    rows = hits.withColumn("title_key", F.left("title", F.lit(80)))
    return rows.join(grades, ["query", "title_key"], "left").withColumn("grade", F.least(F.lit(3), F.greatest(F.lit(0), F.coalesce("grade", F.lit(0))))).drop("title_key")


def padded(rows: DataFrame, queries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, rank, grade) for ranks 1 to depth of every query, 0 where there is no hit."""
    slots = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("rank"))
    return slots.join(rows.select("query_id", "rank", "grade"), ["query_id", "rank"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def query_metrics(rows: DataFrame, cuts=CUTS) -> DataFrame:
    """(query_id, k, mrr, map, ndcg, precision, hit) from padded rows.

    Average precision divides by the relevant hits found; the ideal order of NDCG is that of the same k grades, and NDCG is 1
    where all are 0 - so NDCG@1 is always 1, and so is a query without hits.
    """
    at = rows.select("query_id", "rank", "grade", F.explode(F.array(*[F.lit(k) for k in cuts])).alias("k")).where("rank <= k")
    by = Window.partitionBy("query_id", "k")
    relevant = (F.col("grade") >= RELEVANT).cast("int")
    at = at.withColumn("rel", relevant).withColumn("seen", F.sum("rel").over(by.orderBy("rank"))).withColumn("ideal", F.row_number().over(by.orderBy(F.desc("grade"), "rank")))
    gain = lambda place: F.sum(F.col("grade") / F.log2(F.col(place) + 1.0))
    return at.groupBy("query_id", "k").agg(
        F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(F.col("rel") == 1, F.col("seen") / F.col("rank"))), F.lit(0.0)).alias("map"),
        F.coalesce(gain("rank") / F.nullif(gain("ideal"), F.lit(0.0)), F.lit(1.0)).alias("ndcg"),
        (F.sum("rel") / F.col("k")).alias("precision"), F.max("rel").cast("double").alias("hit"),
    )


def metric_means(metrics: DataFrame, queries: DataFrame) -> DataFrame:
    """(metric, k, mean) over queries with a category."""
    on = metrics.join(queries.where("category IS NOT NULL").select("query_id"), "query_id", "left_semi")
    wide = on.groupBy("k").agg(*[F.avg(m).alias(m) for m in ("mrr", "map", "ndcg", "precision", "hit")])
    return wide.unpivot("k", ["mrr", "map", "ndcg", "precision", "hit"], "metric", "mean")


def fallback_rates(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Fallbacks (queries without hits) of on-domain queries, with a floored percent, and deflected off-domain ones."""
    rows = queries.join(hits.select("query_id").distinct().withColumn("found", F.lit(True)), "query_id", "left").withColumn("fell", F.col("found").isNull())
    on = F.col("category").isNotNull()
    n, fell = F.sum(on.cast("long")), F.sum((on & F.col("fell")).cast("long"))
    return rows.agg(n.alias("on_domain"), fell.alias("fallbacks"), F.coalesce(F.floor(fell * 100 / F.nullif(n, F.lit(0))), F.lit(0)).cast("long").alias("fallback_pct"), F.sum((~on).cast("long")).alias("off_domain"), F.sum((~on & F.col("fell")).cast("long")).alias("deflected"))


def with_zeros(rows: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """(value, n): counts of each value from low to high, zeros kept."""
    spark = rows.sparkSession
    all_values = spark.range(low, high + 1).select(F.col("id").cast("int").alias(value))
    counts = rows.groupBy(F.col(value).cast("int").alias(value)).agg(F.count("*").alias("n"))
    return all_values.join(counts, value, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def summary(metrics: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: the headline means to 4 digits, and the band of each that has one."""
    on = metrics.join(queries.where("category IS NOT NULL").select("query_id"), "query_id", "left_semi")
    pick = lambda m, k: F.avg(F.when(F.col("k") == k, F.col(m)))
    wanted = {"ndcg@1": ("ndcg", 1), "ndcg@3": ("ndcg", 3), "ndcg@5": ("ndcg", 5), "mrr@5": ("mrr", 5), "map@5": ("map", 5), "precision@5": ("precision", 5), "hit@1": ("hit", 1), "hit@3": ("hit", 3)}
    one = on.agg(*[F.round(pick(*mk), 4).alias(name.replace("@", "_")) for name, mk in wanted.items()])
    bands = []
    for name, (best, good, fair) in BANDS.items():
        c = F.col(name.replace("@", "_"))
        bands.append(F.when(c >= best, "excellent").when(c >= good, "good").when(c >= fair, "fair").otherwise("poor").alias(f"band_{name.replace('@', '_')}"))
    return one.select("*", *bands)


# Judgments: one row per question, judge and label with four scores, the chosen label and label -> contestant.


def clamped(scores: DataFrame) -> DataFrame:
    """scores with each dimension between 0 and 5 and their sum as overall."""
    out = scores
    for d in DIMENSIONS:
        out = out.withColumn(d, F.least(F.lit(5), F.greatest(F.lit(0), F.coalesce(F.col(d), F.lit(0)))))
    return out.withColumn("overall", sum((F.col(d) for d in DIMENSIONS), F.lit(0)))


def win_rates(scores: DataFrame, system: str) -> DataFrame:
    """(judge, baseline, wins, ties, losses, n) of the system against every other contestant, question by question."""
    mine = scores.where(F.col("contestant") == system).select("question", "judge", F.col("overall").alias("own"))
    both = scores.where(F.col("contestant") != system).join(mine, ["question", "judge"])
    count = lambda test: F.sum(test.cast("long"))
    own, other = F.col("own"), F.col("overall")
    return both.groupBy("judge", F.col("contestant").alias("baseline")).agg(count(own > other).alias("wins"), count(own == other).alias("ties"), count(own < other).alias("losses"), F.count("*").alias("n"))


def dimension_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("contestant").agg(*[F.round(F.avg(d), 2).alias(d) for d in DIMENSIONS])


def best_choices(scores: DataFrame) -> DataFrame:
    """(question, judge, best): the judge's choice if it is one of the labels, else the label with the highest sum, the lowest on ties."""
    fallback = F.min(F.struct((-F.col("overall")).alias("less"), "label", "contestant"))
    own = F.max(F.when(F.col("label") == F.col("chosen"), F.col("contestant")))
    return scores.groupBy("question", "judge").agg(F.coalesce(own, fallback["contestant"]).alias("best"))


def best_counts(scores: DataFrame) -> DataFrame:
    """(judge, contestant, n) with zero rows for every contestant that the judge has scored."""
    won = best_choices(scores).groupBy("judge", F.col("best").alias("contestant")).agg(F.count("*").alias("n"))
    return scores.select("judge", "contestant").distinct().join(won, ["judge", "contestant"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def agreement(choices: DataFrame) -> DataFrame:
    """One row: share of questions on which the two judges chose the same, 3 digits; null unless there are exactly two judges."""
    per = choices.groupBy("question").agg(F.min("judge").alias("low"), F.max("judge").alias("high"), F.count("*").alias("n"), F.min("best").alias("a"), F.max("best").alias("b")).where("n = 2 AND low != high")
    judges = choices.agg(F.count_distinct("judge").alias("judges"))
    rate = per.agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 3).alias("rate"), F.count("*").alias("questions"))
    return rate.join(F.broadcast(judges)).select("questions", "judges", F.when(F.col("judges") == 2, F.col("rate")).alias("agreement"))


def resolution(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(arm, n, resolution_rate, either_rate, mean_turns): resolved by all judges (at least one), by any; 3, 3 and 2 digits."""
    votes = verdicts.groupBy("scenario", "arm").agg(F.bool_and("resolved").alias("every"), F.bool_or("resolved").alias("some"))
    rows = runs.join(votes, ["scenario", "arm"], "left")
    rate = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), 3)
    return rows.groupBy("arm").agg(F.count("*").alias("n"), rate("every").alias("resolution_rate"), rate("some").alias("either_rate"), F.round(F.avg("turns"), 2).alias("mean_turns"))


def resolved_by_judge(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("judge", "arm").agg(F.sum(F.col("resolved").cast("long")).alias("resolved"))


def gate(rates: DataFrame, system: str, rival: str, baseline: float, tolerance: float, must_beat: bool = True) -> DataFrame:
    """One row: whether the system keeps its baseline less the tolerance and, if asked, its rival."""
    of = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("resolution_rate")))
    one = rates.agg(of(system).alias("system_rate"), of(rival).alias("rival_rate"))
    kept = F.col("system_rate") + 1e-9 >= baseline - tolerance
    beats = (F.col("system_rate") + 1e-9 >= F.col("rival_rate")) | F.lit(not must_beat)
    return one.select("system_rate", "rival_rate", kept.alias("kept"), beats.alias("beats"), (kept & beats).alias("passed"))


def blind_labels(answers: DataFrame) -> DataFrame:
    """answers(question, contestant) with label A, B, ... in an order that depends on the pair alone, not on the contestant's name order."""
    order = Window.partitionBy("question").orderBy(F.sha2(F.concat_ws("|", "question", "contestant"), 256))
    return answers.withColumn("label", F.char(F.row_number().over(order) + 64))


def unblinded(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """scores(question, label, ...) with the contestant that labels(question, contestant, label) hides behind each label; scores of
    labels that were not dealt are left out."""
    return scores.join(labels.select("question", "label", "contestant"), ["question", "label"])


def repaired_judgment(raw):
    """Column: the scores map of a judge's raw reply: fences stripped, from the first brace to the last; null if it does not parse."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.from_json(body, "scores map<string,struct<correctness:int,actionability:int,depth_triage:int,grounding:int,note:string>>, best string")


def judgments(replies: DataFrame, labels: list[str]) -> DataFrame:
    """(columns of replies but raw, label, the four dimensions, note, best, parse_error) of replies(raw, ...), a row for each label:
    scores clamped to 0..5, a missing one 0, notes cut at 200 characters; a best that is no label becomes the one with the
    highest sum, the first of equals. A reply that does not parse has a row with zeros for each label and no best."""
    dims = ["correctness", "actionability", "depth_triage", "grounding"]
    rows = replies.withColumn("parsed", repaired_judgment("raw"))
    own = F.transform(
        F.array(*[F.lit(x) for x in labels]),
        lambda x: F.struct(x.alias("label"), *[F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(F.try_element_at(F.col("parsed.scores"), x)[d], F.lit(0)))).alias(d) for d in dims], F.left(F.coalesce(F.try_element_at(F.col("parsed.scores"), x)["note"], F.lit("")), F.lit(200)).alias("note")),
    )
    rows = rows.withColumn("own", own)
    total = lambda s: s["correctness"] + s["actionability"] + s["depth_triage"] + s["grounding"]
    most = F.array_max(F.transform("own", total))
    highest = F.get(F.filter("own", lambda s: total(s) == most), F.lit(0))["label"]
    given = F.col("parsed.best")
    failed = F.col("parsed").isNull() | (F.col("parsed.scores").isNull() & given.isNull())
    best = F.when(~failed, F.when(given.isin(labels), given).otherwise(highest))
    keep = [c for c in replies.columns if c != "raw"]
    return rows.select(*keep, F.explode("own").alias("s"), best.alias("best"), failed.alias("parse_error")).select(*keep, "s.*", "best", "parse_error")
