"""Commands in answers, and whether the context that an answer rests on knows them: column expressions and grouped reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam import rules
from loam.functions import text as X
from loam.functions.rows import once
from loam.operators.turns import first_seen
from loam.operators.vectors import embedded, top_similar
from loam.sources.storage import shared_dir

FENCE = r"(?s)```[a-zA-Z]*\n?(.*?)```"
PATH = r"(?:/[A-Za-z0-9._-]+){2,}|~/[A-Za-z0-9._/-]+"
LONGEST = 200
#: A command is grounded if this share of its tokens is in the context.
SHARE = 0.5
#: Hits of the second search.
RESCUED = 3


def tool_pattern(tools=rules.TOOLS) -> str:
    return r"\b(" + "|".join(X.escaped(t) for t in tools) + r")\b"


def commands(answer, tools=rules.TOOLS) -> Column:
    """The lines of fenced blocks, then the inline code spans, that name a tool or a path; the first 200 characters, without
    repeats that differ in case only."""
    text = F.coalesce(X.col(answer), F.lit(""))
    lines = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)), lambda b: F.split(b, r"\r\n|\r|\n")))
    lines = F.transform(lines, lambda line: F.trim(F.regexp_replace(F.trim(line), r"^[$ ]+", "")))
    spans = F.transform(F.regexp_extract_all(F.regexp_replace(text, FENCE, " "), F.lit("`([^`]+)`"), F.lit(1)), lambda s: F.trim(s))
    found = F.filter(F.concat(lines, spans), lambda c: (c != "") & (c.rlike(tool_pattern(tools)) | c.rlike(PATH)))
    return first_seen(F.transform(found, lambda c: F.left(c, F.lit(LONGEST))), F.lower)


def grounded(command, context, tools=rules.TOOLS, stop=rules.COMMAND_STOP_WORDS, prefix: str = "sudo") -> Column:
    """Whether the lower-cased context has the command's first tool as a word, the tool with its subcommand word for word, and
    at least half of the command's tokens (three characters or more, no stop words) as substrings."""
    command, context = X.col(command), F.lower(F.coalesce(X.col(context), F.lit("")))
    tool = F.get(F.filter(F.regexp_extract_all(command, F.lit(tool_pattern(tools)), F.lit(1)), lambda t: t != prefix), F.lit(0))
    named = tool.isNull() | F.regexp_like(context, F.concat(F.lit(r"\b\Q"), tool, F.lit(r"\E\b")))
    words = F.filter(F.split(F.replace(command, F.lit(prefix), F.lit(" ")), r"\s+"), lambda w: w != "")
    sub = F.when(F.array_position(words, tool) > 0, F.get(words, F.array_position(words, tool).cast("int")))
    known = F.coalesce(~sub.rlike(r"^[a-z][a-z-]*$") | F.contains(F.regexp_replace(context, r"\s+", " "), F.concat(tool, F.lit(" "), sub)), F.lit(True))
    tokens = F.filter(F.regexp_extract_all(F.lower(command), F.lit("[A-Za-z0-9._/-]+"), F.lit(0)), lambda t: (F.length(t) >= 3) & ~t.isin(list(stop)))
    enough = F.size(F.filter(tokens, lambda t: F.contains(context, t))) >= SHARE * F.size(tokens)
    return named & known & enough


def grounding_report(answers: DataFrame, tools=rules.TOOLS, stop=rules.COMMAND_STOP_WORDS, prefix: str = "sudo") -> DataFrame:
    """answers(answer_id, answer, context, ...) with total, grounded, ungrounded (array) and ratio (3 digits; 1 where there is
    no command). The context is not copied for each command: the test runs inside the row."""
    found = answers.withColumn("commands", commands("answer", tools))
    bad = F.filter("commands", lambda c: ~grounded(c, F.col("context"), tools, stop, prefix))
    out = found.withColumn("ungrounded", bad).withColumn("total", F.size("commands")).withColumn("grounded", F.size("commands") - F.size("ungrounded"))
    return out.withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(F.bround(F.col("grounded") / F.col("total"), 3))).drop("commands")


def grounding_totals(report: DataFrame) -> DataFrame:
    """One row over a report: answers, commands, grounded ones, and the share of these (3 digits, 1 without commands)."""
    n, good = F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("grounded"), F.lit(0))
    return report.agg(F.count("*").alias("answers"), n.alias("total"), good.alias("grounded"), F.when(n == 0, 1.0).otherwise(F.bround(good / n, 3)).alias("ratio"))


def rescued(sources: DataFrame, hits: DataFrame) -> DataFrame:
    """The sources of each answer, then hits found for its commands that it does not have yet by title and url.

    Both: answer_id, pos, title, url, text; hits' places go on behind the sources'. A hit that repeats counts once."""
    size = sources.groupBy("answer_id").agg(F.max("pos").alias("size"))
    once = hits.groupBy("answer_id", "title", "url").agg(F.min_by(F.struct("pos", "text"), "pos").alias("h")).select("answer_id", "title", "url", "h.*")
    have = sources.select("answer_id", F.col("title").alias("t"), F.col("url").alias("u")).distinct()
    new = once.join(have.withColumnRenamed("answer_id", "a"), (F.col("a") == F.col("answer_id")) & F.col("t").eqNullSafe(F.col("title")) & F.col("u").eqNullSafe(F.col("url")), "left_anti")
    new = new.join(size, "answer_id", "left").withColumn("pos", F.col("pos") + F.coalesce("size", F.lit(0))).drop("size")
    return sources.select("answer_id", "pos", "title", "url", "text").unionByName(new.select("answer_id", "pos", "title", "url", "text"))


def grounded_after_rescue(report: DataFrame, hits: DataFrame, tools=rules.TOOLS, stop=rules.COMMAND_STOP_WORDS, prefix: str = "sudo") -> DataFrame:
    """The report again, with the texts of hits(answer_id, pos, text) for its ungrounded commands behind the context."""
    more = hits.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda h: h["text"]), "\n").alias("more"))
    rows = report.drop("total", "grounded", "ungrounded", "ratio").join(more, "answer_id", "left")
    return grounding_report(rows.withColumn("context", F.concat_ws("\n", "context", "more")).drop("more"), tools, stop, prefix)


def with_rescue(answers: DataFrame, points: DataFrame, embed, n: int = RESCUED, tools=rules.TOOLS, stop=rules.COMMAND_STOP_WORDS, prefix: str = "sudo") -> DataFrame:
    """The grounding report of answers(answer_id, answer, context), and after a second search for what it did not find.

    The ungrounded commands of an answer, together and cut to 200 characters, are a query for the n nearest of points(point_id,
    embedding, title, url, text); queries of one text or one vector are searched once. Hits, one for each title and url, go behind
    the context of the answer, and its commands are graded again. Columns: those of the report, rescued (hits) and total_after,
    grounded_after, ungrounded_after, ratio_after.

    The search moves ids and vectors only. The texts of a query's hits are put together once for each distinct vector, and meet
    an answer in its own row.
    """
    spark, base = answers.sparkSession, f"{shared_dir(answers.sparkSession)}/loam/{uuid.uuid4().hex}"
    report = once(grounding_report(answers, tools, stop, prefix), ungrounded=F.col("ungrounded"))
    report = report.withColumn("_asked", F.when(F.size("ungrounded") > 0, F.left(F.array_join("ungrounded", " "), F.lit(LONGEST))))
    queries = embedded(report.where("_asked IS NOT NULL").select(F.col("_asked").alias("query_id")).distinct(), embed, "query_id")
    queries.write.parquet(f"{base}/queries")  # each query is embedded once, so that equal vectors stay equal
    queries = spark.read.schema(queries.schema).parquet(f"{base}/queries")
    searched = queries.groupBy("embedding").agg(F.min("query_id").alias("_searched"))
    of = queries.join(searched, "embedding").select(F.col("query_id").alias("_asked"), "_searched")
    hits = top_similar(points.select("point_id", "embedding"), searched.select(F.col("_searched").alias("query_id"), "embedding"), n).select("query_id", "pos", "point_id")
    found = hits.join(points.select("point_id", "title", "url", "text"), "point_id")
    first = found.groupBy("query_id", "title", "url").agg(F.min_by(F.struct("pos", "text"), "pos").alias("h"))
    more = F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda h: h["text"]), "\n").alias("_more")
    more = first.groupBy(F.col("query_id").alias("_searched")).agg(more, F.count("*").alias("rescued"))
    rows = report.join(of, "_asked", "left").join(more, "_searched", "left")
    names = ("total", "grounded", "ungrounded", "ratio")
    rows = rows.select(*[c for c in report.columns if c not in ("_asked", *names)], *[F.col(c).alias(f"_{c}") for c in names], F.coalesce("rescued", F.lit(0).cast("long")).alias("rescued"), F.col("context").alias("_context"), F.concat_ws("\n", "context", "_more").alias("_wide"))
    after = grounding_report(rows.withColumn("context", F.col("_wide")), tools, stop, prefix)
    given = [F.col("_context").alias(c) if c == "context" else F.col(f"_{c}").alias(c) if c in names else F.col(c) for c in report.columns if c != "_asked"]
    return after.select(*given, "rescued", *[F.col(c).alias(f"{c}_after") for c in names])
