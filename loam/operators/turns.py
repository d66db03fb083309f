"""Conversation turns: numbering, history windows, case files, and the decisions that are taken for each turn.

Per-turn decisions are column expressions. What concerns a whole conversation is a grouped aggregate that is combined before
the shuffle, so a conversation that holds a large share of all rows never meets in one task; only the running number of a
turn and the place of a message counted from the end need the ordered window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam import rules
from loam.functions import text as X

KEEP, FOLD = 6, 2
ANSWER_TURN, DIAGNOSTICS, QUESTIONS, OPTIONS = 3, 2, 3, 4
LEAST_MAJOR = 15
CLEAR = "CLEAR"


def first_seen(values, key=None) -> Column:
    """The array's elements without later repeats, in order; key: a function of an element that says what is equal."""
    a = X.col(values)
    keys = F.transform(a, key) if key else a
    return F.filter(a, lambda x, i: F.array_position(keys, key(x) if key else x) == i + 1)


def user_turns(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """messages with user_turn: how many of the conversation's messages up to this one are the user's."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("user_turn", F.sum((F.col("role") == "user").cast("long")).over(upto))


def history(messages: DataFrame, key: str = "conv_id", order: str = "turn", keep: int = KEEP, fold: int = FOLD) -> DataFrame:
    """messages with kept and folded: the last `keep` stay as they are, older ones are folded into a summary where a
    conversation has at least `fold` of them with an id (the order column); otherwise all stay."""
    size = messages.groupBy(key).agg(F.count("*").alias("size"), F.count(order).alias("with_id"))
    rows = messages.join(size, key).withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(order))))
    folds = (F.col("size") >= keep + fold) & (F.col("with_id") >= keep + fold)
    gone = folds & (F.col("back") > keep) & F.col(order).isNotNull()
    return rows.withColumn("kept", ~gone).withColumn("folded", gone).drop("size", "with_id", "back")


def last_messages(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, last_user, last_assistant): the last text of each role, null where there is none."""
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col(order)))
    return messages.groupBy(key).agg(last("user").alias("last_user"), last("assistant").alias("last_assistant"))


def case_files(updates: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The case file of each conversation after all its updates: facts only improve.

    updates: key, order, version, chip, category, topic, tried (array), new_problem, asked, diagnostics, pending. A new
    problem forgets topic, category, tried steps, budgets and what is pending, and keeps version and chip. The last known
    version and chip count; the last category that is not general; the first topic; tried steps in first-seen order, without
    regard to case; asked once is asked; the largest number of diagnostics; pending is the last value, none after CLEAR.
    """
    at = F.col(order)
    last = lambda c, ok: F.max_by(F.when(ok, F.col(c)), F.when(ok, at))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    new = F.coalesce("new_problem", F.lit(False))
    facts = updates.groupBy(key).agg(last("version", filled("version")).alias("version"), last("chip", filled("chip")).alias("chip"), F.max(F.when(new, at)).alias("since"))
    rows = updates.join(facts.select(key, "since"), key).where(F.col("since").isNull() | (at >= F.col("since")))
    own = rows.groupBy(key).agg(
        F.min_by(F.when(filled("topic"), F.col("topic")), F.when(filled("topic"), at)).alias("topic"),
        last("category", filled("category") & (F.col("category") != "general")).alias("category"),
        F.coalesce(F.bool_or("asked"), F.lit(False)).alias("asked"),
        F.coalesce(F.max("diagnostics"), F.lit(0)).alias("diagnostics"),
        F.nullif(last("pending", filled("pending")), F.lit(CLEAR)).alias("pending"),
    )
    steps = rows.select(key, at.alias("at"), F.posexplode("tried").alias("pos", "step")).groupBy(key, F.lower("step").alias("low"))
    steps = steps.agg(F.min(F.struct("at", "pos", "step")).alias("first")).groupBy(key).agg(F.array_sort(F.collect_list("first")).alias("all"))
    steps = steps.select(key, F.transform("all", lambda s: s["step"]).alias("tried"))
    out = facts.drop("since").join(own, key).join(steps, key, "left")
    return out.withColumn("tried", F.coalesce("tried", F.array().cast("array<string>")))


def retrieval_query(topic, latest, excerpt, clean, pending) -> Column:
    """The text to search with: the sticky topic and what the message adds to it; else the message's excerpt, or the cleaned
    query where the message is short; and the pending command, unless it is in there."""
    topic, latest, excerpt = X.col(topic), F.coalesce(X.col(latest), F.lit("")), F.coalesce(X.col(excerpt), F.lit(""))
    both = F.when(F.contains(topic, excerpt), topic).otherwise(F.trim(F.concat(topic, F.lit(" "), excerpt)))
    own = F.when(F.length(F.trim(latest)) >= 20, excerpt).otherwise(F.coalesce(F.nullif(X.col(clean), F.lit("")), latest))
    query = F.when(F.coalesce(topic, F.lit("")) != "", both).otherwise(own)
    command = F.coalesce(X.col(pending), F.lit(""))
    return F.when((command == "") | F.contains(query, command), query).otherwise(F.trim(F.concat(query, F.lit(" "), command)))


def least_tier(tried, latest, turns, tools=rules.TOOL_SIGNALS, failures=rules.FAILURE_SIGNALS) -> Column:
    """The least difficulty tier to offer: 2 where tools were tried or a follow-up says that it failed, 3 from the third user
    turn on; null: any."""
    failed = (X.col(turns) > 1) & X.mentions(F.lower(F.coalesce(X.col(latest), F.lit(""))), failures)
    deep = X.mentions(F.lower(F.array_join(F.coalesce(X.col(tried), F.array().cast("array<string>")), " ")), tools)
    return F.when(failed & (X.col(turns) >= 3), 3).when(failed | deep, 2)


def on_topic(flag, text, signals=rules.TOPIC_SIGNALS) -> Column:
    """A missing verdict counts as on topic, and a topic word overrules a verdict against; nothing turns true into false."""
    return F.coalesce(X.col(flag), F.lit(True)) | X.mentions(F.lower(F.coalesce(X.col(text), F.lit(""))), signals)


def web_worth(text, version, signals=rules.RECENCY_SIGNALS, major: int = LEAST_MAJOR) -> Column:
    """Whether a web search may add something: a word of recency, or a version from `major` on."""
    number = F.split_part(F.coalesce(X.col(version), F.lit("")), F.lit("."), F.lit(1))
    newer = F.when(number.rlike("^[0-9]+$"), number.try_cast("long") >= major).otherwise(False)
    return X.mentions(F.lower(F.coalesce(X.col(text), F.lit(""))), signals) | F.coalesce(newer, F.lit(False))


def clean_questions(questions, most: int = QUESTIONS, options: int = OPTIONS) -> Column:
    """Of an array of (text, options): texts trimmed, blank ones out, the first `most`; blank options out, the first few."""
    none = F.array().cast("array<string>")
    tidy = F.transform(
        X.col(questions),
        lambda q: F.struct(F.trim(F.coalesce(q["text"], F.lit(""))).alias("text"), F.slice(F.filter(F.transform(F.coalesce(q["options"], none), lambda o: F.trim(o)), lambda o: o != ""), 1, options).alias("options")),
    )
    return F.slice(F.filter(tidy, lambda q: q["text"] != ""), 1, most)


def turn_action(topical, turns, proposal, quality, asked, awaiting, questions, diagnostics, command, grounded, last_turn: int = ANSWER_TURN, most: int = DIAGNOSTICS) -> Column:
    """What a turn does, from the planner's proposal and the budgets: decline, answer, clarify or diagnose.

    Off topic: decline. From user turn `last_turn` on: answer. An answer without any context on the first turn becomes a
    question, if none was asked or is being answered. One round of questions; `most` diagnostics, each with a command that
    the context knows; whatever is not allowed is an answer.
    """
    c, no = X.col, lambda x: ~F.coalesce(X.col(x), F.lit(False))
    plan = F.lower(F.trim(F.coalesce(c(proposal), F.lit("answer"))))
    blind = (plan == "answer") & (c(quality) == "NONE") & (c(turns) == 1) & no(asked) & no(awaiting)
    asks = no(asked) & (F.coalesce(c(questions), F.lit(0)) > 0)
    runs = (F.coalesce(c(diagnostics), F.lit(0)) < most) & (F.trim(F.coalesce(c(command), F.lit(""))) != "") & F.coalesce(c(grounded), F.lit(False))
    return (
        F.when(no(topical), "decline").when(c(turns) >= last_turn, "answer").when(blind, "clarify")
        .when((plan == "clarify") & asks, "clarify").when((plan == "diagnose") & runs, "diagnose").otherwise("answer")
    )
