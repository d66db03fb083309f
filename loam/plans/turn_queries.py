"""Queries on conversation turns, grounding and credits, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loam.operators import credits as C
from loam.operators import grounding as G
from loam.operators import turns as U
from loam.operators.vectors import embedded
from loam.plans.common import contains_any, quoted, table
from loam.plans.registry import query
from loam.streaming import conversations, counters

FAILED, TOOLS, RECENT, TOPICAL = ["and", "with"], ["the", "der", "le"], ["new", "from"], ["the", "in "]
STOP = ["and", "for"]


def messages(spark, d):
    return table(spark, d, "conversations")


@query("SELECT conv_id, turn, (sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS user_turn FROM conversations")
def w11_user_turns(spark, d):
    return U.user_turns(messages(spark, d)).select("conv_id", "turn", "user_turn")


@query("""SELECT conv_id, turn, NOT (f AND r > 3) AS kept, f AND r > 3 AS folded
FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) >= 5 AS f FROM conversations)""")
def w12_history(spark, d):
    return U.history(messages(spark, d), keep=3, fold=2).select("conv_id", "turn", "kept", "folded")


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS last_user, arg_max(text, turn) FILTER (role = 'assistant') AS last_assistant FROM conversations GROUP BY 1")
def w13_last_messages(spark, d):
    return U.last_messages(messages(spark, d))


def said(spark, d):
    """User messages with the conversation's first message as its topic, and a command that waits on every other turn."""
    first = messages(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.min("turn").alias("start"))
    rows = U.user_turns(messages(spark, d)).where("role = 'user'").join(first, "conv_id")
    topic = F.when(F.col("turn") > F.col("start"), F.col("first"))
    return rows.withColumn("topic", topic).withColumn("pending", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("run "), F.col("turn").cast("string"))))


SAID = """WITH u AS (SELECT *, (sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS user_turn FROM conversations),
s AS (SELECT conv_id, turn, user_turn, text, CASE WHEN row_number() OVER w > 1 THEN first_value(text) OVER w END AS topic, CASE WHEN turn % 2 = 0 THEN 'run ' || turn END AS pending
FROM u WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(f"""{SAID}, q AS (SELECT conv_id, turn, pending, CASE WHEN coalesce(topic, '') <> '' THEN CASE WHEN contains(topic, left(text, 60)) THEN topic ELSE trim(topic || ' ' || left(text, 60)) END
WHEN length(trim(text)) >= 20 THEN left(text, 60) ELSE text END AS query FROM s)
SELECT conv_id, turn, CASE WHEN pending IS NULL OR contains(query, pending) THEN query ELSE trim(query || ' ' || pending) END AS query FROM q""")
def x33_retrieval_query(spark, d):
    return said(spark, d).select("conv_id", "turn", U.retrieval_query("topic", "text", F.left("text", F.lit(60)), F.lit(None).cast("string"), "pending").alias("query"))


@query(f"""{SAID} SELECT conv_id, turn, CASE WHEN user_turn > 1 AND {contains_any('lower(text)', FAILED)} THEN CASE WHEN user_turn >= 3 THEN 3 ELSE 2 END
WHEN {contains_any('lower(text)', TOOLS)} THEN 2 END AS tier FROM s""")
def x34_least_tier(spark, d):
    return said(spark, d).select("conv_id", "turn", U.least_tier(F.array("text"), "text", "user_turn", TOOLS, FAILED).alias("tier"))


@query(f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN true WHEN turn % 3 = 1 THEN {contains_any('lower(text)', TOPICAL)} ELSE true END AS topical FROM conversations")
def f13_on_topic(spark, d):
    flag = F.when(F.col("turn") % 3 == 0, True).when(F.col("turn") % 3 == 1, False)
    return messages(spark, d).select("conv_id", "turn", U.on_topic(flag, "text", TOPICAL).alias("topical"))


@query(f"""SELECT conv_id, turn, {contains_any('lower(text)', RECENT)} OR coalesce(turn % 4 <> 3 AND 11 + conv_id % 8 >= 15, false) AS web FROM conversations""")
def f14_web_worth(spark, d):
    version = F.when(F.col("turn") % 4 == 3, "x.1").otherwise(F.concat((11 + F.col("conv_id") % 8).cast("string"), F.lit(".2")))
    return messages(spark, d).select("conv_id", "turn", U.web_worth("text", version, RECENT).alias("web"))


@query("""SELECT conv_id, turn, array_to_string(list_transform(list_slice(list_filter(list_transform(list_slice(string_split(text, ' '), 1, 6), lambda x, i: [CASE WHEN i % 3 = 2 THEN '' ELSE trim(x) END, array_to_string(list_slice(list_filter(list_transform(list_slice(string_split(text, ' '), 2, 6), lambda o: trim(o)), lambda o: o <> '' AND o <> 'the'), 1, 4), '/')]), lambda q: q[1] <> ''), 1, 3), lambda q: q[1] || ':' || q[2]), '|') AS questions FROM conversations""")
def x38_questions(spark, d):
    words = F.split("text", " ", -1)
    options = F.transform(F.slice(words, 2, 5), lambda o: F.when(o == "the", F.lit(" ")).otherwise(o))
    raw = F.transform(F.slice(words, 1, 6), lambda x, i: F.struct(F.when(i % 3 == 1, F.lit("  ")).otherwise(x).alias("text"), options.alias("options")))
    shown = F.array_join(F.transform(U.clean_questions(raw), lambda q: F.concat(q["text"], F.lit(":"), F.array_join(q["options"], "/"))), "|")
    return messages(spark, d).select("conv_id", "turn", shown.alias("questions"))


@query("""WITH r AS (SELECT event_id, event_id % 11 <> 0 AS topical, 1 + event_id % 4 AS turns, ['answer', 'clarify', ' Diagnose ', 'other'][1 + event_id % 7 % 4] AS plan, CASE WHEN event_id % 3 = 0 THEN 'NONE' ELSE 'GOOD' END AS quality,
event_id % 5 = 0 AS asked, event_id % 13 = 0 AS awaiting, event_id % 2 AS questions, event_id % 3 AS diagnostics, CASE WHEN event_id % 17 <> 0 THEN 'log show' ELSE ' ' END AS command, event_id % 6 <> 0 AS grounded FROM events)
SELECT event_id, CASE WHEN NOT topical THEN 'decline' WHEN turns >= 3 THEN 'answer' WHEN plan = 'answer' AND quality = 'NONE' AND turns = 1 AND NOT asked AND NOT awaiting THEN 'clarify'
WHEN plan = 'clarify' AND NOT asked AND questions > 0 THEN 'clarify' WHEN trim(lower(plan)) = 'diagnose' AND diagnostics < 2 AND command <> ' ' AND grounded THEN 'diagnose' ELSE 'answer' END AS action FROM r""")
def x39_turn_action(spark, d):
    e = F.col("event_id")
    plan = F.element_at(F.array(*[F.lit(p) for p in ("answer", "clarify", " Diagnose ", "other")]), (1 + e % 7 % 4).cast("int"))
    quality, command = F.when(e % 3 == 0, "NONE").otherwise("GOOD"), F.when(e % 17 != 0, "log show").otherwise(" ")
    action = U.turn_action(e % 11 != 0, 1 + e % 4, plan, quality, e % 5 == 0, e % 13 == 0, e % 2, e % 3, command, e % 6 != 0)
    return table(spark, d, "events").select("event_id", action.alias("action"))


def updates(spark, d):
    return updates_of(messages(spark, d))


def updates_of(rows):
    t, c = F.col("turn"), F.col("conv_id")
    some = lambda test, value: F.when(test, value)
    return rows.select(
        "conv_id", "turn", some(t % 3 == 1, F.concat(F.lit("v"), t.cast("string"))).alias("version"), some((t + c) % 4 == 0, F.concat(F.lit("m"), (c % 3).cast("string"))).alias("chip"),
        F.element_at(F.array(F.lit("general"), F.lit("disk"), F.lit(None), F.lit("wifi")), ((t + c) % 4 + 1).cast("int")).alias("category"), some(F.col("role") == "user", F.left("text", F.lit(30))).alias("topic"),
        F.slice(F.split("text", " "), 1, 2).alias("tried"), ((t > 2) & ((c + t) % 5 == 0)).alias("new_problem"), ((t + c) % 7 == 1).alias("asked"), (t % 3).alias("diagnostics"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("ask"), t.cast("string"))).when((t + c) % 2 == 0, U.CLEAR).alias("pending"),
    )


CASES = """WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'v' || turn END AS version, CASE WHEN (turn + conv_id) % 4 = 0 THEN 'm' || (conv_id % 3) END AS chip, ['general', 'disk', NULL, 'wifi'][1 + (turn + conv_id) % 4] AS category,
CASE WHEN role = 'user' THEN left(text, 30) END AS topic, string_split(text, ' ')[1:2] AS tried, turn > 2 AND (conv_id + turn) % 5 = 0 AS new, (turn + conv_id) % 7 = 1 AS asked, turn % 3 AS diagnostics,
CASE WHEN role = 'assistant' THEN 'ask' || turn WHEN (turn + conv_id) % 2 = 0 THEN 'CLEAR' END AS pending FROM conversations),
f AS (SELECT conv_id, arg_max(version, turn) FILTER (version IS NOT NULL) AS version, arg_max(chip, turn) FILTER (chip IS NOT NULL) AS chip, coalesce(max(turn) FILTER (new), -1) AS since FROM x GROUP BY 1),
p AS (SELECT x.* FROM x JOIN f USING (conv_id) WHERE turn >= since),
o AS (SELECT conv_id, arg_min(topic, turn) FILTER (coalesce(topic, '') <> '') AS topic, arg_max(category, turn) FILTER (category <> 'general') AS category, bool_or(asked) AS asked, max(diagnostics) AS diagnostics,
nullif(arg_max(pending, turn) FILTER (pending IS NOT NULL), 'CLEAR') AS pending FROM p GROUP BY 1),
s AS (SELECT conv_id, turn, pos, tried[pos] AS step FROM (SELECT conv_id, turn, tried, unnest(range(1, len(tried) + 1)) AS pos FROM p)),
k AS (SELECT conv_id, min(row(turn, pos, step)) AS first FROM s GROUP BY conv_id, lower(step)),
t AS (SELECT conv_id, string_agg(first[3], '|' ORDER BY first) AS tried FROM k GROUP BY 1)
SELECT conv_id, version, chip, topic, category, asked, diagnostics, pending, coalesce(tried, '') AS tried FROM f JOIN o USING (conv_id) LEFT JOIN t USING (conv_id)"""


@query(CASES)
def g5_case_files(spark, d):
    return U.case_files(updates(spark, d)).withColumn("tried", F.array_join("tried", "|"))


def answers(spark, d):
    """Documents as answers: their first words in a fence and in spans, the rest of the text as context."""
    w = F.split("text", " ", -1)
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    answer = F.concat(F.lit("Try\n```bash\n$ "), part(1, 4), F.lit("\n"), part(5, 3), F.lit("\n```\nthen `"), part(8, 3), F.lit("` or `"), part(1, 4), F.lit("`."))
    return table(spark, d, "documents").where("NOT contains(text, '`') AND NOT regexp_like(left(text, 300), '[\\n\\r\\t/]|[^\\\\x00-\\\\x7F]') AND length(text) > 300").select(F.col("doc_id").alias("answer_id"), answer.alias("answer"), F.substring("text", 61, 2000).alias("context"))


TOOL = rf"\b({'|'.join(TOOLS)})\b"
COMMANDS = rf"""WITH d AS (SELECT doc_id AS answer_id, string_split(text, ' ') AS w, substr(text, 61, 2000) AS context FROM documents
WHERE NOT contains(text, '`') AND NOT regexp_matches(left(text, 300), '[\n\r\t/]|[^\x00-\x7F]') AND length(text) > 300),
c AS (SELECT answer_id, lower(context) AS context, list_filter([trim(array_to_string(w[1:4], ' ')), trim(array_to_string(w[5:7], ' ')), trim(array_to_string(w[8:10], ' ')), trim(array_to_string(w[1:4], ' '))], lambda x: regexp_matches(x, '{TOOL}')) AS found FROM d),
u AS (SELECT answer_id, context, list_filter(found, lambda x, i: list_position(list_transform(found, lambda y: lower(y)), lower(x)) = i) AS commands FROM c),
e AS (SELECT answer_id, context, unnest(commands) AS command, unnest(range(1, len(commands) + 1)) AS pos FROM u),
k AS (SELECT *, regexp_extract(command, '{TOOL}', 1) AS tool, list_filter(regexp_split_to_array(command, '\s+'), lambda x: x <> '') AS words,
list_filter(regexp_extract_all(lower(command), '[A-Za-z0-9._/-]+'), lambda t: length(t) >= 3 AND t NOT IN ({quoted(STOP)})) AS tokens FROM e),
v AS (SELECT *, CASE WHEN list_position(words, tool) > 0 THEN words[list_position(words, tool) + 1] END AS sub FROM k),
g AS (SELECT answer_id, command, pos, (tool = '' OR regexp_matches(context, '\b' || tool || '\b')) AND (sub IS NULL OR NOT regexp_matches(sub, '^[a-z][a-z-]*$') OR contains(regexp_replace(context, '\s+', ' ', 'g'), tool || ' ' || sub))
AND len(list_filter(tokens, lambda t: contains(context, t))) >= 0.5 * len(tokens) AS grounded FROM v)"""


@query(f"{COMMANDS} SELECT answer_id, array_to_string(commands, '|') AS commands FROM u")
def x27_commands(spark, d):
    return answers(spark, d).select("answer_id", F.array_join(G.commands("answer", TOOLS), "|").alias("commands"))


@query(f"{COMMANDS} SELECT answer_id, command, grounded FROM g")
def x28_grounded(spark, d):
    rows = answers(spark, d).select("answer_id", "context", F.explode(G.commands("answer", TOOLS)).alias("command"))
    return rows.select("answer_id", "command", G.grounded("command", "context", TOOLS, STOP).alias("grounded"))


REPORT = f"""{COMMANDS}, r AS (SELECT u.answer_id, count(g.command)::INT AS total, (count(*) FILTER (g.grounded))::INT AS grounded, coalesce(string_agg(g.command, '|' ORDER BY pos) FILTER (NOT g.grounded), '') AS ungrounded
FROM u LEFT JOIN g USING (answer_id) GROUP BY 1)"""


@query(f"{REPORT} SELECT *, CASE WHEN total = 0 THEN 1.0 ELSE round_even(grounded / total, 3) END::DOUBLE AS ratio FROM r")
def r3_grounding_report(spark, d):
    report = G.grounding_report(answers(spark, d), TOOLS, STOP)
    return report.select("answer_id", "total", "grounded", F.array_join("ungrounded", "|").alias("ungrounded"), "ratio")


@query(f"{REPORT} SELECT count(*) AS answers, sum(total)::BIGINT AS total, sum(grounded)::BIGINT AS grounded, round_even(sum(grounded) / sum(total), 3)::DOUBLE AS ratio FROM r")
def a36_grounding_totals(spark, d):
    return G.grounding_totals(G.grounding_report(answers(spark, d), TOOLS, STOP))


@query("""WITH s AS (SELECT doc_id // 4 AS answer_id, doc_id % 4 + 1 AS pos, 't' || (doc_id % 3) AS title, 'u' || (doc_id % 2) AS url FROM documents WHERE doc_id % 2 = 0),
h AS (SELECT doc_id // 4 AS answer_id, doc_id % 4 + 1 AS pos, 't' || (doc_id % 4) AS title, 'u' || (doc_id % 2) AS url FROM documents),
n AS (SELECT answer_id, min(pos) AS pos, title, url FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.answer_id = h.answer_id AND s.title = h.title AND s.url = h.url) GROUP BY answer_id, title, url)
SELECT answer_id, pos, title, url FROM s UNION ALL SELECT n.answer_id, pos + coalesce(z.size, 0), title, url FROM n LEFT JOIN (SELECT answer_id, max(pos) AS size FROM s GROUP BY 1) z USING (answer_id)""")
def j15_rescued(spark, d):
    i = F.col("doc_id")
    named = lambda k: table(spark, d, "documents").select(F.floor(i / 4).alias("answer_id"), (i % 4 + 1).alias("pos"), F.concat(F.lit("t"), (i % k).cast("string")).alias("title"), F.concat(F.lit("u"), (i % 2).cast("string")).alias("url"), "text")
    sources = named(3).where((F.col("pos") - 1) % 2 == 0)
    return G.rescued(sources, named(4)).drop("text")


def by_length(texts):
    """A stand-in for an embedder that SQL can follow: the direction of (length mod 97, 1)."""
    return np.array([[len(t) % 97, 1] for t in texts], np.float32)


SOLID = r"(^|[^\p{L}\p{N}_])der($|[^\p{L}\p{N}_])"


def single(context: str, name: str) -> str:
    """SQL: whether a lower-cased context grounds the command `der a b`."""
    known = f"regexp_matches({context}, '{SOLID}') AND contains(regexp_replace({context}, '[ \t\n\x0B\f\r]+', ' ', 'g'), 'der ' || a)"
    token = lambda t: f"CASE WHEN contains({context}, {t}) THEN 1 ELSE 0 END"
    counted = lambda t: f"CASE WHEN {t} IN ({quoted(STOP)}) THEN 0 ELSE 1 END"
    return f"({known} AND {token(quoted(['der']))} + {counted('a')} * {token('a')} + {counted('b')} * {token('b')} >= 0.5 * (1 + {counted('a')} + {counted('b')})) AS {name}"


@query(f"""WITH w AS (SELECT doc_id, text, lower(text) AS low, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{{3,20}}') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, low, text, w[1] AS a, w[2] AS b FROM w WHERE len(w) >= 2),
g AS (SELECT doc_id, low, a, b, 'der ' || a || ' ' || b AS query, {single('low', 'before')} FROM d),
q AS (SELECT DISTINCT query, [(length(query) % 97)::DOUBLE, 1] AS v FROM g WHERE NOT before),
h AS (SELECT query, text, row_number() OVER (PARTITION BY query ORDER BY list_cosine_similarity(v, [(length(text) % 97)::DOUBLE, 1]) DESC, doc_id) AS pos FROM q, documents WHERE text IS NOT NULL QUALIFY pos <= 3),
m AS (SELECT query, lower(string_agg(text, chr(10) ORDER BY pos)) AS more FROM h GROUP BY query),
e AS (SELECT g.*, CASE WHEN more IS NULL THEN low ELSE low || chr(10) || more END AS wide FROM g LEFT JOIN m ON m.query = g.query AND NOT before),
f AS (SELECT *, {single('wide', 'after')} FROM e)
SELECT doc_id AS answer_id, before, after, CASE WHEN before THEN 0 ELSE 3 END::BIGINT AS rescued FROM f""")
def r3_rescued_report(spark, d):
    """Every text answers with one command made of its first words; what its own text does not ground is searched for in all texts."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z]{3,20}"), F.lit(0))
    rows = docs.select(F.col("doc_id").alias("answer_id"), F.col("text").alias("context"), words.alias("w")).where(F.size("w") >= 2)
    rows = rows.select("answer_id", "context", F.concat(F.lit("Run `der "), F.get("w", F.lit(0)), F.lit(" "), F.get("w", F.lit(1)), F.lit("` now.")).alias("answer"))
    points = embedded(docs.select(F.col("doc_id").alias("point_id"), F.col("doc_id").cast("string").alias("title"), F.lit("u").alias("url"), "text"), by_length)
    report = G.with_rescue(rows, points, by_length, tools=["der"], stop=STOP)
    return report.select("answer_id", (F.col("grounded") == F.col("total")).alias("before"), (F.col("grounded_after") == F.col("total_after")).alias("after"), "rescued")


def turns(spark, d):
    """One turn an event, in a few hundred accounts: the cost from its id."""
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("turn_id"), F.when(e % 29 != 0, F.col("user_id")).alias("user_id"), "ts", (e % 97 / 1000).alias("cost"))


#: The fold as a recursion over the turns of each account.
GATE = """WITH RECURSIVE t AS (SELECT event_id, user_id, strftime(ts, '%G-W%V') AS week, strftime(ts, '%Y-%m') AS month, (event_id % 97) / 1000 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_id % 29 <> 0),
f(event_id, user_id, n, week, month, left_, spent, allowed, reason, shown, before) AS (
SELECT event_id, user_id, n, week, month, 4::BIGINT, cost::DOUBLE, true, NULL::VARCHAR, 4::BIGINT, 0.0::DOUBLE FROM t WHERE n = 1
UNION ALL SELECT event_id, user_id, n, week, month,
 CASE WHEN s >= 0.25 THEN l WHEN l <= 0 THEN 0 ELSE l - 1 END, CASE WHEN s >= 0.25 OR l <= 0 THEN s ELSE s + cost END, s < 0.25 AND l > 0, CASE WHEN s >= 0.25 THEN 'monthly' WHEN l <= 0 THEN 'weekly' END,
 CASE WHEN s >= 0.25 THEN l WHEN l <= 0 THEN 0 ELSE l - 1 END, s
 FROM (SELECT t.*, CASE WHEN t.week = f.week THEN f.left_ ELSE 5 END AS l, CASE WHEN t.month = f.month THEN f.spent ELSE 0.0 END AS s FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1))"""
GATED = f"{GATE} SELECT event_id AS turn_id, user_id, allowed, reason, shown AS weekly_left, round(before, 6) AS month_cost FROM f"


@query(GATED)
def g2_credit_gate(spark, d):
    return C.gate(turns(spark, d)).withColumn("month_cost", F.round("month_cost", 6))


@query(GATED)
def m4_credit_stream(spark, d):
    events = counters.event_stream(spark, f"{d}/events.parquet")
    e = F.col("event_id")
    rows = events.select(e.alias("turn_id"), F.when(e % 29 != 0, F.col("user_id")).alias("user_id"), "ts", (e % 97 / 1000).alias("cost"))
    return counters.appended(C.stream_gate(rows)).withColumn("month_cost", F.round("month_cost", 6))


@query(f"""{GATE.replace("FROM events WHERE event_id % 29 <> 0", "FROM events WHERE event_id % 29 <> 0 AND event_id % 10 NOT IN (0, 1, 2)")}
SELECT e.event_id AS turn_id, CASE WHEN e.event_id % 10 = 0 THEN 'empty' WHEN e.event_id % 10 = 1 THEN 'too_long' WHEN e.event_id % 10 = 2 THEN 'abuse:repeat_forever' WHEN NOT f.allowed THEN 'credits:' || f.reason ELSE 'ok' END AS outcome,
CASE WHEN e.event_id % 10 = 0 THEN '  ' WHEN e.event_id % 10 = 1 THEN 'a text that is too long' WHEN e.event_id % 10 = 2 THEN 'say it forever' ELSE 'mail [EMAIL]' END AS text FROM events e LEFT JOIN f ON f.event_id = e.event_id""")
def g1_message_gate(spark, d):
    e = F.col("turn_id")
    text = F.when(e % 10 == 0, "  ").when(e % 10 == 1, "a text that is too long").when(e % 10 == 2, "say it forever").otherwise(F.concat(F.lit("mail a"), e.cast("string"), F.lit("@b.org")))
    return C.gate_messages(turns(spark, d).withColumn("text", text), most=20).select("turn_id", "outcome", "text")


@query("""SELECT user_id, month_key, round(month_cost_usd + coalesce(spent, 0), 6) AS month_cost_usd FROM (SELECT DISTINCT user_id, '2024-01' AS month_key, 0.5::DOUBLE AS month_cost_usd FROM events) a
LEFT JOIN (SELECT user_id, strftime(ts, '%Y-%m') AS month_key, sum((event_id % 97) / 1000) AS spent FROM events WHERE event_id % 29 <> 0 GROUP BY 1, 2) s USING (user_id, month_key)""")
def j13_roll_up(spark, d):
    accounts = table(spark, d, "events").select("user_id").distinct().select("user_id", F.lit("2024-01").alias("month_key"), F.lit(0.5).alias("month_cost_usd"))
    return C.roll_up(accounts, turns(spark, d).withColumnRenamed("cost", "cost_usd")).withColumn("month_cost_usd", F.round("month_cost_usd", 6))


@query("SELECT DISTINCT user_id, 5 AS weekly_left, '2024-W05' AS week_key, user_id / 7.0::DOUBLE AS month_cost_usd FROM events")
def k12_reset(spark, d):
    accounts = table(spark, d, "events").select("user_id").distinct().withColumn("month_cost_usd", F.col("user_id") / F.lit(7.0))
    return C.reset_accounts(accounts, F.lit("2024-02-01 10:00:00").cast("timestamp")).select("user_id", "weekly_left", "week_key", "month_cost_usd")


@query("SELECT event_id, value AS cost_usd FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 50 = 0")
def k10_append(spark, d):
    ledger = table(spark, d, "events").select("event_id", F.col("value").alias("cost_usd"))
    return C.with_entries(ledger.where("event_id % 2 = 0"), ledger.where("event_id % 50 = 0").select("event_id"))


def message_stream(spark, d):
    return counters.parquet_stream(spark, f"{d}/conversations.parquet")


@query(CASES)
def m3_case_stream(spark, d):
    return counters.appended(conversations.stream_case_files(updates_of(message_stream(spark, d)))).withColumn("tried", F.array_join("tried", "|"))


@query("SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM (SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY 1")
def m7_history_stream(spark, d):
    return counters.appended(conversations.stream_history(message_stream(spark, d)))


@query("SELECT DISTINCT 'c' || (event_id % 700) AS chunk_id FROM events")
def m6_ingest_stream(spark, d):
    events = counters.event_stream(spark, f"{d}/events.parquet")
    return counters.appended(conversations.stream_once(events.select(F.concat(F.lit("c"), (F.col("event_id") % 700).cast("string")).alias("chunk_id")), "chunk_id"))
