"""Spend, histogram, rate, feedback, link and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import accounting as A
from loam.plans.common import table
from loam.plans.registry import query
from loam.sources import readers
from loam.streaming import counters

BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0]
HOURLY = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
LATEST = "SELECT user_id, event_type, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY 1, 2"
#: The buckets' counts by event type, as a list in order of bounds.
CELLS = "SELECT event_type, unnest([5.0, 10.0, 25.0, 50.0, 100.0, 'Infinity'::DOUBLE]::DOUBLE[]) AS le FROM (SELECT DISTINCT event_type FROM events)"
HISTOGRAM = f"SELECT c.event_type, c.le, count(*) FILTER (e.value <= c.le) AS n FROM ({CELLS}) c JOIN events e ON e.event_type = c.event_type GROUP BY 1, 2"


def ledger(spark, d):
    """One turn an event: tokens from its id, the model from its id's remainder."""
    e = F.col("event_id")
    model = F.when(e % 3 == 0, "llama-3.1-8b-instant").otherwise("other")
    rows = table(spark, d, "events").select("ts", "user_id", (e % 1000).alias("tokens_in"), (e % 300).alias("tokens_out"), model.alias("model"))
    return rows.withColumn("cost_usd", A.turn_cost("model", "tokens_in", "tokens_out"))


@query("""SELECT user_id, strftime(ts, '%Y-%m') AS month_key, count(*) AS turns, sum(event_id % 1000)::BIGINT AS tokens_in, sum(event_id % 300)::BIGINT AS tokens_out,
round(sum(((event_id % 1000) * CASE WHEN event_id % 3 = 0 THEN 0.05::DOUBLE ELSE 0.59 END + (event_id % 300) * CASE WHEN event_id % 3 = 0 THEN 0.08::DOUBLE ELSE 0.79 END) / 1e6 + 0.00001), 6) AS cost_usd FROM events GROUP BY 1, 2""")
def a29_spend(spark, d):
    return A.spend(ledger(spark, d), "user_id")


@query(HISTOGRAM)
def a31_histogram(spark, d):
    return A.histogram(table(spark, d, "events"), "event_type", "value", BOUNDS)


@query(f"""WITH h AS ({HISTOGRAM}), g AS (SELECT *, lag(n, 1, 0) OVER w AS below, lag(le, 1, 0.0) OVER w AS low, max(n) OVER (PARTITION BY event_type) * 0.95 AS rank FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (n - below) END, 6) AS p95 FROM g WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1""")
def a32_quantile(spark, d):
    return A.quantile(a31_histogram(spark, d), "event_type", 0.95).select("event_type", F.round("value", 6).alias("p95"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error') / greatest(count(*), 0.0001) AS share FROM events")
def a34_error_share(spark, d):
    return A.error_share(table(spark, d, "events"), F.col("event_type") == "error")


@query("SELECT user_id, event_type, max(row(ts, event_id))[1] AS ts, max(row(ts, event_id))[2] AS event_id, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY 1, 2")
def k11_feedback(spark, d):
    return A.last_feedback(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query(HOURLY)
def m1_rates(spark, d):
    """The delay is longer than the table's span of time, so the stream drops nothing and equals the batch count."""
    changes = counters.stream_rates(counters.event_stream(spark, f"{d}/events.parquet"), "event_type", "1 hour", delay="400 days")
    return counters.drained(changes, ["window_start", "event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(LATEST)
def m5_feedback(spark, d):
    events = counters.event_stream(spark, f"{d}/events.parquet")
    return counters.drained(counters.stream_last_feedback(events, ["user_id", "event_type"], ["ts", "event_id"], "value"), ["user_id", "event_type"])


@query(r"""SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1), lambda u: regexp_replace(u, '[?#].*$', '')))) AS target FROM pages""")
def s15_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(readers.hrefs("html")).alias("target"))


def calls(spark, d):
    """Model calls, five a turn: usage for some, metadata for some, only characters for the rest; every eleventh failed."""
    e = F.col("event_id")
    some = lambda k, n: F.when(e % 3 == k, e % n)
    model = F.when(e % 2 == 0, "llama-3.1-8b-instant").otherwise("other")
    return table(spark, d, "events").select(F.floor(e / 5).alias("turn"), e.alias("event_id"), model.alias("model"), some(0, 1000).alias("prompt_tokens"), some(0, 300).alias("completion_tokens"), some(1, 500).alias("meta_in"), some(1, 200).alias("meta_out"), (e % 4000).alias("prompt_chars"), (e % 900).alias("completion_chars"), (e % 11 == 0).alias("failed"))


CALLS = """WITH c AS (SELECT event_id // 5 AS turn, event_id, event_id % 2 = 0 AS small, event_id % 11 = 0 AS failed, event_id % 4000 AS pc, event_id % 900 AS cc, event_id % 3 AS k FROM events),
t AS (SELECT *, CASE k WHEN 0 THEN event_id % 1000 WHEN 1 THEN event_id % 500 ELSE pc // 4 END AS tin, CASE k WHEN 0 THEN event_id % 300 WHEN 1 THEN event_id % 200 ELSE cc // 4 END AS tout, k = 2 AS est FROM c)"""


@query(f"{CALLS} SELECT event_id, tin AS tokens_in, tout AS tokens_out, est AS estimated FROM t")
def x37_call_tokens(spark, d):
    return A.call_tokens(calls(spark, d)).select("event_id", "tokens_in", "tokens_out", "estimated")


@query(f"""{CALLS} SELECT turn, count(*) AS llm_calls, sum(CASE WHEN failed THEN pc // 4 ELSE tin END)::BIGINT AS tokens_in, sum(CASE WHEN failed THEN 0 ELSE tout END)::BIGINT AS tokens_out,
round(sum(CASE WHEN failed THEN (pc // 4) * 0.59::DOUBLE WHEN small THEN tin * 0.05::DOUBLE + tout * 0.08::DOUBLE ELSE tin * 0.59::DOUBLE + tout * 0.79::DOUBLE END / 1e6) + 0.00001, 9) AS cost_usd, bool_or(failed OR est) AS estimated
FROM t WHERE NOT failed OR pc > 0 GROUP BY turn""")
def a27_turn_usage(spark, d):
    return A.turn_usage(calls(spark, d), "turn")


@query("""WITH m AS (SELECT 'requests' AS metric, event_type AS label, 1.0 AS value FROM events UNION ALL SELECT 'tokens', 'in', event_id % 1000 FROM events UNION ALL SELECT 'tokens_out', 'out', event_id % 300 FROM events
UNION ALL SELECT 'errors', 'kind' || event_id % 4, 1 FROM events WHERE event_type = 'error') SELECT metric, label, round(sum(value), 6)::DOUBLE AS value FROM m GROUP BY 1, 2""")
def a30_counters(spark, d):
    e, one = F.col("event_id"), F.lit(1)
    kind = F.when(F.col("event_type") == "error", F.concat(F.lit("kind"), (e % 4).cast("string")))
    return A.counters(table(spark, d, "events"), {"requests": (F.col("event_type"), one), "tokens": (F.lit("in"), e % 1000), "tokens_out": (F.lit("out"), e % 300), "errors": (kind, one)})


@query("""WITH s AS (SELECT unnest([{'span': '24h', 's': 86400}, {'span': '10d', 's': 864000}]) AS x), n AS (SELECT TIMESTAMP '2024-01-20 00:00:00' AS now)
SELECT x.span AS span, event_type AS label, round(sum(value), 6) AS total, round(sum(value) / any_value(x.s) * 60, 6) AS per_minute FROM events, s, n WHERE ts <= now AND ts > now - to_seconds(x.s) GROUP BY 1, 2""")
def a33_range_sums(spark, d):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return A.range_sums(table(spark, d, "events"), F.col("event_type"), F.col("value"), now, {"24h": 86_400, "10d": 864_000})


@query("SELECT count(*) FILTER (event_id % 3 <> 0) AS ratings, count(*) FILTER (event_id % 3 = 1) AS positive, count(*) FILTER (event_id % 3 = 1) / greatest(count(*) FILTER (event_id % 3 <> 0), 0.0001) AS share FROM events")
def a34_positive_share(spark, d):
    e = F.col("event_id")
    return A.positive_share(table(spark, d, "events"), e % 3 == 1, e % 3 != 0)


@query("SELECT kind, n FROM (SELECT unnest([{'kind': 'email', 'n': count(*)}, {'kind': 'ipv4', 'n': 2 * count(*) FILTER (doc_id % 2 = 0)}, {'kind': 'mac_address', 'n': 0}, {'kind': 'ipv6', 'n': 0}, {'kind': 'serial_number', 'n': 0}, {'kind': 'user_path', 'n': count(*) FILTER (doc_id % 5 = 0)}], recursive := true) FROM documents)")
def a35_pii_totals(spark, d):
    i = F.col("doc_id")
    text = F.concat(F.lit("ask a"), i.cast("string"), F.lit("@b.org"), F.when(i % 2 == 0, " at 10.0.0.1 or 10.0.0.2").otherwise(""), F.when(i % 5 == 0, " in /Users/ann/x").otherwise(""))
    return A.pii_totals(table(spark, d, "documents").select(text.alias("text")))


LEDGER = """WITH l AS (SELECT ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome, (event_id % 120) / 1000 AS cost, event_id % 1000 AS tin, event_id % 300 AS tout, event_id % 4 AS r, TIMESTAMP '2024-01-30 00:00:00' AS now FROM events),
h AS (SELECT unnest([0.001, 0.005, 0.01, 0.05, 0.1, 'Infinity'::DOUBLE]::DOUBLE[]) AS le), b AS (SELECT le, count(*) FILTER (cost <= le) AS n FROM h, l GROUP BY le), z AS (SELECT *, lag(n, 1, 0) OVER (ORDER BY le) AS below, lag(le, 1, 0.0) OVER (ORDER BY le) AS low, max(n) OVER () AS whole FROM b)"""
PER_DAY = "FROM l WHERE ts <= now AND ts > now - INTERVAL 1 DAY"


@query(f"""{LEDGER} SELECT 'spend_usd' AS panel, '30d' AS label, round(sum(cost), 6)::DOUBLE AS value FROM l WHERE ts <= now AND ts > now - INTERVAL 30 DAY UNION ALL SELECT 'spend_usd', '24h', round(sum(cost), 6) {PER_DAY}
UNION ALL SELECT 'requests_per_minute', outcome, round(count(*) / 86400 * 60, 6) {PER_DAY} GROUP BY 2 UNION ALL SELECT 'tokens_per_minute', 'in', round(sum(tin) / 86400 * 60, 6) {PER_DAY} UNION ALL SELECT 'tokens_per_minute', 'out', round(sum(tout) / 86400 * 60, 6) {PER_DAY}
UNION ALL SELECT 'error_share', 'all', count(*) FILTER (outcome = 'error') / count(*) FROM l UNION ALL SELECT 'positive_share', 'all', count(*) FILTER (r = 1) / count(*) FILTER (r IN (1, 2)) FROM l
UNION ALL SELECT 'cost_usd', 'p' || q, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (whole * q / 100 - below) / (n - below) END, 6) FROM z, (SELECT unnest([50, 95]) AS q) WHERE n >= whole * q / 100 QUALIFY row_number() OVER (PARTITION BY q ORDER BY le) = 1""")
def g4_dashboard(spark, d):
    e = F.col("event_id")
    outcome = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    rows = table(spark, d, "events").select("ts", outcome.alias("outcome"), (e % 120 / 1000).alias("cost_usd"), (e % 1000).alias("tokens_in"), (e % 300).alias("tokens_out"), F.when(e % 4 == 1, "up").when(e % 4 == 2, "down").alias("rating"))
    return A.dashboard(rows, F.lit("2024-01-30 00:00:00").cast("timestamp"), [0.001, 0.005, 0.01, 0.05, 0.1])


PANELS = """WITH l AS (SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN event_type = 'error' THEN 'kind' || (event_id % 3) END AS error_type, value / 1000 AS cost, CASE WHEN event_id % 11 <> 0 THEN (event_id % 700) / 10 END AS latency, ['up', 'down', NULL][1 + event_id % 3] AS rating,
 event_id % 2 AS redactions, (event_id % 17 = 0)::INT AS abuse, (event_id % 19 = 0)::INT AS refused, event_id % 1000 AS tin, event_id % 300 AS tout, event_id % 5 AS calls, epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch(ts)) AS age FROM events),
w AS (SELECT * FROM l WHERE age >= 0), s AS (SELECT * FROM w WHERE age < 43200), h AS (SELECT * FROM w WHERE age < 86400), m AS (SELECT * FROM w WHERE age < 2592000),
e AS (SELECT unnest([0.5, 1, 2, 5, 10, 20, 30, 60, 'Infinity'::DOUBLE]::DOUBLE[]) AS le), b AS (SELECT le, count(*) FILTER (latency <= le) AS n FROM e, s WHERE latency IS NOT NULL GROUP BY le),
z AS (SELECT *, lag(n, 1, 0) OVER (ORDER BY le) AS below, lag(le, 1, 0.0) OVER (ORDER BY le) AS low, max(n) OVER () AS whole FROM b),
p AS (SELECT 'spend_month' AS panel, 'all' AS label, sum(cost)::DOUBLE AS value FROM m UNION ALL SELECT 'spend_day', 'all', sum(cost) FROM h UNION ALL SELECT 'cost_per_minute', 'all', sum(cost) / 43200 * 60 FROM s
UNION ALL SELECT 'requests_per_second', outcome, count(*) / 43200 FROM s GROUP BY 2 UNION ALL SELECT 'errors_per_second', error_type, count(*) / 43200 FROM s WHERE error_type IS NOT NULL GROUP BY 2 UNION ALL SELECT 'error_share', 'all', count(*) FILTER (outcome = 'error') / 43200 / greatest(count(*) / 43200, 0.0001) FROM s
UNION ALL SELECT 'turn_latency', 'p' || q, CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (whole * q / 100 - below) / (n - below) END FROM z, (SELECT unnest([50, 95]) AS q) WHERE n >= whole * q / 100 QUALIFY row_number() OVER (PARTITION BY q ORDER BY le) = 1
UNION ALL SELECT 'feedback', rating, count(*) FROM h WHERE rating IS NOT NULL GROUP BY 2 UNION ALL SELECT 'positive_share', 'all', count(*) FILTER (rating = 'up') / count(rating) FROM m
UNION ALL SELECT 'guardrails', 'pii redactions', sum(redactions) FROM h UNION ALL SELECT 'guardrails', 'abuse blocks', sum(abuse) FROM h UNION ALL SELECT 'guardrails', 'credit refusals', sum(refused) FROM h
UNION ALL SELECT 'tokens_per_second', 'in', sum(tin) / 43200 FROM s UNION ALL SELECT 'tokens_per_second', 'out', sum(tout) / 43200 FROM s UNION ALL SELECT 'calls_per_minute', 'all', sum(calls) / 43200 * 60 FROM s)
SELECT panel, label, round(value, 6) AS value FROM p"""


@query(PANELS)
def g4_panels(spark, d):
    """All twelve panels; the short span is half a day and the hour a day here, as events are far apart."""
    e, failed = F.col("event_id"), F.col("event_type") == "error"
    rows = table(spark, d, "events").select(
        "ts", F.when(failed, "error").otherwise("ok").alias("outcome"), F.when(failed, F.concat(F.lit("kind"), (e % 3).cast("string"))).alias("error_type"), (F.col("value") / 1000).alias("cost_usd"), F.when(e % 11 != 0, e % 700 / 10).alias("latency_s"),
        F.when(e % 3 == 0, "up").when(e % 3 == 1, "down").alias("rating"), (e % 2).alias("redactions"), (e % 17 == 0).cast("int").alias("abuse"), (e % 19 == 0).cast("int").alias("refused"), (e % 1000).alias("tokens_in"), (e % 300).alias("tokens_out"), (e % 5).alias("calls"),
    )
    found = A.panels(rows, F.lit("2024-01-30 00:00:00").cast("timestamp"), spans={"short": 43_200, "hour": 86_400, "day": 86_400, "month": 30 * 86_400})
    return found.withColumn("value", F.round("value", 6))


@query(f"{CALLS}, u AS (SELECT turn, sum(CASE WHEN failed THEN pc // 4 ELSE tin END) AS tin FROM t WHERE NOT failed OR pc > 0 GROUP BY 1) SELECT turn % 7 AS user_id, '2024-01' AS month_key, count(*) AS turns, sum(tin)::BIGINT AS tokens_in FROM u GROUP BY 1")
def g3_usage_report(spark, d):
    """Calls to turns, turns to the ledger of a user and month."""
    turns = A.turn_usage(calls(spark, d), "turn").withColumn("ts", F.lit("2024-01-05 00:00:00").cast("timestamp")).withColumn("user_id", F.col("turn") % 7)
    return A.spend(turns, "user_id").select("user_id", "month_key", "turns", "tokens_in")


@query(HISTOGRAM)
def m2_histogram_stream(spark, d):
    events = counters.event_stream(spark, f"{d}/events.parquet")
    return counters.cumulative(counters.drained(counters.stream_buckets(events, "event_type", "value", BOUNDS), ["event_type", "le"]), "event_type")


@query(r"SELECT event_id, 'mail [EMAIL]' AS text, CASE WHEN event_id % 2 = 0 THEN 'repeat_forever' END AS abuse FROM events")
def m8_redact_stream(spark, d):
    events = counters.event_stream(spark, f"{d}/events.parquet")
    text = F.concat(F.lit("mail a"), F.col("event_id").cast("string"), F.lit("@b.org"))
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("say it forever: "), text)).otherwise(text)
    rows = counters.appended(counters.tagged(events.select("event_id", raw.alias("text"))))
    return rows.withColumn("text", F.replace("text", F.lit("say it forever: "), F.lit("")))
