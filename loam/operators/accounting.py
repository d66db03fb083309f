"""Usage, cost, feedback and latency reports over a ledger of turns.

Everything is a grouped aggregate with map-side partial sums; no group is ever held whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from loam.functions import text as X

FLAT_USD = 0.00001
COST_BUCKETS, LATENCY_BUCKETS = X.rules.COST_BUCKETS, X.rules.LATENCY_BUCKETS


def turn_cost(model, tokens_in, tokens_out, flat: float = FLAT_USD) -> Column:
    """US dollars of a turn: both token counts at the model's prices per million, and a flat share; null counts are 0."""
    low, high = X.price(model)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (n(tokens_in) * low + n(tokens_out) * high) / 1e6 + flat


def spend(ledger: DataFrame, *by: str) -> DataFrame:
    """(by..., month_key, turns, tokens_in, tokens_out, cost_usd) of ledger(ts, tokens_in, tokens_out, cost_usd, by...)."""
    return ledger.groupBy(*by, X.month_key("ts").alias("month_key")).agg(
        F.count("*").alias("turns"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd")
    )


def histogram(rows: DataFrame, label: str, value: str, bounds: list[float]) -> DataFrame:
    """(label, le, n): rows at most each bound, cumulative, and all rows at +infinity; null values are not counted."""
    v = F.col(value)
    wide = rows.where(v.isNotNull()).groupBy(label).agg(*[F.count_if(v <= b).alias(f"b{k}") for k, b in enumerate(bounds)], F.count("*").alias(f"b{len(bounds)}"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate([*bounds, float("inf")])]
    return wide.select(label, F.inline(F.array(*cells)))


def quantile(buckets: DataFrame, label: str, q: float) -> DataFrame:
    """(label, value): the quantile by linear interpolation inside its bucket; the last finite bound beyond it, null if empty."""
    rows = buckets.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("b"))
    rank = F.element_at("b", -1)["n"] * q
    place = F.array_position(F.transform("b", lambda x: x["n"] >= rank), F.lit(True)).cast("int")
    at = lambda k, f: F.get("b", k)[f]
    low, below = F.when(place > 1, at(place - 2, "le")).otherwise(0.0), F.when(place > 1, at(place - 2, "n")).otherwise(0)
    inside = low + (at(place - 1, "le") - low) * (rank - below) / F.nullif(at(place - 1, "n") - below, F.lit(0))
    return rows.select(label, F.when(F.element_at("b", -1)["n"] == 0, None).when(place == F.size("b"), at(place - 2, "le")).otherwise(inside).alias("value"))


def rates(rows: DataFrame, label: str, width: str, slide: str | None = None) -> DataFrame:
    """(window_start, label, n): rows per event-time window; works on a batch and, with a watermark on ts, on a stream."""
    w = F.window("ts", width, slide)
    return rows.groupBy(w.alias("w"), label).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), label, "n")


def last_feedback(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last rating of each key by the order columns: one struct maximum, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in {*key, *order}]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("m")).select(*key, *[F.col(f"m.{c}").alias(c) for c in [*order, *rest]])


def error_share(rows: DataFrame, failed: Column) -> DataFrame:
    """(total, errors, share): the share's denominator is at least 0.0001, so an empty ledger gives 0."""
    n, bad = F.count("*"), F.count_if(failed)
    return rows.agg(n.alias("total"), bad.alias("errors"), (bad / F.greatest(n.cast("double"), F.lit(0.0001))).alias("share"))


def call_tokens(calls: DataFrame, chars_per_token: int = 4) -> DataFrame:
    """calls with tokens_in, tokens_out and estimated: what the provider's usage says, else the message's metadata; where a
    count is still missing, both are estimated from characters."""
    usage = F.col("prompt_tokens").isNotNull()
    given_in = F.coalesce("prompt_tokens", "meta_in")
    given_out = F.when(usage, F.col("completion_tokens")).otherwise(F.coalesce("meta_out", "completion_tokens"))
    none = given_in.isNull() | given_out.isNull()
    chars = lambda c: F.floor(F.coalesce(F.col(c), F.lit(0)) / chars_per_token)
    return calls.withColumn("tokens_in", F.when(none, chars("prompt_chars")).otherwise(given_in)).withColumn("tokens_out", F.when(none, chars("completion_chars")).otherwise(given_out)).withColumn("estimated", none)


def turn_usage(calls: DataFrame, *by: str, default=X.rules.DEFAULT_PRICE, flat: float = FLAT_USD) -> DataFrame:
    """(by..., llm_calls, tokens_in, tokens_out, cost_usd, estimated) of calls(by..., model, failed, token and character counts).

    A failed call counts, as estimated input at the default price, only if its prompt had characters. One flat share a turn."""
    failed = F.coalesce("failed", F.lit(False))
    rows = call_tokens(calls).where(~failed | (F.coalesce("prompt_chars", F.lit(0)) > 0))
    guess = F.floor(F.coalesce("prompt_chars", F.lit(0)) / 4)
    low, high = X.price("model")
    cost = F.when(failed, guess * default[0]).otherwise(F.col("tokens_in") * low + F.col("tokens_out") * high) / 1e6
    return rows.groupBy(*by).agg(
        F.count("*").alias("llm_calls"), F.sum(F.when(failed, guess).otherwise(F.col("tokens_in"))).cast("long").alias("tokens_in"), F.sum(F.when(failed, 0).otherwise(F.col("tokens_out"))).cast("long").alias("tokens_out"),
        F.round(F.sum(cost) + flat, 9).alias("cost_usd"), F.bool_or(failed | F.col("estimated")).alias("estimated"),
    )


def counters(rows: DataFrame, metrics: dict[str, tuple]) -> DataFrame:
    """(metric, label, value): the sum of each metric by its label, in one pass; metrics: name -> (label, value). Null labels are
    left out."""
    cells = [F.struct(F.lit(name).alias("metric"), label.cast("string").alias("label"), value.cast("double").alias("value")) for name, (label, value) in metrics.items()]
    return rows.select(F.inline(F.array(*cells))).where("label IS NOT NULL").groupBy("metric", "label").agg(F.round(F.sum("value"), 6).alias("value"))


def range_sums(rows: DataFrame, label, value, now, spans: dict[str, int]) -> DataFrame:
    """(span, label, total, per_minute) over the seconds of each span before now: (now - span, now]."""
    age = F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))
    cells = [F.when((age >= 0) & (age < seconds * 1_000_000), F.struct(F.lit(name).alias("span"), F.lit(seconds).alias("seconds"))) for name, seconds in spans.items()]
    inside = rows.select(label.alias("label"), value.cast("double").alias("v"), F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c"))
    total = F.sum("v")
    return inside.groupBy("c.span", "label").agg(F.round(total, 6).alias("total"), F.round(total / F.max("c.seconds") * 60, 6).alias("per_minute"))


def positive_share(rows: DataFrame, up, rated) -> DataFrame:
    """(ratings, positive, share): the share of good ratings, with a denominator of at least 0.0001."""
    n, good = F.count_if(rated), F.count_if(up & rated)
    return rows.agg(n.alias("ratings"), good.alias("positive"), (good / F.greatest(n.cast("double"), F.lit(0.0001))).alias("share"))


def pii_totals(texts: DataFrame) -> DataFrame:
    """(kind, n): personal data found in texts(text), counted in the order of replacement."""
    found = X.redacted("text")[1]
    cells = [F.struct(F.lit(k).alias("kind"), n.cast("long").alias("n")) for k, n in found.items()]
    return texts.select(F.inline(F.array(*cells))).groupBy("kind").agg(F.sum("n").alias("n"))


def dashboard(rows: DataFrame, now, cost_bounds: list[float] = COST_BUCKETS) -> DataFrame:
    """(panel, label, value) of a ledger(ts, outcome, cost_usd, tokens_in, tokens_out, rating): spend of 30 days and of a day,
    requests by minute and outcome, token rates, error share, positive share, cost quantiles."""
    day, month = 86_400, 30 * 86_400
    shape = lambda df, panel, label, value: df.select(F.lit(panel).alias("panel"), label.cast("string").alias("label"), value.cast("double").alias("value"))
    spent = range_sums(rows, F.lit("all"), F.coalesce("cost_usd", F.lit(0.0)), now, {"30d": month, "24h": day})
    asked = range_sums(rows, F.col("outcome"), F.lit(1), now, {"24h": day})
    sides = F.array(F.struct(F.lit("in").alias("side"), F.col("tokens_in").alias("n")), F.struct(F.lit("out").alias("side"), F.col("tokens_out").alias("n")))
    tokens = range_sums(rows.select("ts", F.inline(sides)), F.col("side"), F.coalesce("n", F.lit(0)), now, {"24h": day})
    hist = histogram(rows.withColumn("one", F.lit("all")), "one", "cost_usd", cost_bounds)
    parts = [
        shape(spent, "spend_usd", F.col("span"), F.col("total")), shape(asked, "requests_per_minute", F.col("label"), F.col("per_minute")), shape(tokens, "tokens_per_minute", F.col("label"), F.col("per_minute")),
        shape(error_share(rows, F.col("outcome") == "error"), "error_share", F.lit("all"), F.col("share")), shape(positive_share(rows, F.col("rating") == "up", F.col("rating").isNotNull()), "positive_share", F.lit("all"), F.col("share")),
        *[shape(quantile(hist, "one", q), "cost_usd", F.lit(f"p{round(100 * q)}"), F.round("value", 6)) for q in (0.5, 0.95)],
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


#: Upper bounds in seconds of the latency histogram, and the spans in seconds of the panels.
LATENCY_BUCKETS = [0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0]
SPANS = {"short": 300, "hour": 3600, "day": 86_400, "month": 30 * 86_400}


def panels(rows: DataFrame, now, bounds: list[float] = LATENCY_BUCKETS, spans: dict[str, int] = SPANS) -> DataFrame:
    """(panel, label, value): the twelve panels of the dashboard, from one pass over a ledger with ts, outcome, error_type,
    cost_usd, latency_s, rating, redactions, abuse, refused, tokens_in, tokens_out, calls.

    Each row becomes what it adds to each series whose span it is in; one aggregate, combined before its shuffle, sums them up, and
    shares and quantiles come from these few sums. A series without rows is not there; nulls add nothing; shares are of a
    rate of 0.0001 a second at least, or of one rating.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp("ts")
    within = {name: (age >= 0) & (age < span) for name, span in spans.items()}
    rate = lambda v: v / F.lit(float(spans["short"]))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    one, every = F.lit(1.0), F.lit("all")
    series = [
        ("spend_month", every, number("cost_usd"), "month"), ("spend_day", every, number("cost_usd"), "day"), ("cost_per_minute", every, rate(number("cost_usd")) * 60, "short"),
        ("requests_per_second", F.col("outcome"), rate(one), "short"), ("errors_per_second", F.col("error_type"), rate(one), "short"), ("feedback", F.col("rating"), one, "hour"), ("_ratings", F.col("rating"), one, "month"),
        ("guardrails", F.lit("pii redactions"), number("redactions"), "hour"), ("guardrails", F.lit("abuse blocks"), number("abuse"), "hour"), ("guardrails", F.lit("credit refusals"), number("refused"), "hour"),
        ("tokens_per_second", F.lit("in"), rate(number("tokens_in")), "short"), ("tokens_per_second", F.lit("out"), rate(number("tokens_out")), "short"), ("calls_per_minute", every, rate(number("calls")) * 60, "short"),
        *[("_latency", F.lit(str(float(b))), F.when(F.col("latency_s").isNotNull(), (F.col("latency_s") <= b).cast("double")), "short") for b in [*bounds, float("inf")]],
    ]
    adds = F.array(*[F.struct(F.lit(p).alias("panel"), F.when(within[span], label).alias("label"), value.alias("value")) for p, label, value, span in series])
    sums = rows.select(F.inline(F.filter(adds, lambda x: x["label"].isNotNull() & x["value"].isNotNull()))).groupBy("panel", "label").agg(F.sum("value").alias("value"))
    # from here on there is a row for each series
    total, part = F.sum("value").over(Window.partitionBy("panel")), F.when(F.col("panel") == "requests_per_second", "error").otherwise("up")
    shares = sums.where(F.col("panel").isin("requests_per_second", "_ratings")).withColumn("total", total).groupBy("panel").agg(F.sum(F.when(F.col("label") == part, F.col("value")).otherwise(0.0)).alias("own"), F.max("total").alias("total"))
    least = F.when(F.col("panel") == "requests_per_second", 0.0001).otherwise(1.0)
    shares = shares.select(F.when(F.col("panel") == "requests_per_second", "error_share").otherwise("positive_share").alias("panel"), F.lit("all").alias("label"), (F.col("own") / F.greatest("total", least)).alias("value"))
    held = sums.where("panel = '_latency'").select(F.lit("all").alias("one"), F.col("label").cast("double").alias("le"), F.col("value").alias("n"))
    out = sums.where("NOT startswith(panel, '_')").unionByName(shares)
    for q in (0.5, 0.95):
        out = out.unionByName(quantile(held, "one", q).select(F.lit("turn_latency").alias("panel"), F.lit(f"p{round(100 * q)}").alias("label"), F.col("value").cast("double").alias("value")))
    return out
