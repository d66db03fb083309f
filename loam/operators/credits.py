"""The credit gate: a weekly number of turns and a monthly cost for each account, in batch and as a stream.

What a turn may do depends on what the turns before it were allowed, so an account is a sequential fold, of those turns that
may be allowed at all. A refused turn consumes nothing, and its cost is not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from loam.functions import text as X

WEEKLY, MONTHLY_USD = 5, 0.25
#: Milliseconds for which a stream remembers an account: forty days.
LIVES = 40 * 24 * 3600 * 1000
SHAPE = "turn_id long, user_id long, allowed boolean, reason string, weekly_left long, month_cost double"


def step(state: tuple | None, week: str, month: str, cost: float, weekly: int, cap: float) -> tuple[tuple, tuple]:
    """(state after, (allowed, reason, weekly_left, month_cost before this turn)). A new week refreshes the turns, a new month
    the cost, also where the turn is refused; the month is tested first."""
    old_week, left, old_month, spent = state or (week, weekly, month, 0.0)
    left = weekly if old_week != week else left
    spent = 0.0 if old_month != month else spent
    if spent >= cap:
        return (week, left, month, spent), (False, "monthly", left, spent)
    if left <= 0:
        return (week, 0, month, spent), (False, "weekly", 0, spent)
    return (week, left - 1, month, spent + cost), (True, None, left - 1, spent)


def keyed(turns: DataFrame) -> DataFrame:
    """turn_id, user_id, ts, week, month, cost of turns(turn_id, user_id, ts, cost); turns without a user are in no account."""
    rows = turns.where("user_id IS NOT NULL").select("turn_id", "user_id", "ts", X.week_key("ts").alias("week"), X.month_key("ts").alias("month"), F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost"))
    return rows


def gate(turns: DataFrame, weekly: int = WEEKLY, cap: float = MONTHLY_USD) -> DataFrame:
    """SHAPE for turns(turn_id, user_id, ts, cost): whether each turn is allowed, in the order of time and then id.

    A segment is an account's turns of one week and month; it is a stretch of time. In it the allowed turns come first, `weekly`
    at most, since a refusal changes nothing. So only the first `weekly` turns of each segment are folded, which every task
    picks before they are shuffled; the outcomes of a segment, and the one of all turns behind them, are then joined to its
    turns. An account with any number of turns is nowhere in one task. Turns of one id and time share an outcome.
    """
    rows = keyed(turns)
    place = F.row_number().over(Window.partitionBy("user_id", "week", "month").orderBy("ts", "turn_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= max(weekly, 1)).drop("place")
    shape = "user_id long, week string, month string, turn_id long, allowed boolean, reason string, weekly_left long, month_cost double, left long, spent double"
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state = None, None
        for b in batches:
            out = []
            for t, u, w, m, c in zip(*(b.column(n).to_pylist() for n in ("turn_id", "user_id", "week", "month", "cost")), strict=True):
                state, told = step(state if u == user else None, w, m, c, weekly, cap)
                user = u
                out.append((u, w, m, t, *told, state[1], state[3]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in shape.split(", ")])

    folded = first.repartition("user_id").sortWithinPartitions("user_id", "ts", "turn_id").mapInArrow(fold, shape)
    told = F.struct("turn_id", "allowed", "reason", "weekly_left", "month_cost")
    own = [F.col("user_id").alias("u"), F.col("week").alias("w"), F.col("month").alias("m")]
    segments = folded.groupBy(*own).agg(F.collect_list(told).alias("told"), F.min("left").alias("left"), F.max("spent").alias("spent"))  # `weekly` outcomes each
    same = (F.col("user_id") == F.col("u")) & F.col("week").eqNullSafe(F.col("w")) & F.col("month").eqNullSafe(F.col("m"))
    over = F.col("spent") >= cap
    rest = F.struct(
        F.lit(None).cast("long").alias("turn_id"), F.lit(False).alias("allowed"), F.when(over, "monthly").otherwise("weekly").alias("reason"),
        F.when(over, F.col("left")).otherwise(0).cast("long").alias("weekly_left"), F.col("spent").alias("month_cost"),
    )
    outcome = F.coalesce(F.get(F.filter("told", lambda x: x["turn_id"] == F.col("turn_id")), F.lit(0)), rest)
    joined = rows.join(segments, same).withColumn("o", outcome)
    return joined.select("turn_id", "user_id", *[F.col(f"o.{c}").alias(c) for c in ("allowed", "reason", "weekly_left", "month_cost")])


def stream_gate(turns: DataFrame, weekly: int = WEEKLY, cap: float = MONTHLY_USD, lives: int = LIVES) -> DataFrame:
    """The gate on a stream: the state is one row an account, rows of a micro-batch are put in order of time and id first. An
    account without turns for `lives` milliseconds, longer than a month, has nothing to remember and goes."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "turn_id"])
        state, out = (held.get if held.exists else None), []
        for t, w, m, c in zip(rows["turn_id"], rows["week"], rows["month"], rows["cost"], strict=True):
            state, told = step(state, w, m, float(c), weekly, cap)
            out.append((int(t), int(key[0]), *told))
        held.update(state)
        held.setTimeoutDuration(lives)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in SHAPE.split(", ")])

    return keyed(turns).groupBy("user_id").applyInPandasWithState(fold, SHAPE, "week string, left long, month string, spent double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def gate_messages(messages: DataFrame, most: int = 16_000, weekly: int = WEEKLY, cap: float = MONTHLY_USD) -> DataFrame:
    """messages(turn_id, user_id, ts, cost, text) with outcome and the redacted text: empty, too_long, abuse:kind,
    credits:monthly or credits:weekly, else ok. Only messages that pass what comes before reach the gate and use credits."""
    text = F.coalesce("text", F.lit(""))
    kind = X.abuse_kind(text)
    early = F.when(F.trim(text) == "", "empty").when(F.length(text) > most, "too_long").when(kind.isNotNull(), F.concat(F.lit("abuse:"), kind))
    rows = messages.withColumn("early", early)
    gated = gate(rows.where("early IS NULL"), weekly, cap).select("turn_id", F.when(~F.col("allowed"), F.concat(F.lit("credits:"), "reason")).alias("late"))
    out = rows.join(gated, "turn_id", "left").withColumn("outcome", F.coalesce("early", "late", F.lit("ok")))
    return out.withColumn("text", X.redacted(text)[0]).drop("early", "late")


def reset_accounts(accounts: DataFrame, now, weekly: int = WEEKLY) -> DataFrame:
    """All accounts with the full number of turns, stamped with the week of now; the monthly cost stays."""
    return accounts.withColumn("weekly_left", F.lit(weekly)).withColumn("week_key", X.week_key(now))


def roll_up(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """accounts(user_id, month_key, month_cost_usd, ...) with the costs of ledger(user_id, ts, cost_usd) of their month added;
    rows without a user stay in the ledger only."""
    spent = ledger.where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("u"), X.month_key("ts").alias("m")).agg(F.sum("cost_usd").alias("spent"))
    same = (accounts["user_id"] == spent["u"]) & (accounts["month_key"] == spent["m"])
    out = accounts.join(spent, same, "left")
    return out.withColumn("month_cost_usd", F.coalesce("month_cost_usd", F.lit(0.0)) + F.coalesce("spent", F.lit(0.0))).drop("u", "m", "spent")


def with_entries(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """The ledger with rows appended: columns by name, those that an entry lacks are null; nothing is keyed or replaced."""
    return ledger.unionByName(entries, allowMissingColumns=True).select(ledger.columns)
