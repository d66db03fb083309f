import datetime as dt
import json

from loam.functions import text as X
from loam.operators import accounting as A
from loam.plans import registry
from loam.sources import readers
from loam.streaming import counters
from pyspark.sql import functions as F

DAY = dt.datetime(2024, 1, 31, 23, 59)
LEDGER = "ts timestamp, user string, tokens_in long, tokens_out long, cost_usd double, kind string"


def test_turn_cost_treats_null_counts_as_none(spark):
    rows = spark.createDataFrame([(1_000_000, 1_000_000), (None, None)], "i long, o long").select(A.turn_cost(F.lit("llama-3.1-8b-instant"), "i", "o").alias("c")).collect()
    assert [round(r.c, 6) for r in rows] == [0.13001, 0.00001]


def test_spend_by_month_and_of_nothing(spark):
    rows = [(DAY, "a", 1, 2, 0.5, "x"), (DAY + dt.timedelta(minutes=2), "a", 3, None, 0.25, "x"), (DAY, None, None, None, None, None)]
    got = {(r.user, r.month_key): (r.turns, r.tokens_in, r.tokens_out, r.cost_usd) for r in A.spend(spark.createDataFrame(rows, LEDGER), "user").collect()}
    assert got == {("a", "2024-01"): (1, 1, 2, 0.5), ("a", "2024-02"): (1, 3, 0, 0.25), (None, "2024-01"): (1, 0, 0, 0.0)}
    assert A.spend(spark.createDataFrame([], LEDGER), "user").collect() == []


def test_histogram_and_quantile(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 11)] + [("b", 100.0), ("b", None)], "k string, v double")
    buckets = A.histogram(rows, "k", "v", [5.0, 10.0])
    assert sorted((r.k, r.le, r.n) for r in buckets.collect())[:3] == [("a", 5.0, 5), ("a", 10.0, 10), ("a", float("inf"), 10)]
    assert {r.k: r.value for r in A.quantile(buckets, "k", 0.75).collect()} == {"a": 7.5, "b": 10.0}


def test_last_feedback_wins_in_batch_and_stream(spark, tmp_path):
    rows = [("s", 1, 5, "up"), ("s", 1, 9, "down"), ("s", 2, 1, None), ("s", 1, 7, "up")]
    table = spark.createDataFrame(rows, "session string, turn int, at long, rating string")
    want = {("s", 1): "down", ("s", 2): None}
    assert {(r.session, r.turn): r.rating for r in A.last_feedback(table, ["session", "turn"], ["at"]).collect()} == want
    table.withColumn("ts", F.timestamp_seconds("at")).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    changes = counters.stream_last_feedback(counters.event_stream(spark, str(tmp_path / "t.parquet"), 1), ["session", "turn"], ["at"], "rating")
    assert {(r.session, r.turn): r.rating for r in counters.drained(changes, ["session", "turn"]).collect()} == want


def test_rates_slide_over_windows(spark):
    rows = spark.createDataFrame([(DAY, "x"), (DAY + dt.timedelta(minutes=2), "x")], "ts timestamp, k string")
    assert sorted(r.n for r in A.rates(rows, "k", "1 hour").collect()) == [1, 1]
    assert sorted(r.n for r in A.rates(rows, "k", "1 hour", "30 minutes").collect()) == [1, 1, 2]


def test_error_share_of_an_empty_ledger_is_zero(spark):
    assert tuple(A.error_share(spark.createDataFrame([], LEDGER), F.col("kind") == "error").first()) == (0, 0, 0.0)


def test_dump_posts_join_their_accepted_answers(spark, tmp_path):
    post = lambda **a: "<row " + " ".join(f'{k}="{v}"' for k, v in a.items()) + " />"
    rows = [
        post(Id=1, PostTypeId=1, AcceptedAnswerId=2, Score=3, Title="T", Body="Q", Tags="|macos|wifi|"), post(Id=2, PostTypeId=2, ParentId=1, Score=1, Body="A"),
        post(Id=3, PostTypeId=1, AcceptedAnswerId=2, Score="many", Title="U", Body="Q", Tags="|macos|"), post(Id=4, PostTypeId=1, AcceptedAnswerId=5, Score=9, Title="V", Body="Q", Tags="&lt;macos&gt;"),
        post(Id=5, PostTypeId=2, ParentId=4, Score="bad", Body="A"), post(Id=6, PostTypeId=1, AcceptedAnswerId=2, Score=9, Title="W", Body="Q", Tags="|ios|"),
    ]
    (tmp_path / "posts.xml").write_text("<posts>\n" + "\n".join(rows) + "\n</posts>")
    pairs = readers.accepted_pairs(readers.dump_posts(spark, str(tmp_path / "posts.xml")), ["macos"])
    assert [(r.question_id, r.title, r.answer, r.tags) for r in pairs.collect()] == [(1, "T", "A", ["macos", "wifi"])]


def test_chunk_lines_limit_is_by_id(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"chunk_id": c, "text": c}) for c in "cab"))
    assert [r.chunk_id for r in readers.chunk_lines(spark, str(tmp_path / "c.jsonl"), 2).collect()] == ["a", "b"]


def test_links_and_sitemaps(spark):
    row = spark.createDataFrame([('<a href="/x?y=1"><a href="/x#z"><a href="">', "<loc> http://a/b </loc>\nSitemap: http://a/s.xml"), (None, None)], "h string, t string")
    got = row.select(readers.hrefs("h").alias("h"), readers.sitemap_urls("t").alias("t")).collect()
    assert [(r.h, r.t) for r in got] == [(["/x", ""], ["http://a/b", "http://a/s.xml"]), ([], [])]


def test_stable_ids_are_version_5_uuids(spark):
    import uuid

    names = ["macos_kb.a", "macos_kb.é", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.uuid5("n").alias("u")).collect()
    assert {r.n: r.u for r in got} == {n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names}


def test_every_oracle_belongs_to_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
