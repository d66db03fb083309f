"""The credit gate by segments, grounding with rescue, streams that forget, sitemaps, file scans and blind labels."""

import datetime as dt
import json
import random
import time

import numpy as np
import pytest
from loam.functions import text as X
from loam.operators import articles as A
from loam.operators import credits as C
from loam.operators import evaluation as E
from loam.operators import grounding as G
from loam.sources import readers
from loam.streaming import conversations
from pyspark.sql import functions as F


@pytest.mark.parametrize(("weekly", "cap"), [(5, 0.25), (2, 100.0), (50, 0.05), (0, 1.0)])
def test_gate_equals_a_fold_over_all_turns(spark, weekly, cap):
    r = random.Random(weekly)
    start, turns = dt.datetime(2023, 12, 20), []
    for k in range(600):
        user = r.choice([1, 1, 1, 1, 2, 3, None])
        turns.append((k, user, start + dt.timedelta(minutes=r.randrange(60 * 24 * 50)) if user != 3 else start, r.choice([None, 0.0, 0.01, 0.03])))
    turns.append((600, 2, None, 0.01))
    df = spark.createDataFrame(turns, "turn_id long, user_id long, ts timestamp, cost double")
    want = {}
    keys = {x["turn_id"]: x for x in C.keyed(df).collect()}
    for user in (1, 2, 3):
        state = None
        for t in sorted((k for k in keys.values() if k["user_id"] == user), key=lambda x: (x["ts"] is not None, x["ts"], x["turn_id"])):
            state, told = C.step(state, t["week"], t["month"], t["cost"], weekly, cap)
            want[t["turn_id"]] = told
    got = {x["turn_id"]: (x["allowed"], x["reason"], x["weekly_left"], x["month_cost"]) for x in C.gate(df, weekly, cap).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:3] == want[k][:3] and abs(got[k][3] - want[k][3]) < 1e-9, k


def test_hot_account_is_not_in_one_task(spark):
    df = spark.range(20_000).select(F.col("id").alias("turn_id"), F.lit(7).cast("long").alias("user_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), F.lit(0.0).alias("cost"))
    plan = C.gate(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # the first turns of a segment are picked before they are shuffled
    assert C.gate(df).where("allowed").count() == 5


def test_grounding_with_rescue(spark):
    answers = spark.createDataFrame([(1, "Run `pmset -g assertions`", "a tool"), (2, "Run `pmset -g assertions`", "nothing"), (3, "no command", "x"), (4, "`tmutil thinlocalsnapshots`", "tmutil thinlocalsnapshots is here"), (5, "`tmutil listbackups`", None)], "answer_id long, answer string, context string")
    near = {"pmset": [1.0, 0.0], "tmutil": [0.0, 1.0]}
    embed = lambda texts: np.array([near["pmset" if "pmset" in t else "tmutil"] for t in texts], np.float32)
    points = spark.createDataFrame([(1, [1.0, 0.0], "p", "u", "pmset -g assertions lists them"), (2, [0.9, 0.1], "q", "u", "other"), (3, [0.0, 1.0], "t", "u", "nothing of use")], "point_id long, embedding array<float>, title string, url string, text string")
    got = {x["answer_id"]: x for x in G.with_rescue(answers, points, embed, n=1).collect()}
    assert [(got[k]["grounded"], got[k]["grounded_after"], got[k]["rescued"]) for k in range(1, 6)] == [(0, 1, 1), (0, 1, 1), (0, 0, 0), (1, 1, 0), (0, 0, 1)]
    assert got[5]["ungrounded_after"] == ["tmutil listbackups"] and got[2]["ratio_after"] == 1.0


def test_streams_forget(spark, tmp_path):
    def batch(n, rows):
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps(x) + "\n" for x in rows))

    (tmp_path / "in").mkdir()
    messages = spark.readStream.schema("conv_id long, turn long").json(f"file://{tmp_path}/in")
    seen = {}

    def keep(rows, number):
        for x in rows.collect():
            seen.setdefault(x["conv_id"], []).append(x["turns"])

    def until(test):
        end = time.time() + 60
        while not test() and time.time() < end:
            time.sleep(0.3)
        assert test(), seen

    batch(0, [{"conv_id": 1, "turn": t} for t in (1, 2, 3)] + [{"conv_id": 2, "turn": 1}])
    query = conversations.stream_history(messages, keep=2, lives=8000).writeStream.option("checkpointLocation", f"file://{tmp_path}/state").foreachBatch(keep).trigger(processingTime="1 second").start()
    try:
        until(lambda: 2 in seen)
        batch(1, [{"conv_id": 1, "turn": 4}])
        until(lambda: len(seen[1]) == 2)
        assert seen == {1: ["2,3", "3,4"], 2: ["1"]}
        until(lambda: sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]) == 0)  # both are freed without any input
        batch(2, [{"conv_id": 1, "turn": 5}])
        until(lambda: len(seen[1]) == 3)
        assert seen[1][-1] == "5"
    finally:
        query.stop()


def test_sitemaps_follow_indexes_and_end(spark):
    loc = lambda *urls: "".join(f"<loc> {u} </loc>" for u in urls)
    files = [("r", "User-agent: *\nSitemap: i1\nsitemap: i2\n"), ("i1", loc("m1", "i2", "r", "page0")), ("i2", loc("i1", "m2", "m1")), ("m1", loc("b", "a", "b")), ("m2", loc("c", "a", "missing.xml")), ("alone", loc("z")), ("none", None)]
    got = readers.sitemap_pages(spark.createDataFrame(files, "url string, text string"), "r").collect()
    ordered = [x["url"] for x in sorted(got, key=lambda x: (x["depth"], x["trail"]))]
    assert ordered == ["page0", "b", "a", "c", "missing.xml"] and len(got) == 5
    assert readers.sitemap_pages(spark.createDataFrame(files, "url string, text string"), "unknown").count() == 0


def test_scans_keep_order_and_what_is_broken(spark, tmp_path):
    for name, lines in (("b.jsonl", ['{"chunk_id": "b1"}', "{", '{"chunk_id": "b2"}']), ("a.jsonl", ['{"chunk_id": "a1", "text": "x"}', '{"chunk_id": "a2", "difficulty_tier": "many"}'])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    good, bad = readers.scanned(spark, str(tmp_path))
    assert sorted(x["chunk_id"] for x in good.collect()) == ["a1", "b1", "b2"]
    assert sorted((x["file"].rsplit("/", 1)[1], x["line"]) for x in bad.collect()) == [("a.jsonl", '{"chunk_id": "a2", "difficulty_tier": "many"}'), ("b.jsonl", "{")]
    assert [x["chunk_id"] for x in readers.scanned(spark, str(tmp_path), 2)[0].collect()] == ["a1", "b1"]


def test_last_question_of_an_answer(spark):
    post = "_Id long, _PostTypeId int, _AcceptedAnswerId long, _ParentId long, _Score string, _Title string, _Body string, _Tags string"
    posts = [(1, 1, 9, None, "5", "first", "q", "|macos|"), (2, 1, 9, None, "5", "last", "q", "|macos|"), (3, 1, 9, None, "1", "low", "q", "|macos|"), (9, 2, None, 1, "3", None, "answer", None)]
    assert [tuple(x) for x in readers.accepted_pairs(spark.createDataFrame(posts, post)).select("question_id", "title", "answer").collect()] == [(2, "last", "answer")]


def test_solutions_choose_by_place(spark):
    long = "x" * 120
    rows = [("i", 1, f"{long} one", 1), ("i", 2, f"{long} two", 4), ("i", 3, f"{long} three", 4), ("j", 1, f"{long} fixed it", 0), ("j", 2, f"{long} later", None), ("k", 1, "short", 9), ("l", 1, f"{long} a", 0), ("l", 2, f"{long} b", 0)]
    got = {x["issue"]: x["solution"][121:] for x in A.solutions(spark.createDataFrame(rows, "issue string, pos long, body string, reactions long"), phrases=["fixed"]).collect()}
    assert got == {"i": "two", "j": "fixed it", "l": "b"}


def test_scores_find_their_contestants(spark):
    labels = E.blind_labels(spark.createDataFrame([(q, c) for q in (1, 2) for c in ("own", "other")], "question long, contestant string"))
    dealt = {(x["question"], x["label"]): x["contestant"] for x in labels.collect()}
    scores = spark.createDataFrame([(1, "A", 5), (2, "B", 3), (2, "Z", 1)], "question long, label string, correctness int")
    assert {(x["question"], x["contestant"], x["correctness"]) for x in E.unblinded(scores, labels).collect()} == {(1, dealt[1, "A"], 5), (2, dealt[2, "B"], 3)}


def test_redaction_gates_let_every_match_through(spark):
    texts = ["mail a.b@c.de now", "00:1A:2b:3C:4d:5E", "fe80::1:2 and 1:2:3:4:5:6:7:8", "10.0.0.255", "Serial No: C02XL0THJG5J", "/Users/anna/x /Users/Shared/y", "nothing", None, "٣.٤"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    slow, fast = X.redacted("t", list(X.rules.PII_RULES)), X.redacted("t")
    both = df.select(slow[0].alias("a"), fast[0].alias("b"), F.array(*slow[1].values()).alias("m"), F.array(*fast[1].values()).alias("n")).collect()
    assert all(x["a"] == x["b"] and x["m"] == x["n"] for x in both) and sum(sum(x["n"]) for x in both) == 7
