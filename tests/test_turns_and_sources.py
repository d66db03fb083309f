"""Golden cases for turns, grounding, credits, articles, pages and text functions."""

import datetime as dt
import json

from loam.functions import text as X
from loam.operators import articles as A
from loam.operators import credits as C
from loam.operators import grounding as G
from loam.operators import ingest as I
from loam.operators import turns as U
from loam.operators import vectors as V
from loam.sources import pages as P
from loam.streaming.conversations import merged_case
from pyspark.sql import functions as F

CONTEXT = "Open the dialog. Use pmset -g assertions to list what prevents sleep. wdutil info shows channel 149. In Terminal: sudo mdutil -E /"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column.alias("x")).first().x


def test_grounding(spark):
    cases = {"log show --last 1h": False, "pmset -g assertions": True, "wdutil set 149": False, "wdutil info": True, "sudo mdutil -E /": True, "/Library/Preferences/x.plist": False, "nvram -p": False}
    rows = spark.createDataFrame([(c, CONTEXT) for c in cases], "command string, context string")
    assert {r.command: r.g for r in rows.select("command", G.grounded("command", "context").alias("g")).collect()} == cases
    answer = "Try:\n```bash\n$ pmset -g assertions\nplain words\nPMSET -g assertions\n```\nthen `wdutil set 149`, `pmset -g assertions` or `no tool`."
    report = G.grounding_report(spark.createDataFrame([(1, answer, CONTEXT), (2, "nothing to run", None), (3, None, CONTEXT)], "answer_id int, answer string, context string"))
    assert {r.answer_id: (r.total, r.grounded, list(r.ungrounded), r.ratio) for r in report.collect()} == {1: (2, 1, ["wdutil set 149"], 0.5), 2: (0, 0, [], 1.0), 3: (0, 0, [], 1.0)}
    hits = spark.createDataFrame([(1, 1, "wdutil set 149 is a command")], "answer_id int, pos int, text string")
    assert G.grounded_after_rescue(report, hits).where("answer_id = 1").first().ratio == 1.0
    assert G.grounding_totals(report.where("answer_id > 1")).first().ratio == 1.0


def turn(k, day, user=1, cost=0.0, hour=9):
    return (k, user, dt.datetime(2024, *day, hour), cost)


TURNS = "turn_id long, user_id long, ts timestamp, cost double"


def gated(spark, rows, **limits):
    return {r.turn_id: (r.allowed, r.reason, r.weekly_left) for r in C.gate(spark.createDataFrame(rows, TURNS), **limits).collect()}


def test_credit_gate(spark):
    rows = [turn(1, (1, 1)), turn(2, (1, 2)), turn(3, (1, 3)), turn(4, (1, 8)), turn(5, (1, 8), user=2), turn(6, (1, 8), user=None)]
    assert gated(spark, rows, weekly=2) == {1: (True, None, 1), 2: (True, None, 0), 3: (False, "weekly", 0), 4: (True, None, 1), 5: (True, None, 1)}
    # the month's cap is tested first, is overshot by one turn, and ends with the month, in the middle of a week
    rows = [turn(1, (1, 29), cost=0.2), turn(2, (1, 30), cost=0.2), turn(3, (1, 31)), turn(4, (2, 1)), turn(5, (2, 2), cost=None)]
    assert gated(spark, rows, weekly=4) == {1: (True, None, 3), 2: (True, None, 2), 3: (False, "monthly", 2), 4: (True, None, 1), 5: (True, None, 0)}
    # a refusal keeps the refreshed week; a new ISO year is a new week
    rows = [(1, 1, dt.datetime(2024, 12, 29), 0.3), (2, 1, dt.datetime(2024, 12, 30), 0.0), (3, 1, dt.datetime(2025, 1, 1), 0.0)]
    assert gated(spark, rows, weekly=1) == {1: (True, None, 0), 2: (False, "monthly", 1), 3: (True, None, 0)}
    assert gated(spark, []) == {}


def test_case_files_and_their_fold(spark):
    shape = "conv_id long, turn long, version string, chip string, topic string, category string, tried array<string>, new_problem boolean, asked boolean, diagnostics int, pending string"
    rows = [
        (1, 1, "14", None, "wifi drops", "wifi", ["Restart"], None, True, 1, "run log"), (1, 2, None, "m1", "other words", "general", ["restart", "toggle"], False, None, None, None), (1, 3, "", None, None, None, None, False, False, 0, U.CLEAR),
        (2, 1, "13", "m2", "disk full", "disk", ["a"], False, True, 2, "q"), (2, 2, None, None, "battery dies", None, ["b"], True, False, None, None),
    ]
    got = {r.conv_id: r.asDict() for r in U.case_files(spark.createDataFrame(rows, shape)).collect()}
    want = {1: ("14", "m1", "wifi drops", "wifi", True, 1, None, ["Restart", "toggle"]), 2: ("13", "m2", "battery dies", None, False, 0, None, ["b"])}
    names = ["version", "chip", "topic", "category", "asked", "diagnostics", "pending", "tried"]
    assert {k: tuple(v[n] for n in names) for k, v in got.items()} == want
    for conv in (1, 2):
        case = {"version": None, "chip": None, "topic": None, "category": None, "asked": False, "diagnostics": 0, "pending": None, "tried": []}
        for r in (r for r in rows if r[0] == conv):
            case = merged_case(case, dict(zip(["conv_id", "turn", "version", "chip", "topic", "category", "tried", "new_problem", "asked", "diagnostics", "pending"], r, strict=True)))
        assert tuple(case[n] for n in names) == want[conv]


def test_history_keeps_six(spark):
    rows = [(c, t, "user", "x") for c, n in ((1, 7), (2, 8), (3, 20)) for t in range(n)]
    got = U.history(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: r.n for r in got.where("folded").groupBy("conv_id").agg(F.count("*").alias("n")).collect()} == {2: 2, 3: 14}


def test_solution_pick(spark):
    long, said = "words " * 20, "in the end this fixed it " + "words " * 20
    rows = [
        ("tie", 1, "a " + long, 3), ("tie", 2, "b " + long, 3), ("phrase", 1, long, 2), ("phrase", 2, said, 0), ("phrase", 3, long, 1), ("last", 1, "c " + long, 0), ("last", 2, "d " + long, None), ("none", 1, "short", 9), ("none", 2, None, 9),
    ]
    got = {r.issue: r.solution[:9] for r in A.solutions(spark.createDataFrame(rows, "issue string, pos int, body string, reactions int")).collect()}
    assert got == {"tie": "a words w", "phrase": "in the en", "last": "d words w"}


def test_preferred_urls(spark):
    rows = [(1, "https://s.org/de-de/102640"), (2, "https://s.org/en-us/102640"), (3, "https://s.org/en-us/102640?a"), (4, "https://s.org/fr-fr/HT201232"), (5, "https://s.org/HT201232")]
    got = {r.article_id: (r.pos, r.url[-10:]) for r in A.preferred_urls(spark.createDataFrame(rows, "pos int, url string")).collect()}
    assert got == {"102640": (1, "s/102640?a"), "HT201232": (4, "r/HT201232")}


def test_manual_sections(spark):
    raw = "lead\nNAME\n  x - does it\n\nSEE ALSO\nNAME\n  y\n   NOT A HEAD\nEXAMPLES\n$ pmset -g\n    # no\n    sleepnow --now\n    abc\n"
    s = one(spark, A.manual_sections("raw"), raw=raw)
    assert [(x.heading, x.body) for x in s] == [("PREAMBLE", "lead"), ("NAME", "y\n   NOT A HEAD"), ("EXAMPLES", "$ pmset -g\n    # no\n    sleepnow --now\n    abc")]
    assert one(spark, A.manual_examples("t"), t=s[2].body) == ["pmset -g", "sleepnow --now"]
    assert one(spark, A.manual_flags("t"), t="x [-a] --all-of -b2 - -a") == ["--all-of", "-a", "-b2"]


PAGE = """<html><head><title>T &amp; t</title><meta name="date" content="2024-02-03"><meta property="og:title" content="Og"><script>var x = "<p>no</p>";</script></head><body>
<nav><ul><li>menu</li></ul></nav><h1>Reset &eacute;verything</h1><p>Short.<p>This paragraph is the first one of more than forty characters.</p><h2>Empty</h2><h2>First</h2><p>Do <b>this</b> and</p>
<ul><li>one <ul><li>inner</li></ul></li><li>two</li></ul><ol><li>step 1</li><li>step&nbsp;2</li></ol><style>p {}</style></body></html>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>no end")], "page_id long, html string")
    got = {r.page_id: r for r in P.support_fields(pages).collect()}
    r = got[1]
    assert (r.title, r.modified, r.summary) == ("Reset éverything", "2024-02-03", "This paragraph is the first one of more than forty characters.")
    assert [s.heading for s in r.sections] == ["Overview", "First"] and r.sections[1].body.startswith("Do this and one") and list(r.steps) == ["step 1", "step 2"]
    assert got[2].title == "" and got[2].sections == [] and got[3].sections[0].body == "no end"
    s = {r.page_id: r for r in P.session_fields(pages).collect()}
    assert s[1].title == "Reset éverything" and s[3].title == "" and s[3].content == "no end"


def test_doc_sections(spark):
    data = {"metadata": {"title": "T"}, "primaryContentSections": [{"kind": "content", "content": [
        {"type": "paragraph", "inlineContent": [{"type": "text", "text": "a"}, {"type": "codeVoice", "code": "x"}]}, {"type": "heading", "text": "H"},
        {"type": "unorderedList", "items": [{"content": [{"type": "paragraph", "inlineContent": [{"type": "text", "text": "b"}]}, {"type": "text", "text": "c"}]}]}, {"type": "codeListing", "code": ["d", "e"]}]}]}
    rows = [("x", json.dumps(data)), ("y", json.dumps({"abstract": [{"type": "text", "text": "only"}]})), ("z", "no json"), ("n", None)]
    got = {r.name: (r.title, [(s.heading, s.body) for s in r.sections]) for r in P.doc_sections(spark.createDataFrame(rows, "name string, json string")).collect()}
    assert got == {"x": ("T", [("Overview", "a"), ("H", "b c d e")]), "y": (None, [("Overview", "only")]), "z": (None, []), "n": (None, [])}


def test_unescape(spark):
    cases = {"&eacute;&#233;&#xE9; &hellip;": "ééé …", "&amp;lt; &lt;": "&lt; <", "&nope; & &#0; &#x110000;": "&nope; & &#0; &#x110000;", "&#128512;": "😀", "plain": "plain"}
    for text, want in cases.items():
        assert one(spark, X.unescape("t"), t=text) == want


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)]
    points = spark.createDataFrame(rows, "point_id long, embedding array<float>")
    queries = points.where("point_id % 6 = 0").withColumnRenamed("point_id", "query_id")
    whole = {(r.query_id, r.pos): r.point_id for r in V.top_similar(points, queries, 4).collect()}
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    for q, v in rows[::6]:
        near = sorted(((-round(sum(a * b for a, b in zip(unit(v), unit(w), strict=True)), 9), p) for p, w in rows))[:4]
        assert [whole[q, k + 1] for k in range(4)] == [p for _, p in near]
    assert V.top_similar(points.limit(0), queries, 4).count() == 0 and V.top_similar(points, queries.limit(0), 4).count() == 0


def test_dedupe_chunks(spark):
    rows = [("a", 1, "old"), ("a", 2, "new"), ("b", 1, "one")]
    got = I.dedupe_chunks(spark.createDataFrame(rows, "chunk_id string, scraped_at int, text string")).collect()
    assert {r.chunk_id: r.text for r in got} == {"a": "new", "b": "one"}
