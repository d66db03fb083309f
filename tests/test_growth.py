"""What larger tables brought up: results against SQL beyond the small tables' ranges, and work that grows with the input only."""

import os

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loam import rules
from loam.functions import text as X
from loam.operators import grounding as G
from loam.operators import index as I
from loam.plans import source_queries as S
from loam.sources.keyed import KeyedTable


def oracle(name: str, **tables) -> list[tuple]:
    """The rows of a query's SQL over parquet files."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table, path in tables.items():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return con.sql(entry.oracle_sql()[name]).fetchall()


def test_years_of_five_digits(spark, tmp_path):
    spark.createDataFrame([(1,), (2_930_000,), (5_999_999,)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in entry.queries()["x42_iso_time"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(oracle("x42_iso_time", events=f"{tmp_path}/events.parquet"))
    assert dict(got)[5_999_999].startswith("+18399-")


def test_rescue_searches_without_texts(spark, monkeypatch):
    seen, search = [], G.top_similar
    monkeypatch.setattr(G, "top_similar", lambda points, queries, n: seen.append((points.columns, queries.count())) or search(points, queries, n))
    embed = lambda texts: np.array([[1.0, 0.0] for _ in texts], np.float32)
    answers = spark.createDataFrame([(k, f"`pmset -g word{k}`", "nothing") for k in range(20)], "answer_id long, answer string, context string")
    points = spark.createDataFrame([(1, [1.0, 0.0], "p", "u", "pmset -g word7"), (2, [0.0, 1.0], "q", "u", "other")], "point_id long, embedding array<float>, title string, url string, text string")
    got = {x["answer_id"]: x["ratio_after"] for x in G.with_rescue(answers, points, embed, n=1).collect()}
    assert seen == [(["point_id", "embedding"], 1)]  # twenty queries of one vector; the texts stay out of the search
    assert len(got) == 20 and got[7] == 1.0


def test_text_is_made_once(spark):
    """Filters do not copy the expression that makes the text into each place that names it."""
    made = lambda name: entry.queries()[name](spark, entry.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString().count("[^A-Za-z0-9.]+")
    names = ("c5_manual_articles", "c6_session_articles", "c4_post_articles", "s9_manual_sections", "x18_flags")
    assert {name: made(name) for name in names} == dict.fromkeys(names, 1)
    assert made("w6_solutions") == 2 and made("c1_pair_articles") == 2 and made("c3_issue_articles") == 3  # one for each table that is read


def test_records_are_parsed_once(spark):
    plan = lambda name: entry.queries()[name](spark, entry.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert [plan(name).count("from_json(") for name in ("s11_closed_issues", "s8_index_links", "s13_api_pairs")] == [1, 1, 2]
    assert plan("s6_doc_sections").count("[^A-Za-z0-9.]+") == 1


def test_versions_are_matched_once_and_by_sign(spark):
    assert entry.queries()["x6_versions"](spark, entry.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString().count("RLIKE(") == len(rules.VERSION_PATTERNS)
    texts = ["Sequoia", "mac os15.2", "Big   Sur", "OS 11", "macOS 11", "high  sierra", "El Capitan 10.11.6", "10x13", "10.10 and 10.12", "catalina mojave yosemite", "ventura13", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.versions("t").alias("by_sign"), X.versions("t", list(rules.VERSION_PATTERNS)).alias("all")).collect()
    assert all(r["by_sign"] == r["all"] for r in rows) and sum(r["all"] != ["all"] for r in rows) == 8


def test_inserted_rows_stand_beside_the_old_files(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}", ["k"], "k long, v string", 2)
    make = lambda ids, v: spark.createDataFrame([(k, v) for k in ids], "k long, v string")
    t.insert_new(make(range(50), "a"), "one")
    one = t.manifest()["files"]
    t.insert_new(make(range(50, 100), "b"), "two")
    t.insert_new(make(range(90, 120), "c"), "three")
    files = t.manifest()["files"]
    assert all(set(one[b]) < set(files[b]) for b in one)  # nothing that was there is written again
    assert t.vacuum(keep=1, older=0) == 0  # and no folder is left over
    assert {r["k"]: r["v"] for r in t.read().collect()} == {k: "a" if k < 50 else "b" if k < 100 else "c" for k in range(120)}


def test_lists_of_rows_are_looked_up_in_slices():
    rng = np.random.default_rng(1)
    vectors, centres = rng.normal(size=(300, 8)).astype(np.float32), rng.normal(size=(40, 8))
    b = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(list(vectors), pa.list_(pa.float32()))], ["id", "embedding"])
    got = list(I._in_slices(b, centres, 30, cells=5_000))
    assert max(x.num_rows for x in got) * 9 <= 5_000
    whole = list(I._in_slices(b, centres, 30, cells=10**9))
    assert len(whole) == 1 and pa.Table.from_batches(got).combine_chunks().to_pydict() == pa.Table.from_batches(whole).to_pydict()


def test_files_of_lines_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FILE_CHARS", 10_000)
    path = S.chunk_files(spark, entry.SMOKE_DIR)
    size = spark.read.parquet(f"{entry.SMOKE_DIR}/documents.parquet").selectExpr("sum(n_chars)").first()[0]
    files = [f for f in os.listdir(path.removeprefix("file://")) if f.endswith(".txt")]
    assert len(files) > size / 10_000 * 0.5 > 5
    assert entry.queries()["s1_quarantine"](spark, entry.SMOKE_DIR).first()[0] == spark.read.parquet(f"{entry.SMOKE_DIR}/documents.parquet").where("doc_id % 7 = 0").count()


def test_issues_whose_phrases_decide(spark, tmp_path):
    """Short comments in place of those with enough reactions: the first comment with a phrase of the query's own list is taken."""
    said, plain, short = "the cable was loose and it works again " * 8, "und so weiter mit vielen anderen Worten " * 8, "too short"
    texts = {1: plain, 2: said, 3: short, 4: short, 5: short, 6: "and this is the issue " * 15, 7: plain, 8: plain, 9: short, 10: short, 11: short, 12: "and another one here " * 15}
    spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["article_id"]: tuple(r) for r in entry.queries()["c3_issue_articles"](spark, str(tmp_path)).collect()}
    assert sorted(got.values()) == sorted(oracle("c3_issue_articles", documents=f"{tmp_path}/documents.parquet"))
    assert got["GH_OWN_S1_6"][4].startswith("the cable") and got["GH_OWN_S1_12"][4].startswith("and another")  # by a phrase; the last


def test_pairs_hold_whole_texts(spark, tmp_path):
    texts = {3: "a long question. " * 4000, 4: "an answer of many words that begins like others do, " * 3000 + "end", 9: "kurz", 10: "", 15: 'marks "x" \\ <b>&</b>\n ß' * 3, 16: None}
    spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in entry.queries()["s13_api_pairs"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(oracle("s13_api_pairs", documents=f"{tmp_path}/documents.parquet"))
    own = {i: (title, answer) for i, title, answer in got}
    assert set(own) == {3, 9, 15} and own[3] == (texts[3].strip(), texts[4].replace(",", "")) and own[15][1] == ""
