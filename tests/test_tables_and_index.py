"""Keyed tables, the resumable ingest stream, and similarity search with filters and by an index."""

import random

import numpy as np
import pytest
from loam.operators import index as X
from loam.operators import retrieval as R
from loam.operators import vectors as V
from loam.sources.keyed import KeyedTable
from loam.streaming import ingest as I
from pyspark.sql import functions as F


def rows_of(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_keyed_runs(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}", ["k"], "k long, v string", 8)
    assert rows_of(t) == []
    make = lambda rows: spark.createDataFrame(rows, "k long, v string")
    before = t.upsert(make([(k, "a") for k in range(100)] + [(None, "n")]), "one")
    old = t.manifest()
    t.upsert(make([(3, "b"), (None, "m")]), "two")
    new = t.manifest()
    assert 0 < sum(old["files"][b] != new["files"][b] for b in old["files"]) <= 2  # files of other buckets keep their names
    want = {**{k: "a" for k in range(100)}, 3: "b", None: "m"}
    assert {r["k"]: r["v"] for r in t.read().collect()} == want and t.read().count() == 101
    assert {r["k"]: r["v"] for r in t.read(old).collect()} == {**want, 3: "a", None: "n"}  # an older version is whole
    t.upsert(make([(3, "again")]), "two")  # a replay
    assert t.manifest() == new
    with pytest.raises(Exception, match="broken"):
        t.upsert(make([(5, "x")]).withColumn("v", F.raise_error(F.lit("broken"))), "three")
    assert t.manifest() == new
    t.insert_new(make([(3, "no"), (200, "yes")]), "four")
    t.refresh(make([(200, "fresh"), (201, "none")]), ["v"], "five")
    want |= {200: "fresh"}
    assert {r["k"]: r["v"] for r in t.read().collect()} == want
    t.upsert(make([]), "empty")
    t.reset()
    assert rows_of(t) == [] and t.manifest()["version"] == 6


def test_overtaken_run_starts_again(spark, tmp_path):
    t, other = (KeyedTable(spark, f"file://{tmp_path}", ["k"], "k long, v string", 2) for _ in range(2))
    t.upsert(spark.createDataFrame([(k, "a") for k in range(10)], "k long, v string"), "base")
    commit, first = t._commit, [True]

    def late(manifest):
        if first:
            first.clear()
            other.upsert(spark.createDataFrame([(1, "other"), (2, "other")], "k long, v string"), "other")
        return commit(manifest)

    t._commit = late
    t.upsert(spark.createDataFrame([(2, "mine"), (3, "mine")], "k long, v string"), "mine")
    assert {r["k"]: r["v"] for r in t.read().collect()} == {**{k: "a" for k in range(10)}, 1: "other", 2: "mine", 3: "mine"}


def test_vacuum_keeps_the_newest_versions(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}", ["k"], "k long, v string", 2)
    for n in range(4):
        t.upsert(spark.createDataFrame([(k, f"v{n}") for k in range(6)], "k long, v string"), f"run{n}")
    before = sorted(tuple(r) for r in t.read().collect())
    assert t.vacuum(keep=2) == 0  # nothing is old enough
    assert t.vacuum(keep=2, older=0) == 2 and t.vacuum(keep=1, older=0) == 1
    assert sorted(tuple(r) for r in t.read().collect()) == before == [(k, "v3") for k in range(6)]
    assert t.manifest()["version"] == 4 and KeyedTable(spark, f"file://{tmp_path}/none", ["k"], "k long").vacuum() == 0


def test_ingest_stops_and_goes_on_without_embedding_twice(spark, tmp_path):
    log = tmp_path / "embedded"
    chunks = [(f"c{k}", "S", f"text of chunk {k}", f"a{k // 5}", "en-us", "T", "u", ["Mac"], ["all"], 1, "disk", "s", None) for k in range(450)]
    schema = "chunk_id string, section_heading string, text string, article_id string, locale string, title string, url string, affected_devices array<string>, macos_versions array<string>, difficulty_tier int, category string, source string, scraped_at timestamp"
    spark.createDataFrame(chunks, schema).repartition(3).write.parquet(f"file://{tmp_path}/chunks")
    spark.createDataFrame(chunks[:40], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/chunks")  # saved again
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/chunks")
    points = KeyedTable(spark, f"file://{tmp_path}/points", ["point_id"], I.point_schema(spark.createDataFrame([], schema)), 4)
    progress = KeyedTable(spark, f"file://{tmp_path}/progress", ["batch", "part", "slice"], I.PROGRESS, 2)
    where = str(log)

    def embed(texts):
        assert len(texts) <= 100
        with open(where, "a") as out:
            out.writelines(f"{t}\n" for t in texts)
        return np.zeros((len(texts), 4), np.float32)

    insert, seen = progress.insert_new, []

    def stopping(changes, run):
        seen.append(run)
        if len(seen) == 2:
            raise RuntimeError("stopped between the points and their marks")
        return insert(changes, run)

    progress.insert_new = stopping
    with pytest.raises(Exception, match="stopped between"):
        I.ingest(rows, points, progress, embed, f"file://{tmp_path}/state").awaitTermination()
    half = len(log.read_text().splitlines())
    assert 0 < half < 450 and points.read().count() == half
    progress.insert_new = insert
    I.ingest(rows, points, progress, embed, f"file://{tmp_path}/state").awaitTermination()
    lines = log.read_text().splitlines()
    assert len(lines) == len(set(lines)) == 450 and points.read().count() == 450
    marks = progress.read().collect()
    assert max(m["chunks"] for m in marks) <= 100 and sum(m["chunks"] for m in marks) == 490 and {m["batch"] for m in marks} == {0, 1, 2, 3}


POINT = "point_id long, embedding array<float>, article_id string, source string, category string, versions array<string>, tier int, title string"


@pytest.mark.parametrize("want", [{}, {"version": "14"}, {"category": "x"}, {"min_tier": 2}, {"version": "any", "category": "x", "min_tier": 3}])
def test_few_points_and_each_filter(spark, want):
    points = spark.createDataFrame([(1, [1.0, 0.0], "a", "man", "x", ["all"], 3, "pmset"), (2, [0.0, 1.0], "b", "s", "y", ["13"], 1, "t")], POINT)
    queries = spark.createDataFrame([(k, [1.0, k / 10.0], "run pmset", *want.values()) for k in range(6)], ", ".join(["query_id long, embedding array<float>, text string", *(f"{c} {'int' if c == 'min_tier' else 'string'}" for c in want)]))
    got = {(r["query_id"], r["point_id"]) for r in V.top_similar(points, queries, 5).collect()}
    assert got == {(q, p) for q in range(6) for p in ((1, 2) if not want else (1,))}
    assert R.retrieve(points, queries, manual_source="man", commands=["pmset"], threshold=-1.0).count() >= 6
    assert V.top_similar(points.limit(0), queries, 5).collect() == []


def plain_top(points, queries, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    return {(q, p) for q, u in queries for _, p in sorted((-round(float(unit(u) @ unit(v)), 12), p) for p, v in points)[:k]}


def test_tiles_and_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "TILE", 7)
    r = random.Random(3)
    points = [(k, [r.gauss(c, 0.3), r.gauss(-c, 0.3), r.gauss(1, 0.3)]) for k in range(300) for c in [r.choice([-3, 0, 3])]] + [(300 + k, [1.0, 1.0, 1.0]) for k in range(30)]
    queries = [(k, [r.gauss(0, 2), r.gauss(0, 2), 1.0]) for k in range(20)] + [(99, [1.0, 1.0, 1.0])]
    p, q = spark.createDataFrame(points, "point_id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, embedding array<double>")
    want = plain_top(points, queries, 6)
    pairs = lambda df: {(x["query_id"], x["point_id"]) for x in df.collect()}
    assert pairs(V.top_similar(p, q, 6)) == want
    index = X.built(p, f"file://{tmp_path}/index", 12, block=20)  # lists in blocks
    assert index.rows.count() == 330 and index.sizes.agg(F.max("blocks")).first()[0] > 1
    assert pairs(X.search(index, q, 6, 12)) == want
    few = X.search(index, q, 6, 3)
    assert X.recall(few, V.top_similar(p, q, 6)).first()["recall"] >= 0.9
    monkeypatch.setattr(X, "QUERY_BLOCK", 5)
    assert pairs(X.search(index, q, 6, 12)) == want
    assert X.search(X.built(p.limit(0), f"file://{tmp_path}/none"), q, 3, 2).collect() == []
