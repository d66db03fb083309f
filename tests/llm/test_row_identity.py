"""Rows and words that are easily taken for one another: cancelling words, ids with several texts, null ids, clashing columns;
and operators whose workers have no copy of the library."""

import os
import subprocess
import sys
import tempfile
from pathlib import Path

import corpus_pipeline
import pytest
from loam.llm import decontaminate, line_dedup, maxent, near_dedup, packing
from loam.llm.common import small_batches, table, written

REPO = str(Path(__file__).resolve().parents[2])
SF = "/root/testdata/sf0.001"


def cancelling(letters: str = "ab", rounds: int = 10) -> tuple[str, str]:
    """Two words whose letters' differences cancel out in every polynomial modulo 2^64 (the Thue-Morse word, its complement)."""
    word, swap = letters[0], str.maketrans(letters, letters[::-1])
    for _ in range(rounds):
        word += word.translate(swap)
    return word, word.translate(swap)


def test_cancelling_words(spark):
    a, b = cancelling()
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert [x.component_id for x in near_dedup.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 2]
    assert line_dedup.line_duplicates(docs).isEmpty()
    seen = {x.doc_id: x.n_known for x in maxent.score_documents(docs, docs.where("doc_id = 1")).collect()}
    assert seen == {1: 2, 2: 1}  # the end is known to both
    lines = [" ".join(x) for x in cancelling("ab", 11)]
    assert line_dedup.line_duplicates(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).isEmpty()


def test_pipeline_drops_rows_not_ids(spark):
    one, other = "a text of more than five words", "only here are these words in one row"
    rows = [(1, one, "x"), (1, other, "x"), (2, one, "y"), (None, one, "z"), (None, "no id, and a text that nobody else has", "z"), (2, one, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print string")
    exact = written(corpus_pipeline.exact_dedup(spark, docs, SF))
    assert sorted(exact.collect(), key=str) == sorted([rows[1], rows[2], rows[4]], key=str)
    many = [f"w{k}" for k in range(60)]
    near = [(1, " ".join(many), "x"), (1, other, "x"), (2, " ".join(many + ["more"]), "y"), (None, " ".join(many + ["still", "more"]), "z"), (None, other + " x", "z")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(near, docs.schema), SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted([near[0], near[1], near[4]], key=str)
    only = [(None, " ".join(many), "x"), (None, " ".join(many + ["more"]), "x")]
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame(only, docs.schema), SF).count() == 1


def test_decontamination_by_row(spark):
    words = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"x {words} y", 1, 2), (1, "clean text", 1, 2), (2, "clean, too", 1, 2), (None, words, 1, 2), (None, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits int, raw int")
    bench = spark.createDataFrame([(7, words)], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.clean_documents(docs, bench).collect()), key=str) == sorted([rows[1], rows[2], rows[4]], key=str)
    cut = decontaminate.without_spans(docs, bench)
    assert cut.columns == docs.columns
    assert sorted((str(x.doc_id), str(x.text)) for x in cut.collect()) == sorted([("1", "x y"), ("1", "clean text"), ("2", "clean, too"), ("None", ""), ("None", "None")])


def test_long_text_in_linear_time(spark):
    long = spark.createDataFrame([(1, " ".join(f"w{k % 977}" for k in range(300_000)))], "doc_id long, text string")
    got = decontaminate.contamination(long, spark.createDataFrame([(1, "w5 w6 w7")], "item_id long, text string")).first()
    assert got.n_hit == 3 * sum(k % 977 == 5 for k in range(300_000))


def test_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(1, "a b\na b", 99, "x", 5)], "doc_id long, text string, n_lines int, dropped string, gone_id int")
    got = line_dedup.without_duplicate_lines(docs).first()
    assert (got.n_lines, got.dropped, got.n_lines_, got.dropped_, got.text) == (99, "x", 2, [1], "a b")


def test_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    near_dedup.near_duplicates(table(spark, SF, "documents")).count()
    packing.pack_documents(table(spark, SF, "documents")).count()
    assert spark.conf.get(key) == before
    with pytest.raises(ZeroDivisionError), small_batches(spark, 7):
        assert spark.conf.get(key) == "7"
        raise ZeroDivisionError
    assert spark.conf.get(key) == before


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config(map={{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.local.dir": {tmp!r}, "spark.checkpoint.dir": "file://" + {tmp!r} + "/shared", "spark.ui.showConsoleProgress": "false"}}).getOrCreate()
import __spark_entry__
def absent(batches):
    for b in batches:
        try:
            import loam
        except ImportError:
            yield b
assert spark.range(3).mapInArrow(absent, "id long").count() == 3
for name in sys.argv[1:]:
    print(name, __spark_entry__.queries()[name](spark, {sf!r}).count(), flush=True)
"""


def test_workers_without_the_library():
    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "SPARK", "PYSPARK"))}
    names = ["op1_toxicity", "op2_near_dedup", "op3_packing", "op6_line_dedup", "op7_lm_scoring", "op8_warc"]
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, tmp=tmp, sf=SF), *names], cwd=tmp, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert [line.split()[0] for line in run.stdout.splitlines() if line.startswith("op")] == names


def test_unset_folder_on_a_cluster(spark, monkeypatch):
    from loam.llm import common

    class Far:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://far:7077"

    with pytest.raises(RuntimeError):
        common.shared_dir(Far)
