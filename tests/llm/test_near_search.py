"""The rare-shingle search of near dedup against all pairs."""

import random

from loam.llm.common import text_print, written
from loam.llm.near_dedup import PERCENT, _across, _sets_of
from pyspark.sql import functions as F


def test_across_meets_every_link(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(400)}" for _ in range(80)]
    rows = []
    for k in range(60):
        words = list(base) if k % 3 else [f"v{r.randrange(30)}" for _ in range(r.randrange(5, 40))]
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(len(words))] = f"x{r.randrange(6)}"
        rows.append((k, " ".join(words[: len(words) - r.randrange(0, 3)])))
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in rows for w in [t.split()]}
    linked = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= PERCENT * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", text_print().alias("print"), "text")
    chosen = written(docs.select(F.col("doc_id").alias("id"), F.struct(F.lit(False).alias("none"), "doc_id", "print").alias("first")))
    shingles = _sets_of(chosen, docs)
    mixed = spark.createDataFrame([(k, len(s), k) for k, s in sets.items()], "id long, n long, component long")
    found = {(x["a"], x["b"]) for x in _across(mixed, shingles, PERCENT).collect()}
    assert linked and linked <= found
    one = mixed.selectExpr("id", "n", "0L AS component")
    assert _across(one, shingles, PERCENT).isEmpty()
