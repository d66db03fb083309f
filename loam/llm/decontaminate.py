"""Benchmark decontamination against a broadcast hash set of normalised test n-grams (operator 9), DataFrame functions only.

Each document is read once and split into words once. For every place the hash of the window that starts there meets the
benchmark's hashes in a broadcast join, and what meets is verified on the words themselves. The word array stays in its row
while the places are gone through, so time grows with a text's length, not with its square. One row more for each document
(place -1) always passes, so documents without hits stay in the result and no second scan or outer join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import ascii_lower, fresh, table, text_or_empty, text_print, without_rows

#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same for texts that still have capitals
WINDOW = 10
#: Bytes of the benchmark's windows that may be broadcast; beyond, windows meet by a shuffled join instead.
BROADCAST_BYTES = 128 << 20


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; an empty array for an empty text."""
    return F.array_remove(F.split(ascii_lower(text), SPLIT, -1), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(size, gram, items): the distinct windows and the items that hold them. An item of fewer words than the window, but
    not none, is one window of its own size. A null text has no words; an item with a null id has windows, but no name."""
    w = benchmark.select("item_id", words(text_or_empty()).alias("w")).where(F.size("w") > 0).withColumn("size", F.least(F.lit(window), F.size("w")))
    grams = w.select("item_id", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    return grams.groupBy("size", F.slice("w", F.col("at"), F.col("size")).alias("gram")).agg(F.collect_set("item_id").alias("items"))


def window_bytes(grams: DataFrame) -> int:
    """An upper estimate of what the windows take in a broadcast table: rows, words and item ids with their overhead."""
    each = 200 + 24 * F.size("gram") + F.octet_length(F.array_join("gram", "")) + F.octet_length(F.array_join(F.transform("items", lambda i: i.cast("string")), "")) + 24 * F.size("items")
    return grams.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, print, row, n_words, n_hit, items, hits, contaminated.

    n_hit counts the words inside any occurrence of a window, items are the sorted ids (as text) of the items found, hits
    the places, print is the hash of the text. A null or empty text has no words and is clean, as is everything against an
    empty benchmark; repeated rows and rows with a null id give a row each; other columns are not read. The windows are
    broadcast if their measured size allows it; a larger benchmark takes the same join with a shuffle of hashes and windows.
    """
    grams = benchmark_windows(benchmark, window)
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect()) or [window]  # at most `window` of them
    known = grams.select(F.col("size").alias("known_size"), F.xxhash64(*[F.get("gram", F.lit(k)) for k in range(max(sizes))]).alias("h"), "gram", "items")
    small = window_bytes(grams) <= broadcast_bytes
    if small:
        known = F.broadcast(known)
    split = docs.select("doc_id", text_print().alias("print"), F.monotonically_increasing_id().alias("row"), words(text_or_empty()).alias("w")).withColumn("n_words", F.size("w"))
    probes = split.withColumn("at", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)))
    probes = probes.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))) if len(sizes) > 1 else probes.withColumn("size", F.lit(sizes[0]))
    probes = probes.where((F.col("at") < 0) & (F.col("size") == sizes[0]) | (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n_words")))
    # xxhash64 passes over nulls, so one expression serves every size
    word = lambda k: F.get("w", F.col("at") + k) if k < sizes[0] else F.when(F.col("size") > k, F.get("w", F.col("at") + k))
    probes = probes.withColumn("h", F.when(F.col("at") >= 0, F.xxhash64(*[word(k) for k in range(max(sizes))])))
    own = F.slice("w", F.col("at") + 1, F.col("size"))
    if not small:
        probes, own = probes.withColumn("own", F.when(F.col("at") >= 0, own)).drop("w"), F.col("own")  # shuffled: a window takes its own words only
    found = probes.join(known, (probes["h"] == known["h"]) & (probes["size"] == known["known_size"]), "left").where((F.col("at") < 0) | F.col("gram").isNotNull() & (own == F.col("gram")))
    found = found.select("doc_id", "print", "row", "n_words", F.when(F.col("at") >= 0, F.struct("at", "size", "items")).alias("hit"))
    found = found.groupBy("doc_id", "print", "row").agg(F.max("n_words").alias("n_words"), F.collect_list("hit").alias("hits"))
    cover = F.aggregate(
        F.sort_array(F.transform("hits", lambda h: F.struct(h["at"].alias("at"), (h["at"] + h["size"]).alias("end")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, h: F.struct(F.greatest(a["end"], h["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(a["end"], h["at"]))).alias("n")),
        lambda a: a["n"],
    )
    items = F.sort_array(F.array_distinct(F.transform(F.flatten(F.transform("hits", lambda h: h["items"])), lambda i: i.cast("string"))))
    return found.select("doc_id", "print", "row", F.col("n_words").cast("long").alias("n_words"), cover.alias("n_hit"), items.alias("items"), "hits", (F.size("hits") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a benchmark window; all columns. Rows are told apart by id and text, null ids included."""
    bad = contamination(docs, benchmark, window).where("contaminated").select(F.col("doc_id").cast("long").alias("doc_id"), "print")
    return without_rows(docs, bad)


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...) with the hit words, and the separators behind them, cut out of the texts; one row per row, in the
    columns of docs, whatever their names. Each row is cut by its own hits, null and repeated ids included; a null text stays."""
    found = contamination(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("print").alias("hit_print"), "hits").dropDuplicates(["hit_id", "hit_print"])
    hits, raw, sep, text = found["hits"], fresh(docs, "raw"), fresh(docs, "sep"), docs["text"]
    out = docs.join(found, docs["doc_id"].eqNullSafe(found["hit_id"]) & (text_print(docs) == found["hit_print"]), "left")
    own, spots = fresh(docs, "own_text"), fresh(docs, "spots")
    others = [c for c in docs.columns if c != "text"]
    out = out.select(*[docs[c] for c in others], text.alias(own), hits.alias(spots), F.array_remove(F.split(text, RAW_SPLIT, -1), "").alias(raw), F.regexp_extract_all(text, F.lit(RAW_SPLIT), F.lit(0)).alias(sep))
    lead = F.col(own).rlike(f"^{RAW_SPLIT}").cast("int")
    kept = F.transform(
        raw,
        lambda w, i: F.when(F.exists(spots, lambda h: (h["at"] <= i) & (i < h["at"] + h["size"])), "").otherwise(F.concat(w, F.coalesce(F.get(F.col(sep), i + lead), F.lit("")))),
    )
    cut = F.concat(F.when(lead == 1, F.get(F.col(sep), F.lit(0))).otherwise(""), F.array_join(kept, ""))
    return out.withColumn("text", F.when(F.size(spots) > 0, cut).otherwise(F.col(own))).select(docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) s WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, dw.size AS size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.gram = bw.gram),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(named.items, '')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
