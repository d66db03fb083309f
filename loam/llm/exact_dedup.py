"""Exact dedup by deterministic block naming (operator 10).

A text's UTF-8 bytes are cut into fixed-size blocks. Equal blocks get one integer name, different blocks different ones;
then adjacent names are paired and the pairs are named in the same way, until each document has one name. Names come from
sorting and grouping the blocks and pairs themselves, never a hash of them, so two documents have the same
(number of blocks, name) exactly when their bytes are equal.

A name is the integers (doc_id, fingerprint, block number) of the smallest occurrence. That needs no sort into one global
sequence: every shuffle partition sorts its own blocks, map-side minimums shrink hot blocks before the shuffle, and the
join that brings the names back is an equi-join that adaptive execution may split. Levels: log2 of the longest document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import table, text_or_empty, text_print, written

BLOCK_BYTES = 4096


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """(row, n, i, part): document, its number of blocks, block number, bytes. An empty text is one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block).cast("int"))
    return (
        docs.select("row", F.col("text").cast("binary").alias("data"), n.alias("n"))
        .select("row", "n", "data", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
        .select("row", "n", "i", F.substring("data", F.col("i") * block + 1, F.lit(block)).alias("part"))
    )


def _named(parts: DataFrame, key: list[str]) -> DataFrame:
    """(row, n, i, name): equal keys of a level get one name, the smallest (row, i) among them."""
    names = parts.groupBy(*key).agg(F.min(F.struct("row", "i")).alias("name"))
    return parts.join(names, key).select("row", "n", "i", "name")


def block_names(docs: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """(row, n, name), one row for each row key of docs(row, text); keys with equal texts, and no others, share (n, name)."""
    level = written(_named(_blocks(docs, block), ["part"]))
    width = level.agg(F.max("n")).first()[0] or 1
    done, span = level.where("n = 1"), 1
    while span < width:
        none = F.struct(F.struct(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("print")).alias("row"), F.lit(-1).alias("i"))
        pairs = level.where(F.col("n") > span).groupBy("row", "n", F.expr("int(i div 2)").alias("j"))
        pairs = pairs.agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"), F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("right"))
        pairs = pairs.select("row", "n", F.col("j").alias("i"), "left", F.coalesce("right", none).alias("right"))
        level, span = written(_named(pairs, ["left", "right"])), span * 2
        done = done.unionByName(level.where(F.col("n") <= span))
    return done.select("row", "n", "name").distinct()


def exact_duplicates(docs: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256; print: the text's 64-bit hash.

    keep_id is the largest doc_id among equal texts (null only where no other id is there), group_size their number of
    rows. A null text counts as empty, and empty texts equal each other. A repeated row counts again and is kept if its
    id is; rows with one doc_id and different texts are told apart. Other columns are not read; an empty table gives an
    empty result.
    """
    row = F.struct("doc_id", text_print().alias("print")).alias("row")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    names = block_names(docs.select(row, "text"), block)
    named = docs.select("doc_id", row, F.sha2("text", 256).alias("text_sha256")).join(names, "row")
    named = written(named.select("doc_id", "n", "name", "text_sha256", F.col("row.print").alias("print")))
    groups = named.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return named.join(groups, ["n", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "print")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("print")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
