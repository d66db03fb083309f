"""Harmonic packing of tokenised documents into fixed-size sequences (operator 3).

A length in (C/(k+1), C/k] belongs to the reciprocal-capacity class k, and a sequence of class k takes exactly k pieces. Every
worker fills the sequences of each class on its own, while it tokenises. A document longer than C is cut into whole
sequences first; a rest that would leave more than 1/32 of its class's slot empty is cut again, at the largest slot size
below it, so that what is padded stays near one percent.

What a worker has left over is less than one sequence per class (about 90 classes). These pieces meet by class in groups of
64 workers, then 64 of those groups, and so on; what is left at the end is bounded by the classes alone, and is packed by
first fit in one small group.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam.llm.common import discard, table, written

CAPACITY = 2048
END_ID = 1
#: A rest of a document stays whole if it leaves at most this share of its slot empty, or its class is at least this.
SLOT_SLACK, SMALL_CLASS = 1 / 32, 64
FAN_IN = 64
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, worker long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def make_encode(path: str):
    """text -> ids of the tokenizers file at path, without special tokens around the text (add_special_tokens=False).

    The merges run in tiktoken, on the ranks that lie beside the file, as its ids are the same and it takes a fifth of the
    time. Through tokenizers go a text that holds the string of an added token, which the file gives an id of its own, a text
    that tiktoken refuses, and all texts where there are no ranks.
    """
    import os
    import re

    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    slow = lambda text: exact.encode(text, add_special_tokens=False).ids
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    own = [t.content for t in exact.get_added_tokens_decoder().values()]
    added = re.compile("|".join(map(re.escape, own)) if own else "(?!)")

    def encode(text: str) -> list[int]:
        if added.search(text):
            return slow(text)
        try:
            return fast.encode_ordinary(text)
        except ValueError:
            return slow(text)

    return encode


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document, in order."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity // k - rest <= capacity // k * SLOT_SLACK or k >= SMALL_CLASS:
            out.append((rest, k))
            break
        slot = capacity // (k + 1)
        out.append((slot, capacity // slot))
        rest -= slot
    return out


def _packer(path: str, capacity: int, end_id: int):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    schema = pa.schema([(n, pa.int32() if n == "class" else pa.int64()) for n in names])

    def pack(batches):
        encode, worker = make_encode(path), TaskContext.get().partitionId()
        waiting: dict[int, list] = {}
        filled = 0
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                at = 0
                for size, k in cuts(len(ids), capacity):
                    group = waiting.setdefault(k, [])
                    group.append((doc_id, at, size, zlib.crc32(ids[at : at + size].tobytes()), len(ids), k, worker))
                    at += size
                    if len(group) == k:
                        place = 0
                        for piece in group:
                            rows.append((*piece, worker << 34 | filled, place))
                            place += piece[2]
                        filled += 1
                        waiting[k] = []
            if rows:
                yield table(rows)
        if left := [(*piece, None, None) for group in waiting.values() for piece in group]:
            yield table(left)

    return pack


def _first_fit(capacity: int, base: int):
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        used: list[int] = []
        ids, offsets, lowest = [], [], 0
        for size in rows.column("length").to_pylist():
            while lowest < len(used) and used[lowest] == capacity:
                lowest += 1
            at = next((k for k in range(lowest, len(used)) if used[k] + size <= capacity), len(used))
            if at == len(used):
                used.append(0)
            ids.append(base + at)
            offsets.append(used[at])
            used[at] += size
        for name, values in (("sequence_id", ids), ("offset", offsets)):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        return rows

    return pack


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids, and the end id after them, lie in exactly one piece each; a null or empty text is the end id alone.
    Repeated rows are packed once each; a null id stays null. A sequence's pieces lie at gapless offsets and have at most
    capacity ids together. Other columns are not read; an empty table gives an empty result. Memory: one text's ids, and
    what waits for its class (less than one sequence for each).
    """
    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packer(path or tokenizer_path(), capacity, end_id), COLUMNS))
    whole, left = pieces.where("sequence_id IS NOT NULL"), pieces.where("sequence_id IS NULL")
    workers, level = (pieces.agg(F.max("worker")).first()[0] or 0) + 1, 0
    while level == 0 or workers > 1:
        level += 1
        workers = -(-workers // FAN_IN)
        left = left.withColumn("worker", F.floor(F.col("worker") / FAN_IN))
        group = Window.partitionBy("class", "worker")
        row = F.row_number().over(group.orderBy("doc_id", "start", "length", "ids_crc32")) - 1
        placed = left.withColumn("n", F.count("*").over(group)).withColumn("i", row)
        number = F.lit(level << 58).bitwiseOR(F.shiftleft((F.col("worker") * 2048 + F.col("class") - 1), 29)).bitwiseOR(F.floor(F.col("i") / F.col("class")))
        placed = placed.withColumn("sequence_id", F.when(F.col("i") < F.col("n") - F.col("n") % F.col("class"), number))
        before = Window.partitionBy("class", "worker", "sequence_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        placed = placed.withColumn("offset", F.when(F.col("sequence_id").isNotNull(), F.sum("length").over(before) - F.col("length"))).drop("n", "i")
        placed = written(placed.select(pieces.columns))
        whole = whole.unionByName(placed.where("sequence_id IS NOT NULL"))
        left = placed.where("sequence_id IS NULL")
    last = left.groupBy("worker").applyInArrow(_first_fit(capacity, (level + 1) << 58), COLUMNS)
    return whole.unionByName(last).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
