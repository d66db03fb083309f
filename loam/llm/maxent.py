"""Hashed maximum-entropy language model (operator 7).

log p(text) = sum over tokens of log p(class | context) + log p(token | class). The class factor is a softmax over 64 classes
whose weights are looked up by hashed bigram, trigram and skip features; the 32 most frequent tokens are classes of their own,
the others fall into 32 classes by the hash of their last two bytes. The token factor has a bias feature only, whose
maximum-likelihood weights are the smoothed relative counts.

Training: token counts and feature-class counts of the whole training part start the weights; then distributed gradient
updates follow, each over its own share of the training documents, together all of them. Workers sum gradients into fixed
tables; the sums of workers are added in two rounds. Scoring works on numpy blocks of tokens. Counts of the most frequent
tokens (BROADCAST_TOKENS at most, by a frequency threshold) are broadcast; all other tokens of a document meet
their counts in a join, so no vocabulary has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import discard, held_out, small_batches, table, written
from loam.llm.wordhash import byte_values, mix, pieces, word_hashes, word_spans

TOP, TAIL = 32, 32
CLASSES = TOP + TAIL
TEMPLATES, ROWS = 3, 4096
CHUNK_ROWS = 256
BROADCAST_TOKENS = 1 << 18
UPDATES, RATE, DAMPING = 2, 0.3, 5.0
BLOCK, CELLS = 4096, 4 << 20
END, START = np.uint64(0xE4D0000000000001), np.uint64(0x57A2700000000003)
_GROW = np.uint64(0x2545F4914F6CDD1D)


@dataclass
class Model:
    """hashes, counts, classes: the broadcast tokens, sorted by hash; bias and weights: of the class softmax; loss: log10 of
    each tail class's smoothed total."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    loss: np.ndarray


def tokens(column: pa.Array):
    """(first row, number of rows, token hashes, tail classes, bounds) per piece; each row's words and then its end."""
    for row, data, offsets in pieces(column):
        start, end, of = word_spans(data, offsets)
        n = len(offsets) - 1
        bounds = np.searchsorted(of, np.arange(n + 1))
        value = byte_values()[0]
        last, before = value[data[end - 1]], value[data[np.maximum(end - 2, start)]]
        tails = (mix(last * _GROW + before) % np.uint64(TAIL)).astype(np.int64)
        yield row, n, np.insert(word_hashes(data, start, end), bounds[1:], END), np.insert(tails, bounds[1:], 0), bounds + np.arange(n + 1)


def _counted(batches):
    """(hash, tail, n) of the tokens, summed over some batches at a time."""
    schema = pa.schema([("hash", pa.int64()), ("tail", pa.int32()), ("n", pa.int64())])
    parts, size = [], 0

    def merged(parts):
        h, t, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, t, n = h[order], t[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[first], t[first], np.add.reduceat(n, first)

    for batch in batches:
        for _, _, h, t, _ in tokens(batch.column("text")):
            if len(h):
                parts.append(merged([(h, t, np.ones(len(h), np.int64))]))
                size += len(parts[-1][0])
        if size > 1_500_000:
            parts = [merged(parts)]
            size = len(parts[0][0])
            if size > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].astype(np.int64)), pa.array(parts[0][1].astype(np.int32)), pa.array(parts[0][2])], schema=schema)
                parts, size = [], 0
    if parts:
        h, t, n = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(t.astype(np.int32)), pa.array(n)], schema=schema)


def lookup(model: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known, place) of token hashes in the model's table."""
    if not len(model.hashes):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
    return model.hashes[at] == h, at


def features(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of the three weight tables for each token: the token before; the one before that; both."""
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    first = bounds[:-1]
    one[first], two[first] = START, START
    second = first[np.diff(bounds) > 1] + 1
    two[second] = START
    pick = lambda x, k: (mix(x + np.uint64(k)) % np.uint64(ROWS)).astype(np.int64) + (k - 1) * ROWS
    return np.stack([pick(one, 1), pick(two, 2), pick(one * _GROW + two, 3)])


def log_softmax(model: Model, f: np.ndarray) -> np.ndarray:
    z = model.weights[f[0]] + model.weights[f[1]]
    z += model.weights[f[2]]
    z += model.bias
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def class_of(model: Model, h: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known, at = lookup(model, h)
    own = model.classes[at] if len(model.hashes) else np.full(len(h), -1)
    return np.where(known & (own >= 0), own, TOP + tails), known, at


def _summed(shared, gradient: bool):
    """Workers' tables in chunks of rows: counts of (feature, class), or the gradient of the log-likelihood."""

    def run(batches):
        model = Model(**shared.value)
        total = np.zeros((TEMPLATES * ROWS, CLASSES), np.float64)
        cells, held = [], 0

        def settle():  # a pass over the whole table for many tokens, not for each piece
            nonlocal total
            if cells:
                total += np.bincount(np.concatenate(cells), minlength=total.size).reshape(total.shape)
                cells.clear()

        for batch in batches:
            for _, _, h, tails, bounds in tokens(batch.column("text")):
                f = features(h, bounds)
                y = class_of(model, h, tails)[0]
                cells.append((f * CLASSES + y).astype(np.int32).ravel())
                held += len(cells[-1])
                if held > CELLS:
                    settle()
                    held = 0
                if gradient:
                    for a in range(0, len(h), BLOCK):
                        part = f[:, a : a + BLOCK]
                        p = np.exp(log_softmax(model, part))
                        for k in range(TEMPLATES):
                            order = np.argsort(part[k], kind="stable")
                            rows = part[k][order]
                            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                            total[rows[first]] -= np.add.reduceat(p[order], first)
        settle()
        task = TaskContext.get().partitionId() % 64
        for c in range(0, len(total), CHUNK_ROWS):
            part = total[c : c + CHUNK_ROWS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([task], pa.int32()), pa.array([part.astype("<f4").tobytes()], pa.binary())], ["chunk", "task", "part"])

    return run


def _add(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CHUNK_ROWS * CLASSES, np.float64)
    for batch in batches:
        for x in batch.column("part"):
            total += np.frombuffer(x.as_buffer(), "<f4")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.astype("<f4").tobytes()], pa.binary())], ["chunk", "task", "part"])


def table_sum(docs: DataFrame, model: Model, gradient: bool) -> np.ndarray:
    """The sum of all workers' tables (3 MB), added in groups of 1/64 of the workers first."""
    shape = "chunk int, task int, part binary"
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _add(key, batches)

    parts = docs.select("text").mapInArrow(_summed(shared, gradient), shape)
    with small_batches(docs.sparkSession):
        rows = parts.groupBy("chunk", "task").applyInArrow(add, shape).groupBy("chunk").applyInArrow(add, shape).collect()
    out = np.zeros((TEMPLATES * ROWS, CLASSES), np.float64)
    for r in rows:
        out[r["chunk"] : r["chunk"] + CHUNK_ROWS] = np.frombuffer(r["part"], "<f4").reshape(CHUNK_ROWS, CLASSES)
    shared.unpersist()
    return out


def token_counts(docs: DataFrame) -> DataFrame:
    """(hash, tail, c) over docs(text): the count of every token."""
    return docs.select("text").mapInArrow(_counted, "hash long, tail int, n long").groupBy("hash").agg(F.min("tail").alias("tail"), F.sum("n").alias("c"))


def train(docs: DataFrame, counts: DataFrame, updates: int = UPDATES) -> Model:
    """The model of docs(doc_id, text) and their token counts. The driver holds the tables above, of fixed size."""
    sizes = counts.groupBy("c").agg(F.count("*").alias("v")).orderBy(F.desc("c")).collect()  # distinct counts: far fewer than tokens
    least, total = 0, 0
    for r in sizes:
        if total + r["v"] > BROADCAST_TOKENS:
            break
        least, total = r["c"], total + r["v"]
    rows = counts.where(F.col("c") >= least).select("hash", "c").collect() if least else []
    known = np.array([(r["hash"], r["c"]) for r in rows], np.int64).reshape(-1, 2)
    known = known[np.argsort(known[:, 0].astype(np.uint64), kind="stable")]
    hashes, c = known[:, 0].astype(np.uint64), known[:, 1].astype(np.float64)
    classes = np.full(len(hashes), -1, np.int64)
    top = np.lexsort((hashes, -c))[:TOP]
    classes[top] = np.arange(len(top))
    own = [int(x) for x in known[top, 0]]
    loss = np.zeros(TAIL)
    tails = counts.where(~F.col("hash").isin(own)) if own else counts
    for r in tails.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        loss[r["tail"]] = np.log10(r["n"] + 0.5 * (r["v"] + 1))
    loss[loss == 0] = np.log10(0.5)
    model = Model(hashes, np.log10(c + 0.5), classes, np.full(CLASSES, -np.log(CLASSES), np.float32), np.zeros((TEMPLATES * ROWS, CLASSES), np.float32), loss)
    seen = table_sum(docs, model, gradient=False)
    share = seen[:ROWS].sum(0) + 0.5
    share /= share.sum()
    model.bias = np.log(share).astype(np.float32)
    smooth = 20.0
    model.weights = (0.4 * (np.log((seen + smooth * share) / (seen.sum(1, keepdims=True) + smooth)) - np.log(share))).astype(np.float32)
    for k in range(updates):
        slope = table_sum(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(updates)) == k), model, gradient=True)
        step = RATE * slope / (seen / updates + DAMPING)
        model.weights = (model.weights + np.clip(step, -1, 1)).astype(np.float32)
    return model


def _scored(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("shared", pa.float64()), ("own", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def run(batches):
        model = Model(**shared.value)
        for batch in batches:
            for row, n, h, tails, bounds in tokens(batch.column("text")):
                y, known, at = class_of(model, h, tails)
                f = features(h, bounds)
                logs = np.empty(len(h))
                for a in range(0, len(h), BLOCK):
                    p = log_softmax(model, f[:, a : a + BLOCK])
                    logs[a : a + BLOCK] = p[np.arange(len(p)), y[a : a + BLOCK]]
                logs /= np.log(10)
                tail = y >= TOP
                count = np.where(known, model.counts[at] if len(model.hashes) else 0.0, 0.0)
                own = logs - np.where(tail, model.loss[np.where(tail, y - TOP, 0)], 0) - np.where(tail, 0, count)  # the shared count is added to both scores later
                by = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every row has at least its end
                rare, times = [], []
                for r in range(n):
                    u, k = np.unique(h[bounds[r] : bounds[r + 1]][~known[bounds[r] : bounds[r + 1]]], return_counts=True)
                    rare.append(u.astype(np.int64))
                    times.append(k.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, n), pa.array(np.diff(bounds)), pa.array(by(known.astype(np.int64))), pa.array(by(count)), pa.array(by(own)), pa.array(rare, schema.field("rare").type), pa.array(times, schema.field("times").type)],
                    schema=schema,
                )

    return run


def score_documents(docs: DataFrame, training: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Tokens: A-Z lower-cased words between white space, then one end; so a null or empty text is one token. A token that
    training has not seen counts 0. Repeated rows get a row each and null ids stay; other columns are not read. Without
    training rows the base score is 0 and the classes are equally likely.
    """
    spark = docs.sparkSession
    training = training.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = written(token_counts(training))
    vocabulary, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    shared = spark.sparkContext.broadcast(vars(train(training, counts)))
    shape = "doc_id long, n_tokens long, known long, shared double, own double, rare array<long>, times array<int>"
    scored = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(shared), shape).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.inline(F.arrays_zip(F.col("rare").alias("hash"), F.col("times").alias("times")))).join(counts.select("hash", "c"), "hash", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("rare_score"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    both = F.col("shared") + F.coalesce("rare_score", F.lit(0.0))
    return scored.drop("rare", "times").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (both - F.col("n_tokens") * F.lit(float(np.log10(total + 0.5 * (vocabulary + 1))))).alias("base_score"), (both + F.col("own")).alias("score"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, docs.where(~held_out(1)))
    return scored.select("doc_id", held_out(1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
