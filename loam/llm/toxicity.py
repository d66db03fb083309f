"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 1), in numpy.

Input of a token: an embedding of the word (those seen at least twice in training; one row stands for all others) beside
the mean embedding of its character 3- and 4-grams, word edges included. Gated recurrent units read each window in both
directions, attention pools their states, a logistic unit scores the window. A document is cut into overlapping windows
that cover all of it, and takes the score of its highest window.

The network is fitted on the driver to a bounded sample of labelled rows (see fit_sample) by multiple-instance learning:
each epoch scores all windows of the sample and takes steps on the highest of each document. Scoring is one scan: within a
block of text each distinct word is embedded once, and windows run through the network in batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import held_out, table
from loam.llm.wordhash import mix, word_hashes

WINDOW, STRIDE = 48, 36
HIDDEN, WORD_DIM, CHAR_DIM, GRAMS = 12, 12, 12, 1 << 13
#: The training sample: rows of either label at most, code points of a text at most, words with an embedding of their own.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS, VOCABULARY = 800, 2400, 6_000, 20_000
BATCH, LEARNING_RATE, EPOCHS, LEAST_STEPS = 96, 0.01, 6, 250
PIECE, SLICE = 1 << 19, 256

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words:
    """The words of some texts: number of each word among the distinct ones, bounds per text, distinct hashes, grams."""

    def __init__(self, texts: list[str]):
        parts = [t.lower().encode() for t in texts]
        data = np.frombuffer(b" " + b" ".join(parts) + b"   ", np.uint8)
        edges = np.concatenate(([1], 1 + np.cumsum([len(p) + 1 for p in parts]))) if parts else np.array([1])
        inside = _INSIDE[data]
        start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        self.bounds = np.searchsorted(start, edges)
        self.hashes, first, self.index = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        value = np.where(inside, data, 32).astype(np.uint64)
        size = (end - start)[first] + 1  # 3-grams from the byte before a word on, as many 4-grams
        at = np.repeat(start[first] - 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        three = value[at] << np.uint64(16) | value[at + 1] << np.uint64(8) | value[at + 2]
        four = three << np.uint64(8) | value[at + 3] | np.uint64(1 << 40)
        self.grams = np.stack([mix(three), mix(four)], 1).ravel() % np.uint64(GRAMS)
        self.grams = self.grams.astype(np.int64)
        self.gram_bounds = 2 * (np.cumsum(size) - size)
        self.gram_count = 2 * size

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers by window, -1 beyond the text's end; text of each window). A text without words has none."""
        n = np.diff(self.bounds)
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(len(n)), count)
        start = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        at = start[:, None] + np.arange(WINDOW)
        return np.where(at < n[text][:, None], self.index[np.minimum(at + self.bounds[:-1][text][:, None], max(len(self.index) - 1, 0))], -1), text


def new_network(seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    g = lambda *shape, scale=1.0: (r.standard_normal(shape) * scale).astype(np.float32)
    net = {"word": g(VOCABULARY + 1, WORD_DIM, scale=0.1), "char": g(GRAMS, CHAR_DIM, scale=0.3), "attend": g(2 * h, scale=0.3), "out": g(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
    for side in "fb":
        net |= {f"in_{side}": g(d, 3 * h, scale=d**-0.5), f"own_{side}": g(h, 3 * h, scale=h**-0.5), f"add_{side}": np.zeros(3 * h, np.float32)}
    return net


def embed(net: dict, vocabulary: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row in the word table, input vector) of each distinct word; vocabulary: sorted hashes."""
    row = np.zeros(len(words.hashes), np.int64)
    if len(vocabulary) and len(words.hashes):
        at = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
        row = np.where(vocabulary[at] == words.hashes, at + 1, 0)
    chars = np.zeros((len(row), CHAR_DIM), np.float32)
    for a in range(0, len(row), 20_000):  # bounds the memory for grams
        b = min(len(row), a + 20_000)
        low = words.gram_bounds[a]
        high = words.gram_bounds[b - 1] + words.gram_count[b - 1]
        chars[a:b] = np.add.reduceat(net["char"][words.grams[low:high]], words.gram_bounds[a:b] - low) / words.gram_count[a:b, None]
    return row, np.concatenate([net["word"][row], chars], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(pre: np.ndarray, own: np.ndarray, mask: np.ndarray, order, keep: list | None) -> np.ndarray:
    """States (window, place, hidden) of one direction; pre: the input's part of the gates; keep: gets what backward needs."""
    n, h = pre.shape[0], HIDDEN
    state = np.zeros((n, h), np.float32)
    states = np.zeros((n, pre.shape[1], h), np.float32)
    for t in order:
        x, m = pre[:, t], mask[:, t, None]
        pull = state @ own
        gates = _sigmoid(x[:, : 2 * h] + pull[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[:, 2 * h :] + r * pull[:, 2 * h :])
        after = state + m * (1 - z) * (new - state)
        if keep is not None:
            keep.append((t, state, z, r, new, pull[:, 2 * h :]))
        state = after
        states[:, t] = state
    return states


def forward(net: dict, inputs: np.ndarray, index: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """Logits of windows (word numbers, -1 for none) over the distinct words' input vectors."""
    length = int((index >= 0).sum(1).max()) if len(index) else 0
    index = index[:, :length]
    mask = (index >= 0).astype(np.float32)
    states = []
    for side in "fb":
        pre = (inputs @ net[f"in_{side}"] + net[f"add_{side}"])[index] if kept is None or "pre" not in kept else kept["pre"][side][index]
        tape = None if kept is None else kept.setdefault(side, [])
        states.append(_run(pre, net[f"own_{side}"], mask, range(length) if side == "f" else range(length - 1, -1, -1), tape))
    states = np.concatenate(states, 2)
    weight = states @ net["attend"]
    weight = np.where(mask > 0, weight, -1e9)
    weight = np.exp(weight - weight.max(1, keepdims=True)) * mask
    weight /= weight.sum(1, keepdims=True)
    pooled = (weight[:, :, None] * states).sum(1)
    if kept is not None:
        kept |= {"index": index, "mask": mask, "states": states, "weight": weight, "pooled": pooled}
    return pooled @ net["out"] + net["bias"]


def scores(net: dict, inputs: np.ndarray, index: np.ndarray, batch: int = 512) -> np.ndarray:
    """Logits of any number of windows, in batches; the inputs' part of the gates is computed once for each word."""
    pre = {"pre": {s: inputs @ net[f"in_{s}"] + net[f"add_{s}"] for s in "fb"}}
    out = np.zeros(len(index), np.float32)
    for a in range(0, len(index), batch):
        part = index[a : a + batch]
        length = int((part >= 0).sum(1).max())
        part = part[:, :length]
        mask = (part >= 0).astype(np.float32)
        states = [_run(pre["pre"][s][part], net[f"own_{s}"], mask, range(length) if s == "f" else range(length - 1, -1, -1), None) for s in "fb"]
        weight = np.where(mask > 0, states[0] @ net["attend"][:HIDDEN] + states[1] @ net["attend"][HIDDEN:], -1e9)
        weight = np.exp(weight - weight.max(1, keepdims=True)) * mask
        weight /= weight.sum(1, keepdims=True)
        gain = states[0] @ net["out"][:HIDDEN] + states[1] @ net["out"][HIDDEN:]
        out[a : a + batch] = (weight * gain).sum(1) + net["bias"]
    return out


def gradients(net: dict, words: Words, rows: np.ndarray, inputs: np.ndarray, index: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean logistic loss over a batch of windows."""
    kept: dict = {}
    logit = forward(net, inputs, index, kept)
    n, h = len(index), HIDDEN
    slope = ((_sigmoid(logit) - label) / n).astype(np.float32)
    states, weight, mask = kept["states"], kept["weight"], kept["mask"]
    out = {"bias": slope.sum(keepdims=True), "out": kept["pooled"].T @ slope}
    pooled = slope[:, None] * net["out"]
    toward = (states @ pooled[:, :, None])[:, :, 0]
    energy = weight * (toward - (weight * toward).sum(1, keepdims=True))
    out["attend"] = np.einsum("nt,nth->h", energy, states)
    down = weight[:, :, None] * pooled[:, None, :] + energy[:, :, None] * net["attend"]
    used, local = np.unique(kept["index"], return_inverse=True)
    local = local.reshape(kept["index"].shape)
    into = np.zeros((len(used), inputs.shape[1]), np.float32)
    x = np.where((used >= 0)[:, None], inputs[used], 0)
    for k, side in enumerate("fb"):
        own, back = net[f"own_{side}"], np.zeros((n, h), np.float32)
        d_own, d_pre = np.zeros_like(own), np.zeros((len(used), 3 * h), np.float32)
        for t, state, z, r, new, pull in reversed(kept[side]):
            back = back + down[:, t, k * h : (k + 1) * h]
            m = mask[:, t, None]
            live = back * m
            d_new = live * (1 - z) * (1 - new * new)
            d_z = live * (state - new) * z * (1 - z)
            d_r = d_new * pull * r * (1 - r)
            d_gate = np.concatenate([d_z, d_r, d_new], 1)
            d_pull = np.concatenate([d_z, d_r, d_new * r], 1)
            d_own += state.T @ d_pull
            np.add.at(d_pre, local[:, t], d_gate)
            back = back * (1 - m) + live * z + d_pull @ own.T
        out |= {f"own_{side}": d_own, f"in_{side}": x.T @ d_pre, f"add_{side}": d_pre.sum(0)}
        into += d_pre @ net[f"in_{side}"].T
    real = used >= 0
    used, into = used[real], into[real]
    word, char = np.zeros_like(net["word"]), np.zeros_like(net["char"])
    np.add.at(word, rows[used], into[:, :WORD_DIM])
    count = words.gram_count[used]
    flat = np.repeat(words.gram_bounds[used], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    np.add.at(char, words.grams[flat], np.repeat(into[:, WORD_DIM:] / count[:, None], count, axis=0))
    return out | {"word": word, "char": char}


def fit(texts: list[str], labels: list[int], seed: int = 0) -> dict | None:
    """The network, its vocabulary and the share of label 1; None without texts. Texts without words only count for the share."""
    if not texts:
        return None
    words, y = Words(texts), np.array(labels, np.float32)
    index, of = words.windows()
    n = np.bincount(words.index, minlength=len(words.hashes)) if len(words.index) else np.zeros(0, np.int64)
    often = np.flatnonzero(n >= 2)
    often = often[np.argsort(-n[often], kind="stable")[:VOCABULARY]]
    vocabulary = np.sort(words.hashes[often])
    net, r = new_network(seed), np.random.default_rng(seed)
    model = {"net": net, "vocabulary": vocabulary, "share": float(y.mean())}
    if not len(index) or y.min() == y.max():
        return model
    per = np.bincount(of, minlength=len(texts))
    first, second = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}
    epochs, step = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, int((per > 0).sum())))), 0
    for epoch in range(epochs):
        rows, inputs = embed(net, vocabulary, words)
        if epoch < 2 and (per[y > 0] == 1).any() and (per[y == 0] == 1).any():
            chosen = np.flatnonzero(per[of] <= 2)
        else:
            s = scores(net, inputs, index)
            order = np.lexsort((-s, of))
            chosen = order[np.concatenate(([True], of[order][1:] != of[order][:-1]))]
            clean = np.flatnonzero(y[of] == 0)
            chosen = np.unique(np.concatenate([chosen, r.choice(clean, min(len(clean), len(chosen) // 3), replace=False)]))
        chosen = r.permutation(chosen)
        rate = LEARNING_RATE * (1 - epoch / epochs) + LEARNING_RATE / 20
        for a in range(0, len(chosen), BATCH):
            part = chosen[a : a + BATCH]
            rows, inputs = _inputs_of(net, vocabulary, words, rows, index[part])
            step += 1
            for k, g in gradients(net, words, rows, inputs, index[part], y[of[part]]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return model


def _inputs_of(net: dict, vocabulary: np.ndarray, words: Words, rows: np.ndarray, index: np.ndarray):
    """Fresh input vectors for the words of a batch only; the others keep zeros, as no window of the batch holds them."""
    used = np.unique(index[index >= 0])
    count = words.gram_count[used]
    flat = np.repeat(words.gram_bounds[used], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    chars = np.add.reduceat(net["char"][words.grams[flat]], np.cumsum(count) - count) / count[:, None]
    inputs = np.zeros((len(rows), WORD_DIM + CHAR_DIM), np.float32)
    inputs[used] = np.concatenate([net["word"][rows[used]], chars], 1)
    return rows, inputs


def score_texts(model: dict | None, texts: list[str]) -> np.ndarray:
    """Scores of texts; one without words gets the training rows' share of label 1, every text 0 without a model."""
    if model is None:
        return np.zeros(len(texts))
    words = Words(texts)
    index, of = words.windows()
    out = np.full(len(texts), -np.inf)
    if len(index):
        np.maximum.at(out, of, scores(model["net"], embed(model["net"], model["vocabulary"], words)[1], index).astype(float))
    return np.where(np.isinf(out), min(model["share"], 0.49), _sigmoid(out))


def _in_parts(model: dict | None, texts: list[str | None]):
    """Scores of consecutive texts, about PIECE code points at a time."""
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= PIECE:
            yield score_texts(model, part)
            part, size = [], 0
    if part:
        yield score_texts(model, part)


def _slices(shared, batches):
    """(slice of a batch, scores of its texts): a worker holds the strings of SLICE rows at a time, however long a batch is."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            part = batch.slice(a, SLICE)
            yield part, np.concatenate([np.zeros(0), *_in_parts(shared.value, part.column("text").to_pylist())])


def _scored(shared):
    def run(batches):
        for part, scores in _slices(shared, batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return run


def fit_sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, chars: int = SAMPLE_CHARS) -> dict | None:
    """The model for labelled rows outside the held-out fifth: at most `toxic` of label 1 and `clean` of label 0, by the order of
    a hash of doc_id, of these the texts of at most `chars` code points; a bounded sample of whole texts, whatever the input. A
    document is toxic if any of its rows says so; null labels teach nothing, a null text is empty, and of several texts of one
    id the smallest is taken. Only the chosen ids are broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = lambda k, n: known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = some(1, toxic).unionByName(some(0, clean))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= chars)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    return fit(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for each row of docs(doc_id, text), from the labels(doc_id, toxic) outside the held-out fifth.

    Only texts are scored: labels, lang, source and ids are no inputs. Null texts count as empty; texts without words get
    the training share of label 1 (below 0.5); without labels every score is 0. Repeated rows get a row each, null ids stay.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit_sample(docs, labels))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(shared), "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold; one scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_sample(docs, labels))

    def keep(batches):
        for part, scores in _slices(shared, batches):
            yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
