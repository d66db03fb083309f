"""Operators 1 and 7: their own scores against plain loops over windows and tokens."""

import math

import numpy as np
import pyarrow as pa
from loam.llm import maxent, toxicity
from loam.llm.common import written

TEXTS = ["you are a vile fool", "a calm and clean text about the sea", " ".join(f"w{k % 13}" for k in range(130)), "vile vile fool", "the sea is calm", "", "one"]


def plain_score(model, text):
    """Each window on its own, one step of the recurrence at a time."""
    net, vocabulary = model["net"], model["vocabulary"]
    words = toxicity.Words([text])
    rows, inputs = toxicity.embed(net, vocabulary, words)
    seq = [inputs[i] for i in words.index]
    if not seq:
        return min(model["share"], 0.49)
    sig = lambda x: 1 / (1 + np.exp(-x))
    h, best = toxicity.HIDDEN, -np.inf
    starts = range(0, max(1, len(seq) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
    for a in starts:
        window = seq[a : a + toxicity.WINDOW]
        states = []
        for side, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            s, out = np.zeros(h), {}
            for t in order:
                x, pull = window[t] @ net[f"in_{side}"] + net[f"add_{side}"], s @ net[f"own_{side}"]
                z, r = sig(x[:h] + pull[:h]), sig(x[h : 2 * h] + pull[h : 2 * h])
                s = z * s + (1 - z) * np.tanh(x[2 * h :] + r * pull[2 * h :])
                out[t] = s
            states.append(out)
        both = [np.concatenate([states[0][t], states[1][t]]) for t in range(len(window))]
        weight = np.exp([float(v @ net["attend"]) for v in both])
        pooled = sum(w * v for w, v in zip(weight / weight.sum(), both, strict=True))
        best = max(best, float(pooled @ net["out"] + net["bias"][0]))
    return float(sig(best))


def test_toxicity_by_plain_windows():
    model = toxicity.fit(TEXTS[:5] * 3, [1, 0, 0, 1, 0] * 3)
    got = toxicity.score_texts(model, TEXTS)
    for text, score in zip(TEXTS, got, strict=True):
        assert abs(score - plain_score(model, text)) < 1e-4, text


def test_language_model_by_plain_tokens(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["the sea is calm the sea", "the fool is the sea", "calm sea", ""] * 4)], "doc_id long, text string")
    counts = written(maxent.token_counts(docs))
    model = maxent.train(docs, counts)
    scored = {r.doc_id: r for r in maxent.score_documents(docs, docs).collect()}
    count = {r["hash"]: r["c"] for r in counts.collect()}
    for doc, text in ((r.doc_id, r.text) for r in docs.collect()):
        (_, _, h, tails, bounds), want = next(iter(maxent.tokens(pa.array([text])))), 0.0
        f = maxent.features(h, bounds)
        for t in range(len(h)):
            z = [sum(float(model.weights[f[k][t], c]) for k in range(maxent.TEMPLATES)) + float(model.bias[c]) for c in range(maxent.CLASSES)]
            top = max(z)
            norm = top + math.log(sum(math.exp(x - top) for x in z))
            assert abs(sum(math.exp(x - norm) for x in z) - 1) < 1e-9
            own = maxent.class_of(model, h[t : t + 1], tails[t : t + 1])[0][0]
            want += (z[own] - norm) / math.log(10)
            if own >= maxent.TOP:
                c = count.get(int(h[t].astype(np.int64)), 0)
                want += math.log10(c + 0.5) - float(model.loss[own - maxent.TOP])
        assert abs(want - scored[doc].score) < 1e-3, text
