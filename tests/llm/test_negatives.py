"""Hard negatives and the tree's parts against plain Python over all rows."""

import math
import random

import numpy as np
import pytest
from loam.llm import negatives as N


def brute(rows):
    ok = [r for r in rows if None not in r[:3] and all(x is not None and math.isfinite(x) for x in r[1])]
    ok = [(i, [math.floor(256 * x) for x in np.array(e, np.float32).tolist()], (y + 1) % 10 if i % 7 == 0 else y) for i, e, y in ok]
    out = []
    for n, (a, va, ya) in enumerate(ok):
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=False)), i, y == ya) for m, (i, v, y) in enumerate(ok) if m != n)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            near = [(i, -t) for t, i, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k, i, -s, t) for k, (i, t) in enumerate(near, 1)]
    return sorted(out)


def rows_of(r, n, dim, labels, step):
    return [(i * step, [r.gauss(0, 1) / 4 for _ in range(dim)], r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(("part", "block", "page"), [(8192, 4096, 256), (60, 3, 7)])
def test_against_all_rows(spark, monkeypatch, part, block, page):
    r = random.Random(4)
    rows = rows_of(r, 300, 6, 3, 5)
    rows += [(1500 + k, [0.25] * 6, k % 2) for k in range(60)]  # one common vector: ties by id
    rows += [(50, [0.1] * 6, 1), (2000, [], 1), (2050, [0.5, 0.5], 2), (2051, [0.0] * 6, 2), (2100, [0.0] * 6, 2), (1 << 40, [-3.0] * 6, 4), (-50, [0.3] * 6, 0), (-7, [0.3] * 6, -4)]
    rows += [(2150, None, 1), (2200, [0.1] * 6, None), (2250, [float("nan")] * 6, 1), (2300, [float("inf")] + [0.0] * 5, 1), (2350, [None] + [0.1] * 5, 1), (None, [0.1] * 6, 1)]
    monkeypatch.setattr(N, "DIRECTORY", 2)
    whole = N.pages
    monkeypatch.setattr(N, "pages", lambda labels, vectors: whole(labels, vectors, page))
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "vec_id long, embedding array<float>, label int, part int, uid string")
    got = sorted(tuple(x) for x in N.hard_negatives(df, part, block).collect())
    assert len(got) > 100 and got == brute(rows)
    assert N.hard_negatives(df.limit(0)).collect() == [] and N.hard_negatives(df.where("vec_id = 5")).collect() == []


def test_large_numbers_stay_exact(spark):
    rows = [(50 * k, [(3.0**k) * 2.0**11 + 2.0**-8, -(2.0**11)], k % 2) for k in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(x) for x in N.hard_negatives(df).collect()) == sorted(brute_double(rows))


def brute_double(rows):
    plain = [(i, [math.floor(256 * x) for x in e], (y + 1) % 10 if i % 7 == 0 else y) for i, e, y in rows]
    out = []
    for a, va, ya in plain:
        scored = sorted((-(va[0] * v[0] + va[1] * v[1]), i, y == ya) for i, v, y in plain if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            out += [(a, p, k, i, -s, t) for k, (i, t) in enumerate([(i, -t) for t, i, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:3], 1)]
    return out


def test_boxes_hold_their_products():
    r = np.random.default_rng(1)
    points, anchors = r.integers(-90, 90, (40, 5)).astype(float), r.integers(-90, 90, (20, 5)).astype(float)
    lower, upper = N.interval(anchors, points.min(0)[None], points.max(0)[None])
    scores = anchors @ points.T
    assert (lower[:, 0] <= scores.min(1)).all() and (upper[:, 0] >= scores.max(1)).all()
    labels = r.integers(0, 4, 1000)
    cut = N.pages(labels, r.normal(size=(1000, 5)), 64)
    assert sorted(np.concatenate(cut)) == list(range(1000)) and max(map(len, cut)) <= 64 and len(cut) <= 24


def test_repeated_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.75, 0.0], 5), (1, [0.75, 0.0], 5), (50, [1.0, 0.0], None), (3, [1.0, 0.5], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(x) for x in N.hard_negatives(df).collect())
    assert got == brute(rows) and len(got) > 0  # an anchor that repeats is the other's positive, and both have rows
