"""Exact top-k against all scores."""

from __future__ import annotations

import math
import random

import numpy as np

from stationlake.llm import topk


def brute(rows, k, by=64):
    """(query id, rank, id, score) as a sorted list, with every row a candidate but the query's own."""
    clean = [
        (i, [math.floor(by * float(x)) for x in v]) for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (q, a) in enumerate(clean):
        if q is None or q % 20:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a, b)), i is None, i or 0)
            for m, (i, b) in enumerate(clean) if m != n and len(b) == len(a)
        )[:k]
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored)]
    return sorted(out, key=str)


def run(spark, rows, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    vectors = topk.scaled(topk.usable(df, "vec_id", "embedding"), 64.0)
    got = topk.top_k(vectors.where("vec_id % 20 = 0"), vectors, k).collect()
    return sorted([(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got], key=str), len(got)


def test_topk_with_ties_nulls_lengths_and_small_groups(spark):
    r = random.Random(3)
    f = lambda x: float(np.float32(x))
    rows = [(k, [f(r.choice((-0.5, 0.0, 0.25, 0.7))) for _ in range(8)], 0) for k in range(150)]
    rows += [(200 + k, [f(r.gauss(0, 1)) for _ in range(3)], None) for k in range(9)]
    rows += [(300, None, 1), (320, [1.0, None, 2.0], 1), (340, [float("nan")] * 8, 1), (360, [float("inf")] * 8, 1),
             (400, [], 1), (401, [], 1), (None, [1.0] * 8, 1), (500, [1.0], 2)]
    got, n = run(spark, rows, 20)
    want = brute([x[:2] for x in rows], 20)
    assert got == want and n == len(want)


def test_topk_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    r = random.Random(11)
    f = lambda x: float(np.float32(x))
    v = lambda: [f(r.choice((-0.5, 0.0, 0.25, 0.7))) for _ in range(6)]
    rows = [(r.choice([None, 0, 20, 20, 40, 7, 8]), v(), 0) for _ in range(120)] + [(20, [0.5] * 6, 1)] * 30
    got, n = run(spark, rows, 20)
    want = brute([x[:2] for x in rows], 20)
    assert got == want and n > 40 * 20 and any(x[2] is None for x in got) and any(x[0] == x[2] for x in got)


def test_topk_prunes_clustered_vectors_exactly(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 64))
    rows = [
        (k, [float(x) for x in (centres[k % 6] + rng.normal(size=64) * 0.1).astype(np.float32)], 0)
        for k in range(1500)
    ]
    got, n = run(spark, rows, 20)
    assert got == brute([x[:2] for x in rows], 20) and n == 75 * 20


def test_topk_scores_blocks_of_queries_together(monkeypatch):
    rng = np.random.default_rng(4)
    q, x = rng.integers(-20, 21, (60, 32)).astype(float), rng.integers(-20, 21, (1000, 32)).astype(float)
    ids = lambda n, at: np.stack([np.zeros(n, np.int64), np.arange(n) // 2, np.arange(at, at + n)], axis=1)
    monkeypatch.setattr(topk, "exact_scores", None)  # one query at a time is for numbers beyond 2**53
    best = topk.Best(ids(60, 100), q, 20)
    rows = ids(1000, 0)
    best.add(rows[:700], x[:700])
    best.add(rows[700:], x[700:])
    scores = (q @ x.T).astype(int)
    want = [
        (a // 2, a + 100, int(rows[b, 1]), int(b), int(scores[a, b])) for a in range(60)
        for b in sorted((b for b in range(1000) if b != a + 100), key=lambda b: (-scores[a, b], rows[b, 1], b))[:20]
    ]
    assert list(best.rows()) == want


def test_topk_large_components_do_not_overflow():
    q = np.array([3.0e9, -1.0e9])
    x = np.array([[2.0e9, 1.0], [1.0, 3.0e9]])
    assert list(topk.exact_scores(q, x)) == [6 * 10**18 - 10**9, 3 * 10**9 - 3 * 10**18]


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    v = topk.usable(df, "vec_id", "embedding")
    assert topk.top_k(v, v, 5).count() == 0
