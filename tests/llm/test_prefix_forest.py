"""Operator 5: recall against brute force, scores exact, odd vectors left out."""

import math

import numpy as np
from pyspark.sql import functions as F

from casemill.llm import prefix_forest


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def brute(x, q, k):
    s = x @ x[q]
    return sorted(((-s[i], i) for i in range(len(x)) if i != q))[:k]


def recall(spark, x, k=20):
    df = frame(spark, x)
    got = {}
    for r in prefix_forest.nearest(df, F.col("vec_id") % 20 == 0, k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q in range(0, len(x), 20):
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, k + 1))
        assert all(math.isclose(s, float(x[q] @ x[v]), abs_tol=1e-12) and v != q for _, v, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        hit += len({v for _, v, _ in rows} & {i for _, i in brute(x, q, k)})
        total += k
    return hit / total


def test_recall_without_and_with_structure(spark, monkeypatch):
    monkeypatch.setattr(prefix_forest, "SEGMENT", 1500)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 64)).astype(np.float32).astype(float)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    assert recall(spark, x) >= 0.9
    centres = rng.standard_normal((40, 64))
    y = (centres[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 64))).astype(np.float32).astype(float)
    assert recall(spark, y) >= 0.9
    z = y * rng.lognormal(0, 1, (3000, 1))  # lengths differ
    assert recall(spark, z.astype(np.float32).astype(float)) >= 0.9


def test_structure_saves_work():
    """Close neighbours end the ascent early: on clustered rows most are never scored, without structure many are."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((200, 64))
    close = centres[rng.integers(0, 200, 8000)] + 0.1 * rng.standard_normal((8000, 64))
    loose = rng.standard_normal((8000, 64))
    scored = {}
    for name, x in (("close", close), ("loose", loose)):
        forest = prefix_forest.Forest(x / np.linalg.norm(x, axis=1, keepdims=True))
        scored[name] = np.mean([len(f) for f, _ in forest.search(forest.x[:50], np.full(50, -np.inf), 20, 0.95)]) / len(x)
    assert scored["close"] < 0.05 < scored["loose"]


def test_odd_vectors_ties_and_few_rows(spark):
    extra = [(100, None, 0), (120, [0.0, 0.0], 0), (140, [1.0, float("nan")], 0), (160, [1.0, None], 0), (180, [float("inf"), 1.0], 0), (200, [], 0), (201, [1.0, 1.0, 1.0], 0), (None, [1.0, 1.0], 0)]
    df = frame(spark, [[1, 0], [1, 0], [0.5, 0], [-1, 0]], [*extra, (1, [1.0, 0.0], 0)])
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in prefix_forest.nearest(df, F.col("vec_id") % 20 == 0, 3).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 0.5)]
    mixed = frame(spark, [[1, 0]], [(20, [1.0, 1.0, 1.0], 0), (21, [2.0, 0.0, 0.0], 0), (20, [0.5, 0.0, 0.0], 0)])  # each length by itself; of an id's vectors the least asks
    assert [(r.query_id, r.vec_id, r.score) for r in prefix_forest.nearest(mixed, F.col("vec_id") % 20 == 0, 3).collect()] == [(20, 21, 1.0)]
    assert prefix_forest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert prefix_forest.nearest(df.limit(1), F.col("vec_id") % 20 == 0).count() == 0


def test_a_target_of_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(prefix_forest, "SEGMENT", 400)
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((1500, 24)) * rng.lognormal(0, 0.5, (1500, 1))).astype(np.float32).astype(float)
    got = {}
    for r in prefix_forest.nearest(frame(spark, x), F.col("vec_id") % 20 == 0, 7, target=1).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [v for _, v in sorted(rows)] for q, rows in got.items()} == {q: [i for _, i in brute(x, q, 7)] for q in range(0, 1500, 20)}
