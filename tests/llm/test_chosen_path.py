"""Operator 4 against a brute-force join."""

import random
from itertools import combinations

import numpy as np

from casemill.llm import chosen_path as cp


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    order = lambda k: (k is None, k or 0)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k, key=order)
    return sorted((k, least[root(i)], links[i]) for i, (k, _) in enumerate(rows) if k is not None)


def corpus(seed, clusters=25, hot=90):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 3000)
    passage = [word() for _ in range(60)]
    texts = []
    for c in range(clusters):
        base = [word() for _ in range(rng.randint(8, 200))]
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = word()
            texts.append(t)
        texts.append(base[: len(base) // 2] + passage)
    base = [word() for _ in range(150)]
    for _ in range(hot):  # a large group of near copies
        t = list(base)
        t[rng.randrange(150)] = word()
        texts.append(t)
    texts += [["a", "b"], ["a", "b"], ["A", "b"], ["c"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(len(rows), rows[0][1]), (len(rows) + 1, None), (len(rows) + 2, ""), (3, rows[3][1]), (3, rows[3][1])]


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS class_id", "2 AS n", "3 AS key")
    got = [tuple(r) for r in cp.join(df).collect()]
    assert len(got) == len(rows)
    return sorted(r for r in got if r[0] is not None)


def test_join_equals_brute_force(spark):
    rows = corpus(1)
    assert result(spark, rows) == brute(rows)


def test_runs_reach_the_recall_over_shared_minima():
    # walks of 100,000 pairs at the least similarity, whose runs all draw from one list of minima a pair
    rng, n = np.random.default_rng(7), 100_000
    agree = rng.random((n, cp.MINIMA)) < cp.SIMILAR
    row = np.arange(n)

    def meet(depth):
        if not depth:
            return np.ones(n, bool)
        first = rng.integers(0, cp.MINIMA, n)
        second = (first + 1 + rng.integers(0, cp.MINIMA - 1, n)) % cp.MINIMA
        return agree[row, first] & meet(depth - 1) | (rng.random(n) < cp.SECOND) & agree[row, second] & meet(depth - 1)

    found = np.zeros(n, bool)
    for _ in range(cp.runs_for()):
        found |= meet(cp.DEPTH)
    assert (found & (agree.sum(axis=1) >= cp.AGREE)).mean() >= cp.RECALL


def test_large_nodes_are_split_and_blocked(spark, monkeypatch):
    monkeypatch.setattr(cp, "SMALL", 8)
    monkeypatch.setattr(cp, "BLOCK", 16)
    rows = corpus(2, clusters=12, hot=60)
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert cp.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minima_estimate_similarity_and_products_count():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    assert abs((cp.minima(a) == cp.minima(b)).mean() - 900 / 1100) < 0.2
    sets = [np.unique(rng.integers(0, 300, 100).astype(np.uint64)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    want = [len(set(sets[x].tolist()) & set(sets[y].tolist())) for x, y in zip(i, j)]
    assert cp._common(sets, i, j).tolist() == want == cp._common(sets, i[:400], j[:400]).tolist() + [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(i[400:], j[400:])]


def test_exact_way_misses_nothing(spark, monkeypatch):
    """All pairs in blocks equal brute force, also those whose minima agree too seldom for any path."""
    monkeypatch.setattr(cp, "BLOCK", 16)
    rows = corpus(5, clusters=12, hot=40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in cp.join(df, exact=True).collect()) == brute(rows)
    monkeypatch.setattr(cp, "AGREE", 49)  # no path can find a pair now
    assert sorted(tuple(r) for r in cp.join(df, exact=True).collect()) == brute(rows)
    assert cp.join(df.limit(1), exact=True).count() == 1 and cp.join(df.limit(0), exact=True).count() == 0


def test_recall_on_a_larger_table(spark):
    """Against the exact way on a table with several hundred classes: links found, and documents in other classes."""
    rows = corpus(9, clusters=400, hot=300)
    df = spark.createDataFrame(rows, "doc_id long, text string").where("doc_id IS NOT NULL")
    found = {(r.doc_id, i): (r.class_id, r.n_links) for i, r in enumerate(sorted(cp.join(df).collect()))}
    exact = {(r.doc_id, i): (r.class_id, r.n_links) for i, r in enumerate(sorted(cp.join(df, exact=True).collect()))}
    assert sum(n for _, n in found.values()) >= 0.998 * sum(n for _, n in exact.values()) > 0
