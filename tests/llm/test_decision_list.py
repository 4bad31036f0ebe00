"""Operator 6: counts against brute force, rules against held-out labels."""

import random

import numpy as np

from casemill.llm import decision_list as q


def brute_repeat(words):
    w = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, x in enumerate(w):
        if w.count(x) > 1:
            hit.update(range(i, i + 8))
    return len(hit)


def test_counts_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 60))] + [str(i) for i in range(rng.randint(0, 20))] * rng.randint(0, 2)
        assert q.repeat_words(words) == brute_repeat(words)
    text = "a|b  c\n\n \na|b  c\nd é#\td é#\nx\n"
    n_words, chars, symbols, dup, rep, *_ = q.counts_of(text)
    assert (n_words, chars, symbols, dup, rep) == (9, 15, 4, 1, 0)
    assert q.counts_of(None) == q.counts_of("") == (0,) * 8
    assert q.counts_of(" \x1c x")[0] == 2  # only ASCII white space separates


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.2
        words = ["w%d" % rng.randint(0, 999) for _ in range(rng.randint(25, 90))]
        text = " ".join(w + rng.choice("#$%") * (1 + rng.randint(0, 2)) for w in words) if bad else " ".join(words)
        out.append((i, text, int(not bad)))
    return out


def test_rules_find_low_quality_and_keep_the_rest(spark):
    data = rows(900, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(5000, None, "y"), (5001, "", "y"), (5002, "few words", None)], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, g) for i, _, g in data if i % 3], "doc_id long, quality int")
    rules = q.train(docs, labels)
    assert len(rules) == 1 and rules[0].tests[0].name in ("symbol_rate", "word_length") and rules[0].misses == 0 and rules[0].hits > 20
    got = {r.doc_id: r for r in q.report(docs, labels).collect()}
    wrong = sum(got[i].kept != bool(g) for i, _, g in data if i % 3 == 0)
    assert wrong <= 3
    assert got[5000].base_failed and got[5001].base_failed and got[5002].base_failed and not got[5002].kept
    assert not [r for r in q.report(docs, labels.limit(0)).collect() if r.kept == r.base_failed]
    assert q.report(docs.limit(0), labels).count() == 0


def test_very_long_text_and_rules_as_expression(spark):
    text = "again and again the same eight words come " * 20_000
    row = q.report(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed) == (160_000, 160_000, True)
    rules = [q.Rule((q.Test("a", True, 0.5), q.Test("b", False, 0.2)), 1, 0), q.Rule((q.Test("b", True, 0.9),), 1, 0)]
    x = {"a": np.array([0.6, 0.6, 0.1, 0.5, 0.1]), "b": np.array([0.1, 0.3, 0.95, 0.2, 0.9])}
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x["a"], x["b"]))], "i int, a double, b double")
    kept = [r.k for r in df.select("i", q.expression(rules, {"a": q.F.col("a"), "b": q.F.col("b")}).alias("k")).orderBy("i").collect()]
    assert kept == [not any(r.rows(x)[i] for r in rules) for i in range(5)] == [False, True, False, True, True]


def test_learning_ignores_noise():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(2000), "b": rng.random(2000)}
    assert q.learn(x, rng.random(2000) < 0.1) == []
