"""Operator 11: runs against all periods tried one by one, texts and digests against a plain version of the contract."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.llm import periodic_runs


def brute(words):
    """Every period, every stretch of equal words at that distance; of stretches with the same ends the least period."""
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def texts():
    rng = random.Random(11)
    out = [[], [0] * 23, [0] * 24, [0] * 1000, [0, 1] * 12, [0, 1] * 11 + [0], list(range(8)) * 3, list(range(9)) * 2 + list(range(8)), [1] + list(range(2, 40)) * 5 + [1]]
    for n in (5, 30, 100, 400, 1500):
        for letters in (1, 2, 3, 50):
            x = [rng.randrange(letters) for _ in range(n)]
            for _ in range(3):
                at, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
                for i in range(at + p, min(n, at + rng.randint(3, 6) * p)):
                    x[i] = x[i - p]
            out.append(x)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    return [*out, fib[-1], ([0] * 30 + [1]) * 6, [5] * 40 + [6] * 40]


def test_runs_equal_brute_force():
    given = texts()
    assert periodic_runs.runs_of([np.array(x, np.int64) for x in given]) == [brute(x) for x in given]


def test_few_pairs_at_a_time_find_the_same(monkeypatch):
    given = texts()
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    assert periodic_runs.runs_of([np.array(x, np.int64) for x in given]) == [brute(x) for x in given]


@pytest.mark.parametrize("n", [1, 31, 32, 33, 1000])
def test_minima(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 50, n).astype(np.int32)
    lo = rng.integers(0, n, 500)
    hi = np.array([rng.integers(a, n) for a in lo])
    assert periodic_runs.Minima(values).of(lo, hi).tolist() == [int(values[a : b + 1].min()) for a, b in zip(lo, hi)]


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_report_equals_a_plain_version(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \t\n"), (3, " \t\n"), (4, "wort " * 30 + "\x0b" + "é x " * 30), (5, "a b c d e f g h\n" * 3), (-6, "x y " * 40), (7, "long text with words " * 3000)]
    rows += [(i, " ".join(rng.choice(["ka", " ", "ti", "mo" + str(i % 3)]) for _ in range(rng.randint(0, 120)))) for i in range(10, 150)]
    rows += [(i, "\n".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 300)))) for i in range(200, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("best", F.lit(1))
    got = sorted(tuple(r) for r in periodic_runs.report(df).collect())
    want = sorted(plain(*r) for r in rows)
    assert [str(x) for x in got] == [str(x) for x in want]
    assert sum(r[1] > 0 for r in want) >= 20 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in rows)
    assert periodic_runs.report(df.limit(0)).count() == 0
    assert periodic_runs.report(spark.createDataFrame([(None, "x " * 30)], "doc_id long, text string")).first().n_runs == 1


def test_find_keeps_columns_and_texts(spark):
    df = spark.createDataFrame([("k", "a b c d e f g h " * 4 + "end", 1.5)], "name string, text string, collapsed double")
    row = periodic_runs.find(df, runs="spans", collapsed="short").first()
    assert (row["name"], row.collapsed, row.short, [tuple(x) for x in row.spans]) == ("k", 1.5, "a b c d e f g h end", [(0, 32, 8)])


def test_very_long_texts():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 20_000, 400_000)
    text[1000:301_000] = np.resize(text[1000:76_000], 300_000)
    one = np.zeros(200_000, np.int64)
    found = periodic_runs.runs_of([text, one])
    assert found[1] == [(0, 200_000, 1)] and [r[2] for r in found[0]] == [75_000] and found[0][0][0] <= 1000 and found[0][0][1] >= 300_000
