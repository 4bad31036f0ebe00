"""Operator 13: the trie against one built of plain tuples, with odd turns, hot prefixes, long conversations and tall chains."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from casemill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in by.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(list), {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = kids[path]
        leaves[path] = sum(leaves[k] for k in below) or 1
        saved[path] = sum(saved[k] for k in below) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
        if path:
            kids[path[:-1]].append(path)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


def rows_of(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def made(seed):
    """Few different turns, so that many prefixes are shared; null and tied turns, nulls, repeated rows."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-40, 200), 120):
        for t in range(rng.randint(1, 14)):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "user", "user", None]), rng.choice(["", "ja", "ja", "nein é", None])))
    return rows + rng.sample(rows, 30) + [(None, 1, "user", "lost"), (500, 0, None, None), (501, None, "a", "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_a_plain_trie(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("digest", F.lit(1))
    got = prefix_trie.report(df.repartition(3))
    assert rows_of(got) == brute(rebuilt(sequences(rows)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(spark, convs):
    rows = [(c, t, *x) for c, turns in convs.items() for t, x in enumerate(turns)]
    turns = prefix_trie.numbered(spark.createDataFrame(rows, SCHEMA))
    n = spark.createDataFrame([(c, len(t)) for c, t in convs.items()], "conv_id long, n_turns long")
    return prefix_trie.trie(turns, n)


def test_hot_prefixes_turnless_conversations_and_a_tall_tree(spark):
    say = lambda *x: [("user", t) for t in x]
    convs = {1000 + i: say("hello", "copy", "copy") for i in range(3000)}  # most conversations are one
    convs |= {5000 + i: say("hello", f"own {i}") for i in range(300)} | {6000 + i: [] for i in range(50)}
    convs |= {10_000 + k: say(*["step"] * (100 - k), f"turn off {k}") for k in range(90)}  # each chain hangs on the next shorter one's
    convs |= {20_000: say(*[f"long {i}" for i in range(3000)]), 20_001: say(*[f"long {i}" for i in range(2500)], "else")}
    assert rows_of(plain(spark, convs)) == brute(convs)


def test_ends_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 10)
    convs = {i: [("a", "x")] * (i % 2) for i in range(-5, 300)}
    assert rows_of(plain(spark, convs)) == brute(convs)


def test_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.report(none).count() == 0
    rows = [(5, 0, "u", "é" * 300_000 + "a"), (10, 0, "u", "é" * 300_000 + "b"), (10, 1, "u", "x")]
    assert rows_of(prefix_trie.report(spark.createDataFrame(rows, SCHEMA))) == brute(rebuilt(sequences(rows)))
