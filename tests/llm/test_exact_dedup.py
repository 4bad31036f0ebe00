"""Operator 12: groups against a plain version, with nulls, ties, repeated rows, hashes that collide, and a group of most rows."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from casemill.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for plain, members in groups.items():
        best = min(members)[-1]
        out += [(rows[i][0], rows[best][0], len(members), i == best, hashlib.sha256(plain.encode()).hexdigest()) for *_, i in members]
    return sorted(map(str, out))


ROWS = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n"), (7, "x y"), (8, "x y"), (9, "ab"), (9, "ab"), (9, "a b\n"), (None, "ab  "), (None, None), (None, "only"), (10, "é" * 500_000 + " "), (11, "é" * 500_000), (12, "A B"), (0, "z\x1fz"), (13, "zz"), (14, "\x0bz\x0c\rz")]


@pytest.mark.parametrize("digest", [exact_dedup.md5, lambda t: F.substring(t, 1, 1), lambda t: F.lit("one")], ids=["md5", "first letter", "all collide"])
def test_equals_a_plain_version(spark, digest):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("keep_id", F.lit("clash")).withColumn("count", F.lit(0))
    got = exact_dedup.dedup(df.repartition(3), digest=digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(ROWS)


def test_a_group_of_most_rows_and_empty_tables(spark):
    rows = [(i, "same text" + " " * (i % 7)) for i in range(4000)] + [(i, f"own {i}") for i in range(4000, 5000)] + [(i, f"pair {i // 2}") for i in range(5000, 5500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in exact_dedup.dedup(df).collect()) == brute(rows)
    assert exact_dedup.dedup(df.limit(0)).count() == 0
    names = spark.createDataFrame([("b", "x"), ("a", " x")], "name string, body string")
    assert {tuple(r)[:4] for r in exact_dedup.dedup(names, "name", "body").collect()} == {("a", "a", 2, True), ("b", "a", 2, False)}


def test_more_shared_hashes_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_BROADCAST", 0)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for digest in (exact_dedup.md5, lambda t: F.substring(t, 1, 1)):
        assert sorted(str(tuple(r)) for r in exact_dedup.dedup(df, digest=digest).collect()) == brute(ROWS)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = exact_dedup.dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
