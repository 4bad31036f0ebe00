"""Operator 2: the curve's defining property and a brute-force placement."""

import zlib
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from casemill.llm import hilbert


def walk(cell, bits):
    digits, states = hilbert.curve_tables(len(cell))
    h = s = 0
    for level in range(bits - 1, -1, -1):
        at = s * (1 << len(cell)) + sum((c >> level & 1) << k for k, c in enumerate(cell))
        h, s = h * (1 << len(cell)) + digits[at], states[at]
    return h


def test_neighbours_on_the_curve_are_neighbours_in_space(spark):
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = sorted(product(range(1 << bits), repeat=dims), key=lambda c: walk(c, bits))
        assert [walk(c, bits) for c in cells] == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(cells, cells[1:]))
    df = spark.createDataFrame(list(product(range(8), repeat=3)), "a int, b int, c int")
    assert all(r.h == walk((r.a, r.b, r.c), 3) for r in df.withColumn("h", hilbert.hilbert_index([F.col(x) for x in "abc"], 3)).collect())


def brute(rows, n):
    def cells(k):
        values = sorted((r[k] for r in rows), key=lambda v: (v is not None, (v or "").encode()))
        return {v: values.index(v) * 64 // len(rows) for v in set(values)}

    lang, source, out = cells(1), cells(2), []
    for doc, g, s, text in rows:
        size, crc = len((text or "").encode()) + 1, zlib.crc32((text or "").encode())
        b = bin(size)[2:]
        out.append((walk((lang[g], source[s], min(63, 2 * len(b) + (b[1:2] == "1"))), 6), crc, doc, size))
    out.sort()
    first = {s: -(-s * len(out) // n) for s in range(n)}
    return [(d, size, crc, i * n // len(out), i - first[i * n // len(out)], h) for i, (h, crc, d, size) in enumerate(out)]


def test_placement_equals_brute_force(spark, tmp_path):
    rows = [(i, [None, "en", "de", "fr"][i % 4 * (i % 3 > 0)], None if i % 11 == 0 else f"s{i * i % 7}", None if i % 13 == 0 else "é" * (i % 5) + "x" * (i * 37 % 500)) for i in range(203)] + [(7, "en", "s0", "same")] * 3
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").withColumn("shard", F.lit("clash"))
    got = hilbert.report(df)
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.hilbert) for r in got.collect()) == sorted(brute(rows, 8))
    counts = Counter(r.shard for r in got.collect())
    assert max(counts.values()) - min(counts.values()) <= 1
    assert hilbert.report(df.limit(0)).count() == 0 and hilbert.report(df.limit(1)).first().shard == 0
    hilbert.write_shards(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_very_long_text(spark):
    df = spark.createDataFrame([(i, "ä" * 2_000_000 if i == 3 else "x", "en", "s") for i in range(16)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in hilbert.report(df).collect()}
    assert got[3]["size"] == 4_000_001 and sorted(r.shard for r in got.values()) == sorted(list(range(8)) * 2)
