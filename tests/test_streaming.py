"""Stateful streams against plain loops, over several batches."""

import random

import pytest
from pyspark.sql import functions as F

from casemill.operators.audit import seal, verify
from casemill.operators.joins import latest
from casemill.streaming.events import settle
from casemill.streaming.stateful import lockout, rate_limit, seal_stream


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(rng.randint(1, 4), i, float(i * 3 + rng.randint(0, 2)), rng.random() < 0.3) for i in range(300)]


def stream(spark, path, rows, schema):
    """The rows as a stream of three files, one a batch."""
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_rate_limit(spark, rows, tmp_path):
    s = stream(spark, tmp_path, rows, "key long, id long, at double, ok boolean")
    got = {r.key: (r.total, r.refused) for r in latest(settle(rate_limit(s, 2, 40), "update", "rate"), ["key"], ["batch"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        start = n = refused = total = 0
        for at in [r[2] for r in rows if r[0] == key]:
            if n == 0 or at - start >= 40:
                start, n = at, 0
            n, total = n + 1, total + 1
            refused += n > 2
        want[key] = (total, refused)
    assert got == want and any(r for _, r in want.values())


def test_lockout(spark, rows, tmp_path):
    s = stream(spark, tmp_path, rows, "key long, id long, at double, ok boolean")
    got = {r.key: (r.locks, r.turned_away) for r in latest(settle(lockout(s, 3, 60), "update", "lock"), ["key"], ["batch"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        run, until, locks, turned = 0, -1, 0, 0
        for at, ok in [(r[2], r[3]) for r in rows if r[0] == key]:
            if at < until:
                turned += 1
            elif ok:
                run = 0
            else:
                run += 1
                if run == 3:
                    run, until, locks = 0, at + 60, locks + 1
        want[key] = (locks, turned)
    assert got == want and any(n for n, _ in want.values())


def test_sealing_in_batches_equals_sealing_at_once(spark, tmp_path):
    log = [(i % 5, i, f"officer:{i % 3}", "note", None if i % 4 else '{"k": 1}') for i in range(1, 91)]
    schema = "case_id long, audit_id long, actor string, action string, after_json string"
    once = {(r.case_id, r.audit_id): (r.prev_hash, r.hash) for r in seal(spark.createDataFrame(log, schema), "case_id").collect()}
    bits = seal_stream(stream(spark, tmp_path, log, schema), "case_id")
    assert {(r.case_id, r.audit_id): (r.prev_hash, r.hash) for r in bits.collect()} == once and len(once) == 90
    now = spark.createDataFrame(log, schema).where("audit_id <> 50").withColumn("action", F.when(F.col("audit_id") == 20, "edited").otherwise(F.col("action")))
    assert sorted((r.audit_id, r.problem) for r in verify(now, bits, "case_id").collect()) == [(20, "modified"), (50, "deleted")]
