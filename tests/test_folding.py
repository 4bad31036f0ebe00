"""Foldings: a hot key in constant memory, several batches, restart from the checkpoint, states that are forgotten, replay, and text for subscribers."""

import glob
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casemill.operators.joins import latest
from casemill.streaming.events import as_sse, bus, document_progress, replays, settle, write_sse
from casemill.streaming.folding import Folding, fold_batches
from casemill.streaming.stateful import lockout, rate_limit


def files(spark, path, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_a_key_with_all_events_takes_constant_memory(spark):
    """A million events of one key, made as they are read: neither they nor what is emitted are held."""
    stream = spark.createDataFrame([], "key long, id long, at double, ok boolean")
    f = lockout(stream, 3, 60)

    def batches(n):
        for k in range(n):
            ids = list(range(k * 1000, k * 1000 + 1000))
            yield pa.RecordBatch.from_pydict({"key": [7] * 1000, "id": ids, "at": [float(i) for i in ids], "ok": [i % 5 > 2 for i in ids], "__state": pa.nulls(1000, pa.struct([("run", pa.int64())])), "__new": [True] * 1000})

    def peak(n):
        tracemalloc.start()
        rows = sum(b.num_rows for b in fold_batches(batches(n), f._schema(), f.key, f.start, f.step))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, top

    few, many = peak(20), peak(200)
    assert few[0] == 20_001 and many[0] == 200_001 and many[1] < 1.5 * few[1] < 60e6




def add(state, row):
    return (state[0] + row["x"], [*state[1], row["at"]][-3:]), [(row["at"], state[0])] if row["x"] % 2 else []


def adding(stream, forget=None):
    return Folding(stream, "key", ("at",), (0, []), add, "total long, last array<long>", "at long, before long", forget)


ROWS = [(random.Random(i).randint(1, 5), i, i * 7 % 11) for i in range(200)]


def want(rows):
    states, emitted = {}, []
    for key, at, x in sorted(rows, key=lambda r: r[1]):
        state, out = add(states.get(key, (0, [])), {"x": x, "at": at})
        states[key] = state
        emitted += [(key, *e) for e in out]
    return states, sorted(emitted)


def test_batches_and_restart_give_what_one_run_gives(spark, tmp_path):
    parts = [ROWS[:70], ROWS[70:80], ROWS[80:]]
    schema = "key long, at long, x long"
    whole = adding(files(spark, tmp_path / "a", [[*ROWS, (None, 1, 1)]], schema)).run("one")
    again = adding(files(spark, tmp_path / "b", parts[:2], schema))
    again.run("two", f"{tmp_path}/b/offsets", f"{tmp_path}/b/out")
    again = adding(files(spark, tmp_path / "b", parts[2:], schema)).run("two", f"{tmp_path}/b/offsets", f"{tmp_path}/b/out")
    for states, emitted in (whole, again):
        assert {r.key: (r.total, r["last"]) for r in latest(states, ["key"], ["batch"]).collect()} == want(ROWS)[0]
        assert sorted((r.key, r["at"], r.before) for r in emitted.collect()) == want(ROWS)[1]
    assert again[1].select("batch").distinct().count() == 3


def test_states_are_forgotten(spark, tmp_path):
    parts = [[(1, 0, 2), (2, 5, 2)], [(2, 50, 2)], [(1, 60, 2), (2, 60, 2)]]
    f = adding(files(spark, tmp_path, parts, "key long, at long, x long"), "state.last[size(state.last) - 1] < {latest} - 10")
    states = {(r.key, r.batch): r.total for r in f.run("short", f"{tmp_path}/o", f"{tmp_path}/out")[0].collect()}
    assert states == {(1, 0): 2, (2, 0): 2, (2, 1): 4, (1, 2): 2, (2, 2): 6}
    heads = spark.read.parquet(f"{tmp_path}/out/heads-1")
    assert [r.key for r in heads.collect()] == [2]


def test_limits_give_a_verdict_for_each_event_and_forget_windows(spark, tmp_path):
    rows = [(1, i, float(i * 10), True) for i in range(12)] + [(2, 100, 5.0, True)]
    s = files(spark, tmp_path, [rows[:6], rows[6:]], "key long, id long, at double, ok boolean")
    f = rate_limit(s, 2, 35, forget=True)
    verdicts = {r.id: (r.remaining, r.refused) for r in f.run("v", f"{tmp_path}/o", f"{tmp_path}/out")[1].collect()}
    assert [verdicts[i] for i in range(12)] == [(1, False), (0, False), (0, True), (0, True)] * 3 and verdicts[100] == (1, False)
    assert [r.key for r in spark.read.parquet(f"{tmp_path}/out/heads-1").collect()] == [1]


def plain_bus(rows, most):
    ring, since, out = {}, {}, []
    for topic, case, event, registers in sorted(rows, key=lambda r: r[2]):
        if case in since:
            out.append((case, event, False))
        elif registers:
            since[case] = event
            out += [(case, e, True) for c, e in ring.get(topic, [])[-most:] if c == case]
        ring.setdefault(topic, []).append((case, event))
    return sorted(out)


@pytest.mark.parametrize("most", [1, 5, 500])
def test_late_registration_gets_what_it_missed(spark, tmp_path, most):
    rng = random.Random(most)
    rows = [(c % 3, c, i, rng.random() < 0.08) for i in range(240) for c in [rng.randint(1, 9)]]
    s = files(spark, tmp_path, [rows[:90], rows[90:100], rows[100:]], "topic long, case_id long, event_id long, registers boolean")
    got = sorted(tuple(r) for r in bus(s, most).collect())
    assert got == plain_bus(rows, most) and any(r[2] for r in got)
    rings = replays(s, most).run("r")[0]
    assert rings.where(F.size("ring") > most).count() == 0


def test_documents_have_states_of_their_own(spark, tmp_path):
    rows = [(1, "a", 1, "classifying", None, None, None), (1, "b", 2, "extracting", "epic", True, None), (1, "a", 3, "failed", "form", None, "no answer"), (1, None, 4, "done", None, None, None), (1, "b", 5, "extracted", None, None, None), (None, "z", 6, "x", None, None, None)]
    s = files(spark, tmp_path, [rows[:3], rows[3:]], "case_id long, document_id string, event_id long, stage string, kind string, cache_hit boolean, message string")
    got = {r.document.document_id: (r.stage, r.kind, r.cache_hit, r.message, r.applied) for r in latest(settle(document_progress(s), "update", "d"), ["document"], ["batch"]).collect()}
    assert got == {"a": ("failed", "form", False, "no answer", 2), "b": ("extracted", "epic", True, None, 2)}


def test_one_message_an_event_and_none_twice_after_a_restart(spark, tmp_path):
    schema = "event_id long, text string"
    for part in ([(1, "a"), (2, 'b "q"')], [(3, None)]):
        write_sse(files(spark, tmp_path, [part], schema), f"{tmp_path}/out", f"{tmp_path}/offsets")
    assert len(glob.glob(f"{tmp_path}/out/batch=*")) == 2
    messages = spark.read.text(f"{tmp_path}/out", wholetext=True, recursiveFileLookup=True).collect()
    text = "".join(r.value for r in messages)
    assert sorted(m for m in text.split("\n\n") if m) == ['id: 1\ndata: {"event_id":1,"text":"a"}', 'id: 2\ndata: {"event_id":2,"text":"b \\"q\\""}', 'id: 3\ndata: {"event_id":3}']
    assert spark.range(1).select(as_sse(F.struct(F.col("id").alias("event_id")))).first()[0] == 'id: 0\ndata: {"event_id":0}\n'
