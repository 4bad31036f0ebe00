"""Bucketed tables: lookups open few folders, changes rewrite few files; the cache of replies; screening anew only what changed."""

import glob
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from casemill.operators.rescreen import Screening, blocking
from casemill.operators.screen import typed_schema
from casemill.sources.buckets import Bucketed, ReplyCache, cache_key
from tests.test_screen import RULES, case


def stamps(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def folders(files):
    return {f.split("bucket=")[1].split("/")[0] for f in files}


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    t = Bucketed(spark, f"{tmp_path}/t", "k string, v long", "k", 16)
    t.upsert(spark.range(400).select(F.concat(F.lit("key"), "id").alias("k"), F.col("id").alias("v")))
    return t


def test_a_lookup_of_ten_keys_reads_their_folders_alone(spark, table):
    keys = [f"key{i}" for i in range(10)] + ["absent"]
    found = table.lookup(keys)
    assert rows_of(found) == [(f"key{i}", i) for i in range(10)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket), ", "") or "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    one = table.lookup(["key3"])
    files = [m for m in one.select(F.input_file_name()).distinct().collect()]
    assert len(files) == 1 and table.lookup([]).count() == 0


def test_a_change_rewrites_the_buckets_it_touches(spark, table):
    before = stamps(table.path)
    removed = table.rewrite(spark.createDataFrame([("key7",), ("absent",)], "k string"), spark.createDataFrame([("new", -1)], "k string, v long"))
    after = stamps(table.path)
    assert rows_of(removed) == [("key7", 7)]
    changed = folders(set(after) - set(before))
    assert 1 <= len(changed) <= 3 and len(folders(before)) == 16
    assert {f: s for f, s in before.items() if f.split("bucket=")[1].split("/")[0] not in changed}.items() <= after.items()
    assert table.read().count() == 400 and rows_of(table.lookup(["new", "key7"])) == [("new", -1)]
    table.upsert(spark.createDataFrame([("key1", 100)], "k string, v long"))
    assert rows_of(table.lookup(["key1"])) == [("key1", 100)] and table.read().count() == 400


def test_a_table_emptied_is_empty(spark, table):
    table.rewrite(table.read().select("k"), spark.createDataFrame([], "k string, v long"))
    assert table.read().count() == 0
    assert Bucketed(spark, f"{table.path}-none", "k string, v long", "k").read().count() == 0


def reply(sha, model, result, hour=1, stage="extract"):
    return (sha, stage, model, "v1", result, 10, 5, 100, datetime(2024, 1, 1, hour))


REPLY = "sha string, stage string, model string, prompt string, result string, input_tokens long, output_tokens long, latency_ms long, at timestamp"
WANTED = "sha string, stage string, model string, prompt string"


def test_cache_serves_records_and_purges(spark, tmp_path):
    cache = ReplyCache(spark, f"{tmp_path}/cache", 8)
    wanted = spark.createDataFrame([("a", "extract", "m1", "v1"), ("a", "extract", "m1", "v2"), ("b", "extract", "m1", "v1")], WANTED)
    assert [r.outcome for r in cache.serve(wanted).collect()] == ["call"] * 3
    cache.record(spark.createDataFrame([reply("a", "m1", "old"), reply("a", "m1", "new", 2), reply("a", "m2", "other"), reply("b", "m1", "b1"), reply("a", "m1", "kind", stage="classify")], REPLY))
    cache.record(spark.createDataFrame([reply("a", "m1", "too late", 0)], REPLY))
    served = {(r.sha, r.prompt): (r.outcome, r.recorded and r.recorded.result) for r in cache.serve(wanted).collect()}
    assert served == {("a", "v1"): ("hit", "new"), ("a", "v2"): ("call", None), ("b", "v1"): ("hit", "b1")}
    assert sorted(r.outcome for r in cache.serve(wanted, "cache_only").collect()) == ["failed", "hit", "hit"]
    live = cache.serve(wanted, "live").collect()
    assert {r.outcome for r in live} == {"call"} and sum(r.recorded is not None for r in live) == 2
    gone = cache.purge(spark.createDataFrame([("a",), ("zzz",)], "sha string"), "m1")
    wanted_keys = spark.createDataFrame([("extract",), ("classify",)], "s string").select(cache_key(F.col("s"), F.lit("a"), F.lit("m1"), F.lit("v1")))
    assert rows_of(gone) == rows_of(wanted_keys)
    assert sorted((r.sha, r.model, r.result) for r in cache.table.read().collect()) == [("a", "m2", "other"), ("b", "m1", "b1")]


def typed(spark, *cases):
    return spark.createDataFrame(list(cases), typed_schema())


def own(i, **how):
    change = {("card", "masked"): f"XXXX XXXX {5000 + i}", ("card", "last4"): str(5000 + i), ("form", "last4"): str(5000 + i)} | how.pop("change", {})
    return case(f"c{i}", change=change, **how)


def test_only_what_changed_is_screened_anew(spark, tmp_path):
    s = Screening(spark, f"{tmp_path}/s", buckets=8)
    first = [own(i, change={("form", "address"): None}) for i in range(20)] + [own(20)]
    got = {r.case_id: (r.status_before, r.status) for r in s.update(typed(spark, *first), RULES, "2024-03-01 10:00:00").collect()}
    assert len(got) == 21 and got["c3"] == (None, "NEEDS_CITIZEN_CORRECTION") and got["c20"] == (None, "READY")
    before = stamps(f"{tmp_path}/s/findings") | stamps(f"{tmp_path}/s/states")
    assert s.update(typed(spark, *first), RULES, "2024-03-02 10:00:00").count() == 0  # nothing was read otherwise
    assert stamps(f"{tmp_path}/s/findings") | stamps(f"{tmp_path}/s/states") == before

    key = "MISSING_FIELD|form.address"
    decide = lambda *rows: s.decide(spark.createDataFrame(list(rows), "case_id string, flag_key string, verdict string, officer string, at timestamp, reason string"))
    decided = decide(("c3", key, "OVERRIDDEN", "o1", datetime(2024, 3, 3), "seen on the card"), ("c4", key, "ACCEPTED", "o1", datetime(2024, 3, 3), None), ("c5", key, "OVERRIDDEN", "o2", datetime(2024, 3, 3), " "), ("c6", "X|y", "ACCEPTED", "o2", datetime(2024, 3, 3), None))
    assert {r.case_id: r.outcome for r in decided.collect()} == {"c3": "done", "c4": "done", "c5": "an override needs a reason", "c6": "no such finding"}
    log = {r.entity_id: (r.actor, r.action, r.before_json) for r in s.audit(decided).collect()}
    assert log == {f"c3|{key}": ("officer:o1", "FLAG_OVERRIDDEN", '{"resolution":"OPEN"}'), f"c4|{key}": ("officer:o1", "FLAG_ACCEPTED", '{"resolution":"OPEN"}')}
    states = {r.case_id: r.status for r in s.states.read().collect()}
    assert (states["c3"], states["c4"], states["c5"]) == ("READY", "NEEDS_CITIZEN_CORRECTION", "NEEDS_CITIZEN_CORRECTION")
    assert {r.case_id for r in blocking(s.findings.read()).collect()} == {f"c{i}" for i in range(20)} - {"c3"}

    before = stamps(f"{tmp_path}/s/findings")
    second = [*first[:3], own(3, change={("form", "address"): None, ("passbook", "account"): "9"}), own(4), *first[5:]]
    got = {r.case_id: (r.status_before, r.status) for r in s.update(typed(spark, *second), RULES, "2024-03-05 10:00:00").collect()}
    assert got == {"c3": ("READY", "NEEDS_CITIZEN_CORRECTION"), "c4": ("NEEDS_CITIZEN_CORRECTION", "READY")}
    found = {(r.flag_key, r.resolution, r.resolved_by) for r in s.findings.lookup(["c3"]).collect()}
    assert found == {(key, "OVERRIDDEN", "o1"), ("BANK_DETAILS_MISMATCH|form.account,passbook.account", "OPEN", None)}  # by code and fields
    assert s.findings.lookup(["c4"]).count() == 0
    after = stamps(f"{tmp_path}/s/findings")
    assert len(folders(set(after) - set(before))) <= 2
    row = s.states.lookup(["c3"]).first()
    assert (row.first_status, row.screened_at) == ("NEEDS_CITIZEN_CORRECTION", datetime(2024, 3, 1, 10))


def test_new_cases_meet_stored_ones_and_approved_ones_stay(spark, tmp_path):
    s = Screening(spark, f"{tmp_path}/s", buckets=4)
    s.update(typed(spark, own(1), own(2)), RULES, "2024-03-01 10:00:00")
    s.states.upsert(s.states.lookup(["c2"]).withColumn("status", F.lit("APPROVED")))
    twin = own(1)
    got = {r.case_id: r.status for r in s.update(typed(spark, {**twin, "case_id": "twin"}, own(2, change={("form", "address"): None})), RULES, "2024-03-02 10:00:00").collect()}
    assert got == {"twin": "OFFICER_ATTENTION", "c2": "APPROVED"}
    found = {(r.case_id, r.code) for r in s.findings.read().collect()}
    assert found == {("twin", "DUPLICATE_SUSPECTED"), ("c2", "MISSING_FIELD")}
    assert s.decide(spark.createDataFrame([("c2", "MISSING_FIELD|form.address", "ACCEPTED", "o", datetime(2024, 3, 3), None)], "case_id string, flag_key string, verdict string, officer string, at timestamp, reason string")).first().outcome == "the case is approved"
