"""Shared helpers: bounded samples, tables that don't stay, no local folder on a cluster."""

import os
from types import SimpleNamespace

import pytest

from casemill.llm import chosen_path, common, decision_list, fair_mix, hilbert, toxicity
from casemill.sources import shared


def test_only_what_a_plan_reads_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    words = "one two three four five six seven eight nine ten".split()
    docs = spark.createDataFrame([(i, " ".join(words[i % 3 :]) + f" {i // 3}", "en", f"s{i % 2}") for i in range(60)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    for run, keeps in (
        (lambda: chosen_path.join(docs), {"sketches", "classes"}),
        (lambda: hilbert.report(docs), {"hilbert-order"}),
        (lambda: fair_mix.report(docs), {"mix-queue"}),
        (lambda: decision_list.report(docs, labels), set()),
        (lambda: toxicity.report(docs, labels), set()),
    ):
        before = {x for x in os.listdir(tmp_path)}
        out = run()
        assert {x.rsplit("-", 1)[0] for x in set(os.listdir(tmp_path)) - before} == keeps
        assert out.count() == 60


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: None),
        sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda *_: None)),
    )
    with pytest.raises(RuntimeError):
        common.shared_dir(session)


def test_a_labelled_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(1, "text 0")] * 50 + [(2, "b"), (3, None), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    all_ = common.labelled_sample(docs, labels, "quality", "doc_id", "text", 10_000).collect()
    assert len(all_) == 503 and sorted((r.text or "", r.quality) for r in all_ if r.doc_id != 1) == [("", 1), ("b", 0), ("b", 1)]
    some = common.labelled_sample(docs, labels, "quality", "doc_id", "text", 100).collect()
    assert len(some) == 100 and {tuple(r) for r in some} <= {tuple(r) for r in all_}
