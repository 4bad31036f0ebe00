"""Gates of the name comparison on labelled pairs, and the hashes of the audit chain."""

import base64
import hashlib
import hmac
import json

import pytest

from casemill.functions import names
from casemill.operators import audit
from casemill.operators.evaluation import PAIRS, eval_name_fairness


@pytest.mark.parametrize("pair", PAIRS, ids=lambda p: f"{p[1]} / {p[2]}")
def test_outcome_of_each_pair(pair):
    _, a, b, same, wanted = pair
    verdict = names.match(a, b)[1]
    match = verdict in ("SAME", "LIKELY_SAME")
    got = "referred" if verdict == "AMBIGUOUS" else "unscored" if same is None else "correct" if same == match else "false_match" if match else "false_non_match"
    assert got == wanted, names.match(a, b)


def test_gates(spark):
    rows = {r.community: r for r in eval_name_fairness(spark, "").collect()}
    assert rows["All"].false_matches == 0 and rows["All"].referral_rate <= 0.25
    groups = [r for k, r in rows.items() if k != "All"]
    assert all(r.accuracy >= 0.9 for r in groups) and max(r.accuracy for r in groups) - min(r.accuracy for r in groups) <= 0.1


def test_hashes_of_the_chain(spark):
    rows = [(1, "officer:1", "view", '{"k": 1}', 7), (2, "officer:2", "edit", None, 7), (5, "officer:1", 'say "é"', "x", 7), (3, "officer:9", "view", "", 8)]
    log = spark.createDataFrame(rows, "audit_id long, actor string, action string, after_json string, case_id long")
    got = {r.audit_id: (r.prev_hash, r.hash) for r in audit.seal(log, "case_id").collect()}
    for chain in (7, 8):
        before = "genesis"
        for audit_id, actor, action, after, _ in [r for r in rows if r[4] == chain]:
            text = f"{before}\n" + json.dumps([audit_id, actor, action, after], ensure_ascii=False, separators=(",", ":"))
            digest = base64.urlsafe_b64encode(hmac.new(audit.KEY, text.encode(), hashlib.sha256).digest()).decode().rstrip("=")
            assert got[audit_id] == (before, digest)
            before = digest
