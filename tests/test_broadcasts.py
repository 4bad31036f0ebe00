"""Rows made by exploding, as replies and their readings, are never sent round whole: Spark guesses their size from the source's columns, far too low."""

import os

import pytest

from casemill.operators import extraction, readings, scoring, screen
from casemill.operators.casefile import screened
from casemill.operators.rescreen import DECISION, carried
from casemill.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def sent_round(df):
    """Names of the nodes below each broadcast of a plan."""

    def below(p):
        of = p.children()
        return [p.nodeName()] + [n for i in range(of.size()) for n in below(of.apply(i))]

    def walk(p):
        of = p.children()
        own = [below(p)] if p.nodeName() == "BroadcastExchange" else []
        return own + [x for i in range(of.size()) for x in walk(of.apply(i))]

    return walk(df._jdf.queryExecution().executedPlan().initialPlan())


MADE = {
    "outcomes": extraction._read, "typed": extraction._typed, "scored": scoring._scored,
    **{n: catalog.QUERIES[n] for n in ("rule_image_outcome", "rule_normalise_extraction", "rule_merge_images", "rule_wire_typed", "rule_case_documents", "eval_classification", "eval_report", "eval_errors", "join_name_refs", "join_truth_extracted", "json_reply_checked")},
}


@pytest.mark.parametrize("name", MADE)
def test_no_replies_are_broadcast(spark, name):
    assert not [nodes for nodes in sent_round(MADE[name](spark, SF)) if "Generate" in nodes]


def test_findings_are_not_broadcast(spark):
    rows = catalog.QUERIES["screen_flags"](spark, SF).selectExpr("case_id", "explode(array(1L, 2L)) AS place", "code", "severity", "action", "CAST(NULL AS STRING) AS reason", "array(named_struct('document', 'form', 'field', 'name')) AS evidence")
    before = rows.selectExpr("case_id", "place", "code AS flag_key", *[f"CAST(NULL AS STRING) AS {c}" for c in DECISION])
    assert not [nodes for nodes in sent_round(carried(rows, before).select("case_id", "flag_key", "resolution")) if "Generate" in nodes]


def test_screening_of_replies_reads_them_once(spark):
    of = readings.cases(spark, SF), readings.images(spark, SF), readings.calls(spark, SF)
    text = screened(*of, extraction.RULES).select("case_id", "processing")._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in text and "o_orderkey" not in text  # the screened table alone, which holds the state of the images


def test_a_reply_is_parsed_once(spark):
    text = extraction._read(spark, SF).where("outcome = 'extracted'")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in text.splitlines() if line.lstrip(" +-:").startswith("Filter")]
    assert filters and not any("from_json" in line for line in filters)


@pytest.mark.parametrize("name", ["screen_flags", "screen_stored_flags", "eval_status"])
def test_persons_and_duplicates_are_not_broadcast(spark, monkeypatch, name):
    made, write = [], screen.materialize
    monkeypatch.setattr(screen, "materialize", lambda df, what: made.append(df) or write(df, what))
    made.append(catalog.QUERIES[name](spark, SF))
    assert len(made) == 4 and not any(map(sent_round, made))


def test_joins_of_eval_status_stay_shuffles_as_they_run(spark, monkeypatch):
    """On tables this small Spark would send round every side, once it has seen its size, that isn't held to a shuffle."""
    ran, write = [], screen.materialize

    def run(df):
        df.collect()
        ran.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(screen, "materialize", lambda df, what: write(run(df), what))
    run(catalog.QUERIES["eval_status"](spark, SF))
    assert len(ran) == 4 and all("isFinalPlan=true" in plan for plan in ran)
    assert not [line for plan in ran for line in plan.splitlines() if "Broadcast" in line]
