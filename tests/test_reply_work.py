"""What is done for a reply: made, parsed and masked once, by compiled expressions, and only what a result needs of it."""

import json
import os

import pytest
from pyspark.sql import functions as F

from casemill.operators.casefile import REPLY_FIELDS, answered, merged, outcomes
from casemill.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
there = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def lines(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


@there
def test_merging_images_reads_the_fields_it_merges_alone(spark):
    plan = lines(catalog.QUERIES["rule_merge_images"](spark, SF))
    assert not [x for x in plan if "Generate" in x and "to_json" in x]  # replies are not made inside an array that is taken apart, which Spark interprets
    assert not [x for x in plan if "transform_values" in x]  # no lambda over all fields
    parses = [x for x in plan if "from_json" in x]
    assert len(parses) == 1 and "regexp_extract" not in parses[0]
    assert [x for x in plan if "Filter" in x and "application_form" in x]  # no other kind's reply is parsed


def test_replies_with_odd_fields(spark):
    field = lambda **k: {"value": "v", "status": "present", "confidence": "high", "bbox": []} | k
    whole = {f: field() for f in REPLY_FIELDS["epic"]}
    text = lambda **k: json.dumps({"legibility": "good", "notes": "n", "fields": whole | k})
    twice = text().replace('"fields": {', '"fields": {"name": {"value": "w", "status": "present", "confidence": "low"}, ')
    replies = {
        "see: " + text() + " } and {": None, text(bbox_less=field()): "not asked for: bbox_less", text(name=field(value=None)): "a value is null", text(name=None): "unknown status", twice: None,
        text(name=field(confidence=None)): "unknown certainty", text(name=field(bbox="nowhere")): None, text()[:-2]: "no object", "[1]": "no object", "": "no object", text(b=field(), a=field()): "not asked for: a,b",
    }
    images = spark.createDataFrame([("c", str(i), i, True, "epic") for i in range(len(replies))], "case_id string, document_id string, position int, opened boolean, detected string")
    calls = spark.createDataFrame([(str(i), "extract", 1, "OK", None, r) for i, r in enumerate(replies)], "document_id string, stage string, seq int, status string, error string, result string")
    assert [r.error for r in outcomes(images, calls).orderBy("position").collect()] == list(replies.values())


def test_merged_fields_are_those_of_the_readings_and_masked(spark):
    fields = {f: {"value": " ", "status": "present", "confidence": "low"} for f in REPLY_FIELDS["aadhaar"]}
    fields |= {"aadhaar_number": {"value": "2345 6789 0123", "status": "present", "confidence": "medium"}, "name": {"value": " Tomba 2345-6789-0123 ", "status": "present", "confidence": "high"}, "dob_or_yob": {"value": "x", "status": "unreadable", "confidence": "low"}}
    images = spark.createDataFrame([("c", "d", 0, True, "aadhaar")], "case_id string, document_id string, position int, opened boolean, detected string")
    calls = spark.createDataFrame([("d", "extract", 1, "OK", None, json.dumps({"legibility": "good", "notes": "", "fields": fields}))], "document_id string, stage string, seq int, status string, error string, result string")
    m, r = merged(answered(images, calls)).first(), outcomes(images, calls).select("reading.*").first()
    assert {f: m[f"card__{f}"] for f in ("name", "dob_or_yob", "gender", "aadhaar_number")} == {f: r.fields[f] for f in ("name", "dob_or_yob", "gender", "aadhaar_number")}
    assert (m.card__identity, m.card__name.value, m.card__gender.status, m.card__state) == (r.identity, "Tomba XXXX XXXX 0123", "blank", 2)
    assert not merged(answered(images, calls)).select(F.to_json(F.struct("*")).alias("r")).where("r LIKE '%6789%'").count()
