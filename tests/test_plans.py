"""Plans: the case view reads one table, filters reach the reader, nothing is shuffled without need."""

import os

import pytest

from casemill.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["scan_project_prune", "scan_case_summary", "filter_range", "filter_null", "filter_optional", "filter_array_any", "filter_like_prefix", "rule_screen_flags", "rule_status", "audit_retention_due", "date_age", "math_priority"])
def test_one_scan_and_no_exchange(spark, name):
    text = plan(spark, name)
    assert text.count("FileScan") == 1 and "Exchange" not in text, text


@pytest.mark.parametrize(("name", "filter_"), [("filter_range", "LessThan(o_orderdate"), ("scan_project_prune", "LessThan(o_orderpriority"), ("scan_keyed_lookup", "EqualTo(o_orderkey"), ("filter_like_prefix", "GreaterThanOrEqual(o_orderdate"), ("filter_event_match", "")])
def test_filters_reach_the_reader(spark, name, filter_):
    text = plan(spark, name)
    assert "PushedFilters: [" in text and filter_ in text[text.index("PushedFilters: [") :].replace("\n", ""), text


def test_json_fields_are_kept(spark):
    from pyspark.sql import functions as F

    from casemill.functions.text import json_with

    df = spark.createDataFrame([('{"z":2.5,"k":1,"o":{"a":[1,"x"]}}',), ("{}",), (None,)], "p string")
    got = [r[0] for r in df.select(json_with(F.col("p"), k=F.lit(7), new=F.lit(True))).collect()]
    assert got == ['{"k":7,"new":true,"z":2.5,"o":{"a":[1,"x"]}}', '{"k":7,"new":true}', None]
