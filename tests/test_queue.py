"""The officers' queue: all of it, or its head."""

from casemill.operators import aggregates

ROWS = [(i, i * 7919 % 50, i * 31 % 400) for i in range(1000)]


def test_no_case_is_lost_from_the_queue(spark, monkeypatch):
    def cases(spark, sf_dir, where=None):
        return spark.createDataFrame(ROWS, "case_id long, priority int, received_ms long").selectExpr("*", "'OFFICER_ATTENTION' AS status", "case_id % 10 = 0 AS historical")

    monkeypatch.setattr(aggregates, "cases", cases)
    got = [tuple(r) for r in aggregates.sort_queue_all(spark, "").collect()]
    want = sorted((r for r in ROWS if r[0] % 10), key=lambda r: (-r[1], r[2], r[0]))
    assert got == [(place, key, priority) for place, (key, priority, _) in enumerate(want, 1)]
    assert [tuple(r) for r in aggregates.queue(cases(spark, ""), top=7).collect()] == [(place, key, priority) for place, (key, priority, _) in enumerate(want[:7], 1)]
