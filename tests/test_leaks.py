"""Full identifiers in log files by line, over blocks of a file, in responses and tables."""

from pyspark.sql import functions as F

from casemill.operators.leaks import in_logs, in_responses, in_tables, log_lines, tally


def test_lines_of_files_read_in_blocks(spark, tmp_path):
    for name, n in (("a.log", 4000), ("b.log", 10)):
        lines = [("" if i % 11 == 5 else f"line {i} " + "x" * (i % 50)) + (" id 2345 6789 0123" if i % 501 == 7 else "") for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = log_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() >= 1 and rows.count() == 4010
        found = sorted(r.location for r in in_logs(spark, str(tmp_path)).collect())
        assert found == sorted([f"a.log line {i + 1}" for i in range(4000) if i % 501 == 7] + ["b.log line 8"])
        assert rows.where("NOT empty").count() == sum(1 for n in (4000, 10) for i in range(n) if i % 11 != 5 or i % 501 == 7)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_responses_tables_and_tallies(spark):
    r = spark.createDataFrame([("/a", "2345 6789 0123"), ("/b", "fine"), ("/c", None)], "label string, note string")
    found = in_responses(r, "label", F.struct("note"))
    assert [tuple(x) for x in found.collect()] == [("response", "/a")]
    t = in_tables({"docs": (spark.createDataFrame([(1, "x 998877665544"), (2, "no")], "id long, body string"), "id")})
    assert [tuple(x) for x in t.collect()] == [("table", "docs.body row 1")]
    n = tally({"response": r.agg(F.count("*")), "table": spark.range(1).select(F.lit(2)), "log file": spark.range(1).select(F.lit(0))}, found.unionByName(t))
    assert {tuple(x) for x in n.collect()} == {("response", 3, 1), ("table", 2, 1), ("log file", 0, 0)}
