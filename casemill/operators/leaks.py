"""The search for full identifiers outside tables: in lines of log files, by file and line, and in responses; with what tables hold as one report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions.text import contains_id
from casemill.operators.audit import _LEAK, SCANNED, leaks
from casemill.plans.registry import query
from casemill.sources.storage import scratch
from casemill.sources.views import table


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, empty ones counted), empty and leak of every line of text files; no line leaves its task.

    A large file is read in blocks side by side: a line's number is its place in its block and the lines of the file's blocks before.
    """
    at = F.monotonically_increasing_id()  # rises within a block, which is one task's
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"), (F.col("value") == "").alias("empty"), contains_id(F.col("value")).alias("leak"))
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    placed = rows.join(offsets, ["file", "block"])
    return placed.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "empty", "leak")


def in_logs(spark: SparkSession, path: str) -> DataFrame:
    """place ('log file') and location (file and line) of every line with a full identifier."""
    found = log_lines(spark, path).where("leak")
    return found.select(F.lit("log file").alias("place"), F.concat(F.substring_index("file", "/", -1), F.lit(" line "), F.col("line").cast("string")).alias("location"))


def in_responses(responses: DataFrame, label: str, body: Column) -> DataFrame:
    """place ('response') and location (the label) of every response whose JSON holds a full identifier."""
    return responses.where(contains_id(F.to_json(body))).select(F.lit("response").alias("place"), F.col(label).cast("string").alias("location"))


def in_tables(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """place ('table') and location (table, column and key) of every value with a full identifier."""
    found = leaks(tables)
    return found.select(F.lit("table").alias("place"), F.concat(F.col("place"), F.lit("."), F.col("column"), F.lit(" row "), F.col("id").cast("string")).alias("location"))


def tally(scanned: dict[str, DataFrame], findings: DataFrame) -> DataFrame:
    """place, scanned and findings: how much was looked at in each place (a one-row count each), and what was found."""
    out = None
    for place, n in scanned.items():
        row = n.select(F.lit(place).alias("place"), F.col(n.columns[0]).cast("long").alias("scanned"))
        out = row if out is None else out.unionByName(row)
    by = findings.groupBy("place").agg(F.count("*").alias("findings"))
    return out.join(by, "place", "left").na.fill(0, ["findings"])


_LINE = "concat('at ', CAST(event_id AS STRING), ' user ', CAST(user_id % 100 AS STRING), CASE WHEN event_id % 97 = 0 THEN ' number 2345 6789 0123' ELSE ' ok' END)"
_ROWS = " UNION ALL ".join(f"SELECT {' OR '.join(f'coalesce({_LEAK.format(c)}, FALSE)' for c in cs)} AS leak, {' + '.join(f'CAST(coalesce({_LEAK.format(c)}, FALSE) AS INT)' for c in cs)} AS n FROM {t}" for t, (_, cs) in SCANNED.items())


@query("audit_leak_report", f"""SELECT 'table' AS place, count(*) AS scanned, CAST(sum(n) AS BIGINT) AS findings FROM ({_ROWS}) UNION ALL SELECT 'log file', count(*), count(*) FILTER (WHERE event_id % 97 = 0) FROM events
UNION ALL SELECT 'response', count(*), count(*) FILTER (WHERE o_orderkey % 89 = 0) FROM orders""")
def audit_leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that was scanned and found: rows of all tables, lines of a log of every event, a response for every case; some of both with an identifier put in."""
    path = scratch(spark, "log")
    table(spark, sf_dir, "events").select(F.expr(_LINE).alias("value")).write.text(path)
    tables = {t: (table(spark, sf_dir, t), k) for t, (k, _) in SCANNED.items()}
    note = F.when(F.col("o_orderkey") % 89 == 0, "card 2345-6789-0123").otherwise(F.col("o_orderstatus"))
    responses = table(spark, sf_dir, "orders").select(F.concat(F.lit("/cases/"), F.col("o_orderkey").cast("string")).alias("label"), F.struct("o_orderkey", note.alias("note")).alias("body"))
    found = in_tables(tables).unionByName(in_logs(spark, path)).unionByName(in_responses(responses, "label", F.col("body")))
    rows = None
    for df, _ in tables.values():
        n = df.agg(F.count("*").alias("n"))
        rows = n if rows is None else rows.unionByName(n)
    scanned = {"table": rows.agg(F.sum("n").alias("n")), "log file": log_lines(spark, path).where("NOT empty").agg(F.count("*").alias("n")), "response": responses.agg(F.count("*").alias("n"))}
    return tally(scanned, found)
