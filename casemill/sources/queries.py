"""Queries of the sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.plans.registry import query
from casemill.sources.storage import check_pairs, upsert
from casemill.sources.views import literal_and, table

PAIRS, PAIRS_SQL = literal_and([(2, "Asha Rai", "Asha Ray", "Nepali", "Yes"), (3, "", "X", "Naga", "no"), (4, "A", "B", None, "perhaps"), (5, "A", "B", "Meitei", "ambiguous"), (6, "A", "B", "Meitei", None)], "row long, name_a string, name_b string, community string, expected_same string", "customer", row="c_custkey + 1000", name_a="CASE WHEN c_custkey % 13 <> 0 THEN c_name END", name_b="CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE lower(c_name) END", community="c_mktsegment", expected_same="CASE c_custkey % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'different' WHEN 2 THEN 'AMBIGUOUS' WHEN 3 THEN 'false ' WHEN 4 THEN c_mktsegment END")


@query("scan_pairs_checked", f"""SELECT row, CASE WHEN lower(trim(expected_same)) IN ('yes', 'same', 'true') THEN TRUE WHEN lower(trim(expected_same)) IN ('no', 'different', 'false') THEN FALSE END AS same_person,
CASE WHEN coalesce(trim(name_a), '') = '' OR coalesce(trim(name_b), '') = '' THEN 'a name is missing' WHEN expected_same IS NULL OR lower(trim(expected_same)) NOT IN ('yes', 'same', 'true', 'no', 'different', 'false', 'ambiguous') THEN concat('unknown label: ', coalesce(expected_same, '')) END AS error FROM {PAIRS_SQL}""")
def scan_pairs_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_pairs(PAIRS(spark, sf_dir)).select("row", "same_person", "error")


@query("scan_catalog_columns", "SELECT * FROM (VALUES ('nation', 'n_name', 'string'), ('nation', 'n_nationkey', 'int'), ('nation', 'n_regionkey', 'int'), ('region', 'r_name', 'string'), ('region', 'r_regionkey', 'int')) v(tbl, col, kind)")
def scan_catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and types of tables, from their schemas."""
    rows = [(t, f.name, f.dataType.simpleString()) for t in ("nation", "region") for f in table(spark, sf_dir, t).schema]
    return spark.createDataFrame(rows, "tbl string, col string, kind string")


@query("scan_lines", "SELECT count(*) AS lines, sum(length(l))::BIGINT AS chars FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE l <> ''")
def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines of the texts."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("l")).where("l <> ''")
    return lines.agg(F.count("*").alias("lines"), F.sum(F.length("l")).alias("chars"))


@query("sink_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer")
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return upsert(old, old.where("c_custkey % 3 = 0").withColumn("segment", F.lit("NEW")), ["c_custkey"])


@query("scan_packet_groups", "SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, count(*) AS files, count(*) > 6 AS skipped FROM pages GROUP BY 1")
def scan_packet_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their folder; a packet of more than six is skipped."""
    folder = F.regexp_extract("url", "^(.*)/[^/]*$", 1).alias("folder")
    return table(spark, sf_dir, "pages").groupBy(folder).agg(F.count("*").alias("files")).withColumn("skipped", F.col("files") > 6)
