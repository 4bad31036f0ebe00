"""Exact duplicates: groups by a 128-bit hash of the text without white space, bytes compared inside groups, one row of each group stays.

All is native expressions. Narrow rows (hash, digest, length, key) are written once; whole texts are read a second time to compare bytes, and
only those of hashes that several rows have leave their task, one a task and hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import lookup, materialize, temporaries

#: Characters that make no difference: blank, and tabulator to carriage return.
IGNORED = " \t\n\x0b\x0c\r"
#: So many hashes (16 bytes each) of groups are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 500_000


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _stays() -> Column:
    """The least of a group's rows in this order is the one that stays: the longest, then the smallest key (null last)."""
    return F.min(F.struct((-F.col("__length")).alias("length"), F.col("__key").isNull().alias("none"), F.col("__key").alias("key"), F.col("__row").alias("row")))


def _settle(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (with __row, a number of their own) with group_size and __best of their group; a group of one isn't looked up."""
    groups = rows.groupBy(*by).agg(F.count("*").alias("group_size"), _stays().alias("__best")).where("group_size > 1")
    return lookup(rows, materialize(groups, "copies"), by, "copies")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = md5) -> DataFrame:
    """One row a row of df: key, keep_id (key of the row that stays), group_size, kept, text_sha256 (of the text without white space).

    Texts are equal if they are without the ASCII white space characters; null counts as empty. The row with the most code points stays, then
    the one with the smallest key, a null key last; of rows equal in all that, one. Other columns are not read. ``digest`` gives the groups'
    hash; different texts under one hash are found by comparing bytes (least and greatest text of a hash, pre-aggregated in each task), and
    such hashes' rows are grouped by their whole texts.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).withColumn("__normal", normal(F.col("__text"))).withColumn("__hash", digest(F.col("__normal")))
    narrow = ["__key", "__hash", F.unhex(F.sha2("__normal", 256)).alias("__sha"), F.coalesce(F.length("__text"), F.lit(0)).alias("__length"), F.monotonically_increasing_id().alias("__row")]
    with temporaries(spark, "exact"):
        rows = materialize(docs.select(*narrow), "copy-keys")
        shared = materialize(rows.groupBy("__hash").count().where("count > 1").select("__hash"), "copy-hashes")
        several = docs.select("__hash", "__normal").join(F.broadcast(shared) if shared.count() <= MOST_BROADCAST else shared, "__hash", "left_semi")
        clash = several.groupBy("__hash").agg(F.min("__normal").alias("a"), F.max("__normal").alias("b")).where("a <> b").select("__hash")
        clash = materialize(clash, "copy-clashes")
        few = F.broadcast(clash) if (n := clash.count()) <= MOST_BROADCAST else clash
        parts = [_settle(materialize(rows.join(few, "__hash", "left_anti"), "copy-clear") if n else rows, ["__hash"])]
        if n:
            mixed = materialize(docs.join(few, "__hash", "left_semi").select(*narrow, "__normal"), "copy-mixed")
            parts.append(_settle(mixed, ["__hash", "__normal"]).drop("__normal"))
        best = F.col("__best")
        out = [
            p.select(
                F.col("__key").alias(key), F.when(best.isNull(), F.col("__key")).otherwise(best["key"]).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                F.coalesce(best["row"] == F.col("__row"), F.lit(True)).alias("kept"), F.lower(F.hex("__sha")).alias("text_sha256"),
            )
            for p in parts
        ]
        return materialize(out[0] if len(out) == 1 else out[0].unionByName(out[1]), "exact")


_PLAIN = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"
ORACLE = f"""WITH d AS (SELECT doc_id, {_PLAIN} AS plain, length(coalesce(text, '')) AS n FROM documents),
g AS (SELECT doc_id, plain, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY plain) AS group_size FROM d WINDOW w AS (PARTITION BY plain ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(plain) AS text_sha256 FROM g"""
