"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.sources.shared import drop, materialize, prefix_sums, shared_dir, temporaries  # noqa: F401

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, key: str, text: str, most: int) -> DataFrame:
    """key, text and label of at most ``most`` different rows: labels with the smallest hashes of their keys, then rows with the smallest hashes.

    Equal rows count once, rows of one key that differ in text or label count each. Both bounds hold before a text is shuffled, and what is
    broadcast are ``most`` rows of a key, a label and a hash.
    """
    chosen = labels.select(F.col(key).alias(key), F.col(label).alias(label)).dropna().orderBy(F.xxhash64(key), key, label).limit(most)
    docs = documents.select(F.col(key).alias(key), F.col(text).alias(text), F.xxhash64(text).alias("__hash"))
    pairs = docs.select(key, "__hash").join(F.broadcast(chosen), key).distinct().orderBy(F.xxhash64(key, "__hash"), key, "__hash", label).limit(most)
    return docs.join(F.broadcast(pairs), [key, "__hash"]).dropDuplicates([key, "__hash", label]).select(key, text, label)


def with_columns(df: DataFrame, without: tuple[str, ...] | list[str] | set[str], **added: str) -> T.StructType:
    """The schema of df without some columns and with others, for functions over Arrow batches; any names and types are carried."""
    kept = [T.StructField(f.name, f.dataType) for f in df.schema if f.name not in without and f.name not in added]
    return T.StructType([*kept, *[T.StructField(n, T._parse_datatype_string(k)) for n, k in added.items()]])


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches cut into some rows each: what Python makes of a batch of long texts is then held for a few of them, not for ten thousand."""
    for b in batches:
        for at in range(0, max(b.num_rows, 1), rows):
            yield b.slice(at, rows)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def lookup(rows: DataFrame, one: DataFrame, keys: list[str], what: str) -> DataFrame:
    """rows, left-joined with ``one`` (a row a key, no nulls), however many rows a key has.

    A key that over a thousandth of the rows have is one of at most a thousand: those are broadcast with what belongs to them, all others are
    joined by a shuffle in which no key is large. Reads ``rows`` thrice and writes the hot keys, so rows should be a table.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    hot = F.broadcast(materialize(counts.where(F.col("__n") * 1000 > rows.count()).select(*keys), f"{what}-hot"))  # at most 1,000 rows
    marked = rows.join(hot.withColumn("__hot", F.lit(True)), keys, "left")
    few = one.join(hot, keys, "left_semi")
    parts = [marked.where("__hot").drop("__hot").join(F.broadcast(few), keys, "left"), marked.where("__hot IS NULL").drop("__hot").join(one, keys, "left")]
    return union_all(parts)


def running(df: DataFrame, group: str, order: list[str], sums: dict[str, Column], what: str) -> DataFrame:
    """df with running totals (inclusive) of long columns within each group, which may hold most of the rows and is never gathered in one task.

    Rows are range-partitioned by group (not null) and order and written. Totals restart in each partition and group; what a group has in the
    partitions before is added from one table of at most two rows a partition, as only its first and last group can lie in others too.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumns({f"__v_{s}": c.cast("long") for s, c in sums.items()})
    ranged = materialize(df.repartitionByRange(n, group, *order).withColumn("__part", F.spark_partition_id()), what)
    edges = ranged.groupBy("__part").agg(F.min(group).alias("__lo"), F.max(group).alias("__hi"))
    at_edge = ranged.join(F.broadcast(edges), "__part").where((F.col(group) == F.col("__lo")) | (F.col(group) == F.col("__hi")))
    totals = at_edge.groupBy("__part", group).agg(*[F.sum(f"__v_{s}").alias(f"__t_{s}") for s in sums])
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__part", group, *[F.sum(f"__t_{s}").over(before).alias(f"__o_{s}") for s in sums])
    within = Window.partitionBy("__part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({s: F.sum(f"__v_{s}").over(within) for s in sums}).join(F.broadcast(carried), ["__part", group], "left")
    out = out.withColumns({s: F.col(s) + F.coalesce(F.col(f"__o_{s}"), F.lit(0)) for s in sums})
    return out.drop("__part", *[f"__v_{s}" for s in sums], *[f"__o_{s}" for s in sums])
