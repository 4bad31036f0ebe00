"""Tables in the folder that driver and executors share, and running totals in a global order."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset on one machine, as in tests, a temporary folder."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = f"file://{tempfile.mkdtemp(prefix='casemill-')}"
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir


_SCOPES = threading.local()
#: Paths that results of this driver still read; see cleanup().
_KEPT: list[str] = []


def kept(path: str) -> str:
    """Note a path that a result reads, for cleanup()."""
    _KEPT.append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Remove all tables, stream outputs and offsets that results of this driver were read from, once those results are no longer needed; how many."""
    gone = 0
    while _KEPT:
        _remove(spark, _KEPT.pop())
        gone += 1
    return gone


@contextmanager
def temporaries(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Tables that materialize() writes in this block are removed at its end, but those named in ``keep``: an enclosing block has them then."""
    open_ = _SCOPES.__dict__.setdefault("open", [])
    made: list[tuple[str, str]] = []
    open_.append(made)
    try:
        yield
    finally:
        open_.pop()
        for what, path in made:
            if what not in keep:
                _remove(spark, path)
            elif open_:
                open_[-1].append((what, path))
            else:
                kept(path)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, and each task's work is done once even if executors are lost later."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    if open_ := _SCOPES.__dict__.get("open"):
        open_[-1].append((what, path))
    else:
        kept(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._casemill_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Remove a materialized table that nothing reads any more."""
    _remove(df.sparkSession, df._casemill_path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that Spark shuffles and never sends round.

    For rows made by exploding, or with long texts and maps: Spark guesses their size from the columns of the source, far too low, and the driver
    would gather all of them to broadcast them. For written tables too, whose files are many times smaller than their rows.
    """
    return df.hint("merge")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later expressions and filters read and don't repeat: Spark puts a filter's columns in by their text, and a parse in it runs for each mention."""
    for name, c in columns.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], what: str, partitions: int | None = None) -> DataFrame:
    """df with running totals (inclusive) of the given long columns in one global order, without gathering rows in one task.

    Rows are range-partitioned and sorted by ``order``, which should be unique, and written; each partition's totals (one row a
    partition) give the offset of the next ones. ``sums`` maps a new column to the column that it adds up.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    df = df.withColumns(dict(zip(keys, order)) | {f"__v_{n}": c.cast("long") for n, c in sums.items()})
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), what)
    totals = ranged.groupBy("__part").agg(*[F.sum(f"__v_{s}").alias(f"__t_{s}") for s in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums])
    within = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({s: F.sum(f"__v_{s}").over(within) for s in sums}).join(F.broadcast(offsets), "__part")  # a row for each partition
    out = out.withColumns({s: F.col(s) + F.col(f"__o_{s}") for s in sums})
    return out.drop("__part", *keys, *[f"__v_{s}" for s in sums], *[f"__o_{s}" for s in sums])
