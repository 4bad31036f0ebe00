"""Keyed tables in buckets of files, of which a change rewrites only those it touches, and the cache of model replies kept in one.

A row's bucket is a hash of its key. Keys at hand become a list of buckets in the filter, so that a lookup opens those folders alone; keys in a
table are joined by bucket and key, and Spark prunes folders by the buckets that the keys have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.sources.shared import materialize, temporaries

BUCKET = "bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Bucketed:
    """A table under ``path`` with a string or whole-number key; ``schema`` is DDL with the key, ``buckets`` stays what it was at the first write."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def read(self) -> DataFrame:
        """All rows; none before the first write."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], f"{self.schema}, {BUCKET} int")
        return self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)

    def with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, bucket_of(F.col(self.key), self.buckets))

    def lookup(self, keys: list) -> DataFrame:
        """Rows of the given keys (a bounded list), from their buckets alone."""
        if not keys:
            return self.read().limit(0).drop(BUCKET)
        kind = self.read().schema[self.key].dataType
        given = self.spark.createDataFrame([(k,) for k in keys], f"`{self.key}` {kind.simpleString()}")
        numbers = sorted({r[0] for r in self.with_bucket(given).select(BUCKET).collect()})
        return self.read().where(F.col(BUCKET).isin(*numbers) & F.col(self.key).isin(*keys)).drop(BUCKET)

    def join(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        """rows (with the key) joined to the table; folders without a key of theirs are pruned if rows are few."""
        return self.with_bucket(rows).join(self.read(), [BUCKET, self.key], how).drop(BUCKET)

    def _put(self, df: DataFrame) -> None:
        # a row goes to the one task of its bucket and a part of its key, so that a bucket is a few files, not one from each task
        spread = df.withColumn("__part", F.pmod(F.xxhash64(self.key, F.lit(7)), F.lit(4))).repartition(BUCKET, "__part").drop("__part")
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def rewrite(self, gone: DataFrame, new: DataFrame) -> DataFrame:
        """Remove the rows of ``gone``'s keys and add ``new``; other buckets' files stay as they are. Returns the rows that were removed.

        What is kept of the touched buckets is written aside first, so that nothing reads what is being replaced. A bucket whose last row goes
        keeps an empty file. The removed rows are a table in the shared folder.
        """
        spark = self.spark
        with temporaries(spark, "removed"):
            keys = materialize(self.with_bucket(gone.select(self.key).distinct()), "gone-keys")
            added = materialize(self.with_bucket(new), "new-rows")
            touched = F.broadcast(keys.select(BUCKET).union(added.select(BUCKET)).distinct())  # at most a row a bucket
            old = self.read().join(touched, BUCKET, "left_semi")
            removed = materialize(old.join(keys, [BUCKET, self.key], "left_semi").select(*[c for c in old.columns if c != BUCKET]), "removed")
            kept = materialize(old.join(keys, [BUCKET, self.key], "left_anti").select(*old.columns), "kept-rows")
            columns = old.columns
            whole = kept.unionByName(added.select(*columns))
            emptied = {r[0] for r in touched.collect()} - {r[0] for r in whole.select(BUCKET).distinct().collect()}  # at most a row a bucket
            self._put(whole)
            for b in sorted(emptied):
                spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.path}/{BUCKET}={b}")
            return removed

    def upsert(self, new: DataFrame) -> None:
        """Rows by key, one each: they replace those of their keys."""
        self.rewrite(new, new)


#: Columns of the cache of model replies.
CACHE = "key string, sha string, stage string, model string, prompt string, result string, input_tokens long, output_tokens long, latency_ms long, at timestamp"


def cache_key(stage: Column, sha: Column, model: Column, prompt: Column) -> Column:
    """What a reply depends on: the stage, the image's hash, the model and the prompt's version."""
    return F.concat_ws("|", stage, sha, model, prompt)


class ReplyCache:
    """Replies of a vision model, recorded by stage, image, model and prompt version; an image's replies lie in one bucket."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.table = Bucketed(spark, path, CACHE, "sha", buckets)

    def record(self, replies: DataFrame) -> None:
        """Replies (the cache's columns without key); of equal keys the latest stays, whether it is new or recorded."""
        keyed = replies.withColumn("key", cache_key(F.col("stage"), F.col("sha"), F.col("model"), F.col("prompt")))
        names = [c for c in self.table.read().columns if c != BUCKET]
        with temporaries(self.table.spark):
            fresh = materialize(keyed.select(*names), "fresh-replies")
            known = self.table.join(fresh.select("sha").distinct()).select(*names)
            latest = fresh.unionByName(known).groupBy("key").agg(F.max_by(F.struct(*[c for c in names if c != "key"]), "at").alias("r")).select("key", "r.*")
            self.table.rewrite(fresh, latest.select(*names))

    def serve(self, wanted: DataFrame, mode: str = "cache_first") -> DataFrame:
        """wanted (sha, stage, model, prompt) with what is recorded for it and outcome: 'hit', or what is to be done.

        Modes: 'cache_first' calls the model only for a miss, 'cache_only' fails a miss, 'live' calls for every row and keeps what is recorded
        as the fallback for a failed call.
        """
        miss = {"cache_first": "call", "cache_only": "failed", "live": "call"}[mode]
        keyed = wanted.withColumn("key", cache_key(F.col("stage"), F.col("sha"), F.col("model"), F.col("prompt")))
        recorded = self.table.read().select(BUCKET, "sha", "key", F.struct("result", "input_tokens", "output_tokens", "latency_ms", "at").alias("recorded"))
        found = self.table.with_bucket(keyed).join(recorded, [BUCKET, "sha", "key"], "left").drop(BUCKET)
        return found.withColumn("outcome", F.when(F.col("recorded").isNotNull() & F.lit(mode != "live"), "hit").otherwise(miss))

    def purge(self, images: DataFrame, model: str) -> DataFrame:
        """Forget what a model said of images (sha); returns the keys that were removed. What other models said of them stays."""
        with temporaries(self.table.spark, "removed", "purged"):
            there = materialize(self.table.join(images.select("sha").distinct()), "purge-there")
            keys = materialize(there.where(F.col("model") == model).select("key"), "purged")
            touched = there.where(F.col("model") == model).select("sha").distinct()
            self.table.rewrite(touched, there.join(touched, "sha", "left_semi").where(F.col("model") != model))
            return keys
