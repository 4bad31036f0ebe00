"""Mixing sources to target weights by weighted fair queueing (operator 7).

Every document, in a shuffled order of its source, gets a virtual finish time: the words of its source up to and with it, over the source's
target. One global order of finish times, cut at the total budget, takes each source in proportion to its target. A source whose target is
above its size goes round again, up to ``repeats`` times; a round adds the source's size to the finish times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import free_name, materialize, prefix_sums, temporaries, word_count


def targets(sizes: DataFrame, weights: int = 3, repeats: int = 3) -> DataFrame:
    """source, source_size -> also source_before (sizes of earlier sources) and target, without gathering the sources anywhere.

    Sources by code point, null last, weigh 1 to ``weights``, repeating. Targets share the total by weight; one above repeats * source_size is
    set to that, and the rest share the excess by weight. Sources in the order of repeats * size / weight are capped up to some point, and a
    source is capped just if its share is too large with all before it capped.
    """
    ranked = prefix_sums(sizes, [F.col("source").isNull().cast("int"), F.col("source")], {"__rank": F.lit(1), "__upto": F.col("source_size")}, "mix-sources")
    ranked = ranked.select("source", "source_size", (F.col("__upto") - F.col("source_size")).alias("source_before"), ((F.col("__rank") - 1) % weights + 1).alias("__weight"), (F.col("source_size") * repeats).alias("__cap"))
    filled = prefix_sums(ranked, [F.col("__cap") / F.col("__weight"), F.col("source").isNull().cast("int"), F.col("source")], {"__caps": F.col("__cap"), "__weights": F.col("__weight")}, "mix-targets")
    total, weight = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("__weight"), F.lit(0))).first()
    share = F.col("__weight") * (F.lit(total) - (F.col("__caps") - F.col("__cap"))).cast("double") / (F.lit(weight) - (F.col("__weights") - F.col("__weight"))).cast("double")
    filled = filled.withColumn("__capped", share > F.col("__cap"))
    capped, capped_weight = filled.where("__capped").agg(F.coalesce(F.sum("__cap"), F.lit(0)), F.coalesce(F.sum("__weight"), F.lit(0))).first()
    level = (total - capped) / (weight - capped_weight) if weight > capped_weight else 0.0
    return filled.select("source", "source_size", "source_before", F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(F.col("__weight") * F.lit(float(level))).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None, weights: int = 3, repeats: int = 3) -> DataFrame:
    """One row for each row of df: its key, source, size, source_size, target, taken (words the mix takes) and copies (how often).

    Sources by code point, null last, weigh 1 to ``weights``, repeating; a row of size 0 is never taken. Reruns agree: the shuffle is the
    MD5 of the key. Equal rows are told apart by their place in that order. An empty table gives an empty result.
    """
    size = word_count(F.col("text")) if size is None else size
    docs = df.select(F.col(key).alias(key), F.col(source).cast("string").alias("source"), size.alias("size")).withColumn("__h", F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    with temporaries(df.sparkSession, "mix-queue"):
        docs = materialize(docs, "mix-rows")  # without texts: words are counted once
        order = [F.col("source").isNull().cast("int"), F.col("source"), F.col("__h"), F.col(key), F.col("size")]
        placed = prefix_sums(docs, order, {"__row": F.lit(1), "__upto": F.col("size")}, "mix-shuffled")
        of = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats).withColumnRenamed("source", "__source")
        placed = placed.join(of, placed["source"].eqNullSafe(of["__source"]), "left").drop("__source").withColumn("__cum", F.col("__upto") - F.col("source_before"))
        rounds = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.lit(repeats - 1))).otherwise(F.array(F.lit(0)))
        copies = placed.withColumn("__round", F.explode(rounds))
        finish = (F.col("__cum") + F.col("__round") * F.col("source_size")).cast("double") / F.when(F.col("target") > 0, F.col("target"))
        copies = copies.select("__row", key, "source", "size", "source_size", "target", "__round", finish.alias("__finish"))
        queue = prefix_sums(copies, [F.coalesce("__finish", F.lit(0.0)), F.col("__row"), F.col("__round")], {"__taken": F.col("size")}, "mix-queue")
        budget = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    into = (F.col("__taken") <= F.lit(budget)) & (F.col("size") > 0)
    rest = [F.first(c).alias(c) for c in (key, "source", "size", "source_size", "target")]
    return queue.groupBy("__row").agg(*rest, F.sum(F.when(into, F.col("size")).otherwise(0)).alias("taken"), F.count_if(into).alias("copies")).drop("__row")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def apply(df: DataFrame, key: str = "doc_id", text: str = "text", weights: int = 3, repeats: int = 3) -> DataFrame:
    """df's rows as often as the mix takes them, none to ``repeats`` times; columns stay those of df.

    A row is known by its key and text; rows that agree in both share their copies out.
    """
    own, times = free_name(df, "__row_key"), free_name(df, "__copies")
    keyed = df.withColumn(own, F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.xxhash64(text).cast("string"))))
    mixed = mix(keyed.select(F.col(own), "source", F.col(text).alias("text")), key=own, weights=weights, repeats=repeats)
    chosen = mixed.groupBy(own).agg(F.sum("copies").alias(times)).where(F.col(times) > 0)
    again = keyed.dropDuplicates([own]).join(chosen, own)
    return again.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*df.columns)


#: The mix in DuckDB SQL.
ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source, h, doc_id, size) AS n FROM d),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY n) AS cum FROM r),
s AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM d GROUP BY source),
f AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS weight,
         coalesce(sum(3 * source_size) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS weights
  FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, w * (total - caps)::DOUBLE / (weight - weights)::DOUBLE > 3 * source_size AS capped FROM f),
l AS (
  SELECT any_value(total - k) / nullif(any_value(weight - kw), 0)::DOUBLE AS level
  FROM p, (SELECT coalesce(sum(3 * source_size), 0) AS k, coalesce(sum(w), 0) AS kw FROM p WHERE capped)),
t AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE w * level END AS target FROM p, l),
q AS (
  SELECT c.*, t.source_size, t.target, i, (c.cum + i * t.source_size)::DOUBLE / t.target AS finish
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source, range(3) x(i) WHERE c.size > 0 OR i = 0),
m AS (SELECT *, sum(size) OVER (ORDER BY coalesce(finish, 0), n, i) AS upto FROM q)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size)::BIGINT AS source_size, any_value(target) AS target,
       sum(CASE WHEN upto <= (SELECT sum(size) FROM d) THEN size ELSE 0 END)::BIGINT AS taken, any_value(source) AS source,
       count(*) FILTER (WHERE size > 0 AND upto <= (SELECT sum(size) FROM d)) AS copies
FROM m GROUP BY n
"""
