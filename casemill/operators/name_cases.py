"""Queries of the name comparison over the names that cases' documents hold; equal pairs are compared once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators.names_queries import DOCUMENTS, PEOPLE, explain_match, match_names, none_known, surnames_of
from casemill.operators.screen_queries import NAMED, NAMES, PERSON, UNLIKE_SAME
from casemill.plans.registry import query
from casemill.sources.views import pick, table

_AT = {d: f"CAST({e} AS BIGINT)" for d, e in NAMED.items()}
_SAME = ", ".join(f"({i}, {j}, '{UNLIKE_SAME.get((min(i, j), max(i, j)), 'SAME')}')" for i in range(len(NAMES)) for j in range(len(NAMES)) if i // 2 == j // 2)
_BASE = f"b AS (SELECT k, p, {', '.join(f'{e} AS {d}' for d, e in _AT.items())} FROM (SELECT o_orderkey AS k, {PERSON} AS p FROM orders)), same(i, j, verdict) AS (VALUES {_SAME})"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, doc and name: the few people written out, with negative ids, and the names on every order's documents."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr(PERSON).alias("p"))
    names = F.array(*[F.struct(F.lit(d).alias("doc"), F.expr(pick(NAMES, at, False)).alias("name")) for d, at in NAMED.items()])
    made = o.select(F.col("k").alias("case_id"), F.explode(names).alias("n")).select("case_id", "n.doc", "n.name")
    return PEOPLE(spark).select((-F.col("case_id")).alias("case_id"), "doc", "name").unionByName(made)


def compared(pairs: DataFrame, a: str, b: str, known: str | None = None, matching: Callable[..., Column] = match_names) -> DataFrame:
    """pairs with m, what the comparison says of a and b: each different pair (with what is known) is compared once, wherever it occurs."""
    on = [a, b, *([known] if known else [])]
    once = pairs.select(*on).distinct().withColumn("m", matching(a, b, F.col(known) if known else none_known()))
    left, right = pairs.alias("l"), once.alias("r")
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, same).select("l.*", "r.m")


@query("name_match")
def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a case's form name with its other documents' names."""
    p = people(spark, sf_dir)
    pairs = p.where("doc = 'form'").select("case_id", F.col("name").alias("a")).join(p.where("doc <> 'form'").select("case_id", "doc", F.col("name").alias("b")), "case_id")
    return compared(pairs, "a", "b").select("case_id", "doc", "a", "b", "m.*")


@query("name_verdicts", f"WITH {_BASE}, d AS (SELECT k, form, unnest(['card', 'epic', 'passbook']) AS doc, unnest([card, epic, passbook]) AS j FROM b) SELECT d.k AS case_id, d.doc, coalesce(s.verdict, 'DIFFERENT') AS verdict FROM d LEFT JOIN same s ON s.i = d.form AND s.j = d.j")
def name_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every order's form name and the names on its other documents."""
    return name_match(spark, sf_dir).where("case_id >= 0").select("case_id", "doc", "verdict")


@query("name_identity_matrix")
def name_identity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a packet's names once, the earlier document (DOCUMENTS) first."""
    p = people(spark, sf_dir).withColumn("at", F.array_position(F.array(*map(F.lit, DOCUMENTS)), F.col("doc")))
    a, b = (p.select("case_id", F.col("doc").alias(x), F.col("name").alias(f"name_{x}"), F.col("at").alias(f"at_{x}")) for x in "ab")
    pairs = a.join(b, "case_id").where("at_a < at_b").select("case_id", "a", "b", "name_a", "name_b")
    return compared(pairs, "name_a", "name_b").select("case_id", "a", "b", "m.score", "m.verdict")


_PAIRS = " UNION ALL ".join(f"SELECT k, '{a}' AS a, '{b}' AS b, {a} AS i, {b} AS j FROM b" for x, a in enumerate(DOCUMENTS) for b in DOCUMENTS[x + 1 :])


@query("name_matrix_worst", f"""WITH {_BASE}, m AS (SELECT k, coalesce(s.verdict, 'DIFFERENT') AS verdict FROM ({_PAIRS}) p LEFT JOIN same s ON s.i = p.i AND s.j = p.j)
SELECT k AS case_id, count(*) AS pairs, count(*) FILTER (WHERE verdict = 'DIFFERENT') AS different, CASE min(list_position(['DIFFERENT', 'AMBIGUOUS', 'LIKELY_SAME', 'SAME'], verdict)) WHEN 1 THEN 'DIFFERENT' WHEN 2 THEN 'AMBIGUOUS' WHEN 3 THEN 'LIKELY_SAME' ELSE 'SAME' END AS worst FROM m GROUP BY k""")
def name_matrix_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every order's matrix of names: its pairs, those that differ, and the gravest verdict."""
    order = F.array(*map(F.lit, ("DIFFERENT", "AMBIGUOUS", "LIKELY_SAME", "SAME")))
    m = name_identity_matrix(spark, sf_dir).where("case_id >= 0").groupBy("case_id")
    return m.agg(F.count("*").alias("pairs"), F.count_if(F.col("verdict") == "DIFFERENT").alias("different"), F.element_at(order, F.min(F.array_position(order, F.col("verdict"))).cast("int")).alias("worst"))


@query("name_explain")
def name_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to tell an officer about each pair of a case's form name with another document's name, surnames of the packet's relatives known."""
    p = people(spark, sf_dir)
    packs = p.groupBy("case_id").agg(F.array_sort(F.collect_list("name")).alias("names"))  # a packet has at most six documents
    known = packs.join(packs.select("names").distinct().withColumn("known", surnames_of("names")), "names").select("case_id", "known")
    pairs = p.where("doc = 'form'").select("case_id", F.col("name").alias("a")).join(p.where("doc <> 'form'").select("case_id", "doc", F.col("name").alias("b")), "case_id").join(known, "case_id")
    return compared(pairs, "a", "b", "known", explain_match).select("case_id", "doc", "m.score", "m.verdict", "m.headline", "m.points")
