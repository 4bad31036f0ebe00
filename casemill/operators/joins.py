"""Joins of cases, findings, extractions, officers and reference data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.plans.registry import query
from casemill.sources.views import AUDIT, CASES, EXTRACTIONS, FLAGS, audit_log, cases, extractions, flags, table


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group; the order should be unique."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


@query("join_left_case_flags", f"""WITH {CASES}, {FLAGS} SELECT c.case_id, count(f.code) AS n_flags, count(*) FILTER (WHERE f.resolution = 'OPEN' AND f.severity <> 'info') AS n_open
 FROM cases c LEFT JOIN flags f ON c.case_id = f.case_id GROUP BY c.case_id""")
def join_left_case_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = flags(spark, sf_dir).groupBy("case_id").agg(F.count("*").alias("n_flags"), F.count_if((F.col("resolution") == "OPEN") & (F.col("severity") != "info")).alias("n_open"))
    return cases(spark, sf_dir).select("case_id").join(counts, "case_id", "left").na.fill(0)


@query("join_semi_live", f"WITH {CASES}, {FLAGS} SELECT case_id, seq, part, code FROM flags WHERE case_id IN (SELECT case_id FROM cases WHERE NOT historical)")
def join_semi_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).join(cases(spark, sf_dir).where("NOT historical").select("case_id"), "case_id", "left_semi").select("case_id", "seq", "part", "code")


@query("join_anti_missing", "SELECT p_partkey AS asked FROM part WHERE p_partkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)")
def join_anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked-for ids that no case has."""
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asked"))
    found = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("asked"))
    return asked.join(found, "asked", "left_anti")


@query("join_broadcast_officer", f"""WITH {FLAGS} SELECT f.case_id, f.seq, f.part, s.s_name AS officer FROM flags f LEFT JOIN supplier s ON f.resolved_by = concat('officer:', CAST(s.s_suppkey AS VARCHAR)) WHERE f.resolved_by IS NOT NULL""")
def join_broadcast_officer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The officer's name by a prefixed id; Spark sends the small side round if its size is below its threshold."""
    officers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("officer:"), F.col("s_suppkey").cast("string")).alias("resolved_by"), F.col("s_name").alias("officer"))
    return flags(spark, sf_dir).where("resolved_by IS NOT NULL").join(officers, "resolved_by", "left").select("case_id", "seq", "part", "officer")


@query("join_latest_per_key", f"WITH {EXTRACTIONS} SELECT document_id, stage, seq, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id, stage ORDER BY seq DESC) AS r FROM extractions) WHERE r = 1")
def join_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(extractions(spark, sf_dir), ["document_id", "stage"], ["seq"]).select("document_id", "stage", "seq", "status")


@query("join_latest_ok", f"""WITH {EXTRACTIONS}, l AS (SELECT document_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq DESC) AS r FROM extractions WHERE status = 'OK' AND stage = 'extract') WHERE r = 1)
SELECT d.document_id, l.seq FROM (SELECT DISTINCT document_id FROM extractions) d LEFT JOIN l ON d.document_id = l.document_id""")
def join_latest_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their latest successful reading; null where there is none."""
    e = extractions(spark, sf_dir)
    ok = latest(e.where("status = 'OK' AND stage = 'extract'"), ["document_id"], ["seq"]).select("document_id", "seq")
    return e.select("document_id").distinct().join(ok, "document_id", "left")


@query("join_pairs_triangular", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_pairs_triangular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a packet's names, each once."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    b = n.select("n_regionkey", F.col("n_nationkey").alias("k"), F.col("n_name").alias("b"))
    return n.join(b, (n.n_regionkey == b.n_regionkey) & (n.n_nationkey < b.k)).select(F.col("n_name").alias("a"), "b")


def same_dob(a: str, b: str) -> Column:
    """Equal dates; a year alone equals any date of the year."""
    return F.when((F.length(a) == 4) | (F.length(b) == 4), F.substring(a, 1, 4) == F.substring(b, 1, 4)).otherwise(F.col(a) == F.col(b))


#: What makes two cases one person's.
PERSON = ("last4", "birth_year", "dob", "c_name")


def near_candidates(persons: DataFrame) -> DataFrame:
    """Pairs (the second's columns begin with o_) of distinct persons that share digits, year and a name with at most one letter left out.

    Names at most one edit apart share such a form, so none is missed, and a block of many persons with unlike names has no pairs.
    """
    left_out = F.transform(F.sequence(F.lit(0), F.length("c_name")), lambda i: F.xxhash64(F.concat(F.substr("c_name", F.lit(1), i - 1), F.substr("c_name", i + 1))))
    forms = persons.where("c_name IS NOT NULL").withColumn("form", F.explode(F.array_distinct(left_out)))
    other = forms.select("last4", "birth_year", "form", F.col("dob").alias("o_dob"), F.col("c_name").alias("o_c_name"))
    return forms.join(other, ["last4", "birth_year", "form"]).where(F.struct("dob", "c_name") < F.struct("o_dob", "o_c_name")).drop("form")


def near_persons(persons: DataFrame) -> DataFrame:
    """Pairs of distinct persons whose dates agree and whose names are at most one edit apart, each once."""
    pairs = near_candidates(persons).where(same_dob("dob", "o_dob") & (F.levenshtein("c_name", "o_c_name") <= 1)).distinct()
    return pairs.withColumns({"o_last4": F.col("last4"), "o_birth_year": F.col("birth_year")})


@query("join_duplicate_blocked", f"""WITH {CASES} SELECT a.case_id AS case_id, b.case_id AS other_id FROM cases a JOIN cases b ON a.last4 = b.last4 AND a.birth_year = b.birth_year AND b.case_id < a.case_id
 AND (a.dob = b.dob OR ((length(a.dob) = 4 OR length(b.dob) = 4) AND substr(a.dob, 1, 4) = substr(b.dob, 1, 4)))
 JOIN customer ca ON ca.c_custkey = a.applicant_id JOIN customer cb ON cb.c_custkey = b.applicant_id AND levenshtein(ca.c_name, cb.c_name) <= 1
 WHERE NOT a.historical AND NOT b.historical""")
def join_duplicate_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspected duplicates among earlier cases: cases of one person, and of persons of equal digits, agreeing dates and names at most one edit apart."""
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("applicant_id"), "c_name")
    a = cases(spark, sf_dir).where("NOT historical AND last4 IS NOT NULL").select("case_id", "applicant_id", *PERSON[:3]).join(named, "applicant_id").select("case_id", *PERSON)
    b = a.withColumnRenamed("case_id", "other_id")
    own = a.join(b, list(PERSON)).where("other_id < case_id").select("case_id", "other_id")
    there = b.withColumnsRenamed({c: f"o_{c}" for c in PERSON})
    near = near_persons(a.select(*PERSON).distinct()).join(a, list(PERSON)).join(there, [f"o_{c}" for c in PERSON])
    return own.unionByName(near.select(F.greatest("case_id", "other_id").alias("case_id"), F.least("case_id", "other_id").alias("other_id")))


@query("join_full_outer_verify", f"""WITH {AUDIT}, sealed AS (SELECT audit_id, action AS sealed_action FROM audit_log WHERE audit_id % 17 <> 0 AND audit_id <= (SELECT max(audit_id) * 9 // 10 FROM audit_log) UNION ALL SELECT -1, 'ghost'),
now AS (SELECT audit_id, CASE WHEN audit_id % 501 = 0 THEN 'edited' ELSE action END AS action FROM audit_log WHERE audit_id % 333 <> 0), head AS (SELECT max(audit_id) AS head FROM sealed)
SELECT problem, count(*) AS n FROM (SELECT CASE WHEN n.audit_id IS NULL THEN 'deleted' WHEN s.audit_id IS NULL AND n.audit_id <= head THEN 'inserted' WHEN s.audit_id IS NULL THEN 'unsealed' WHEN n.action <> s.sealed_action THEN 'modified' ELSE 'ok' END AS problem
FROM now n FULL OUTER JOIN sealed s ON n.audit_id = s.audit_id, head) GROUP BY problem""")
def join_full_outer_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against what was sealed of them: modified, deleted, inserted up to the last sealed row, or not sealed yet."""
    log = audit_log(spark, sf_dir)
    last = log.agg(F.max("audit_id")).scalar()  # part of the plan, as the head below: nothing runs while the query is built
    sealed = log.where((F.col("audit_id") % 17 != 0) & (F.col("audit_id") <= F.floor(last * 9 / 10))).select("audit_id", F.col("action").alias("sealed_action")).union(spark.sql("SELECT -1L, 'ghost'"))
    head = sealed.agg(F.max("audit_id")).scalar()
    now = log.where("audit_id % 333 <> 0").select("audit_id", F.when(F.col("audit_id") % 501 == 0, "edited").otherwise(F.col("action")).alias("action"), F.lit(True).alias("here"))
    both = now.join(sealed.withColumn("there", F.lit(True)), "audit_id", "full_outer")
    problem = F.when(F.col("here").isNull(), "deleted").when(F.col("there").isNull() & (F.col("audit_id") <= head), "inserted").when(F.col("there").isNull(), "unsealed").when(F.col("action") != F.col("sealed_action"), "modified").otherwise("ok")
    return both.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))


@query("join_rescreen_merge", f"""WITH {FLAGS}, prev AS (SELECT case_id, code, max(resolution) AS resolution FROM flags WHERE seq <= 3 GROUP BY case_id, code), fresh AS (SELECT DISTINCT case_id, code FROM flags WHERE seq >= 2)
SELECT f.case_id, f.code, coalesce(p.resolution, 'OPEN') AS resolution FROM fresh f LEFT JOIN prev p ON f.case_id = p.case_id AND f.code = p.code""")
def join_rescreen_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new screening keeps the resolutions of findings that come again; the rest are open."""
    f = flags(spark, sf_dir)
    before = f.where("seq <= 3").groupBy("case_id", "code").agg(F.max("resolution").alias("resolution"))
    return f.where("seq >= 2").select("case_id", "code").distinct().join(before, ["case_id", "code"], "left").select("case_id", "code", F.coalesce("resolution", F.lit("OPEN")).alias("resolution"))


@query("join_evidence_document", f"""WITH {EXTRACTIONS} SELECT document_id, seq FROM (SELECT document_id, seq, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN output_tokens > 50 THEN 0 ELSE 1 END, seq) AS r FROM extractions) WHERE r = 1""")
def join_evidence_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image to show for a finding: one that has the field if any does, else the first."""
    w = Window.partitionBy("document_id").orderBy((F.col("output_tokens") <= 50).cast("int"), "seq")
    return extractions(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r = 1").select("document_id", "seq")
