"""Screening rules over one row of readings a case, one finding a step; screen.py has them with evidence, for each document and field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.plans.registry import query
from casemill.sources.views import CASES, FLAGS, cases, flags

MIN_AGE, CEILING, CONFIDENT = 60, 60_000, 0.75
#: Typed readings of a case, as expressions over the cases view that Spark and DuckDB both read.
READINGS = {
    "form_present": "case_id % 31 <> 0",
    "card_present": "case_id % 29 <> 0",
    "passbook_ok": "case_id % 23 <> 0",
    "epic_present": "case_id % 2 = 0",
    "name_value": "CASE WHEN case_id % 19 <> 0 THEN 'x' END",
    "name_conf": "CASE WHEN case_id % 8 = 0 THEN 0.4 ELSE 0.95 END",
    "dob_value": "CASE WHEN case_id % 17 <> 0 THEN dob END",
    "dob_conf": "CASE WHEN case_id % 12 = 0 THEN 0.3 ELSE 0.95 END",
    "card_dob": "CASE WHEN case_id % 14 = 0 THEN '1901-01-01' ELSE dob END",
    "income_value": "CASE WHEN case_id % 21 <> 0 THEN income / 4 END",
    "income_conf": "CASE WHEN case_id % 10 = 0 THEN 0.4 ELSE 0.8 END",
    "checksum_valid": "CASE WHEN case_id % 6 = 0 THEN NULL ELSE case_id % 13 <> 0 END",
    "ifsc_valid": "case_id % 15 <> 0",
    "epic_valid": "case_id % 18 <> 0",
    "form_last4": "last4",
    "card_last4": "CASE WHEN case_id % 22 = 0 THEN '9999' ELSE last4 END",
    "signed": "CASE WHEN case_id % 16 <> 0 THEN TRUE WHEN case_id % 32 = 0 THEN FALSE END",
    "accounts_differ": "case_id % 26 = 0",
}
AGE = "(2001 - CAST(substr(dob_value, 1, 4) AS INT) - CASE WHEN length(dob_value) > 4 AND '09-01' < substr(dob_value, 6, 5) THEN 1 WHEN length(dob_value) = 4 THEN 1 ELSE 0 END)"
DOBS_DIFFER = "(CASE WHEN length(dob_value) = 4 OR length(card_dob) = 4 THEN substr(dob_value, 1, 4) <> substr(card_dob, 1, 4) ELSE dob_value <> card_dob END)"
#: (code, severity, action, condition) in the order of the screening steps.
STEPS = (
    ("MISSING_DOCUMENT", "critical", "citizen", "NOT form_present OR NOT card_present"),
    ("OPTIONAL_DOCUMENT_NOT_PROVIDED", "info", "none", "NOT epic_present"),
    ("EXTRACTION_FAILED", "warn", "officer", "NOT passbook_ok"),
    ("MISSING_FIELD", "critical", "citizen", f"(name_value IS NULL AND name_conf >= {CONFIDENT}) OR (dob_value IS NULL AND dob_conf >= {CONFIDENT}) OR (income_value IS NULL AND income_conf >= {CONFIDENT})"),
    ("LOW_CONFIDENCE", "warn", "officer", f"name_conf < {CONFIDENT} OR dob_conf < {CONFIDENT} OR income_conf < {CONFIDENT}"),
    ("AADHAAR_CHECKSUM_INVALID", "critical", "officer", "card_present AND checksum_valid = FALSE"),
    ("IFSC_INVALID", "critical", "citizen", "NOT ifsc_valid"),
    ("EPIC_FORMAT_INVALID", "warn", "officer", "epic_present AND NOT epic_valid"),
    ("AADHAAR_FORM_CARD_MISMATCH", "warn", "officer", "form_last4 IS NOT NULL AND card_last4 IS NOT NULL AND form_last4 <> card_last4"),
    ("MISSING_SIGNATURE", "critical", "citizen", "signed = FALSE"),
    ("BANK_DETAILS_MISMATCH", "critical", "citizen", "passbook_ok AND accounts_differ"),
    ("DOB_MISMATCH", "critical", "citizen", f"dob_conf >= {CONFIDENT} AND {DOBS_DIFFER}"),
    ("AGE_BELOW_MINIMUM", "critical", "officer", f"dob_conf >= {CONFIDENT} AND {AGE} < {MIN_AGE}"),
    ("DOB_YEAR_ONLY", "info", "none", f"dob_conf >= {CONFIDENT} AND length(dob_value) = 4"),
    ("INCOME_ABOVE_CEILING", "critical", "officer", f"income_conf >= {CONFIDENT} AND income_value > {CEILING}"),
)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    return c.select("case_id", *[F.expr(v).alias(k) for k, v in READINGS.items()])


def findings(typed: DataFrame) -> DataFrame:
    """typed with flags: an array of (step, code, severity, action), in the order of the steps, in one pass over the row."""
    each = [F.when(F.expr(test), F.struct(F.lit(i).alias("step"), F.lit(c).alias("code"), F.lit(s).alias("severity"), F.lit(a).alias("action"))) for i, (c, s, a, test) in enumerate(STEPS)]
    return typed.withColumn("flags", F.array_compact(F.array(*each)))


def status(flags_: Column) -> Column:
    """A suspected duplicate keeps the citizen out; a critical finding for the citizen asks for a correction; any other finding needs an officer."""
    duplicate = F.exists(flags_, lambda f: f["code"] == "DUPLICATE_SUSPECTED")
    citizen = F.exists(flags_, lambda f: (f["action"] == "citizen") & (f["severity"] == "critical"))
    any_ = F.exists(flags_, lambda f: f["action"].isin("officer", "citizen"))
    return F.when(citizen & ~duplicate, "NEEDS_CITIZEN_CORRECTION").when(any_, "OFFICER_ATTENTION").otherwise("READY")


_READ = f"typed AS (SELECT case_id, {', '.join(f'{v} AS {k}' for k, v in READINGS.items())} FROM cases)"
_FOUND = "found AS (" + " UNION ALL ".join(f"SELECT case_id, {i} AS step, '{c}' AS code, '{s}' AS severity, '{a}' AS action FROM typed WHERE {t}" for i, (c, s, a, t) in enumerate(STEPS)) + ")"


@query("rule_screen_flags", f"WITH {CASES}, {_READ}, {_FOUND} SELECT case_id, step, code, severity, action FROM found")
def rule_screen_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(readings(spark, sf_dir)).select("case_id", F.explode("flags").alias("f"))
    return f.select("case_id", "f.step", "f.code", "f.severity", "f.action")


@query("rule_status", f"""WITH {CASES}, {_READ}, {_FOUND}, s AS (SELECT case_id, bool_or(action = 'citizen' AND severity = 'critical') AS citizen, bool_or(action <> 'none') AS any_ FROM found GROUP BY case_id)
SELECT t.case_id, CASE WHEN s.citizen THEN 'NEEDS_CITIZEN_CORRECTION' WHEN s.any_ THEN 'OFFICER_ATTENTION' ELSE 'READY' END AS status FROM typed t LEFT JOIN s ON t.case_id = s.case_id""")
def rule_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(readings(spark, sf_dir)).select("case_id", status(F.col("flags")).alias("status"))


@query("rule_notice_eligible", f"""WITH {FLAGS}, g AS (SELECT case_id, bool_or(code = 'DUPLICATE_SUSPECTED' AND resolution <> 'OVERRIDDEN') AS dup, bool_or(action = 'citizen' AND resolution <> 'OVERRIDDEN') AS citizen FROM flags GROUP BY case_id)
SELECT case_id, citizen AND NOT dup AS allowed, CASE WHEN dup THEN 'DUPLICATE_SUSPECTED' ELSE '' END AS blocked_by FROM g""")
def rule_notice_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the findings in force: a notice may go out if something is asked of the citizen and no duplicate is suspected, which is what blocks it."""
    force = F.col("resolution") != "OVERRIDDEN"
    g = flags(spark, sf_dir).groupBy("case_id").agg(F.some((F.col("code") == "DUPLICATE_SUSPECTED") & force).alias("dup"), F.some((F.col("action") == "citizen") & force).alias("citizen"))
    return g.select("case_id", (F.col("citizen") & ~F.col("dup")).alias("allowed"), F.when(F.col("dup"), "DUPLICATE_SUSPECTED").otherwise("").alias("blocked_by"))


@query("rule_reroute_lowconf", f"""WITH {CASES}, {_READ}, {_FOUND} SELECT f.case_id, f.step, f.code, CASE WHEN f.action = 'citizen' AND (t.name_conf < {CONFIDENT} OR t.dob_conf < {CONFIDENT}) THEN 'officer' ELSE f.action END AS action FROM found f JOIN typed t ON f.case_id = t.case_id""")
def rule_reroute_lowconf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for the citizen that rests on an unsure reading goes to an officer."""
    unsure = (F.col("name_conf") < CONFIDENT) | (F.col("dob_conf") < CONFIDENT)
    to = F.transform("flags", lambda f: F.when((f["action"] == "citizen") & unsure, f.withField("action", F.lit("officer"))).otherwise(f))
    f = findings(readings(spark, sf_dir)).select("case_id", F.explode(to).alias("f"))
    return f.select("case_id", "f.step", "f.code", "f.action")


@query("rule_approvable", f"""WITH {CASES}, {FLAGS} SELECT c.case_id FROM cases c WHERE c.status = 'READY' AND NOT EXISTS (SELECT 1 FROM flags f WHERE f.case_id = c.case_id AND ((f.severity = 'critical' AND f.resolution <> 'OVERRIDDEN') OR (f.severity = 'warn' AND f.resolution = 'OPEN')))""")
def rule_approvable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases without a blocking finding."""
    block = flags(spark, sf_dir).where("(severity = 'critical' AND resolution <> 'OVERRIDDEN') OR (severity = 'warn' AND resolution = 'OPEN')").select("case_id")
    return cases(spark, sf_dir).where("status = 'READY'").select("case_id").join(block, "case_id", "left_anti")


@query("rule_decisions", f"""WITH e AS (SELECT event_id, user_id AS case_id, event_type FROM events), o AS (SELECT *, count(*) FILTER (WHERE event_type = 'view') OVER (PARTITION BY case_id ORDER BY event_id) AS reopened FROM e), l AS (SELECT case_id, max(reopened) AS r FROM o GROUP BY case_id)
SELECT o.case_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'APPROVED' WHEN bool_or(event_type = 'error') THEN 'OFFICER_ATTENTION' ELSE 'READY' END AS state, count(*) AS steps FROM o JOIN l ON o.case_id = l.case_id AND o.reopened = l.r GROUP BY o.case_id""")
def rule_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's state from its decision events: what has happened since it was last reopened (a view stands for reopening)."""
    from pyspark.sql import Window

    from casemill.sources.views import table

    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("case_id"), "event_type")
    o = e.withColumn("reopened", F.count_if(F.col("event_type") == "view").over(Window.partitionBy("case_id").orderBy("event_id")))
    last = o.groupBy("case_id").agg(F.max("reopened").alias("reopened"))
    state = F.when(F.some(F.col("event_type") == "purchase"), "APPROVED").when(F.some(F.col("event_type") == "error"), "OFFICER_ATTENTION").otherwise("READY")
    return o.join(last, ["case_id", "reopened"]).groupBy("case_id").agg(state.alias("state"), F.count("*").alias("steps"))
