"""Scans, projections and predicates over cases and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.plans.registry import query
from casemill.sources.views import CASES, FLAGS, NOW_MS, audit_log, cases, flags, table, with_district

NOTICE_CODES = ("EXTRACTION_FAILED", "AADHAAR_FORM_CARD_MISMATCH")


def in_force() -> Column:
    return F.col("resolution") != "OVERRIDDEN"


def blocking() -> Column:
    """Critical and not overridden, or a warning that is still open."""
    return ((F.col("severity") == "critical") & in_force()) | ((F.col("severity") == "warn") & (F.col("resolution") == "OPEN"))


def notice_relevant() -> Column:
    return in_force() & ((F.col("action") == "citizen") | ((F.col("resolution") == "ACCEPTED") & F.col("code").isin(*NOTICE_CODES)))


def optional(df: DataFrame, **values: object) -> DataFrame:
    """Equality filters on those columns whose value is given; an unknown status is ignored."""
    for name, value in values.items():
        if value is None or name == "status" and value not in ("READY", "NEEDS_CITIZEN_CORRECTION", "OFFICER_ATTENTION", "APPROVED"):
            continue
        df = df.where(F.col(name) == value)
    return df


@query("scan_project_prune", f"WITH {CASES} SELECT case_id, reference, priority, received_ms FROM cases WHERE priority >= 80")
def scan_project_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir, "o_orderpriority < '3'").where("priority >= 80").select("case_id", "reference", "priority", "received_ms")


@query("scan_keyed_lookup", f"WITH {CASES} SELECT case_id, status, district FROM cases WHERE case_id = 77")
def scan_keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_district(cases(spark, sf_dir).where("case_id = 77"), sf_dir).select("case_id", "status", "district")


@query("scan_case_summary", f"""WITH {CASES} SELECT case_id, 'XXXX XXXX ' || last4 AS masked_id, CAST(2001 - birth_year AS INT) AS years, screened_ms - received_ms AS screening_ms,
 status = 'APPROVED' AS approved FROM cases WHERE NOT historical""")
def scan_case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir).where(~F.col("historical"))
    masked = F.concat(F.lit("XXXX XXXX "), "last4")  # null without digits
    return c.select("case_id", masked.alias("masked_id"), (2001 - F.col("birth_year")).alias("years"), (F.col("screened_ms") - F.col("received_ms")).alias("screening_ms"), (F.col("status") == "APPROVED").alias("approved"))


@query("filter_in_force", f"WITH {FLAGS} SELECT case_id, seq, part, code FROM flags WHERE resolution <> 'OVERRIDDEN' AND severity = 'critical'")
def filter_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).where(in_force() & (F.col("severity") == "critical")).select("case_id", "seq", "part", "code")


@query("filter_blocking", f"WITH {FLAGS} SELECT case_id, seq, part, code FROM flags WHERE (severity = 'critical' AND resolution <> 'OVERRIDDEN') OR (severity = 'warn' AND resolution = 'OPEN')")
def filter_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).where(blocking()).select("case_id", "seq", "part", "code")


@query("filter_notice_relevant", f"WITH {FLAGS} SELECT case_id, seq, part, code FROM flags WHERE resolution <> 'OVERRIDDEN' AND (action = 'citizen' OR (resolution = 'ACCEPTED' AND code IN ('EXTRACTION_FAILED', 'AADHAAR_FORM_CARD_MISMATCH')))")
def filter_notice_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).where(notice_relevant()).select("case_id", "seq", "part", "code")


@query("filter_optional", f"WITH {CASES} SELECT case_id, reference FROM cases WHERE batch_id = 'b7' AND historical = FALSE")
def filter_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optional(cases(spark, sf_dir), status="REJECTED", batch_id="b7", historical=False).select("case_id", "reference")


@query("filter_array_any", f"""WITH {CASES}, r AS (SELECT case_id, list_filter([CASE WHEN birth_year <= 1921 THEN 'Aged 80 or over' END, CASE WHEN case_id % 3 = 0 THEN 'Widowed' END, CASE WHEN case_id % 7 = 0 THEN 'Displaced' END], lambda x: x IS NOT NULL) AS reasons FROM cases)
SELECT case_id, array_to_string(reasons, '; ') AS reasons FROM r WHERE len(list_filter(reasons, lambda x: starts_with(x, 'Aged') OR x = 'Displaced')) > 0""")
def filter_array_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array(F.when(F.col("birth_year") <= 1921, "Aged 80 or over"), F.when(F.col("case_id") % 3 == 0, "Widowed"), F.when(F.col("case_id") % 7 == 0, "Displaced"))
    c = cases(spark, sf_dir).select("case_id", F.array_compact(reasons).alias("reasons"))
    return c.where(F.exists("reasons", lambda x: x.startswith("Aged") | (x == "Displaced"))).select("case_id", F.array_join("reasons", "; ").alias("reasons"))


@query("filter_like_prefix", f"WITH {CASES} SELECT reference FROM cases WHERE reference LIKE 'CM-1998-%'")
def filter_like_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_year = "o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'"
    return cases(spark, sf_dir, in_year).where(F.col("reference").startswith("CM-1998-")).select("reference")


@query("filter_in_list", f"WITH {CASES} SELECT case_id, district FROM cases WHERE district IN ('NATION_1', 'NATION_3')")
def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_district(cases(spark, sf_dir), sf_dir).where(F.col("district").isin("NATION_1", "NATION_3")).select("case_id", "district")


@query("filter_null", f"WITH {CASES} SELECT case_id FROM cases WHERE last4 IS NOT NULL AND screened_ms IS NULL")
def filter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).where("last4 IS NOT NULL AND screened_ms IS NULL").select("case_id")


@query("filter_substring_ci", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')")
def filter_substring_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lower(F.lit("RED")))).select("p_partkey", "p_name")


@query("filter_range", f"WITH {CASES} SELECT case_id, decided_ms FROM cases WHERE decided_ms <= {NOW_MS} - CAST(365 AS BIGINT) * 86400000")
def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a decision comes a day after receipt at the earliest, and only on closed orders: what the reader can check
    decided = f"o_orderstatus = 'F' AND o_orderdate < timestamp_millis({NOW_MS - 365 * 86_400_000})"
    return cases(spark, sf_dir, decided).where(F.col("decided_ms") <= NOW_MS - 365 * 86_400_000).select("case_id", "decided_ms")


@query("filter_junk_path", "SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '(^|/)(\\.|__MACOSX(/|$)|(?i:thumbs\\.db|desktop\\.ini)$)')")
def filter_junk_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden, archive and system files have no place among uploads."""
    return table(spark, sf_dir, "pages").where(~F.col("url").rlike(r"(^|/)(\.|__MACOSX(/|$)|(?i:thumbs\.db|desktop\.ini)$)")).select("page_id", "url")


@query("filter_event_match", "SELECT event_id, event_type FROM events WHERE (event_type = 'signup') OR (event_id % 500 = 42)")
def filter_event_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events pass whatever case is asked for."""
    return audit_log(spark, sf_dir).where((F.col("action") == "signup") | (F.col("case_id") == 42)).select(F.col("audit_id").alias("event_id"), F.col("action").alias("event_type"))
