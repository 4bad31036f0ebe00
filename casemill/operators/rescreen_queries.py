"""Queries of screening anew: every order's typed case as it was read first, and as its stored replies say later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators import readings
from casemill.operators.casefile import screened as screened_again
from casemill.operators.rescreen import DECISION, blocking, carried, flag_key, refreshed
from casemill.operators.screen_queries import _SQL, FLAG_ROWS, RULES, screened
from casemill.plans.registry import query
from casemill.sources.shared import shuffled

_RESOLVED = "CASE (case_id + place) % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ACCEPTED' ELSE 'OVERRIDDEN' END"
_KEY = "concat(code, '|', array_to_string(list_sort(regexp_extract_all(evidence, '(?:^|;)((?:form|card|passbook|epic)\\.[a-z0-9_]+)=', 1)), ','))"
_BOTH = f"""before AS (SELECT case_id, {_KEY} AS flag_key, arg_max({_RESOLVED}, place) AS resolution FROM (WITH {_SQL} {FLAG_ROWS}) GROUP BY ALL),
later AS (SELECT *, {_KEY} AS flag_key FROM (WITH {readings.FOUND} {FLAG_ROWS})),
kept AS (SELECT l.*, coalesce(b.resolution, 'OPEN') AS resolution FROM later l LEFT JOIN before b ON b.case_id = l.case_id AND b.flag_key = l.flag_key)"""


def _rows(screened_: DataFrame) -> DataFrame:
    return screened_.select("case_id", F.posexplode("flags").alias("place", "f")).select("case_id", "place", "f.*")


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the second screening with the decisions on the first one's."""
    before = _rows(screened(spark, sf_dir)).withColumn("flag_key", flag_key(F.col("code"), F.col("evidence"))).withColumn("resolution", F.expr(_RESOLVED))
    for c in DECISION[1:]:
        before = before.withColumn(c, F.lit(None).cast("timestamp" if c == "resolved_at" else "string"))
    again = screened_again(readings.cases(spark, sf_dir), readings.images(spark, sf_dir), readings.calls(spark, sf_dir), RULES)
    return carried(_rows(again), before)


@query("rescreen_carried", f"WITH {_BOTH} SELECT case_id, place, code, flag_key, resolution FROM kept")
def rescreen_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of a second screening, with the decision on the same finding of the first: same code about the same fields."""
    return _kept(spark, sf_dir).select("case_id", F.col("place").cast("long").alias("place"), "code", "flag_key", "resolution")


@query("rescreen_status", f"""WITH {_BOTH}, s AS (SELECT case_id, bool_or(code = 'DUPLICATE_SUSPECTED' AND resolution <> 'OVERRIDDEN') AS doubled, bool_or(action = 'citizen' AND severity = 'critical' AND resolution <> 'OVERRIDDEN') AS correct, bool_or(action <> 'none' AND resolution <> 'OVERRIDDEN') AS any_,
 count(*) FILTER (WHERE (severity = 'critical' AND resolution <> 'OVERRIDDEN') OR (severity = 'warn' AND resolution = 'OPEN')) AS n_blocking FROM kept GROUP BY case_id)
SELECT case_id, CASE WHEN correct AND NOT doubled THEN 'NEEDS_CITIZEN_CORRECTION' WHEN any_ THEN 'OFFICER_ATTENTION' ELSE 'READY' END AS status, n_blocking FROM s""")
def rescreen_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every case with findings by what stands after the second screening, and how many findings are in the way of an approval."""
    kept = _kept(spark, sf_dir)
    return refreshed(kept).join(shuffled(blocking(kept).groupBy("case_id").agg(F.count("*").alias("n_blocking"))), "case_id", "left").na.fill(0, ["n_blocking"])
