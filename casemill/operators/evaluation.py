"""Evaluation: accuracy by group, calibration, fairness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators.names_queries import match_names, none_known
from casemill.plans.registry import query
from casemill.sources.views import literal

def fairness(pairs: DataFrame, group: str) -> DataFrame:
    """pairs has the group, verdict, and same (null where the label is unclear)."""
    outcome = F.when(F.col("verdict") == "AMBIGUOUS", "referred").when(F.col("same").isNull(), "unscored").when(F.col("same") == F.col("verdict").isin("SAME", "LIKELY_SAME"), "correct").when(F.col("verdict").isin("SAME", "LIKELY_SAME"), "false_match").otherwise("false_non_match")
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    decided = n("correct", "false_match", "false_non_match")
    by = pairs.withColumn("outcome", outcome).rollup(group).agg(
        F.count("*").alias("pairs"), decided.alias("decided"), n("correct").alias("correct"), n("false_match").alias("false_matches"), n("false_non_match").alias("false_non_matches"), n("referred").alias("referred"), n("unscored").alias("unscored"),
        F.round(F.when(decided == 0, 1.0).otherwise(n("correct") / decided), 6).alias("accuracy"), F.round(n("referred") / F.count("*"), 6).alias("referral_rate"),
    )
    return by.withColumn(group, F.coalesce(group, F.lit("All")))


# Labelled pairs of names by community, whether they name one person (null: unclear), and the outcome that the rules give.
PAIRS = (
    ("Meitei", "Okram Ibochou Singh", "Okram Ibochou", True, "correct"), ("Meitei", "Laishram Sanahal Meitei", "Laishram Sanahal Singh", True, "correct"), ("Meitei", "W. Jiten Singh", "Wangkhem Jiten Singh", True, "correct"),
    ("Meitei", "Kh. Bimol Singh", "Khumanthem Bimol Singh", True, "referred"), ("Meitei", "Yumnam Nandini Devi", "Yumnam Nandinee Debi", True, "correct"), ("Meitei", "Okram Sanatombi Devi", "Okram Sanatomba Singh", False, "correct"),
    ("Meitei", "Thangjam Ratan Singh", "Thokchom Ratan Singh", False, "correct"), ("Meitei", "Laishram Ongbi Memcha Devi", "Yumnam Memcha Devi", None, "referred"),
    ("Naga", "R. Muivah Shangreiphao", "Muivah Shangreiphao", True, "correct"), ("Naga", "Muivah Ningreingam", "Ningreingam Muivah", True, "correct"), ("Naga", "Muivah Chihanpam", "Muivah Pamreishang", False, "correct"),
    ("Kuki-Zo", "Gangte Lalrinpuia", "Lalrinpuia Gangte", True, "correct"), ("Kuki-Zo", "Lalthansang Gangte", "Lalbiakzuala Gangte", False, "correct"), ("Kuki-Zo", "Paominlun Gangte", "Paominlun", True, "correct"),
    ("Pangal", "Md. Rafiuddin Khan", "Mohd Rafiuddin Khan", True, "correct"), ("Pangal", "Nasima Begum", "Naseema Bibi", True, "correct"), ("Pangal", "Md. Salim Khan", "Md. Kalimuddin Khan", False, "correct"), ("Pangal", "Begum", "Sahida Begum", None, "unscored"),
    ("Nepali", "Bishnu Prasad Thapa", "Bisnu Prasad Thapa", True, "correct"), ("Nepali", "B.P. Thapa", "Bishnu Prasad Thapa", True, "correct"), ("Nepali", "Maya Thapa", "Mina Thapa", False, "correct"),
)
PAIR_ROWS, PAIRS_SQL = literal([p for p in PAIRS], "community string, a string, b string, same boolean, wanted string")


@query("eval_name_fairness", f"""WITH o AS (SELECT community, wanted AS outcome FROM {PAIRS_SQL})
SELECT coalesce(community, 'All') AS community, count(*) AS pairs, count(*) FILTER (WHERE outcome IN ('correct', 'false_match', 'false_non_match')) AS decided, count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'false_match') AS false_matches,
count(*) FILTER (WHERE outcome = 'false_non_match') AS false_non_matches, count(*) FILTER (WHERE outcome = 'referred') AS referred, count(*) FILTER (WHERE outcome = 'unscored') AS unscored,
round(CASE WHEN count(*) FILTER (WHERE outcome IN ('correct', 'false_match', 'false_non_match')) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE outcome = 'correct') / count(*) FILTER (WHERE outcome IN ('correct', 'false_match', 'false_non_match'))::DOUBLE END, 6) AS accuracy,
round(count(*) FILTER (WHERE outcome = 'referred') / count(*)::DOUBLE, 6) AS referral_rate FROM o GROUP BY ROLLUP(community)""")
def eval_name_fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matcher's verdicts on labelled pairs, by community and overall."""
    judged = PAIR_ROWS(spark).withColumn("m", match_names("a", "b", none_known())).select("community", "same", F.col("m.verdict").alias("verdict"))
    return fairness(judged, "community")
