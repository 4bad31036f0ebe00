"""Window behaviours: links to the row before, sequence numbers, strictly rising times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.plans.registry import query
from casemill.sources.shared import materialize, prefix_sums, temporaries
from casemill.sources.views import AUDIT, CASES, audit_log, cases


@query("win_lag_chain", f"WITH {AUDIT} SELECT case_id, audit_id, coalesce(lag(action) OVER (PARTITION BY case_id ORDER BY audit_id), 'genesis') AS previous FROM audit_log")
def win_lag_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("action", 1, "genesis").over(Window.partitionBy("case_id").orderBy("audit_id"))
    return audit_log(spark, sf_dir).select("case_id", "audit_id", before.alias("previous"))


@query("win_sequence_number", f"""WITH {CASES} SELECT case_id, concat(substr(reference, 4, 4), '-', lpad(CAST(row_number() OVER (PARTITION BY substr(reference, 4, 4), batch_id ORDER BY case_id) AS VARCHAR), 4, '0')) AS number FROM cases""")
def win_sequence_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next number within a year and batch, padded to four digits."""
    year = F.substring("reference", 4, 4)
    n = F.row_number().over(Window.partitionBy(year, "batch_id").orderBy("case_id"))
    return cases(spark, sf_dir).select("case_id", F.concat(year, F.lit("-"), F.lpad(n.cast("string"), 4, "0")).alias("number"))


def allotted(asking: DataFrame, taken: DataFrame, group: str, order: list[str]) -> DataFrame:
    """asking with number: in each group the free numbers from one more than the count of those taken, in order, taken ones skipped.

    asking has the group and a unique order; taken has the group and number. The i-th free number is found without trying numbers one by one:
    a taken number beyond the start moves up all that would fall on it or after it, and how many move is a running count in one global order
    of wishes and taken numbers together, so that a group with most of the rows isn't one task's.
    """
    with temporaries(asking.sparkSession, "allotted"):
        groups = taken.groupBy(group).agg(F.count("*").alias("__start"))
        beyond = taken.distinct().join(groups, group).where(F.col("number") > F.col("__start"))
        # the j-th taken number beyond the start, t, stands after t - start - j free ones: wishes of a higher rank move up by one more
        one = F.lit(1)
        in_order = materialize(prefix_sums(beyond.select(group, "number", "__start"), [F.col(group), F.col("number")], {"__all": one}, "taken-order"), "taken-ranked")
        first_taken = in_order.groupBy(group).agg((F.min("__all") - 1).alias("__before"))
        free_before = F.col("number") - F.col("__start") - (F.col("__all") - F.col("__before"))
        walls = in_order.join(first_taken, group).select(group, free_before.alias("__rank"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__at"))
        wishes = materialize(prefix_sums(asking, [F.col(group), *[F.col(c) for c in order]], {"__all": one}, "wish-order"), "wishes")
        first_wish = wishes.groupBy(group).agg((F.min("__all") - 1).alias("__before"))
        ranked = materialize(wishes.join(first_wish, group).withColumn("__rank", F.col("__all") - F.col("__before")).drop("__before"), "wishes-ranked")
        both = walls.unionByName(ranked.select(group, "__rank", F.lit(0).alias("__kind"), F.col("__all").alias("__at")))
        moved = prefix_sums(both, [F.col(group), F.col("__rank"), F.col("__kind"), F.coalesce("__at", F.lit(0))], {"__walls": F.col("__kind").cast("long")}, "merged-order")
        moved = materialize(moved, "merged")
        none_yet = moved.groupBy(group).agg(F.min(F.col("__walls") - F.col("__kind").cast("long")).alias("__none"))
        up = moved.where("__kind = 0").join(none_yet, group).select(F.col("__at").alias("__all"), (F.col("__walls") - F.col("__none")).alias("__up"))
        out = ranked.join(up, "__all").join(groups, group, "left")
        numbered = out.withColumn("number", F.coalesce("__start", F.lit(0)) + F.col("__rank") + F.col("__up"))
        return materialize(numbered.select(*asking.columns, "number"), "allotted")


_TAKEN = "SELECT substr(reference, 4, 4) AS year, ((case_id * 13) % 4000) + 1 AS number FROM cases WHERE case_id % 4 = 0"


@query("win_numbers_allotted", f"""WITH RECURSIVE {CASES}, taken AS (SELECT DISTINCT year, number FROM ({_TAKEN})), s AS (SELECT year, count(*) AS start FROM ({_TAKEN}) GROUP BY year),
a AS (SELECT case_id, substr(reference, 4, 4) AS year, row_number() OVER (PARTITION BY substr(reference, 4, 4) ORDER BY case_id) AS r FROM cases WHERE case_id % 4 = 1),
most AS (SELECT a.year, coalesce(any_value(s.start), 0) AS start, count(*) + (SELECT count(*) FROM taken t WHERE t.year = a.year) AS n FROM a LEFT JOIN s ON s.year = a.year GROUP BY a.year),
free AS (SELECT m.year, n.n, row_number() OVER (PARTITION BY m.year ORDER BY n.n) AS r FROM (SELECT year, unnest(range(start + 1, start + n + 1)) AS n FROM most) n JOIN most m ON m.year = n.year WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.year = n.year AND t.number = n.n))
SELECT a.case_id, a.year, f.n AS number FROM a JOIN free f ON f.year = a.year AND f.r = a.r""")
def win_numbers_allotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a year for new cases, from one more than the count of those given, numbers in use skipped."""
    c = cases(spark, sf_dir).withColumn("year", F.substring("reference", 4, 4))
    taken = c.where("case_id % 4 = 0").select("year", ((F.col("case_id") * 13) % 4000 + 1).alias("number"))
    return allotted(c.where("case_id % 4 = 1").select("case_id", "year"), taken, "year", ["case_id"])


@query("win_monotonic_ts", f"WITH {CASES} SELECT case_id, received_ms + row_number() OVER (PARTITION BY batch_id, received_ms ORDER BY case_id) - 1 AS at_ms FROM cases")
def win_monotonic_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a batch with one time get strictly rising times."""
    offset = F.row_number().over(Window.partitionBy("batch_id", "received_ms").orderBy("case_id")) - 1
    return cases(spark, sf_dir).select("case_id", (F.col("received_ms") + offset).alias("at_ms"))


@query("win_first_two", f"WITH {AUDIT} SELECT case_id, audit_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY value DESC, audit_id) AS r FROM audit_log WHERE action = 'error') WHERE r <= 2")
def win_first_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("value").desc(), "audit_id"))
    return audit_log(spark, sf_dir).where("action = 'error'").withColumn("r", r).where("r <= 2").select("case_id", "audit_id")


@query("win_tumbling_rate", f"WITH {AUDIT} SELECT actor, audit_id // 1000 AS slot, count(*) AS n, count(*) > 10 AS limited FROM audit_log GROUP BY actor, slot")
def win_tumbling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of each actor in fixed slots, and whether the limit of ten is passed."""
    slot = F.floor(F.col("audit_id") / 1000).alias("slot")
    return audit_log(spark, sf_dir).groupBy("actor", slot).agg(F.count("*").alias("n")).withColumn("limited", F.col("n") > 10)


@query("win_lockout", f"""WITH {AUDIT}, e AS (SELECT actor, audit_id, action, count(*) FILTER (WHERE action = 'signup') OVER (PARTITION BY actor ORDER BY audit_id) AS run FROM audit_log WHERE action IN ('error', 'signup'))
SELECT actor, run, count(*) FILTER (WHERE action = 'error') AS failures, count(*) FILTER (WHERE action = 'error') >= 3 AS locked FROM e GROUP BY actor, run""")
def win_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row since the last success of each actor; three lock the actor out."""
    run = F.count_if(F.col("action") == "signup").over(Window.partitionBy("actor").orderBy("audit_id"))
    e = audit_log(spark, sf_dir).where(F.col("action").isin("error", "signup")).withColumn("run", run)
    return e.groupBy("actor", "run").agg(F.count_if(F.col("action") == "error").alias("failures")).withColumn("locked", F.col("failures") >= 3)
