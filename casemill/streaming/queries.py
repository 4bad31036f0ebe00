"""Queries of the streaming operators; each runs its stream to the end of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators.joins import latest
from casemill.plans.registry import query
from casemill.sources.views import AUDIT, AUDIT_COLUMNS
from casemill.streaming.events import REPLAYED, bus, document_progress, events, progress, settle
from casemill.streaming.stateful import lockout, rate_limit, seal_stream


@query("stream_event_filter", "SELECT event_id, event_type FROM events WHERE event_type = 'signup' OR user_id = 42")
def stream_event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).where((F.col("event_type") == "signup") | (F.col("user_id") == 42)).select("event_id", "event_type")
    return settle(s, "append", "filter").select("event_id", "event_type")


@query("stream_tumbling_rate", "SELECT event_type, epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) // 3600000 AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind and hour; a count is given again when it changes, and hours ten minutes behind the latest event are closed and forgotten."""
    s = events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "10 minutes")
    counts = s.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    rows = counts.select("event_type", F.floor(F.unix_seconds(F.col("window.start")) / 3600).alias("hour"), "n")
    return latest(settle(rows, "update", "rates"), ["event_type", "hour"], ["batch"]).select("event_type", "hour", "n")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First arrivals of a pair of user and kind, whenever the second comes: the state holds every pair seen, so it grows with the distinct pairs, not the events."""
    s = events(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return settle(s, "append", "arrivals").select("user_id", "event_type")


@query("stream_progress_fold", """WITH d AS (SELECT user_id, min(event_id) AS done FROM events WHERE event_type = 'purchase' GROUP BY user_id),
a AS (SELECT e.* FROM events e LEFT JOIN d ON e.user_id = d.user_id WHERE d.done IS NULL OR e.event_id <= d.done)
SELECT user_id AS case_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'done' ELSE coalesce(max_by(event_type, event_id) FILTER (WHERE event_type <> 'error'), 'received') END AS stage,
CASE WHEN max_by(event_type, event_id) = 'error' THEN 'error' ELSE 'ok' END AS status, count(*) AS applied FROM a GROUP BY user_id""")
def stream_progress_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = settle(progress(events(spark, sf_dir)), "update", "progress")
    return latest(out, ["case_id"], ["batch"]).select("case_id", "stage", "status", "applied")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_type") != "error").alias("ok"))


_TIMES = "e AS (SELECT user_id AS key, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events)"
_WINDOWS = f"""WITH RECURSIVE {_TIMES}, w AS (SELECT key, i, id, t AS t0, 1 AS n FROM e WHERE i = 1
UNION ALL SELECT e.key, e.i, e.id, CASE WHEN e.t - w.t0 >= 3600 THEN e.t ELSE w.t0 END, CASE WHEN e.t - w.t0 >= 3600 THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1)"""
_LOCKS = f"""WITH RECURSIVE {_TIMES}, f AS (SELECT key, i, id, CASE WHEN ok THEN 0 ELSE 1 END AS run, -1::BIGINT AS until, CASE WHEN ok THEN 'ok' ELSE 'wrong' END AS verdict FROM e WHERE i = 1
UNION ALL SELECT key, i, id, CASE verdict WHEN 'locked' THEN run WHEN 'wrong' THEN run + 1 ELSE 0 END, CASE verdict WHEN 'locks' THEN t + 86400 ELSE until END, verdict FROM
 (SELECT e.key, e.i, e.id, e.t, f.run, f.until, CASE WHEN e.t < f.until THEN 'locked' WHEN e.ok THEN 'ok' WHEN f.run + 1 >= 2 THEN 'locks' ELSE 'wrong' END AS verdict FROM f JOIN e ON e.key = f.key AND e.i = f.i + 1))"""


@query("stream_rate_limit", f"{_WINDOWS} SELECT key, count(*) AS total, count(*) FILTER (WHERE n > 2) AS refused FROM w GROUP BY key")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events an hour for each user, the hour beginning at the first."""
    return latest(settle(rate_limit(_timed(spark, sf_dir), 2, 3600), "update", "limits"), ["key"], ["batch"]).select("key", "total", "refused")


@query("stream_rate_verdicts", f"{_WINDOWS} SELECT key, id, greatest(0, 2 - n) AS remaining, n > 2 AS refused FROM w")
def stream_rate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with what remains of its user's window, and whether it is refused."""
    return rate_limit(_timed(spark, sf_dir), 2, 3600).run("verdicts")[1].select("key", "id", "remaining", "refused")


@query("stream_lockout", f"{_LOCKS} SELECT key, count(*) FILTER (WHERE verdict = 'locks') AS locks, count(*) FILTER (WHERE verdict = 'locked') AS turned_away FROM f GROUP BY key")
def stream_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two failures in a row lock a user out for a day."""
    return latest(settle(lockout(_timed(spark, sf_dir), 2, 86_400), "update", "locks"), ["key"], ["batch"]).select("key", "locks", "turned_away")


@query("stream_lock_verdicts", f"{_LOCKS} SELECT key, id, verdict FROM f")
def stream_lock_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every event under the lock-out."""
    return lockout(_timed(spark, sf_dir), 2, 86_400).run("lock-verdicts")[1].select("key", "id", "verdict")


@query("stream_replay", f"""WITH p AS (SELECT user_id AS case_id, event_id, event_type = 'signup' AS registers, row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) AS pos FROM events),
r AS (SELECT case_id, min(event_id) AS at, min(pos) AS pos FROM p WHERE registers GROUP BY case_id)
SELECT p.case_id, p.event_id, p.event_id < r.at AS replayed FROM p JOIN r ON r.case_id = p.case_id WHERE p.event_id > r.at OR (p.event_id < r.at AND p.pos >= r.pos - {REPLAYED})""")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each case gets that its first signup registers: its own of the topic's last 500 events before, and all its events after."""
    e = events(spark, sf_dir).select((F.col("user_id") % 2).alias("topic"), F.col("user_id").alias("case_id"), "event_id", (F.col("event_type") == "signup").alias("registers"))
    return bus(e)


_OF_DOCUMENT = {"document_id": "event_id % 6", "stage": "event_type", "kind": "CASE WHEN event_id % 3 = 0 THEN concat('k', CAST(event_id % 5 AS STRING)) END", "cache_hit": "CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END", "message": "CASE WHEN event_type = 'error' THEN 'failed' END"}


@query("stream_document_progress", f"""WITH d AS (SELECT user_id AS case_id, event_id, {', '.join(f'{e} AS {c}' for c, e in _OF_DOCUMENT.items())} FROM events)
SELECT case_id, document_id, arg_max(stage, event_id) AS stage, arg_max(kind, event_id) FILTER (WHERE kind IS NOT NULL) AS kind, coalesce(arg_max(cache_hit, event_id) FILTER (WHERE cache_hit IS NOT NULL), FALSE) AS cache_hit, arg_max_null(message, event_id) AS message, count(*) AS applied FROM d GROUP BY case_id, document_id""")
def stream_document_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage, kind, cache hit and message of every document of every case, by its events in order."""
    e = events(spark, sf_dir).selectExpr("user_id AS case_id", "event_id", *[f"{x} AS {c}" for c, x in _OF_DOCUMENT.items()])
    out = latest(settle(document_progress(e), "update", "documents"), ["document"], ["batch"])
    return out.select("document.case_id", "document.document_id", "stage", "kind", "cache_hit", "message", "applied")


@query("stream_seal", f"WITH {AUDIT} SELECT case_id, audit_id, row_number() OVER (PARTITION BY case_id ORDER BY audit_id) = 1 AS first_of_chain FROM audit_log")
def stream_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log sealed as it comes in."""
    sealed = seal_stream(events(spark, sf_dir).selectExpr(*AUDIT_COLUMNS), "case_id")
    return sealed.select("case_id", "audit_id", (F.col("prev_hash") == "genesis").alias("first_of_chain"))
