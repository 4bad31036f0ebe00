"""Stateful operators on event streams: first-hit rate limits, lock-outs, and the incremental seal of the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.operators.audit import seal
from casemill.sources.storage import scratch
from casemill.streaming.folding import Folding, Step


def _rate(limit: int, seconds: float) -> Step:
    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        start, n, total, refused = state
        if n == 0 or row["at"] - start >= seconds:
            start, n = row["at"], 0
        return (start, n + 1, total + 1, refused + (n + 1 > limit)), [(row["id"], max(0, limit - n - 1), n + 1 > limit)]

    return step


def rate_limit(stream: DataFrame, limit: int, seconds: float, forget: bool = False) -> Folding:
    """key, total, refused of a stream with key, id and at (seconds): a window opens at a key's first event, and events over the limit are refused.

    Within a batch events are taken by time, then id. Emitted is, for each event, what remains of its window and whether it is refused. With
    ``forget``, keys whose window is over are dropped, and their totals begin anew.
    """
    rows = stream.select("key", "id", F.col("at").cast("double").alias("at"))
    state = "start double, n long, total long, refused long"
    return Folding(rows, "key", ("at", "id"), (-1.0, 0, 0, 0), _rate(limit, seconds), state, "id long, remaining long, refused boolean", f"{{latest}} - state.start >= {seconds}" if forget else None)


def _lock(failures: int, seconds: float) -> Step:
    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        run, until, locks, turned = state
        if row["at"] < until:
            return (run, until, locks, turned + 1), [(row["id"], "locked")]
        if row["ok"]:
            return (0, until, locks, turned), [(row["id"], "ok")]
        if run + 1 >= failures:
            return (0, row["at"] + seconds, locks + 1, turned), [(row["id"], "locks")]
        return (run + 1, until, locks, turned), [(row["id"], "wrong")]

    return step


def lockout(stream: DataFrame, failures: int, seconds: float) -> Folding:
    """key, locks, turned_away of a stream with key, id, at (seconds) and ok: failures in a row lock a key for a while; a success starts anew.

    Emitted is what becomes of each event: ok, wrong, locks (the failure that locks) or locked (turned away, even if it was right).
    """
    rows = stream.select("key", "id", F.col("at").cast("double").alias("at"), "ok")
    return Folding(rows, "key", ("at", "id"), (0, -1.0, 0, 0), _lock(failures, seconds), "run long, until double, locks long, turned_away long", "id long, verdict string")


def seal_stream(stream: DataFrame, chain: str) -> DataFrame:
    """The sealed rows of a stream of the log; each batch seals the rows beyond its chains' heads and carries the heads on.

    Rows and heads of a batch are files of their own, which a batch done again replaces, so a lost executor or driver changes nothing.
    """
    spark = stream.sparkSession
    out = scratch(spark, "seal")

    def write(batch: DataFrame, number: int) -> None:
        heads = batch.sparkSession.read.parquet(f"{out}/heads-{number - 1}") if number else None
        if heads is not None:
            last = heads.select(chain, "last")
            batch = batch.join(last, chain, "left").where(F.col("last").isNull() | (F.col("audit_id") > F.col("last"))).drop("last")
        seal(batch, chain, heads=heads).write.mode("overwrite").parquet(f"{out}/rows-{number}")
        rows = batch.sparkSession.read.parquet(f"{out}/rows-{number}")
        new = rows.groupBy(chain).agg(F.max_by("hash", "audit_id").alias("hash"), F.max("audit_id").alias("last"))
        if heads is not None:
            new = new.unionByName(heads.join(new, chain, "left_anti"))
        new.write.mode("overwrite").parquet(f"{out}/heads-{number}")

    q = stream.writeStream.option("checkpointLocation", scratch(spark, "seal-offsets")).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows-*")
