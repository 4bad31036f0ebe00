"""Operators on the stream of case events: filter, progress fold with documents, registration with replay, text for subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.sources.storage import scratch
from casemill.streaming.folding import Folding

#: Events of a topic that a case registered late still gets.
REPLAYED = 500


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def settle(stream: DataFrame | Folding, mode: str, what: str) -> DataFrame:
    """Run a stream over what is there and return all batches' rows, with their batch number, from the shared folder.

    Of a folding, the states that each batch touched.
    """
    if isinstance(stream, Folding):
        return stream.run(what)[0]
    spark = stream.sparkSession
    out = scratch(spark, what)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")  # a batch done again replaces itself

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, f"{what}-offsets")).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{out}/n=*")


def _progress(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
    stage, status, applied = state
    if stage == "done":
        return state, []
    if row["event_type"] == "error":
        return (stage, "error", applied + 1), []
    return ("done" if row["event_type"] == "purchase" else row["event_type"], "ok", applied + 1), []


def progress(stream: DataFrame) -> Folding:
    """case_id, stage, status and the number of applied events: the latest stage; an error keeps the stage; purchase means done, after which events are dropped."""
    rows = stream.select(F.col("user_id").alias("case_id"), "event_id", "event_type")
    return Folding(rows, "case_id", ("event_id",), ("received", "ok", 0), _progress, "stage string, status string, applied long")


def _document(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
    _, kind, hit, message, n = state
    return (row["stage"], row["kind"] if row["kind"] is not None else kind, row["cache_hit"] if row["cache_hit"] is not None else hit, row["message"], n + 1), []


def document_progress(stream: DataFrame) -> Folding:
    """Progress of each document of a case, by the events that name one (case_id, document_id, event_id, stage, kind, cache_hit, message).

    A document's stage and message are the latest event's; its kind and whether it came from the cache stay until an event says otherwise.
    The key is case and document, so that a case's state doesn't grow with its documents.
    """
    rows = stream.where("document_id IS NOT NULL AND case_id IS NOT NULL").select(F.struct("case_id", "document_id").alias("document"), "event_id", "stage", "kind", "cache_hit", "message")
    return Folding(rows, "document", ("event_id",), ("uploaded", None, False, None, 0), _document, "stage string, kind string, cache_hit boolean, message string, applied long")


def _ring(most: int):
    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        ring, registered = state[0], row["registers"]
        emitted = [(e["case_id"], e["event_id"], row["event_id"]) for e in ring if e["case_id"] == row["case_id"]] if registered else []
        ring = [*ring, {"event_id": row["event_id"], "case_id": row["case_id"]}][-most:]
        return (ring,), emitted

    return step


def _live(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
    since = state[0]
    if since is not None:
        return state, [(row["event_id"], since)]
    return (row["event_id"] if row["registers"] else None,), []


def replays(stream: DataFrame, most: int = REPLAYED) -> Folding:
    """What a case gets at its registration: of the last ``most`` events of its topic those that are its own, in order.

    stream: topic, case_id, event_id, registers (whether the event registers its case; the first one counts, see registrations()). The state is
    a ring of at most ``most`` events a topic. Emitted: case_id, event_id, since (the event that registered it).
    """
    rows = stream.select("topic", "case_id", "event_id", "registers")
    return Folding(rows, "topic", ("event_id",), ([],), _ring(most), "ring array<struct<event_id:long,case_id:long>>", "case_id long, event_id long, since long")


def live(stream: DataFrame) -> Folding:
    """Events of cases after their registration; those of unknown cases are dropped. Emitted: event_id, since."""
    return Folding(stream.select("case_id", "event_id", "registers"), "case_id", ("event_id",), (None,), _live, "since long", "event_id long, since long")


def bus(stream: DataFrame, most: int = REPLAYED) -> DataFrame:
    """case_id, event_id, replayed: everything that registered cases get, first what is replayed to them, then what comes after.

    A case registered again gets nothing twice: only its first registration replays.
    """
    first = live(stream).run("live")[1]
    again = replays(stream, most).run("replays")[1]
    known = again.groupBy("case_id").agg(F.min("since").alias("since"))  # the first registration at which anything was replayed
    starts = first.groupBy("case_id").agg(F.min("since").alias("since")).unionByName(known).groupBy("case_id").agg(F.min("since").alias("since"))
    kept = again.join(starts, ["case_id", "since"]).select("case_id", "event_id", F.lit(True).alias("replayed"))
    return kept.unionByName(first.select("case_id", "event_id", F.lit(False).alias("replayed")))


def as_sse(event: Column) -> Column:
    """An event (a struct) as a message of the text/event-stream format, its id first."""
    return F.concat(F.lit("id: "), event["event_id"].cast("string"), F.lit("\ndata: "), F.to_json(event), F.lit("\n"))


def write_sse(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Each event of a stream (with event_id) as one message of text, in files of its batch, which a batch done again replaces; to the end of what is there."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(as_sse(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
