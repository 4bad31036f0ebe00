"""Rules that take a key's events one after another, as streams: each batch is sorted by key and time and folded as it passes.

A state is one row a key. A batch's rows and the states before it are sorted together within partitions, each key's state first, and a function
goes over them row by row: it holds one state and one Arrow batch, however many events a key has. States and what the function emits are files
of the batch, which a batch done again replaces, so a lost executor or a restart from the checkpoint gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from casemill.sources.storage import scratch

Step = Callable[[tuple, dict], tuple[tuple, list[tuple]]]


def fold_batches(batches: Iterator[pa.RecordBatch], schema: T.StructType, key: str, start: tuple, step: Step) -> Iterator[pa.RecordBatch]:
    """Rows of sorted keys folded one after another: a row for each that is emitted, and one with the state at a key's end."""
    arrow, out = to_arrow_schema(schema), []
    of_state, of_emitted = ([f.name for f in schema[c].dataType] for c in ("state", "emitted"))
    at, state, touched, seen = None, start, False, False

    def ended() -> dict:
        return {key: at, "touched": touched, "state": dict(zip(of_state, state)), "emitted": None}

    for b in batches:
        columns = [c for c in b.schema.names if c not in ("__state", "__new")]
        values, states, new = [b.column(c).to_pylist() for c in columns], b.column("__state").to_pylist(), b.column("__new").to_pylist()
        place = columns.index(key)
        for i, is_new in enumerate(new):
            if not seen or values[place][i] != at:
                if seen:
                    out.append(ended())
                at, state, touched, seen = values[place][i], start, False, True
            if not is_new:
                state = tuple(states[i][n] for n in of_state)
                continue
            touched = True
            state, emitted = step(state, {c: v[i] for c, v in zip(columns, values)})
            out += [{key: at, "touched": None, "state": None, "emitted": dict(zip(of_emitted, e))} for e in emitted]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
    if seen:
        out.append(ended())
    yield pa.RecordBatch.from_pylist(out, arrow)


@dataclass(frozen=True)
class Folding:
    """stream has the column ``key`` and those of ``order``, which should be unique within a key; rows without a key take no part.

    ``step`` takes a state and a row (by column) and returns the new state and the rows to emit; ``start`` is the state of a key seen first,
    ``state`` and ``emits`` are DDL. ``forget`` is a predicate over the state's columns and ``latest``, the largest value of the first order
    column in the batch: states for which it holds are dropped, so that keys which nothing can happen to any more cost nothing.
    """

    stream: DataFrame
    key: str
    order: tuple[str, ...]
    start: tuple
    step: Step
    state: str
    emits: str = "none int"
    forget: str | None = None

    def _schema(self) -> T.StructType:
        kind = T.StructType().add(self.stream.schema[self.key]).add("touched", "boolean")
        return kind.add("state", T._parse_datatype_string(self.state)).add("emitted", T._parse_datatype_string(self.emits))

    def _fold(self, rows: DataFrame) -> DataFrame:
        key, start, step, schema = self.key, self.start, self.step, self._schema()
        return rows.mapInArrow(lambda batches: fold_batches(batches, schema, key, start, step), schema)

    def run(self, what: str, checkpoint: str | None = None, out: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(states, emitted), each with its batch: of every batch the states that it touched, and what it emitted. Runs to the end of what is there.

        A run with the checkpoint and out of an earlier one goes on where that one ended.
        """
        spark = self.stream.sparkSession
        out, checkpoint = out or scratch(spark, what), checkpoint or scratch(spark, f"{what}-offsets")
        columns, schema = self.stream.columns, self._schema()
        state_of = schema["state"].dataType

        def write(batch: DataFrame, number: int) -> None:
            session = batch.sparkSession
            new = batch.where(F.col(self.key).isNotNull()).select(*columns, F.lit(None).cast(state_of).alias("__state"), F.lit(True).alias("__new"))
            if number:
                old = session.read.schema(schema).parquet(f"{out}/heads-{number - 1}")
                empty = [F.col(c) if c == self.key else F.lit(None).cast(batch.schema[c].dataType).alias(c) for c in columns]
                new = new.unionByName(old.select(*empty, F.col("state").alias("__state"), F.lit(False).alias("__new")))
            n = int(session.conf.get("spark.sql.shuffle.partitions"))
            ordered = new.repartition(n, self.key).sortWithinPartitions(self.key, "__new", *self.order)
            self._fold(ordered).write.mode("overwrite").parquet(f"{out}/rows-{number}")
            done = session.read.schema(schema).parquet(f"{out}/rows-{number}").where("state IS NOT NULL")
            if self.forget:
                latest = batch.agg(F.max(self.order[0])).first()[0]
                if latest is not None:
                    done = done.where(~F.coalesce(F.expr(self.forget.format(latest=repr(latest))), F.lit(False)))
            done.write.mode("overwrite").parquet(f"{out}/heads-{number}")

        self.stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
        rows = spark.read.schema(schema).parquet(f"{out}/rows-*").withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "/rows-([0-9]+)/", 1).cast("int"))
        return rows.where("touched").select(self.key, "state.*", "batch"), rows.where("emitted IS NOT NULL").select(self.key, "emitted.*", "batch")
