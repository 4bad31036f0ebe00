"""Sharding along a Hilbert curve (operator 2).

Several metadata dimensions are quantised, rows are put in the order of their cell on the curve, and the order is cut into runs of as many
rows, so that a file covers a small box of every dimension and its minima and maxima let readers skip it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import free_name, materialize, prefix_sums, temporaries


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """The curve as a state machine: for state * 2**dims + the dimensions' next bits, the next digit of the index and the next state.

    A state is the entry corner and the direction of a cell, from Gray codes (public: C. Hamilton, Compact Hilbert indices).
    """
    size = 1 << dims

    def turn(x: int, by: int) -> int:
        by %= dims
        return (x >> by | x << dims - by) & size - 1

    def trailing(x: int) -> int:
        return (~x & x + 1).bit_length() - 1

    digits, states = [], []
    for entry in range(size):
        for direction in range(dims):
            for bits in range(size):
                gray = turn(bits ^ entry, direction + 1)
                w = reduce(lambda a, k: a ^ gray >> k, range(1, dims), gray)
                corner = 0 if w == 0 else (x := (w - 1) // 2 * 2) ^ x >> 1
                step = 0 if w == 0 else trailing(w if w % 2 else w - 1) % dims
                digits.append(w)
                states.append((entry ^ turn(corner, -(direction + 1))) * dims + (direction + step + 1) % dims)
    return digits, states


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index on the curve (long) of a cell whose coordinates are below 2**bits; bits * dimensions must be below 63."""
    dims = len(cells)
    digits, states = (F.array(*map(F.lit, t)) for t in curve_tables(dims))
    coordinates = F.array(*[c.cast("int") for c in cells])

    def step(acc: Column, level: Column) -> Column:
        # the first dimension gives the lowest bit
        at = F.aggregate(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            acc["state"] * F.lit(1 << dims),
            lambda a, d: a + F.getbit(F.element_at(coordinates, d + 1), level).cast("int") * F.element_at(F.array(*[F.lit(1 << k) for k in range(dims)]), d + 1),
        )
        return F.struct((acc["h"] * F.lit(1 << dims) + F.element_at(digits, at + 1)).alias("h"), F.element_at(states, at + 1).alias("state"))

    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.aggregate(levels, F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("state")), step, lambda a: a["h"])


def size_cell(size: Column, bits: int) -> Column:
    """A number of bytes (1 or more) on a scale of half powers of two."""
    b = F.bin(size)
    return F.least(F.length(b) * 2 + (F.substring(b, 2, 1) == "1").cast("int"), F.lit((1 << bits) - 1))


def value_cells(df: DataFrame, column: str, bits: int, cell: str) -> DataFrame:
    """Distinct values of a column (null first) with a cell each, equal shares of the rows to equal steps of the scale; df's order is code points'."""
    counts = df.groupBy(column).agg(F.count("*").alias("__rows"))
    running = prefix_sums(counts, [F.col(column).isNotNull().cast("int"), F.col(column)], {"__upto": F.col("__rows")}, f"cells-{cell}")
    total = df.count()
    return running.select(F.col(column).alias(f"{cell}_value"), F.floor((F.col("__upto") - F.col("__rows")) * F.lit(1 << bits) / F.lit(max(total, 1))).cast("int").alias(cell))


def shards(df: DataFrame, values: list[str], size: str, ties: list[Column], n_shards: int, bits: int = 6) -> DataFrame:
    """df with hilbert (long), shard (int) and slot (long, gapless from 0 in each shard); numbers of rows differ by one at most.

    Dimensions are the columns ``values`` (any type that has an order, null is the least) and the number ``size``. Rows of one cell stand in
    the order of ``ties``. Rows with equal ties are split where a cut falls; an empty table gives an empty result.
    """
    n = df.count()
    with temporaries(df.sparkSession, "hilbert-order"):
        cells = []
        for i, v in enumerate(values):
            cell = free_name(df, f"__cell{i}")
            of = value_cells(df, v, bits, cell)
            df = df.join(of, df[v].eqNullSafe(of[f"{cell}_value"]), "left").drop(f"{cell}_value")
            cells.append(F.col(cell))
        df = df.withColumn("hilbert", hilbert_index([*cells, size_cell(F.col(size), bits)], bits)).drop(*[c for c in df.columns if c.startswith("__cell")])
        placed = prefix_sums(df, [F.col("hilbert"), *ties], {"__at": F.lit(1)}, "hilbert-order")
    at = F.col("__at") - 1
    shard = F.floor(at * n_shards / F.lit(max(n, 1))).cast("int")
    placed = placed.withColumn("shard", shard)
    first = F.floor((F.col("shard").cast("long") * n + n_shards - 1) / F.lit(n_shards)).cast("long")
    return placed.withColumn("slot", F.col("__at") - 1 - first).drop("__at")


def write_shards(placed: DataFrame, path: str) -> None:
    """Write rows with shard and slot as one folder a shard, each file a run of the curve."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def report(documents: DataFrame, n_shards: int = 8) -> DataFrame:
    """Shards of documents by language, source and size: doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert.

    A null text has size 1 and the checksum of the empty text.
    """
    text = F.coalesce("text", F.lit(""))
    meta = documents.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    with temporaries(documents.sparkSession, "hilbert-order"):
        meta = materialize(meta, "hilbert-rows")  # without texts: each is read once
        placed = shards(meta, ["lang", "source"], "size", [F.col("text_crc32"), F.col("doc_id"), F.col("size")], n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
