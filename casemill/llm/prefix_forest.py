"""Approximate nearest neighbours in a hash-prefix forest (operator 5).

A tree is a sorted array of long hash strings, one bit a random hyperplane. A query descends each tree to its longest matching prefix, then
all trees ascend together, a bit at a time, and every depth widens the ranges of rows that share the prefix. Candidates are scored exactly.
The ascent ends at the depth at which a row as near as the k-th best found so far would have been met in some tree with the target chance:
close neighbours end it early, and rows without any structure, where the k-th neighbour is hardly nearer than the rest, late.

Rows are sorted by length and by one more hash string and cut into segments of bounded size, each with its own forest. A query looks at its
own segment first; of the others only those can hold a nearer row whose centre and radius allow it (a bound, nothing is lost by it).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import materialize, prefix_sums, temporaries, with_columns

#: Most rows of a segment, and numbers in its vectors; queries of a block; segments of a block of summaries.
SEGMENT, NUMBERS, BLOCK, SUMMARIES = 16_384, 1 << 21, 4_096, 4_096
#: Trees, bits of a hash string, and the chance with which a row as near as the k-th best is to be met.
TREES, BITS, TARGET = 160, 20, 0.95
#: Bits of the hash string that rows are sorted by.
SORT_BITS = 40


def planes(dims: int, count: int, seed: int = 11) -> np.ndarray:
    """Normals of hyperplanes, orthogonal within groups of ``dims``, which spreads a tree's bits."""
    rng, out = np.random.default_rng(seed), []
    while len(out) * dims < count:
        out.append(np.linalg.qr(rng.standard_normal((dims, dims)))[0].T)
    return np.concatenate(out)[:count]


@lru_cache(2)
def _planes(dims: int, count: int, seed: int) -> np.ndarray:
    return planes(dims, count, seed)


def hash_strings(x: np.ndarray, normals: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """One integer of ``bits`` bits, most significant first, for each tree and row."""
    out = np.zeros((trees, len(x)), np.int64)
    for at in range(0, len(x), 4096):
        signs = (x[at : at + 4096] @ normals.T > 0).reshape(-1, trees, bits)
        out[:, at : at + 4096] = (signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).T
    return out


class Forest:
    """A forest over rows that differ in length: one more number makes all rows as long as the longest, so that angles order inner products."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.x, self.trees, self.bits = x, trees, bits
        norms = np.linalg.norm(x, axis=1)
        self.longest = float(norms.max())
        self.normals = _planes(x.shape[1] + 1, trees * bits, 11)
        full = np.concatenate([x, np.sqrt(np.maximum(self.longest**2 - norms**2, 0))[:, None]], axis=1)
        strings = hash_strings(full, self.normals, trees, bits)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, axis=1)
        #: Chance that a row at an angle is met at a depth, by depth: 1 - (1 - (1 - angle / pi) ** depth) ** trees.
        self.depths = np.arange(bits + 1)

    def depth_for(self, score: float, norm: float, target: float) -> int:
        """The largest depth at which a row of this inner product with a query of this length is met with the target chance; for certainty, 0."""
        if target >= 1:
            return 0
        angle = np.arccos(np.clip(score / (norm * self.longest), -1, 1))
        met = 1 - (1 - (1 - angle / np.pi) ** self.depths) ** self.trees
        return int(self.depths[met >= target].max())  # at depth 0 every row is met

    def search(self, queries: np.ndarray, least: np.ndarray, k: int, target: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows found and their inner products. ``least`` are inner products that k rows elsewhere reach, or -inf."""
        strings = hash_strings(np.concatenate([queries, np.zeros((len(queries), 1))], axis=1), self.normals, self.trees, self.bits)
        low, high = (np.empty((self.bits + 1, self.trees, len(queries)), np.int32) for _ in range(2))
        for t in range(self.trees):
            for depth in range(self.bits + 1):
                rest = self.bits - depth
                prefix = strings[t] >> rest << rest
                low[depth, t] = np.searchsorted(self.sorted[t], prefix)
                high[depth, t] = np.searchsorted(self.sorted[t], prefix + (1 << rest))
        sizes = (high - low).sum(axis=1)
        seen = np.zeros(len(self.x), bool)
        for q, norm in enumerate(np.linalg.norm(queries, axis=1)):
            # the first look is where some rows share a prefix; each look tells how far up the next one must go
            depth, kth = self.bits, least[q]
            if kth == -np.inf:
                depth = self.bits - min(self.bits, int(np.searchsorted(sizes[::-1, q], min(4 * k, len(self.x)))))
            else:
                depth = self.depth_for(kth, norm, target)
            while True:
                seen[:] = depth == 0
                if depth:
                    for a, b, o in zip(low[depth, :, q], high[depth, :, q], self.order):
                        if a < b:
                            seen[o[a:b]] = True
                found = np.flatnonzero(seen)
                score = np.einsum("ij,j->i", self.x[found], queries[q])
                # one more than k: the query's own row may be among them
                best = np.partition(score, len(score) - k - 1)[len(score) - k - 1] if len(score) > k else -np.inf
                up = self.depth_for(max(best, kth), norm, target) if max(best, kth) > -np.inf else 0
                if up >= depth:
                    break
                depth = min(up, depth - 1) if best == -np.inf else up
            yield found, score


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(rows, -1)


def _best(ids: np.ndarray, score: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k largest scores of other rows than the query's own, ties to the smaller id."""
    places = np.flatnonzero(ids != own)
    if len(places) > k:  # keep ties of the last place for the order by id
        s = score[places]
        places = places[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return places[np.lexsort((ids[places], -score[places]))[:k]]


OWN = "dims int, segment long, query_id long, vec_id long, score double, centre array<double>, radius double"


def _own(k: int, target: float):
    """A segment searched for its own queries, and one row of its centre and radius."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        x, ids = _matrix(rows.column("embedding"), rows.num_rows), rows.column("vec_id").to_numpy()
        asks = np.flatnonzero(rows.column("is_query").to_numpy(zero_copy_only=False))
        centre = x.mean(axis=0)
        out = {"query_id": [None], "vec_id": [None], "score": [None]}
        if len(asks):
            for q, (found, score) in zip(asks, Forest(x).search(x[asks], np.full(len(asks), -np.inf), k, target)):
                best = _best(ids[found], score, ids[q], k)
                out["query_id"] += [int(ids[q])] * len(best)
                out["vec_id"] += ids[found[best]].tolist()
                out["score"] += score[best].tolist()
        n = len(out["score"])
        summary = [centre.tolist(), *[None] * (n - 1)], [float(np.linalg.norm(x - centre, axis=1).max()), *[None] * (n - 1)]
        columns = [pa.array([key[0].as_py()] * n, pa.int32()), pa.array([key[1].as_py()] * n, pa.int64()), *(pa.array(out[c], t) for c, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))]
        return pa.Table.from_arrays([*columns, pa.array(summary[0], pa.list_(pa.float64())), pa.array(summary[1], pa.float64())], names=["dims", "segment", "query_id", "vec_id", "score", "centre", "radius"])

    return run


def _reaching(key: tuple, rows: pa.Table) -> pa.Table:
    """Pairs of a query and another segment that may hold a row nearer than its k-th best: centre's product and radius allow it."""
    asks = np.asarray(rows.column("is_query").to_numpy(zero_copy_only=False), bool)
    x, radius, segment, ids = _matrix(rows.column("vector"), rows.num_rows), rows.column("number").to_numpy(), rows.column("segment").to_numpy(), rows.column("vec_id").to_numpy()
    q, s = np.flatnonzero(asks), np.flatnonzero(~asks)
    out = []
    for at in range(0, len(q), 256):
        some = q[at : at + 256]
        bound = x[some] @ x[s].T + np.linalg.norm(x[some], axis=1)[:, None] * radius[s]
        near = (bound >= radius[some][:, None] - 1e-9 * np.abs(bound)) & (segment[some][:, None] != segment[s])
        i, j = np.nonzero(near)
        out.append((ids[some[i]], segment[s[j]]))
    a, b = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in (0, 1))
    return pa.table({"dims": pa.array(np.full(len(a), key[0].as_py()), pa.int32()), "vec_id": pa.array(a, pa.int64()), "segment": pa.array(b, pa.int64())})


def _others(k: int, target: float):
    """A segment searched for a block of queries of other segments."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        asks = np.asarray(rows.column("is_query").to_numpy(zero_copy_only=False), bool)
        x, ids, least = _matrix(rows.column("embedding"), rows.num_rows), rows.column("vec_id").to_numpy(), rows.column("least").to_numpy()
        base, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(base) and len(queries):
            for q, (found, score) in zip(queries, Forest(x[base]).search(x[queries], least[queries], k, target)):
                best = _best(ids[base[found]], score, ids[q], k)
                out.append((np.full(len(best), ids[q]), ids[base[found[best]]], score[best]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out)))))

    return run


def searchable(vector: Column) -> Column:
    """Whether a vector takes part: not null, empty or zero, and no component null or non-finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def _placed(rows: DataFrame) -> DataFrame:
    """rows with place: the power of two of their length, then a hash string; rows near in place are mostly near each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = np.zeros(b.num_rows, np.int64)
            sizes = b.column("dims").to_numpy()
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                x = np.asarray(b.column("embedding").take(pa.array(at)).flatten(), np.float64).reshape(len(at), dims)
                power = np.clip(np.floor(np.log2(np.linalg.norm(x, axis=1))), -1000, 1000).astype(np.int64) + 1000
                place[at] = (power << SORT_BITS) + hash_strings(x, _planes(int(dims), SORT_BITS, 7), 1, SORT_BITS)[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], names=[*b.schema.names, "place"])

    return rows.mapInArrow(run, with_columns(rows, (), place="long"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products with other rows, ties to the smaller vec_id.

    vectors has vec_id and embedding. Vectors of one length are searched among themselves, each length by itself; those that aren't searchable
    take no part. Repeated rows are candidates as often as they come, a query's own id never; a query whose id has several vectors is
    answered once, for the least of them. An empty table gives an empty result. A target of 1 looks at every row of each segment whose bound
    allows a nearer one, which is exact.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query"))
    rows = rows.where(searchable(F.col("embedding")) & F.col("vec_id").isNotNull()).withColumn("dims", F.size("embedding"))
    with temporaries(spark, "ann-own", "ann-found"):
        order = [F.col("dims"), F.col("place"), F.col("vec_id"), F.xxhash64("embedding"), F.monotonically_increasing_id()]
        ordered = prefix_sums(_placed(rows), order, {"row": F.lit(1)}, "ann-order")
        size = F.least(F.lit(SEGMENT), F.greatest(F.lit(256), F.floor(F.lit(NUMBERS) / F.col("dims"))))
        # one row of each query asks: the least vector of its id
        first = F.row_number().over(Window.partitionBy("vec_id").orderBy("dims", "embedding", "row"))
        ordered = ordered.withColumn("segment", F.floor((F.col("row") - 1) / size).cast("long"))
        asked = ordered.where("is_query").select("vec_id", "dims", "embedding", "row").withColumn("nth", first).where("nth = 1").select("row", F.lit(True).alias("asks"))
        all_ = materialize(ordered.join(asked, "row", "left").select("dims", "segment", "vec_id", "embedding", F.coalesce("asks", F.lit(False)).alias("is_query")), "ann-rows")
        own = materialize(all_.groupBy("dims", "segment").applyInArrow(_own(k, target), OWN), "ann-own")
        found = own.where("query_id IS NOT NULL").select("query_id", "vec_id", "score")
        summaries = own.where("centre IS NOT NULL").select("dims", "segment", "centre", "radius")
        if summaries.groupBy("dims").count().where("count > 1").isEmpty():
            return _ranked(found, k)
        kth = found.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n"))
        queries = all_.where("is_query").join(kth, F.col("vec_id") == F.col("query_id"), "left").drop("is_query", "query_id")
        queries = materialize(queries.withColumn("least", F.when(F.col("n") >= k, F.col("s")).otherwise(F.lit(float("-inf")))).drop("s", "n"), "ann-queries")
        blocks = F.floor(F.col("segment") / SUMMARIES).cast("long").alias("block")
        last = summaries.groupBy("dims").agg((F.floor(F.max("segment") / SUMMARIES)).cast("long").alias("last"))
        asked_blocks = queries.join(F.broadcast(last), "dims").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "last")))  # a row for each length
        part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
        left = asked_blocks.select("dims", "block", part.alias("part"), "vec_id", "segment", F.col("embedding").alias("vector"), F.col("least").alias("number"), F.lit(True).alias("is_query"))
        right = summaries.select("dims", blocks, F.explode(F.sequence(F.lit(0), F.lit(63))).alias("part"), F.lit(-1).cast("long").alias("vec_id"), "segment", F.col("centre").alias("vector"), F.col("radius").alias("number"), F.lit(False).alias("is_query"))
        grid = left.unionByName(right.withColumn("part", F.col("part").cast("long")))
        reach = materialize(grid.groupBy("dims", "block", "part").applyInArrow(_reaching, "dims int, vec_id long, segment long"), "ann-reach")
        counts = reach.groupBy("dims", "segment").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        base = all_.join(counts, ["dims", "segment"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        base = base.select("dims", "segment", "block", "vec_id", "embedding", F.lit(0.0).alias("least"), F.lit(False).alias("is_query"))
        ask = reach.join(queries.drop("segment", "dims"), "vec_id").join(counts, ["dims", "segment"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
        ask = ask.select("dims", "segment", "block", "vec_id", "embedding", "least", F.lit(True).alias("is_query"))
        more = materialize(base.unionByName(ask).groupBy("dims", "segment", "block").applyInArrow(_others(k, target), "query_id long, vec_id long, score double"), "ann-found")
    return _ranked(found.unionByName(more), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
