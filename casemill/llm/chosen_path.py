"""N-gram Jaccard join by chosen paths (operator 4).

Texts are sets of five-word shingles; pairs of similarity 0.8 or more are links. Every set is embedded as minima of random functions. A run
starts all sets in one node; a node splits its sets by one or, now and then, two of their sampled shared tokens (a minimum that the node's
path chooses), so that two similar sets meet in a child about once. Small nodes are compared by brute force, large ones are split again, and
runs repeat until the target recall. A node that splitting doesn't take apart holds a cluster; it is compared in blocks. A pair is compared
in the first of its common nodes only, first by its minima, then exactly by its shingles, in tasks of bounded size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.bpe import Recent
from casemill.llm.common import drop, materialize, temporaries, union_all

WORDS, SIMILAR = 5, 0.8
#: Minima of a set; how many of them similar sets agree on at least (a pair at 0.8 agrees on 38.4 of 48, with a deviation of 2.8).
MINIMA, AGREE = 48, 27
#: Largest node that brute force compares at once; side of the blocks of a larger one; splits of a path; share of a node's rows in one child
#: from which splitting is given up. Unlike sets seldom share three sampled tokens, and what a fourth split would still take apart costs less
#: in blocks than the three further runs that a path of four splits needs for the same recall.
SMALL, BLOCK, DEPTH, STUCK = 64, 512, 3, 0.7
#: Chance that a node splits by a second token, so that on average 1 / 0.8 children take a set.
SECOND = 0.25
RECALL = 0.999
SEED = 0x9E3779B97F4A7C15


def runs_for(recall: float = RECALL, similar: float = SIMILAR, depth: int = DEPTH) -> int:
    """Runs after which a pair of the least similarity is found with the target probability, even if every path goes to the full depth.

    All runs draw from the same minima, so the chance is averaged over how many of them the pair shares; with under AGREE it is never found.
    """

    def missed(shared: int, runs: int) -> float:
        meet = 1.0
        for _ in range(depth):
            one = shared / MINIMA * meet
            meet = (1 - SECOND) * one + SECOND * (1 - (1 - one) ** 2)
        return (1 - meet) ** runs if shared >= AGREE else 1.0

    chance = [math.comb(MINIMA, k) * similar**k * (1 - similar) ** (MINIMA - k) for k in range(MINIMA + 1)]
    if sum(chance[:AGREE]) >= 1 - recall:
        raise ValueError(f"a recall of {recall} is out of reach of {MINIMA} minima")
    runs = 1
    while sum(c * missed(k, runs) for k, c in enumerate(chance)) > 1 - recall:
        runs += 1
    return runs


def _hash_word(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


_WORD_HASHES = Recent(_hash_word, 80_000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words (lower case, cut at white space); a shorter text is one shingle, an empty one has none."""
    w = (text or "").lower().split()
    h = np.fromiter(map(_WORD_HASHES.__getitem__, w), np.uint64, len(w))
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = _mixed(out * np.uint64(3) + h[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


@lru_cache(1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, MINIMA, np.uint32), rng.integers(0, 1 << 31, MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each random function over a set of hashes (uint32)."""
    low, (xor, times) = (s ^ s >> np.uint64(32)).astype(np.uint32), _functions()
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        v = (low[at : at + 2048, None] ^ xor) * times
        np.minimum(out, (v ^ v >> np.uint32(15)).min(axis=0), out=out)
    return out


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text_hash, set_id (a digest of the shingle set, null for an empty one), n (its size) and minima (4 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, least = [], [], []
            for x in b.column(2):
                s = shingles(x.as_py())
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sizes.append(len(s))
                least.append(minima(s).astype("<i4").tolist() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(least, pa.list_(pa.int32()))], names=["key", "text_hash", "set_id", "n", "minima"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, text_hash long, set_id binary, n long, minima array<int>")


def _children(node: Column, least: Column) -> Column:
    """The nodes that a set goes to from a node: the path chooses one minimum, and with a chance of SECOND another one."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(MINIMA)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(MINIMA - 1)), F.lit(MINIMA)).cast("int")
    child = [F.xxhash64(node, c, F.element_at(least, c + 1)) for c in (first, second)]
    again = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(1000)) < int(1000 * SECOND)
    return F.when(again, F.array(*child)).otherwise(F.array(child[0]))


def leaves(sets: DataFrame, runs: int) -> DataFrame:
    """node, set_id, size: the nodes with two sets or more that are compared, and their members."""
    roots = F.array(*[F.xxhash64(F.lit(SEED & 0xFFFFFFFF), F.lit(r)) for r in range(runs)])
    at = sets.select("set_id", "minima", F.explode(roots).alias("parent")).select("set_id", F.lit(1 << 62).alias("above"), F.explode(_children(F.col("parent"), F.col("minima"))).alias("node"))
    out = []
    for depth in range(1, DEPTH + 1):
        # counts are written first: a join of two plain shuffles is one that Spark splits where a node is large
        sizes = materialize(at.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), f"sizes-{depth}")
        members = materialize(at.join(sizes, "node"), f"paths-{depth}")
        done = (F.col("size") <= SMALL) | (F.col("size") > STUCK * F.col("above")) if depth < DEPTH else F.lit(True)
        out.append(members.where(done).select("node", "set_id", "size"))
        if depth == DEPTH or members.where(~done).isEmpty():
            break
        large = members.where(~done).select("node", "set_id", F.col("size").alias("above")).join(sets.select("set_id", "minima"), "set_id")
        at = large.select("set_id", "above", F.explode(_children(F.col("node"), F.col("minima"))).alias("node"))
    return union_all(out)


def whole(sets: DataFrame) -> DataFrame:
    """node, set_id, size: all sets as one node, whose blocks then hold every pair."""
    size = sets.count()
    return sets.select(F.lit(0).cast("long").alias("node"), "set_id", F.lit(size).cast("long").alias("size")).where("size > 1")


def _cells(members: DataFrame) -> DataFrame:
    """members with cell and side: a node's pairs of blocks are cells; side 2 stands for both sides of a block against itself."""
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_id", "node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return rows.withColumn("cell", cell).withColumn("side", side.cast("int"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of one cell each, from rows sorted by cell (the first column)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        cells = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for a, z in zip(cuts, cuts[1:]):
            if a == z:
                continue
            if held and held[0].column(0)[0].as_py() != cells[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(node: int, side: np.ndarray, nodes: list[np.ndarray]) -> np.ndarray:
    """Which pairs of a cell (upper triangle) are to be compared here: on different sides, and in no earlier common node."""
    n = len(side)
    if (side == 2).all():
        open_ = np.triu(np.ones((n, n), bool), 1)
    else:
        open_ = (side[:, None] != side[None, :]) & np.triu(np.ones((n, n), bool), 1)
    earlier = np.concatenate([x[x < node] for x in nodes])
    of = np.repeat(np.arange(n), [int((x < node).sum()) for x in nodes])
    if len(earlier):
        order = np.argsort(earlier, kind="stable")
        earlier, of = earlier[order], of[order]
        cuts = [0, *(np.flatnonzero(earlier[1:] != earlier[:-1]) + 1).tolist(), len(earlier)]
        for a, z in zip(cuts, cuts[1:]):
            if z - a > 1:
                open_[np.ix_(of[a:z], of[a:z])] = False
    return open_


def _list_rows(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    flat = column.combine_chunks()
    ends = np.cumsum([0, *flat.value_lengths().to_pylist()])
    values = np.asarray(flat.flatten()).astype(kind, copy=False)
    return [values[a:z] for a, z in zip(ends, ends[1:])]


def _by_minima(batches: Iterator[pa.RecordBatch], agree: int = AGREE) -> Iterator[pa.RecordBatch]:
    """Rows of the cells whose minima agree often enough with another row's; for no agreement asked, those whose sizes allow a link."""
    for t in _groups(batches):
        n, sizes = t.num_rows, t.column("n").to_numpy()
        node, nodes = t.column("node")[0].as_py(), _list_rows(t.column("nodes"), np.int64)
        open_ = _open_pairs(node, t.column("side").to_numpy(), nodes)
        if not open_.any():
            continue
        open_ &= np.minimum(sizes[:, None], sizes) >= SIMILAR * np.maximum(sizes[:, None], sizes)
        i, j = np.nonzero(open_)
        if not len(i):
            continue
        least = np.stack(_list_rows(t.column("minima"), np.int32))
        close = np.zeros(n, bool)
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            near = (least[a] == least[b]).sum(axis=1) >= agree
            close[a[near]] = close[b[near]] = True
        if close.any():
            yield from t.select(["cell", "node", "side", "nodes", "set_id"]).filter(pa.array(close)).combine_chunks().to_batches()


def _common(left: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if len(i) <= 4 * len(left):
        return np.array([len(np.intersect1d(left[a], left[b], assume_unique=True)) for a, b in zip(i, j)])
    # many pairs: as products of 0/1 rows, over the tokens that at least two sets hold
    all_ = np.concatenate(left)
    _, token, count = np.unique(all_, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left)), [len(x) for x in left])
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[token]
    token, row = number[token[keep]], row[keep]
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    total = np.zeros((len(left), len(left)), np.float32)
    for low in range(0, int(shared.sum()), 2048):
        a, z = np.searchsorted(token, (low, low + 2048))
        m = np.zeros((len(left), 2048), np.float32)
        m[row[a:z], token[a:z] - low] = 1
        total += m @ m.T
    return total[i, j].astype(np.int64)


def _exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cell: links of each row, weighted by the other's copies, and for each connected row the least set of its part of the cell."""
    for t in _groups(batches):
        ids = t.column("set_id").to_pylist()
        first = [k for k, x in enumerate(ids) if ids.index(x) == k] if len(set(ids)) < len(ids) else range(len(ids))  # a text may be stored twice
        t = t.take(pa.array(list(first), pa.int64()))
        ids, copies = t.column("set_id").to_pylist(), t.column("copies").to_numpy()
        open_ = _open_pairs(t.column("node")[0].as_py(), t.column("side").to_numpy(), _list_rows(t.column("nodes"), np.int64))
        sets = [shingles(x.as_py()) for x in t.column("text")]
        sizes = np.array([len(s) for s in sets])
        open_ &= np.minimum(sizes[:, None], sizes) >= SIMILAR * np.maximum(sizes[:, None], sizes)
        i, j = np.nonzero(open_)
        if not len(i):
            continue
        both = _common(sets, i, j)
        linked = both >= SIMILAR * (sizes[i] + sizes[j] - both) - 1e-9
        i, j = i[linked], j[linked]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        rank = np.argsort(np.argsort(np.array(ids, object)))  # labels by the order of the ids
        label = rank.copy()
        while len(i):
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            if (new == label).all():
                break
            label = new
        by_rank = np.argsort(rank)
        rows = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in rows], pa.binary()), pa.array([ids[by_rank[label[r]]] for r in rows], pa.binary()), pa.array(links[rows])], names=["set_id", "least", "links"])


def components(edges: DataFrame) -> DataFrame:
    """set_id, class: the least set of each connected part, by alternating large-star and small-star steps on tables in the shared folder."""
    star = materialize(edges.select(F.col("set_id").alias("a"), F.col("least").alias("b")).where("a != b").distinct(), "edges")
    before = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first, as the counts of nodes are: Spark splits a join of plain shuffles at a hub that has very many neighbours
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "lows")
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        old, star = star, materialize(small, "stars")
        drop(old)
        drop(low)
        now = star.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            return star.select(F.col("a").alias("set_id"), F.col("b").alias("class"))
        before = now


def _classified(docs: DataFrame, key: str, text: str, recall: float, exact: bool) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and set_id, pick and least (the first row of the set and of its class: none, key, text_hash), n_links."""
    with temporaries(docs.sparkSession, "sketches", "classes"):
        docs = docs.select(F.col(key).alias(key), F.col(text).alias(text))
        rows = materialize(sketches(docs, key, text), "sketches")
        # null keys last: the least of (is null, key, text)
        pick = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("text_hash")))
        sets = materialize(rows.where("set_id IS NOT NULL").groupBy("set_id").agg(pick.alias("pick"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("minima").alias("minima")), "sets")
        members = materialize(whole(sets) if exact else leaves(sets, runs_for(recall)), "leaves")
        nodes = members.groupBy("set_id").agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # at most runs * 2 ** DEPTH
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        near = _cells(members.join(nodes, "set_id").join(sets.select("set_id", "n", "minima"), "set_id")).select("cell", "node", "side", "nodes", "set_id", "n", "minima")
        near = near.repartition(partitions, "cell").sortWithinPartitions("cell").mapInArrow(lambda b: _by_minima(b, 0 if exact else AGREE), "cell long, node long, side int, nodes array<long>, set_id binary")
        near = materialize(near, "near")
        wanted = near.select("set_id").distinct().join(sets.select("set_id", "pick", "copies"), "set_id").select("set_id", "copies", "pick.key", "pick.text_hash")
        stored = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
        texts = wanted.join(stored, wanted["key"].eqNullSafe(stored["key"]) & (wanted["text_hash"] == stored["text_hash"])).select("set_id", "copies", "text")
        paired = near.join(texts, "set_id").select("cell", "node", "side", "nodes", "set_id", "copies", "text")
        links = materialize(paired.repartition(partitions, "cell").sortWithinPartitions("cell").mapInArrow(_exactly, "set_id binary, least binary, links long"), "links")
        classes = components(links)
        counts = links.groupBy("set_id").agg(F.sum("links").alias("links"))
        of = sets.join(classes, "set_id", "left").join(counts, "set_id", "left").withColumn("class", F.coalesce("class", "set_id"))
        least = materialize(of.groupBy("class").agg(F.min("pick").alias("least")), "least")
        classes = materialize(of.join(least, "class").select("set_id", "pick", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    return rows, classes


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL, exact: bool = False) -> DataFrame:
    """One row for each row of docs: its key, class_id (the least key of its class) and n_links (other rows with similarity 0.8 or more).

    Rows with equal shingle sets are similar and are compared once. A text without words has no links and is a class of its own key. A
    text of under five words is one shingle. Null keys come after all others in a class. An empty table gives an empty result. ``exact`` compares
    all different sets, block by block, in place of those that meet on a path: no link is missed, and work grows with their square.
    """
    rows, of = _classified(docs, key, text, recall, exact)
    out = rows.select("key", "set_id").join(of.select("set_id", F.col("least.key").alias("class_id"), "n_links"), "set_id", "left")
    return out.select(F.col("key").alias(key), F.when(F.col("set_id").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL, exact: bool = False) -> DataFrame:
    """docs with one row of each class, that of the least key; of rows without words, equal ones are kept once. Columns stay. ``exact`` as in join()."""
    rows, of = _classified(docs, key, text, recall, exact)
    kept = of.where(F.col("pick").eqNullSafe(F.col("least"))).select(F.col("pick.key").alias("__key"), F.col("pick.text_hash").alias("__hash"))
    kept = kept.unionByName(rows.where("set_id IS NULL").select(F.col("key").alias("__key"), F.col("text_hash").alias("__hash"))).distinct()
    hashed = docs.withColumn("__own", F.xxhash64(text))
    out = hashed.join(kept, hashed[key].eqNullSafe(kept["__key"]) & (hashed["__own"] == kept["__hash"]))
    return out.dropDuplicates(["__key", "__own"]).select(*docs.columns)
