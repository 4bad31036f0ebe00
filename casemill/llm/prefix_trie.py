"""A trie of conversations' prefixes: one node for each distinct sequence of first turns, with its members and its subtree's sums.

A prefix's digest is a sum of 128-bit terms, one a turn and its place, so that running totals give all prefixes of all conversations without
gathering one. The least conversation of a digest owns the node. What a conversation owns begins at one depth and goes on to its end, so the
first owned depth is found by binary search, one batched join a round, and these chains form a tree whose sums go up by doubled pointers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import lookup, materialize, running, temporaries

#: Terms of a digest are added up in so many parts of 32 bits, which cannot overflow a long.
PARTS = 4
#: Bytes of a piece of the list of conversations that end at a node.
PIECE = 1 << 16


def numbered(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth (from 1, by turn, null first), content (digest of role and text), bytes (of the text).

    Null role and text are empty. Rows of one turn number are ordered by role, the text's first 32 characters and its digest; repeated rows
    are turns of their own. Rows without a conversation take no part. Other columns are not read; texts stay in their task.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("__turn"), r.alias("__role"), F.substring(t, 1, 32).alias("__head"),
        F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t))).alias("content"), F.octet_length(t).cast("long").alias("bytes"),
    )
    out = running(rows, "conv_id", ["__turn", "__role", "__head", "content"], {"depth": F.lit(1)}, "turns")
    return out.select("conv_id", "depth", "content", "bytes")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))


def rebuild(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of the conversations that the contract of op13 makes: c gets the first h turns of c - c % 5 in place of its own first h.

    h is crc32 of the decimal c, modulo 9; as much as there is, if that conversation is shorter or absent.
    """
    c = F.col("conv_id")
    known = convs.select(c, "n_turns", F.pmod(F.crc32(c.cast("string")), F.lit(9)).alias("h"), (c - c % 5).alias("base"))
    plan = known.join(convs.select(c.alias("base"), F.col("n_turns").alias("there")), "base", "left").withColumn("given", F.least("h", F.coalesce("there", F.lit(0))))
    plan = materialize(plan, "rebuilt-plan")
    donors = turns.where("conv_id % 5 = 0 AND depth <= 8").select(c.alias("base"), "depth", "content", "bytes")  # at most 8 turns of each for at most 5
    given = plan.where("given > 0").select("conv_id", "base", "given").join(donors, "base").where("depth <= given").select("conv_id", "depth", "content", "bytes")
    own = turns.where(F.col("depth") > F.pmod(F.crc32(c.cast("string")), F.lit(9)))
    moved = lookup(own, plan.where("given < h").select("conv_id", (F.col("given") - F.col("h")).alias("by")), ["conv_id"], "moved")
    moved = moved.select("conv_id", (F.col("depth") + F.coalesce("by", F.lit(0))).alias("depth"), "content", "bytes")
    return given.unionByName(moved), plan.select("conv_id", (F.col("given") + F.greatest(F.lit(0), F.col("n_turns") - F.col("h"))).alias("n_turns"))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, digest and bytes (of the last turn) of every prefix of every conversation, the empty one too."""
    term = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("content")))
    sums = {f"s{k}": F.conv(F.substring(term, 8 * k + 1, 8), 16, 10).cast("long") for k in range(PARTS)}
    digest = F.unhex(F.md5(F.concat_ws(",", F.col("depth").cast("string"), *[F.col(s).cast("string") for s in sums])))
    some = running(turns, "conv_id", ["depth"], sums, "digest-sums").select("conv_id", "depth", digest.alias("digest"), "bytes")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.md5(F.lit("root"))).alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return some.unionByName(root)


def first_owned(convs: DataFrame, owned: DataFrame) -> DataFrame:
    """convs with first, the least depth (from 0) at which (conv_id, depth) is in ``owned``, or n_turns + 1; what is owned is a suffix of the depths.

    Halving by joins on unique keys, in one plan: the exchange of ``owned`` is made once and used by every round.
    """
    longest = convs.agg(F.max("n_turns")).first()[0]
    state = convs.withColumn("lo", F.lit(0).cast("long")).withColumn("hi", F.col("n_turns") + 1)
    marks = owned.select("conv_id", F.col("depth").alias("mid"), F.lit(True).alias("is_owned"))
    for _ in range((longest + 1).bit_length() if longest is not None else 0):
        state = state.withColumn("mid", F.shiftright(F.col("lo") + F.col("hi"), 1)).join(marks, ["conv_id", "mid"], "left")
        open_, hit = F.col("lo") < F.col("hi"), F.col("is_owned").isNotNull()
        state = state.select("conv_id", "n_turns", F.when(open_ & ~hit, F.col("mid") + 1).otherwise(F.col("lo")).alias("lo"), F.when(open_ & hit, F.col("mid")).otherwise(F.col("hi")).alias("hi"))
    return state.select("conv_id", "n_turns", F.col("lo").alias("first"))


def upward(chains: DataFrame, sums: list[str]) -> DataFrame:
    """chains (conv_id, up: the chain that it hangs on or null) with each of ``sums`` added up over all chains below and the chain itself.

    Pointers double: after k rounds a chain has what is less than 2^k below it, and points 2^k up. Rounds are the logarithm of the height.
    """
    while True:
        below = chains.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(s).alias(f"__{s}") for s in sums])
        added = chains.join(below, "conv_id", "left").select("conv_id", "up", *[(F.col(s) + F.coalesce(F.col(f"__{s}"), F.lit(0))).alias(s) for s in sums])
        hung = materialize(added.where("up IS NOT NULL"), "hung")
        far = lookup(hung, chains.select(F.col("conv_id").alias("up"), F.col("up").alias("__far")), ["up"], "pointers").withColumn("up", F.col("__far")).drop("__far")
        chains = materialize(added.where("up IS NULL").unionByName(far), "chains")
        if chains.where("up IS NOT NULL").isEmpty():
            return chains.drop("up")


def joined_ends(ends: DataFrame) -> DataFrame:
    """digest and ends_sha256 of (digest, conv_id): SHA-256 of the decimal ids, ascending, joined by commas.

    Ids are sorted over all partitions and made into pieces where they lie; a node's pieces, not its ids, then meet, and are hashed as they
    pass, so that a node at which a third of all conversations end is neither gathered nor held.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)], pa.string())], names=["digest", "first", "piece"])

        node, first, ids, size = None, 0, [], 0
        for b in batches:
            for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (d != node or size > PIECE):
                    yield made()
                    ids, size = [], 0
                if not ids:
                    node, first = d, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["digest", "ends_sha256"])

        node, h = None, None
        for b in batches:
            for d, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if h is None or d != node:
                    if h is not None:
                        yield made()
                    node, h = d, hashlib.sha256(p.encode())
                else:
                    h.update(b"," + p.encode())
        if h is not None:
            yield made()

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = ends.select("digest", "conv_id").repartitionByRange(n, "digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(pieces, "digest binary, first long, piece string")
    return cut.repartition(n, "digest").sortWithinPartitions("digest", "first").mapInArrow(hashed, "digest binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth (gapless from 1), content (16 bytes), bytes; convs: conv_id and n_turns (0 allowed) of every conversation.
    n_leaves and saved_tokens, each node's (n_convs - 1) times bytes, are summed over the node's subtree; ends_sha256 is the digest of the
    members that end at the node. No conversations, no nodes.
    """
    with temporaries(turns.sparkSession, "trie"):
        return _trie(turns, convs)


def _trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    convs = materialize(convs, "lengths")
    prefix = materialize(prefixes(turns, convs), "prefixes")
    minima = prefix.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    nodes = materialize(minima.withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
    first = materialize(first_owned(convs, nodes), "first-owned")

    above = first.where("first BETWEEN 1 AND n_turns").select("conv_id", (F.col("first") - 1).alias("depth"))
    heads = materialize(above.join(prefix.select("conv_id", "depth", "digest"), ["conv_id", "depth"]), "heads")
    heads = lookup(heads, nodes.select("digest", F.col("conv_id").alias("up")), ["digest"], "heads")
    heads = materialize(heads.select("conv_id", "depth", "up"), "hanging")  # depth: of the node that the chain hangs on, in the chain up

    hung = heads.groupBy(F.col("up").alias("conv_id"), "depth").agg(F.count("*").alias("hanging"))
    tails = first.where("first <= n_turns").select("conv_id", F.col("n_turns").alias("depth")).join(hung, ["conv_id", "depth"], "left")
    own = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved"))
    chains = tails.select("conv_id", F.col("hanging").isNull().cast("long").alias("leaves")).join(own, "conv_id").join(heads.select("conv_id", "up"), "conv_id", "left")
    whole = upward(materialize(chains.select("conv_id", "up", "saved", "leaves"), "chains-alone"), ["saved", "leaves"])

    below = heads.join(whole, "conv_id").groupBy(F.col("up").alias("conv_id"), "depth").agg(F.count("*").alias("hanging"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    marks = heads.select("conv_id", (F.col("depth") + 1).alias("depth"), "up").withColumn("last", F.lit(False)).unionByName(tails.select("conv_id", "depth", F.lit(None).cast("long").alias("up"), F.lit(True).alias("last")))
    marks = marks.groupBy("conv_id", "depth").agg(F.max("up").alias("up"), F.max("last").alias("last"))
    ends = joined_ends(prefix.join(first.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"]))
    whole_nodes = nodes.join(ends, "digest", "left").join(below, ["conv_id", "depth"], "left").join(marks, ["conv_id", "depth"], "left")
    zero, last = F.lit(0), F.coalesce("last", F.lit(False))
    rows = whole_nodes.select(
        "conv_id", "depth", (-F.col("depth")).alias("from_end"), F.when(F.col("depth") > 0, F.coalesce("up", "conv_id")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("hanging", zero) + (~last).cast("long")).alias("n_children"), (F.coalesce("leaves", zero) + (last & F.col("hanging").isNull()).cast("long")).alias("leaves"),
        (F.col("own") + F.coalesce("saved", zero)).alias("saved"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    done = running(rows, "conv_id", ["from_end"], {"n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")}, "suffix-sums")
    return materialize(done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie")


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of the contract; nulls, ties and repeated rows as numbered() has them."""
    with temporaries(conversations.sparkSession, "trie"):
        turns = materialize(numbered(conversations), "numbered")
        convs = materialize(lengths(turns), "conv-lengths")
        again, long = rebuild(turns, convs)
        return trie(again, long)


_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
_CRC32 = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, b: xor(a >> 8, list_extract(tab, (xor(a, b) & 255) + 1))), 4294967295)"
ORACLE = f"""WITH crc AS (SELECT {_TABLE} AS tab), ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 5 AS b, {_CRC32} % 9 AS h FROM ids, crc),
t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), substr(coalesce(text, ''), 1, 32), md5(concat(strlen(coalesce(role, '')), ':', role, text))) AS i FROM conversations WHERE conv_id IS NOT NULL),
again AS (SELECT h.c, 0 AS part, i, r, x FROM h JOIN t ON t.c = h.b AND t.i <= h.h UNION ALL SELECT h.c, 1, i, r, x FROM h JOIN t ON t.c = h.c AND t.i > h.h),
d AS (SELECT c, r, x, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d FROM again),
p AS (SELECT c, d, x, string_agg(md5(concat(strlen(r), ':', r, x)), '') OVER (PARTITION BY c ORDER BY d) AS path FROM d UNION ALL SELECT c, 0, '', '' FROM ids),
n AS (SELECT path, min(c) AS c, any_value(d) AS d, count(*) AS n, (count(*) - 1) * strlen(any_value(x)) AS own FROM p GROUP BY path),
up AS (SELECT k.path, p.path AS above, m.c AS parent FROM n k JOIN p ON p.c = k.c AND p.d = k.d - 1 JOIN n m ON m.path = p.path),
kids AS (SELECT above AS path, count(*) AS kids FROM up GROUP BY above),
sub AS (SELECT a.path, sum(n.own) AS saved, count(*) FILTER (WHERE kids.path IS NULL) AS leaves FROM n LEFT JOIN kids ON kids.path = n.path JOIN p a ON a.c = n.c AND a.d <= n.d GROUP BY a.path),
ends AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(path, d) AS path FROM p GROUP BY c) GROUP BY path)
SELECT n.c AS conv_id, n.d AS depth, up.parent AS parent_conv_id, n.n AS n_convs, coalesce(kids.kids, 0) AS n_children, sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM n LEFT JOIN up ON up.path = n.path LEFT JOIN kids ON kids.path = n.path JOIN sub ON sub.path = n.path LEFT JOIN ends ON ends.path = n.path"""
