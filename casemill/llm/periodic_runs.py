"""Periodic runs of words (maximal repetitions of three periods or more) and texts without their repetitions.

Harmonic grid: a run of period p and length 3p holds two neighbouring multiples jp and (j + 1)p, and is as long as they agree forwards and
backwards. Both lengths come from a suffix array, its reversed twin and range minima, for all documents of a slice at once. A run that is long
enough agrees on at least eight words from one of its grid pairs on, so pairs whose next eight words differ are passed over before that, and
documents without such a pair need no suffix array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import WORD, with_columns

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: So many words agree from a run's first grid pair on: it begins within the run's first period, and a period and 24 words, or three, follow.
AGREE = 8
RUNS = "array<struct<start:long,length:long,period:long>>"
#: Words whose suffixes are sorted together (more where one text has more), and grid pairs looked at at once.
SLICE, PAIRS = 1 << 19, 1 << 20
BLOCK = 32


class Minima:
    """Least values of ranges: running minima within blocks and a table of powers of two over the blocks, so memory stays a few times the values'."""

    def __init__(self, values: np.ndarray):
        filled = np.full(-(-max(len(values), 1) // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        filled[: len(values)] = values
        self.values, rows = filled, filled.reshape(-1, BLOCK)
        self.to_here = np.minimum.accumulate(rows, axis=1).ravel()
        self.from_here = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [rows.min(axis=1)]
        while len(self.levels[-1]) > 1 << len(self.levels) - 1:
            last, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-step], last[step:]))
            if len(self.levels[-1]) <= 1:
                break

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least values from low to high, both included."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.from_here[low], self.to_here[high])
        far = np.flatnonzero(b - a > 1)
        if len(far):
            first, last = a[far] + 1, b[far] - 1
            level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = level == k
                row = self.levels[k]
                out[far[at]] = np.minimum(out[far[at]], np.minimum(row[first[at]], row[last[at] - (1 << int(k)) + 1]))
        near = np.flatnonzero(a == b)
        if len(near):
            lo, hi = low[near], high[near]
            least = self.values[lo]
            for step in range(1, BLOCK):
                least = np.minimum(least, self.values[np.minimum(lo + step, hi)])
            out[near] = least
        return out


class Suffixes:
    """A suffix array by doubling, the common prefixes of its neighbours, and from both the agreement of any two places."""

    def __init__(self, ids: np.ndarray):
        """ids: int64 >= 0; a text's last one is found nowhere else, so that no agreement reaches beyond a text."""
        n = len(ids)
        rank, steps = np.unique(ids, return_inverse=True)[1].astype(np.int64), [1]
        ranks = [rank.astype(np.int32)]
        while n and rank.max() < n - 1:
            step = steps[-1]
            pair = rank * (n + 1)
            pair[: n - step] += rank[step:] + 1
            order = np.argsort(pair, kind="stable")
            ordered = pair[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            ranks.append(rank.astype(np.int32))
            steps.append(2 * step)
        self.rank = rank
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        # neighbours agree on a step where their ranks for it are equal; from the longest step down
        agree, a, b = np.zeros(max(n - 1, 0), np.int32), order[:-1].copy(), order[1:].copy()
        for step, known in zip(reversed(steps), reversed(ranks)):
            inside = np.flatnonzero((a + step <= n) & (b + step <= n))
            same = inside[known[a[inside]] == known[b[inside]]]
            agree[same] += step
            a[same] += step
            b[same] += step
        self.minima = Minima(agree)

    def agreement(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words from two different places on."""
        x, y = self.rank[a], self.rank[b]
        return self.minima.of(np.minimum(x, y), np.maximum(x, y) - 1).astype(np.int64)


def eights(ids: np.ndarray) -> np.ndarray:
    """A hash of the AGREE words from each place on; equal words give equal hashes. Places too near the end get their own value's rest."""
    h = ids.astype(np.uint64)
    for step in (1, 2, 4):
        rest = np.zeros_like(h)
        rest[: len(h) - step] = h[step:]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ ((rest + np.uint64(step)) * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
    return h


def grid_pairs(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place jp, period p) of one text's grid pairs whose next words have equal hashes, some at a time."""
    n = len(hashes)
    for p in range(1, min(n // LEAST_PERIODS, LEAST_WORDS) + 1):
        row = hashes[::p]
        at = np.flatnonzero(row[1:] == row[:-1])
        if len(at):
            yield at * p, np.full(len(at), p)
    low = LEAST_WORDS + 1
    while low <= n // LEAST_PERIODS:  # many periods together: each has few pairs
        high = min(n // LEAST_PERIODS, low + max(0, PAIRS * low // n))
        periods = np.arange(low, high + 1)
        counts = (n - 1) // periods
        p = np.repeat(periods, counts)
        j = np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = j * p
        same = np.flatnonzero(hashes[at] == hashes[at + p])
        if len(same):
            yield at[same], p[same]
        low = high + 1


def some_at_once(hashes: dict[int, np.ndarray], starts: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place in it, period) of all texts' grid pairs, about PAIRS at a time."""
    parts, size = [], 0
    for i in starts:
        for at, p in grid_pairs(hashes[i]):
            parts.append((np.full(len(at), i), at, p))
            size += len(at)
            if size >= PAIRS:
                yield tuple(map(np.concatenate, zip(*parts)))
                parts, size = [], 0
    if parts:
        yield tuple(map(np.concatenate, zip(*parts)))


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, smallest period) of each text's runs by start, then period. Texts are arrays of word numbers."""
    hashes = {i: h for i, ids in enumerate(texts) if len(ids) >= LEAST_WORDS for h in [eights(ids)] if len(np.unique(h)) < len(h) and next(grid_pairs(h), None)}
    least: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    if hashes:
        sizes = [len(texts[i]) + 1 for i in hashes]
        starts = dict(zip(hashes, np.cumsum(sizes) - sizes))
        top = max(int(texts[i].max()) for i in hashes) + 1
        ahead = Suffixes(np.concatenate([np.append(texts[i], top + k) for k, i in enumerate(hashes)]))
        behind = Suffixes(np.concatenate([np.append(texts[i][::-1], top + k) for k, i in enumerate(hashes)]))
        start_of, words_of = np.zeros(len(texts), np.int64), np.array([len(t) for t in texts])
        start_of[list(starts)] = list(starts.values())
        for i, at, p in some_at_once(hashes, starts):
            here = start_of[i] + at
            length = p + ahead.agreement(here, here + p)
            back, inner = np.zeros(len(at), np.int64), np.flatnonzero(at > 0)
            mirrored = (start_of[i] + words_of[i] - at)[inner]
            back[inner] = behind.agreement(mirrored, mirrored - p[inner])
            length += back
            good = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
            for k, s, m, q in np.unique(np.stack([i[good], (at - back)[good], length[good], p[good]], axis=1), axis=0).tolist():
                least[k][s, m] = min(q, least[k].get((s, m), q))  # a run is also found at multiples of its period, with the same ends
    return [sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2])) for found in least]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: it lies in no run, or in the first period of every run that contains it."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def slices(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Words of texts, so many texts at a time that a slice has about SLICE words."""
    part, size = [], 0
    for t in texts:
        words = t.split() if t else []  # bytes: exactly the white space of the contract
        if part and size + len(words) > SLICE:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield part


def find(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """df with its runs (start, length, period in words, by start, then period) and the text's words without what repeats in them.

    Words are joined by one blank in ``collapsed``. Null and empty texts have no runs and collapse to the empty text; repeated rows stay; whole
    texts of any length are searched, each in one task; other columns are kept.
    """
    added = {runs: RUNS, collapsed: "string"}
    kept = [f for f in df.schema if f.name not in added]
    given = "__bytes"
    while given in df.columns:
        given += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            at = 0
            for part in slices(b.column(given).to_pylist()):
                coded = pa.array([w for words in part for w in words], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
                ends = np.cumsum([len(words) for words in part])
                found = runs_of(np.split(coded, ends[:-1]))
                texts = []
                for words, r in zip(part, found):
                    if r:
                        words = [words[k] for k in np.flatnonzero(kept_words(len(words), r))]
                    texts.append(b" ".join(words))
                rows = b.slice(at, len(part))
                at += len(part)
                listed = pa.array([[{"start": s, "length": m, "period": q} for s, m, q in r] for r in found], kind)
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in kept), listed, pa.array(texts, pa.binary()).cast(pa.string())], names=[*(f.name for f in kept), *added])

    return df.withColumn(given, F.col(text).cast("binary")).mapInArrow(run, with_columns(df, (), **added))


def rebuilt(key: Column, text: Column) -> Column:
    """The text that the contract of op11 makes of a document: every tenth key's words repeat with a period from some word on.

    Null stays null, and so do texts of documents without a key.
    """
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)

    def cyclic(words: Column) -> Column:
        n = F.size(words)
        first = F.pmod(g, n).cast("int")
        period = (1 + F.floor((n - first) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        times = F.ceil((n - first) / period).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, first + 1, period), times))
        return F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), first), again), F.lit(1), n), " ")

    split = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))  # an array of one, so that words are split once and used often
    made = F.get(F.transform(split, lambda words: F.when(F.size(words) > 0, cyclic(words)).otherwise("")), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, made).otherwise(text)


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_runs, the run of most periods (start, length, period, exponent_milli; null without runs), digests of all runs and of the kept words.

    Null counts as the empty text; repeated rows each give a row; other columns are not read.
    """
    found = find(df.select(F.col(key).alias("key"), rebuilt(F.col(key), F.col(text)).alias("text")))
    # exponents are compared exactly, as products; the first of equals comes by start, then period
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(more(r, a), r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select(F.col("key").alias(key), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return out.select(key, "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")
