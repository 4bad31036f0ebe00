"""Quality rules as a learned decision list (operator 6).

Sequential covering: rules that recognise low quality are grown one at a time from labelled statistics, each a conjunction of thresholds
chosen by information gain, pruned on rows held out from growing, and emitted as an ordered Spark conditional expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import labelled_sample, with_columns

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
#: Counts that every document gets.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct_words", "n_marks")
#: At most so many labelled rows train the list.
MAX_LABELLED = 20_000


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more in the text, the first place included."""
    n = len(words) - window + 1
    if n < 2 or len(set(words)) == len(words):  # without a word that comes again no window does
        return 0
    ids: dict[str, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # name windows of 2, 4, ... words by their halves' names: exact, no hashing
    width = 1
    while width < window:
        step = min(width, window - width)
        a, b = x[: len(x) - step], x[step:]
        _, x = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)
        width += step
    again = np.bincount(x)[x] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    words = WORDS.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line in seen:
            dup += 1
        elif WORDS.search(line):
            seen.add(line)
    text = text or ""
    return (
        len(words),
        sum(map(len, words)),
        len(SYMBOLS.findall(text)),
        dup,
        repeat_words(words),
        len(UPPER.findall(text)),
        len(set(words)),
        text.count("!") + text.count("?"),
    )


UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts (long) of its whole texts; a null or empty text has zeros. Columns named alike are replaced."""
    kept = [f for f in df.schema if f.name not in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([counts_of(x.as_py()) for x in b.column(text)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *(pa.array(c) for c in rows.T)], names=[*(f.name for f in kept), *COUNTS])

    return df.mapInArrow(run, with_columns(df, COUNTS, **dict.fromkeys(COUNTS, "long")))


def ratios() -> dict[str, Column]:
    """The statistics that rules test, from the counts; 0 for a text without words."""

    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "word_length": per("word_chars", "n_words"),
        "symbol_rate": per("n_symbols", "n_words"),
        "repeat_rate": per("n_repeat_words", "n_words"),
        "distinct_rate": per("n_distinct_words", "n_words"),
        "upper_rate": per("n_upper", "word_chars"),
        "mark_rate": per("n_marks", "n_words"),
        "dup_lines": F.col("n_dup_lines").cast("double"),
    }


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    threshold: float

    def column(self, stats: dict[str, Column]) -> Column:
        return stats[self.name] > self.threshold if self.above else stats[self.name] <= self.threshold

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.threshold if self.above else x[self.name] <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction that means low quality, with what it covered of the pruning rows."""

    tests: tuple[Test, ...]
    hits: int
    misses: int

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([t.rows(x) for t in self.tests])


def _best_test(x: dict[str, np.ndarray], low: np.ndarray, inside: np.ndarray) -> Test | None:
    """The test with the largest information gain (as of rule growing: positives kept times the rise of their log share)."""
    y = low[inside]
    p, n = int(y.sum()), len(y)
    best, found = 1e-9, None
    for name, values in x.items():
        v = values[inside]
        order = np.argsort(v, kind="stable")
        sv, sy = v[order], np.cumsum(y[order])
        cuts = np.flatnonzero(sv[1:] > sv[:-1])
        if not len(cuts):
            continue
        for above in (False, True):
            t = sy[cuts] if not above else p - sy[cuts]
            m = cuts + 1 if not above else n - cuts - 1
            gain = np.where(t > 0, t * (np.log2(np.maximum(t, 1) / m) - np.log2(p / n)), 0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], Test(name, above, float((sv[cuts[k]] + sv[cuts[k] + 1]) / 2))
    return found


def learn(x: dict[str, np.ndarray], low: np.ndarray, seed: int = 5, max_rules: int = 12, max_tests: int = 4, least_precision: float = 0.9, least_cover: int = 3) -> list[Rule]:
    """An ordered list of rules for low quality. Rows are dealt two to one into growing and pruning rows; a rule must keep its precision on the latter."""
    grow = np.random.default_rng(seed).random(len(low)) < 2 / 3
    rest, rules = np.ones(len(low), bool), []
    while len(rules) < max_rules and (low & rest & grow).sum() >= least_cover:
        tests: list[Test] = []
        inside = rest & grow
        while len(tests) < max_tests and 0 < low[inside].sum() < inside.sum():
            if (t := _best_test(x, low, inside)) is None:
                break
            tests.append(t)
            inside = inside & t.rows(x)

        def worth(k: int) -> tuple[float, int, int]:
            r = rest & ~grow & np.logical_and.reduce([t.rows(x) for t in tests[:k]])
            hit, all_ = int((low & r).sum()), int(r.sum())
            return (2 * hit - all_) / max(all_, 1) + 1e-6 * hit, hit, all_ - hit

        if not tests:
            break
        k = max(range(1, len(tests) + 1), key=lambda k: (worth(k)[0], -k))
        _, hit, miss = worth(k)
        if hit < 1 or hit < least_precision * (hit + miss):
            break
        rule = Rule(tuple(tests[:k]), hit, miss)
        rules.append(rule)
        rest = rest & ~rule.rows(x)
    return rules


def expression(rules: list[Rule], stats: dict[str, Column] | None = None) -> Column:
    """True for rows that no rule calls low quality: the rules as an ordered conditional expression."""
    stats = stats or ratios()
    out = F.lit(True)
    for rule in reversed(rules):
        test = rule.tests[0].column(stats)
        for t in rule.tests[1:]:
            test = test & t.column(stats)
        out = F.when(test, F.lit(False)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learn from the quality (0 is low) of at most ``max_labelled`` labelled rows, see labelled_sample(); equal rows count once.

    Without labels there are no rules, and only the base rule rejects. A document with both labels counts as one of each.
    """
    rows = statistics(labelled_sample(documents, labels, "quality", key, "text", max_labelled)).where(F.col("n_words") > 0)
    names = ratios()
    got = rows.select("quality", *[c.alias(n) for n, c in names.items()]).toPandas()  # at most max_labelled rows of numbers
    got = got.sort_values(list(got.columns)).reset_index(drop=True)
    return learn({n: got[n].to_numpy(float) for n in names}, got["quality"].to_numpy() == 0)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document; a null text has no words and fails the base rule."""
    rules = train(documents, labels)
    out = statistics(documents.select("doc_id", "text")).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & expression(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
