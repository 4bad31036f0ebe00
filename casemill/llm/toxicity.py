"""Toxicity (operator 3): gradient-boosted trees over dense features, with isotonic calibration.

Features are lexicon densities, how near lexicon words stand to the second person, capitals, punctuation and obfuscation rates. The lexicon
is a short fixed list plus words and word beginnings learned from labelled documents. Training rows are dealt by their ids into three parts:
one for the lexicon, one for the trees, one for the calibration.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.bpe import Recent
from casemill.llm.common import labelled_sample, materialize, temporaries, with_columns

#: At most so many labelled rows train the classifier.
MAX_LABELLED = 20_000
#: At most so many learned lexicon entries, and what each needs: documents with it, and its log odds.
MAX_LEXICON, LEAST_DOCS, LEAST_ODDS = 5_000, 3, 2.0
#: Lengths of the word beginnings that may enter the lexicon, beside whole words (marked with a trailing blank).
STEMS = (4, 5, 6, 7)
# Common insults, and second-person words of four languages.
INSULTS = "idiot moron stupid loser pathetic worthless disgusting scum trash clown dumb fool jerk filthy vile garbage imbecile ugly hate kill"
SECOND = "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros"
LEET = str.maketrans("013457@$!|", "oieastasil")
LETTERS = re.compile(r"[^\W\d_]+")
UPPER, LOWER, MARKS = re.compile(r"[^\W\d_a-zß-ÿ]"), re.compile(r"[^\W\d_]"), re.compile(r"[!?]")
NEAR = 5
FEATURES = ("lexicon_rate", "lexicon_hits", "lexicon_max", "lexicon_mean", "seed_hits", "hidden_hits", "near_second", "capitals", "marks", "obfuscated", "length")
# Codes of a chunk: the lexicon weight in 1/16 in the low byte, then flags.
SECOND_BIT, SEED_BIT, HIDDEN_BIT, ODD_BIT = 256, 512, 1024, 2048


class Lexicon:
    """Weights of words and beginnings; gives each white-space run of a text its code."""

    def __init__(self, learned: dict[str, float]):
        self.learned, self.seed, self.second = learned, set(INSULTS.split()), set(SECOND.split())
        self.codes = Recent(self.code)

    def weight(self, word: str) -> float:
        return max([self.learned.get(word + " ", 0.0), 4.0 * (word in self.seed), *(self.learned.get(word[:k], 0.0) for k in STEMS if len(word) >= k)])

    def code(self, chunk: str) -> int:
        low, out, best = chunk.lower(), 0, 0.0
        words = LETTERS.findall(low)
        for w in words:
            best = max(best, self.weight(w))
            out |= SECOND_BIT * (w in self.second) | SEED_BIT * (w in self.seed)
        inner = low.strip(".,;:!?\"'()[]{}*#&%$|<>-")
        if words and not inner.isalpha() and len(inner) > 2:
            out |= ODD_BIT
            if not best:
                plain = "".join(LETTERS.findall(inner.translate(LEET)))
                best = self.weight(plain)
                out |= HIDDEN_BIT * (best > 0) | SEED_BIT * (plain in self.seed)
        return out | min(255, round(best * 16))

    def features(self, text: str | None) -> tuple[float, ...]:
        chunks = (text or "").split()
        n = max(1, len(chunks))
        codes = np.fromiter(map(self.codes.__getitem__, chunks), np.int32, len(chunks))
        w = (codes & 255) / 16
        hits = np.flatnonzero(w)
        near = 0
        if len(hits):
            second = np.flatnonzero(codes & SECOND_BIT)
            near = int((np.searchsorted(second, hits + NEAR, "right") > np.searchsorted(second, hits - NEAR)).sum())
        letters = len(LOWER.findall(text)) if text else 0
        upper = len(UPPER.findall(text)) if text else 0
        return (
            len(hits) / n,
            math.log1p(len(hits)),
            float(w.max()) if len(hits) else 0.0,
            float(w[hits].mean()) if len(hits) else 0.0,
            math.log1p(int((codes & SEED_BIT > 0).sum())),
            math.log1p(int((codes & HIDDEN_BIT > 0).sum())),
            near / n,
            upper / max(1, letters),
            len(MARKS.findall(text or "")) / n,
            int((codes & ODD_BIT > 0).sum()) / n,
            math.log1p(len(chunks)),
        )


def entries(text: str | None) -> set[str]:
    """What of a text may enter the lexicon: its words, and their beginnings."""
    out = set()
    for w in set(LETTERS.findall((text or "").lower())):
        out.add(w + " ")
        out.update(w[:k] for k in STEMS if len(w) >= k)
    return out


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Entries with high log odds in toxic documents; counts are summed in Spark, and the best come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (toxic if y else clean).update(entries(x))
        names = list(toxic.keys() | clean.keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[x] for x in part], pa.int64()), pa.array([clean[x] for x in part], pa.int64())], names=["entry", "toxic", "clean"])

    n = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}  # two rows
    odds = F.log((F.col("toxic") + 0.5) / (n.get(1, 0) + 1.0)) - F.log((F.col("clean") + 0.5) / (n.get(0, 0) + 1.0))
    counts = labelled.select("text", "toxic").mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = counts.where(F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (F.col("toxic") > F.col("clean")))
    best = kept.orderBy((F.col("odds") * F.log1p("toxic")).desc(), "entry").limit(MAX_LEXICON)
    return {r.entry: r.odds for r in best.select("entry", "odds").collect()}


def part(key: str) -> Column:
    """A row's part by its id: 0 is held out, 1 and 2 learn the lexicon, 3 the trees, 4 the calibration."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5).cast("int")


_LEXICONS: dict[str, Lexicon] = {}


def features(df: DataFrame, lexicon: dict[str, float], text: str = "text") -> DataFrame:
    """df, its text replaced by the features of the whole text; empty and null texts have zeros."""
    kept = [f for f in df.schema if f.name not in (text, *FEATURES)]
    learned, version = df.sparkSession.sparkContext.broadcast(lexicon), uuid.uuid4().hex  # at most MAX_LEXICON entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _LEXICONS:
            _LEXICONS.clear()
            _LEXICONS[version] = Lexicon(learned.value)
        of = _LEXICONS[version].features
        for b in batches:
            rows = np.array([of(x.as_py()) for x in b.column(text)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *(pa.array(c) for c in rows.T)], names=[*(f.name for f in kept), *FEATURES])

    return df.mapInArrow(run, with_columns(df, (text,), **dict.fromkeys(FEATURES, "double")))


class Model:
    """A learned lexicon, trees and calibration; score() adds score (0 to 1) to rows of features."""

    def __init__(self, lexicon: dict[str, float], trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, rows: DataFrame) -> DataFrame:
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.constant))
        kept = [c for c in rows.columns if c not in FEATURES]
        out = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(rows))
        out = out.select(*kept, vector_to_array("__p")[1].alias("__raw"))
        if self.calibration is None:
            return out.withColumnRenamed("__raw", "score")
        out = self.calibration.transform(out)
        # steps of the calibration tie; a small share of the trees' own probability keeps their order
        return out.select(*kept, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("__calibrated") + 0.01 * F.col("__raw"))).alias("score"))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from at most ``max_labelled`` labelled rows that aren't held out, see labelled_sample(). Without both classes every score is the labels' mean, or 0."""
    with temporaries(documents.sparkSession):
        chosen = labelled_sample(documents, labels.where(part(key) != 0), "toxic", key, "text", max_labelled)
        rows = materialize(chosen.select(part(key).alias("part"), "text", F.col("toxic").cast("int").alias("toxic")), "toxicity-labelled")
        lexicon = learn_lexicon(rows.where(F.col("part").isin(1, 2)))
        sample = materialize(features(rows.where(F.col("part") >= 3), lexicon), "toxicity-sample").repartition(4)
        by = {(r["part"], r["toxic"]): r["count"] for r in sample.groupBy("part", "toxic").count().collect()}  # four rows
        if not (by.get((3, 0)) and by.get((3, 1))):
            total = sum(by.values())
            return Model(lexicon, constant=sum(n for (_, y), n in by.items() if y) / total if total else 0.0)
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(sample).select("part", "toxic", "__x").persist()
        learner = GBTClassifier(featuresCol="__x", labelCol="toxic", predictionCol="__y", maxDepth=3, maxIter=15, stepSize=0.3, seed=1, minInstancesPerNode=3)
        trees = learner.setProbabilityCol("__p").setRawPredictionCol("__r").fit(vectors.where("part = 3"))
        calibration = None
        if by.get((4, 0)) and by.get((4, 1)):
            raw = trees.transform(vectors.where("part = 4")).select(F.col("toxic").cast("double").alias("toxic"), vector_to_array("__p")[1].alias("__raw"))
            calibration = IsotonicRegression(featuresCol="__raw", labelCol="toxic", predictionCol="__calibrated").fit(raw)
        vectors.unpersist()
    return Model(lexicon, trees, calibration)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Only rows that aren't held out teach labels; a score depends on the text alone."""
    model = train(documents, labels)
    rows = features(documents.select("doc_id", "text"), model.lexicon)
    out = model.score(rows.withColumn("held_out", part("doc_id") == 0))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
