"""Operator 3: held-out accuracy, and texts of all kinds."""

import math
import random
import re
import zlib

import numpy as np

from casemill.llm import toxicity


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    vocabulary = ["w" + "".join(rng.choice("aeiou") + rng.choice("bdfgk") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    endings = ["a", "en", "ig", "t", "ung", "os", "ist", "um"]
    rows = []
    for i in range(1500):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(10, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["qorm", "zlup"]) + rng.choice(endings) if i % 2 else rng.choice(["idiot", "scum", "1d1ot", "LOSER!"]))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(None, "x", 1), (9000, None, 1), (9001, "", 1), (9001, "", 1), (9002, "idiot " * 20000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == 1505 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    held = [(y, by[i]) for i, _, y in rows if by[i].held_out]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert sum(bool(y) == bool(r.predicted) for y, r in held) / len(held) > 0.95
    assert by[9002].predicted == 1 and by[9001].predicted == 0


def test_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.report(docs, labels).collect()} == {0.0}
    assert toxicity.report(docs.limit(0), labels.limit(0)).count() == 0


def plain_features(text, learned):
    """The eleven features, chunk by chunk, without codes or caches."""
    chunks, seeds, second_ = (text or "").split(), set(toxicity.INSULTS.split()), set(toxicity.SECOND.split())
    n = max(1, len(chunks))

    def weight(w):
        return max(learned.get(w + " ", 0.0), 4.0 if w in seeds else 0.0, *(learned.get(w[:k], 0.0) for k in toxicity.STEMS if len(w) >= k), 0.0)

    weights, seed, hidden, second, odd = [], 0, 0, [], 0
    for i, c in enumerate(chunks):
        words = re.findall(r"[^\W\d_]+", c.lower())
        best, is_seed = max([weight(w) for w in words], default=0.0), any(w in seeds for w in words)
        if any(w in second_ for w in words):
            second.append(i)
        inner = c.lower().strip(".,;:!?\"'()[]{}*#&%$|<>-")
        if words and len(inner) > 2 and not inner.isalpha():
            odd += 1
            if not best:
                bare = "".join(re.findall(r"[^\W\d_]+", inner.translate(str.maketrans("013457@$!|", "oieastasil"))))
                best = weight(bare)
                hidden += best > 0
                is_seed = is_seed or bare in seeds
        seed += is_seed
        weights.append(min(255, round(best * 16)) / 16)
    hits = [i for i, w in enumerate(weights) if w]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in hits)
    letters = len(re.findall(r"[^\W\d_]", text or ""))
    upper = len(re.findall(r"[^\W\d_a-zß-ÿ]", text or ""))
    marks = sum((text or "").count(x) for x in "!?")
    told = [weights[i] for i in hits]
    return (len(hits) / n, math.log1p(len(hits)), max(told, default=0.0), sum(told) / len(told) if told else 0.0, math.log1p(seed), math.log1p(hidden), near / n, upper / max(1, letters), marks / n, odd / n, math.log1p(len(chunks)))


def test_features_equal_brute_force(spark):
    rng = random.Random(8)
    learned = {"zlup ": 3.1, "qorm": 2.4, "dürr": 5.0, "badword ": 20.0}
    parts = ["You", "your,", "du", "idiot", "1d1ot!", "s-t-u-p-i-d", "zlup", "ZLUP?", "qormish", "dürrer", "badword", "plain", "word", "A1", "!!!", "x_y", "Élan", "(scum)", "l0ser", "12", "tú", "m0r0n.", "b@dword"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", " ", "idiot you " * 3000]
    lexicon = toxicity.Lexicon(learned)
    for x in texts:
        assert np.allclose(lexicon.features(x), plain_features(x, learned)), x
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.features(df, learned).collect()}
    assert all(np.allclose([got[i][f] for f in toxicity.FEATURES], plain_features(x, learned)) for i, x in enumerate(texts))
