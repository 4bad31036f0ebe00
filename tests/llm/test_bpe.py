"""Operator 1 against the tokenizers library."""

import random
import unicodedata

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from casemill.llm import bpe

PATH = P.path("word_bpe_49k.json")
ALPHABETS = ["abcdefgh", "aAbB  \n\t", "étüß ñ", "123 45a", "'s 't're", "漢字かな 한글", "ΑΣσς ΟΣ", "🙂👍 🏽a", "́ë a", "<|endoftext|> x", "\x1c\x1d a\x85\xa0b 　"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(7)
    out = ["", " ", "hello world", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "a" * 5000, "Hello,WORLD!!! don't they'll I'VE 3.14 x́", "ab" * 3000 + "!", "\x00\x01 \x7f", "<|endof", "İstanbul ǅ ﬁ ½ ² ⅷ ٣"]
    for _ in range(1500):
        a = rng.choice(ALPHABETS) + rng.choice(ALPHABETS)
        out.append("".join(rng.choice(a) for _ in range(rng.randint(1, 60))))
    for _ in range(300):
        out.append(" ".join(rng.choice(["the", "ing", "tion", "er", "an", "th", "lowei", "Übung", "ción"]) * rng.randint(1, 3) + rng.choice(["", ".", ",", "!!"]) for _ in range(20)))
    return out


def test_ids_and_decoded_text_equal_the_library(library):
    t = bpe.load(PATH)
    for x in texts():
        want = library.encode(x, add_special_tokens=False).ids
        ids = t.encode(x)
        assert ids.tolist() == want, repr(x)
        assert t.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def all_code_points():
    """Every code point between two letters, 512 to a text; of the unassigned planes and of private use every 97th."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 and not 0xE000 <= c < 0xF900 or 0xE0000 <= c < 0xE1000 or c % 97 == 0)]
    return [" ".join(f"x{c}y" for c in points[at : at + 512]) for at in range(0, len(points), 512)]


def mixed_marks(n=3000):
    rng = random.Random(11)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in points if unicodedata.combining(c)]
    return ["".join(rng.choice(rng.choice((points, marks, marks, "aé1 ,Σİ"))) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_every_code_point_and_mixed_marks(library):
    t, texts_ = bpe.load(PATH), all_code_points() + mixed_marks()
    for x, want in zip(texts_, library.encode_batch(texts_, add_special_tokens=False)):
        assert t.encode(x).tolist() == want.ids, repr(x[:200])


def test_round_trip_frame(spark, library):
    rows = [(1, "Hello there"), (2, None), (3, ""), (4, "word " * 3000), (4, "word " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token_ids", bpe.F.lit("clash"))
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(got) == 5
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.digests(df.limit(0), PATH).count() == 0
