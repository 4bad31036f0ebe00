"""Operator 9 against the tokenizers library."""

import public_tokenizers as P
from tokenizers import Tokenizer

from casemill.llm import token_count
from tests.llm.test_bpe import all_code_points, mixed_marks, texts

PATH = P.path("byte_bpe_50k.json")


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    more = ["  a  b", "a \n b\n\n c  ", " \t\x1c x\x1fy", "a\x85b\xa0 c", "end   ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "'s it's  'S", "x" * 20000, "ab" * 9000]
    rows = [(i, x) for i, x in enumerate(texts() + more)]
    counter = token_count.Counter(PATH, token_count.prove(PATH))
    for _, x in rows:
        assert counter.count(x) == len(library.encode(x, add_special_tokens=False).ids), repr(x)
    df = spark.createDataFrame([*rows[:50], (None, None), (1, "")], "doc_id long, text string")
    got = token_count.token_counts(df, PATH, limit=20).collect()
    assert len(got) == 52
    for r, (i, x) in zip(got, [*rows[:50], (None, None), (1, "")]):
        n = len(library.encode(x or "", add_special_tokens=False).ids)
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (i, len((x or "").encode()), n, n > 20)


def test_proof_holds_for_every_string():
    library, proven = Tokenizer.from_file(PATH), token_count.prove(PATH)
    assert len(proven) > 45_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(list(proven), add_special_tokens=False))


def test_every_code_point_and_mixed_marks():
    library, counter, texts_ = Tokenizer.from_file(PATH), token_count.Counter(PATH, token_count.prove(PATH)), all_code_points() + mixed_marks()
    for x, want in zip(texts_, library.encode_batch(texts_, add_special_tokens=False)):
        assert counter.count(x) == len(want.ids), repr(x[:200])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    assert token_count.token_counts(df, PATH).collect() == []
