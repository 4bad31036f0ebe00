"""The pipeline's stages against plain versions on a small corpus."""

import random
from collections import Counter

import duckdb
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from casemill.llm import bpe, fair_mix, pii
from tests.llm.test_chosen_path import brute

NAMES = [n for n, _ in cp.STAGES]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(6)
    word = lambda: "w%d" % rng.randint(0, 900)
    rows = []
    for i in range(240):
        text = " ".join(word() for _ in range(rng.randint(22, 80)))
        if i % 6 == 0:
            text = " ".join(w + "###" for w in text.split())
        if i % 5 == 0 and rows:
            text = rows[-1][1] + " tail"
        if i % 7 == 0:
            text += " mail a.b@c.org now"
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows += [(900, None, "en", "s0", 0), (901, "", "en", None, 0), (902, "too short", "de", None, 9), (7, rows[7][1], "en", "s3", 1)]
    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], int("###" not in (r[1] or "")), 0) for r in rows[:200]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    first = cp.quality(spark, docs, sf)
    kept = {r.doc_id: r.text for r in first.collect()}
    clean = {r.doc_id for r in docs.collect() if r.text and len(r.text.split()) >= 20 and "###" not in r.text}
    assert first.columns == columns and set(kept) == clean
    second = cp.near_duplicates(spark, first, sf)
    rows = sorted((r.doc_id, r.text) for r in first.collect())
    least = {c for _, c, _ in brute(rows)}
    assert second.columns == columns and sorted(r.doc_id for r in second.collect()) == sorted(least)
    third = cp.personal_data(spark, second, sf)
    assert third.columns == columns
    for r in third.collect():
        assert "@" not in r.text and r.n_chars == len(r.text) and r.text == pii.mask(kept[r.doc_id], pii.spans_of(kept[r.doc_id]))
    fourth = cp.source_mix(spark, third, sf)
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert fourth.columns == columns and abs(words(fourth) - words(third)) <= 90
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in fourth.collect()}
    last = cp.encode(spark, fourth, sf).collect()
    assert len(last) == fourth.count()
    for r in last[:40]:
        assert r.token_ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)
    assert bpe.CACHE > 0 and NAMES == ["quality", "near_duplicates", "personal_data", "source_mix", "encode"]


def test_run_equals_brute_force(spark, sf):
    """The whole of run() against plain steps: the counts of each text, all pairs of texts, masked spans, the mix's SQL, the library's ids."""
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and len(r.text.split()) >= 20 and "###" not in r.text]
    of = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        of.setdefault(r.doc_id, r)
    least = sorted({c for _, c, _ in brute(sorted((r.doc_id, r.text) for r in rows))})
    kept = [(i, pii.mask(of[i].text, pii.spans_of(of[i].text)), of[i].source, of[i].lang) for i in least]
    keyed = spark.createDataFrame(kept, "doc_id long, text string, source string, lang string").selectExpr("md5(concat_ws(':', CAST(doc_id AS STRING), CAST(xxhash64(text) AS STRING))) AS own", "doc_id", "text", "source")
    documents = keyed.selectExpr("own AS doc_id", "source", "text").toPandas()  # noqa: F841  read by name
    copies = dict(duckdb.connect().sql(f"SELECT doc_id, copies FROM ({fair_mix.ORACLE})").fetchall())
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for r in keyed.collect():
        if copies[r.own]:
            want[r.doc_id, of[r.doc_id].lang, r.source, tuple(library.encode(r.text, add_special_tokens=False).ids)] += copies[r.own]
    got = Counter((r.doc_id, r.lang, r.source, tuple(r.token_ids)) for r in cp.run(spark, sf).collect())
    assert got == want and all(copies[k] <= 3 for k in copies)


def test_run_and_empty_table(spark, sf):
    assert cp.run(spark, sf).count() > 50
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_odd_rows_and_clashing_columns(spark, sf):
    """Nulls in every column, repeated rows, a very long text and columns named like the operators' own go through each stage and stay."""
    rows = [(i, " ".join(f"a{i}b{k}" for k in range(30)), "en", f"s{i % 2}", 1) for i in range(20)]
    rows += [(None, "null key " + " ".join(map(str, range(40))), None, None, None), (3, rows[3][1], "en", "s1", 1), (3, rows[3][1], "en", "s1", 1), (50, " ".join(f"long{k}" for k in range(60_000)), "de", "s1", 2)]
    odd = ["n_words", "kept", "size", "copies", "key", "class_id", "pii", "token_ids", "score", "taken", "target", "node"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"CAST(doc_id AS STRING) AS `{c}`" for c in odd])
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        got = docs.collect()
        assert docs.columns == columns and got, name
        assert all(r[c] == (None if r.doc_id is None else str(r.doc_id)) for r in got for c in odd), name
        if name == "near_duplicates":
            assert sorted((r.doc_id or -1 for r in got)) == sorted([-1, *range(1, 20), 50, -1])
    assert {r.doc_id for r in cp.encode(spark, docs, sf).collect()} == {r.doc_id for r in got}
