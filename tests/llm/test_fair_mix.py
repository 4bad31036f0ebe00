"""Operator 7: against its SQL, and the contract's bounds."""

import duckdb
import pytest

from casemill.llm import fair_mix


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "'x' AS copies")
    got = fair_mix.report(df).toPandas()
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841  read by name
    want = con.sql(fair_mix.ORACLE).df()
    key = ["doc_id", "source", "size", "taken"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(rows) and (a[["doc_id", "size", "source_size", "taken", "copies"]].fillna(-1).to_numpy() == b[["doc_id", "size", "source_size", "taken", "copies"]].fillna(-1).to_numpy()).all()
    assert a.target.to_numpy() == pytest.approx(b.target.to_numpy())
    assert (a.taken <= 3 * a["size"]).all()
    for _, g in a.fillna({"source": "-"}).groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2 * a["size"].max()
        assert g.target.iloc[0] <= 3 * g.source_size.iloc[0] + 1e-9
    assert abs(a.drop_duplicates("source").target.sum() - a["size"].sum()) < 1e-6
    return a


def test_mix(spark):
    rows = [(i, None if i % 17 == 0 else f"s{i % 23 % 5}", None if i % 19 == 0 else "w " * (i * 7 % 40)) for i in range(600)]
    rows += [(1000 + i, "hot", "a b c d e") for i in range(500)] + [(5, "s1", "same words")] * 4 + [(3000 + i, "tiny", "a b") for i in range(9)]
    a = check(spark, rows)
    assert a.copies.max() == 3  # small sources are repeated
    check(spark, [(1, "a", "x y"), (2, "b", "")])


def test_empty_and_writing(spark):
    df = spark.createDataFrame([(1, "a", "x y z"), (2, "b", "x " * 100)], "doc_id long, source string, text string")
    assert fair_mix.report(df.limit(0)).count() == 0
    out = fair_mix.apply(df)
    copies = {r.doc_id: r.copies for r in fair_mix.mix(df.union(df.limit(0))).collect()}
    assert out.columns == df.columns and set(copies) == {1, 2} and out.count() >= 1
    many = spark.createDataFrame([(i, f"s{i % 3}", "w " * (i % 9)) for i in range(90)] + [(8, "s2", "w " * 8)], "doc_id long, source string, text string")
    got = fair_mix.apply(many).collect()
    assert abs(sum(len(r.text.split()) for r in got) - sum(len(r.text.split()) for r in many.collect())) <= 8


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 300_000, "a"), (2, "one two", "a"), (3, "three", None)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in fair_mix.report(df).collect()}
    assert [got[i]["size"] for i in (1, 2, 3)] == [300_000, 2, 1] and all(r.taken <= 3 * r["size"] for r in got.values())
