"""Numbers that skip what is taken, natural order, and what is removed when results are done with."""

import os
import random

import pytest
from pyspark.sql import functions as F

from casemill.operators.aggregates import by_name, natural_key
from casemill.operators.windows import allotted
from casemill.sources import shared
from casemill.sources.shared import cleanup, materialize, temporaries


def plain(asking, taken):
    used, out = {}, []
    for g, n in taken:
        used.setdefault(g, []).append(n)
    given = {g: set(ns) for g, ns in used.items()}
    for key, g in sorted(asking, key=lambda x: (x[1], x[0])):
        n = len(used.get(g, [])) + 1
        while n in given.setdefault(g, set()):
            n += 1
        given[g].add(n)
        out.append((key, g, n))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_numbers_equal_trying_one_by_one(spark, seed):
    rng = random.Random(seed)
    taken = [(rng.choice("abc"), rng.randint(1, 40)) for _ in range(rng.choice([0, 20, 60]))]
    asking = [(i, "hot" if i % 3 == 0 else rng.choice("abcd")) for i in range(90)]
    got = allotted(spark.createDataFrame(asking, "id long, g string"), spark.createDataFrame(taken, "g string, number long"), "g", ["id"])
    assert sorted(tuple(r) for r in got.collect()) == plain(asking, taken)


def test_numbers_of_nobody(spark):
    none = spark.createDataFrame([], "id long, g string")
    assert allotted(none, spark.createDataFrame([("a", 1)], "g string, number long"), "g", ["id"]).count() == 0


def test_natural_order(spark):
    names = ["packet-10", "packet-2", "Packet-2", "packet-02", "b", "B", "a", "10", "9", "x1y20", "x1y3", "x01y3", "", "file 2 of 10", "file 2 of 9", "é"]
    got = [r.n for r in by_name(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()]
    assert got == ["", "9", "10", "a", "B", "b", "file 2 of 9", "file 2 of 10", "Packet-2", "packet-02", "packet-2", "packet-10", "x01y3", "x1y3", "x1y20", "é"]
    assert spark.range(1).select(natural_key(F.lit(None).cast("string"))).first()[0] is None


def test_what_results_read_is_removed_on_demand(spark):
    cleanup(spark)
    df = spark.range(3)
    with temporaries(spark, "result"):
        gone = materialize(df, "step")._casemill_path
        result = materialize(df, "result")
    alone = materialize(df, "alone")
    local = lambda p: p.removeprefix("file:")
    paths = [local(x._casemill_path).replace("//", "/") for x in (result, alone)]
    assert result.count() == 3 and not os.path.exists(local(gone).replace("//", "/")) and all(map(os.path.exists, paths))
    assert cleanup(spark) == 2 and not any(map(os.path.exists, paths)) and cleanup(spark) == 0 and shared._KEPT == []
