"""Persons of one block: pairs of names at most one edit apart, all of them, and no others compared."""

from itertools import combinations

from casemill.operators.joins import near_candidates, near_persons


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def persons(spark, names, dobs=("1940-01-02",)):
    return spark.createDataFrame([("0001", 1940, d, n) for n in names for d in dobs], "last4 string, birth_year int, dob string, c_name string")


def test_a_large_block_of_unlike_names_has_no_pairs(spark):
    assert near_candidates(persons(spark, [f"{i:03d} name {i:03d}" for i in range(140)])).count() == 0


def test_pairs_equal_brute_force(spark):
    names, dobs = ["", "a", "b", "ab", "ba", "aab", "abb", "aabb", "abab", "bbbb", "abc", "abcd", "xbcd", "bcd", "acbd", "éa", "é"], ["1940", "1940-01-02", "1940-03-04"]
    got = [((r.dob, r.c_name), (r.o_dob, r.o_c_name)) for r in near_persons(persons(spark, names, dobs)).collect()]
    agree = lambda x, y: x[:4] == y[:4] if 4 in (len(x), len(y)) else x == y
    want = [(a, b) for a, b in combinations(sorted((d, n) for d in dobs for n in names), 2) if agree(a[0], b[0]) and edits(a[1], b[1]) <= 1]
    assert sorted(got) == sorted(want)
