"""Names: parsing, verdicts, symmetry, speed; and the Arrow functions over them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from casemill.functions import names
from casemill.operators.names_queries import gazetteer_of, match_names, parse_name, search


def verdict(a, b, known=()):
    return names.match(a, b, frozenset(map(names.key, known)))[1]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("Tomba Singh", "Tomba Singh", "LIKELY_SAME"),  # one given part and no family name: capped
        ("Khuraijam Tomba Singh", "Khuraijam Tomba", "SAME"),
        ("Okram Ibemcha Devi", "Okram Ibemchaa Debi", "SAME"),
        ("Kh. Loken Singh", "Khuraijam Loken Singh", "AMBIGUOUS"),  # two surnames go by Kh.
        ("Okram Tomba Meitei", "Okram Tombi Devi", "DIFFERENT"),  # the last vowel tells brother from sister
        ("Okram Tomba", "Laishram Tomba", "DIFFERENT"),
        ("", "Okram Tomba", "DIFFERENT"),
        ("Shri Okram Tomba S/o Okram Thoiba", "Okram Tomba", "SAME"),
        ("Okram T. Singh", "Okram Tomba Singh", "AMBIGUOUS"),
        ("0kram Tomba", "Okram Tomba", "SAME"),
    ],
)
def test_verdicts(a, b, want):
    assert verdict(a, b) == want, names.match(a, b)


def test_a_known_surname_resolves_an_abbreviation():
    assert verdict("Kh. Loken Singh", "Khuraijam Loken Singh", known=["Khuraijam"]) in ("SAME", "LIKELY_SAME")


def test_symmetry_and_bounds():
    rng = random.Random(1)
    parts = ["Okram", "Kh.", "Tomba", "Tombi", "Singh", "Devi", "Md.", "Ibemcha", "ongbi", "R.", "Thapa", "Guite", "Ram", "0kram", "", "Leima"]
    for _ in range(1500):
        a, b = (" ".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(2))
        x, y = names.match(a, b), names.match(b, a)
        assert x[:2] == y[:2], (a, b)
        assert 0 <= x[0] <= 100 and (x[0] < 50) == (x[1] == "DIFFERENT")


def test_ten_thousand_distinct_names_compared_in_a_second():
    syllables = "tom ba ibem cha lo ken san jen yai ma bi ra".split()
    rng = random.Random(2)
    took = []
    for _ in range(5):  # the best of five, in processor time: tests share their cores
        pairs = [tuple(f"{rng.choice(['Okram', 'Kh.', 'Laishram'])} {''.join(rng.choice(syllables) for _ in range(5)).title()} Singh" for _ in range(2)) for _ in range(10_000)]
        t = time.process_time()
        for a, b in pairs:
            names.match(a, b)
        took.append(time.process_time() - t)
        if took[-1] < 1.0:
            break
    assert min(took) < 1.0, took


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("R. K. Tomba", [("rk", True), ("tomba", False)]),
        ("Th.Ibemcha Devi", [("th", True), ("ibemcha", False), ("devi", False)]),
        ("Shri Okram Tomba (Late)", [("okram", False), ("tomba", False)]),
        ("Prof. Dr.", [("dr", True)]),
        ("Khurai.jam Tomba", [("khuraijam", False), ("tomba", False)]),
        ("1aishram T0mba", [("laishram", False), ("tomba", False)]),
        ("Asha, wife of Ram", [("asha", False)]),
        ("", []),
        ("99 --", []),
    ],
)
def test_tokens(raw, want):
    assert names.tokens(raw) == want


def test_edit_distance_up_to_two():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(3)
    for _ in range(5000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        assert [names.within(a, b, m) for m in (0, 1, 2)] == [min(plain(a, b), m + 1) for m in (0, 1, 2)]


def test_gazetteer_scores_and_relatives_are_inputs(spark):
    g = gazetteer_of(spark.createDataFrame([("Khundrakpam", "Meitei", "kh"), ("Khundrakpam", "Meitei", "kh"), (None, "x", "y"), ("Haokip", "Kuki-Zo", None)], "surname string, community string, abbreviation string"))
    assert names.match("Kh. Loken Singh", "Khundrakpam Loken Singh", gazetteer=g)[1] in ("SAME", "LIKELY_SAME")  # the only surname of that abbreviation
    assert names.match("Kh. Loken Singh", "Khuraijam Loken Singh", gazetteer=g)[1] == "AMBIGUOUS"
    assert names.match("Okram Tomba", "Okram Tomba", scores=names.Scores(same=101))[1] == "LIKELY_SAME"
    assert names.surnames(["Shri Okram Thoiba Singh", None, "O. Chaoba", "Laishram Ibemcha", "Okram X"]) == ["Okram", "Laishram"]
    score, verdict, headline, points = names.explain("Okram Tomba Meitei", "Okram Tombi Devi")
    assert verdict == "DIFFERENT" and headline and points and all(len(p.split()) <= 12 for p in points)
    with pytest.raises(ValueError):
        gazetteer_of(spark.createDataFrame([("a", "b", "c"), ("d", "e", "f")], "surname string, community string, abbreviation string"), most=1)


def test_search_is_ordered(spark):
    people = spark.createDataFrame([(3, "Okram Tomba"), (1, "Okram Tomba Singh"), (2, "Laishram Tomba"), (4, None), (5, "Okram Tombaa")], "id long, n string")
    got = [r.id for r in search(people, "okram tomba", "id", "n").collect()]
    assert got == [1, 3, 5]


def test_arrow_functions_take_nulls_and_long_texts(spark):
    df = spark.createDataFrame([("Okram Tomba", "Okram Tomba"), (None, "x"), ("", None), ("Tomba " * 2000, "Okram")], "a string, b string")
    got = df.select(match_names("a", "b", F.array().cast("array<string>")).alias("m"), parse_name("a").alias("p")).collect()
    assert got[0].m.verdict == "SAME" and [r.m.verdict for r in got[1:3]] == ["DIFFERENT", "DIFFERENT"] and got[1].p.normalised == ""
