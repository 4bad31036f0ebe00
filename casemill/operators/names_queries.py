"""Name parsing, comparison, identity matrices and search as Arrow functions over distinct names."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.functions import names
from casemill.plans.registry import query
from casemill.sources.views import literal, table

WORDS = T.ArrayType(T.StringType())
PARSED = T.StructType().add("normalised", "string").add("family", WORDS).add("given", WORDS).add("endings", WORDS).add("gender", "string")
MATCHED = T.StructType().add("score", "integer").add("verdict", "string").add("reasons", WORDS)
EXPLAINED = T.StructType().add("score", "integer").add("verdict", "string").add("headline", "string").add("points", WORDS)
#: At most so many surnames make a gazetteer, which goes to every worker.
MAX_SURNAMES = 100_000
_WORDS = pa.list_(pa.string())


def _struct(rows: list[tuple], **kinds: pa.DataType) -> pa.StructArray:
    columns = zip(*rows) if rows else ((),) * len(kinds)
    return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values())], list(kinds))


def _known(known: pa.Array) -> list[frozenset[str]]:
    return [frozenset(map(names.key, k)) if k else frozenset() for k in known.to_pylist()]


def parser(gazetteer: names.Gazetteer = names.DEMONSTRATION) -> Callable[..., Column]:
    """A function (name) -> struct of the name's parts."""

    @F.arrow_udf(PARSED)
    def parse_name(raw: pa.Array) -> pa.Array:
        parsed = [names.parse(x or "", gazetteer) for x in raw.to_pylist()]
        rows = [(n.text, [f[0] for f in n.family], [g[0] for g in n.given], n.endings, n.gender) for n in parsed]
        return _struct(rows, normalised=pa.string(), family=_WORDS, given=_WORDS, endings=_WORDS, gender=pa.string())

    return parse_name


def matcher(gazetteer: names.Gazetteer = names.DEMONSTRATION, scores: names.Scores = names.Scores()) -> Callable[..., Column]:
    """A function (a, b, surnames known from elsewhere) -> struct of score, verdict and reasons."""

    @F.arrow_udf(MATCHED)
    def match_names(a: pa.Array, b: pa.Array, known: pa.Array) -> pa.Array:
        rows = [names.match(x or "", y or "", k, gazetteer, scores) for x, y, k in zip(a.to_pylist(), b.to_pylist(), _known(known))]
        return _struct(rows, score=pa.int32(), verdict=pa.string(), reasons=_WORDS)

    return match_names


def explainer(gazetteer: names.Gazetteer = names.DEMONSTRATION, scores: names.Scores = names.Scores()) -> Callable[..., Column]:
    """A function (a, b, surnames known from elsewhere) -> struct of score, verdict, headline and points of at most twelve words."""

    @F.arrow_udf(EXPLAINED)
    def explain_match(a: pa.Array, b: pa.Array, known: pa.Array) -> pa.Array:
        rows = [names.explain(x or "", y or "", k, gazetteer, scores) for x, y, k in zip(a.to_pylist(), b.to_pylist(), _known(known))]
        return _struct(rows, score=pa.int32(), verdict=pa.string(), headline=pa.string(), points=_WORDS)

    return explain_match


def relatives(gazetteer: names.Gazetteer = names.DEMONSTRATION) -> Callable[..., Column]:
    """A function (array of relatives' names) -> array of the surnames that they have in full."""

    @F.arrow_udf(WORDS)
    def surnames_of(of: pa.Array) -> pa.Array:
        return pa.array([names.surnames(x or [], gazetteer) for x in of.to_pylist()], _WORDS)

    return surnames_of


parse_name, match_names, explain_match, surnames_of = parser(), matcher(), explainer(), relatives()


def gazetteer_of(rows: DataFrame, most: int = MAX_SURNAMES) -> names.Gazetteer:
    """A gazetteer from a table of surname, community and abbreviation (null or '' for none), first rows first by surname; more than ``most`` are refused."""
    got = rows.select("surname", "community", F.coalesce("abbreviation", F.lit("")).alias("abbreviation")).where("surname IS NOT NULL").distinct().orderBy("surname", "community", "abbreviation").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a gazetteer has at most {most} surnames")
    return names.Gazetteer([tuple(r) for r in got])


def none_known() -> Column:
    """No surnames known from elsewhere."""
    return F.array().cast("array<string>")


PEOPLE, _ = literal(
    [(1, "form", "Kh. Loken Singh"), (1, "card", "Khuraijam Loken Singh"), (1, "passbook", "LOKEN KHURAIJAM"), (2, "form", "Tomba Meitei"), (2, "card", "Tombi Devi"), (3, "form", "Smt. Ibemcha Devi W/o Okram Thomas"), (3, "card", "Ibemchaa Debi"), (3, "epic", "Okram Ongbi Ibemcha Devi"), (4, "form", "Md. Abdul Hussain"), (4, "card", "Mohd Abdul Husain"), (5, "form", None), (5, "card", "R.B. Thapa")],
    "case_id long, doc string, name string",
)
#: Documents in the order in which they are compared.
DOCUMENTS = ("form", "card", "epic", "passbook")


@query("name_parse")
def name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names, parsed once each."""
    people = PEOPLE(spark).select("name").unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))).distinct()
    return people.withColumn("p", parse_name("name")).select("name", "p.*")


def search(people: DataFrame, asked: str, key: str = "p_partkey", name: str = "p_name", matching: Callable[..., Column] = match_names) -> DataFrame:
    """Rows whose name holds the words asked for (score 95) or matches as a name, best first, then by key; cheap hits never reach the matcher."""
    p = people.select(key, name)
    cheap = F.contains(F.lower(name), F.lit(asked.lower()))
    hits = p.where(cheap).select(key, name, F.lit(95).alias("score"))
    rest = p.where(~cheap).select(name).distinct().withColumn("m", matching(name, F.lit(asked), none_known())).where("m.verdict <> 'DIFFERENT'").select(name, "m.score")
    return hits.unionByName(p.join(rest, name).select(key, name, "score")).orderBy(F.col("score").desc(), key)


@query("name_search")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over the names of parts."""
    return search(table(spark, sf_dir, "part"), "red widget")


_LISTED = " UNION ALL ".join(f"SELECT {i} AS ord, '{s}' AS surname, '{a}' AS abbreviation" for i, (s, _, a) in enumerate(names.SURNAMES) if a)


def ambiguous(gazetteer: DataFrame) -> DataFrame:
    """Abbreviations (of ord, surname, abbreviation) that stand for more than one surname, with those in the list's order."""
    inside = F.transform(F.array_sort(F.collect_list(F.struct("ord", "surname"))), lambda x: x["surname"])
    by = gazetteer.where("abbreviation <> ''").groupBy("abbreviation").agg(F.array_join(inside, ",").alias("surnames"), F.count("*").cast("int").alias("n"))
    return by.where("n > 1").select("abbreviation", "surnames", "n")


@query("name_gazetteer", f"""SELECT abbreviation, string_agg(surname, ',' ORDER BY ord) AS surnames, CAST(count(*) AS INT) AS n FROM ({_LISTED} UNION ALL SELECT 1000 + n_nationkey, n_name, lower(substr(n_name, 1, 2)) FROM nation UNION ALL SELECT 2000 + p_partkey, p_name, lower(substr(p_name, 1, 3)) FROM part)
WHERE abbreviation <> '' GROUP BY abbreviation HAVING count(*) > 1""")
def name_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambiguous abbreviations of the list together with the names of nations and parts."""
    listed = spark.createDataFrame([(i, s, a) for i, (s, _, a) in enumerate(names.SURNAMES) if a], "ord long, surname string, abbreviation string")
    made = [table(spark, sf_dir, t).select((F.col(k) + start).cast("long").alias("ord"), F.col(n).alias("surname"), F.lower(F.substring(n, 1, most)).alias("abbreviation")) for t, k, n, start, most in (("nation", "n_nationkey", "n_name", 1000, 2), ("part", "p_partkey", "p_name", 2000, 3))]
    return ambiguous(listed.unionByName(made[0]).unionByName(made[1]))
