"""Checks that may be undecided, first names, names of files, check digits."""

from pyspark.sql import functions as F

from casemill.functions import text
from casemill.operators.eligibility import check_age, check_income, first_name, true_extension
from casemill.operators.names_queries import parse_name


def rows(spark, data, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_age_on_a_day(spark):
    given = [("1/1/1941", "2001-01-01"), ("2/1/1941", "2001-01-01"), ("1941", "2001-12-31"), ("1941", "30.12.2001"), ("31/02/1941", "2001-01-01"), ("1941-01-01", "2001"), (None, "2001-01-01"), ("2005-01-01", "2001-01-01")]
    got = [tuple(r[0]) for r in rows(spark, given, "dob string, on string", check_age(F.col("dob"), F.col("on")))]
    assert got == [(True, 60, False), (False, 59, False), (True, 60, True), (False, 59, True), (None, None, False), (None, None, False), (None, None, False), (None, None, False)]


def test_income(spark):
    given = [(60000.0,), (60000.01,), (0.0,), (None,), (float("nan"),), (float("inf"),)]
    assert [r[0] for r in rows(spark, given, "x double", check_income(F.col("x")))] == [True, False, True, None, None, None]


def test_first_names(spark):
    df = spark.createDataFrame([("Khuraijam Loken Singh",), ("",), (None,), ("  ",), ("Singh",)], "name string").withColumn("p", parse_name("name"))
    got = {r.name: r.f for r in df.select("name", first_name("name", "p").alias("f")).collect()}
    assert got["Khuraijam Loken Singh"].lower() == "loken" and got[None] == got[""] == got["  "] == "Applicant" and got["Singh"].lower() == "singh"


def test_file_names(spark):
    given = [("a.JPG", "jpeg"), ("a.png", "jpeg"), ("a", "heic"), ("a.HEIF", "heic"), ("a.zip", "zip"), (None, "png")]
    assert [r[0] for r in rows(spark, given, "n string, k string", true_extension(F.col("n"), F.col("k")))] == ["a.JPG", "a.png.jpg", "a.heic", "a.HEIF", "a.zip", None]
    names = [("Application.pdf",), ("aadhar back",), ("UID",), ("cancelled-cheque.jpg",), ("Voter id",), ("card.jpg",), ("appl",), (None,)]
    assert [r[0] for r in rows(spark, names, "n string", text.document_type(F.col("n")))] == ["form", "card", "card", "passbook", "epic", None, None, None]


def test_check_digits_make_numbers_valid(spark):
    df = spark.range(500).select((F.col("id") * 977 + 1).cast("string").alias("d")).withColumn("c", text.check_digit(F.col("d")))
    assert df.where(text.checksum(F.concat("d", F.col("c").cast("string"))) != 0).count() == 0
    assert text.verhoeff("2363") == 0 and df.select(text.check_digit(F.lit("x"))).first()[0] is None
