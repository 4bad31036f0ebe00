"""Checks of age and income that may be undecided, names of files, and figures of the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import text
from casemill.functions.dates import age_on, parse_date
from casemill.functions.queries import _D, _P, date_sql
from casemill.operators.names_queries import parse_name
from casemill.plans.registry import query
from casemill.sources.views import CASES, cases, table

MIN_AGE, CEILING = 60, 60_000
#: Extensions of the kinds of images; the first is the one to put on a file that has none of them.
EXTENSIONS = {"jpeg": (".jpg", ".jpeg"), "png": (".png",), "webp": (".webp",), "heic": (".heic", ".heif")}


def check_age(dob: Column, on: Column, least: int = MIN_AGE) -> Column:
    """eligible (null: not to be told), age and approximate (a year alone, of which the last day counts) on a day; dates as people write them."""
    read = F.array(F.struct(parse_date(dob).alias("born"), parse_date(on).alias("day")))  # an array of one, so that dates are parsed once and used often

    def judge(d: Column) -> Column:
        age = F.when(F.length(d["day"]) > 4, age_on(d["born"], d["day"]))
        return F.struct((age >= least).alias("eligible"), age.alias("age"), F.coalesce(age.isNotNull() & (F.length(d["born"]) == 4), F.lit(False)).alias("approximate"))

    return F.get(F.transform(read, judge), F.lit(0))


def check_income(income: Column, ceiling: float = CEILING) -> Column:
    """Whether an income is at or below the ceiling; null where it is not known."""
    return F.when(income.isNotNull() & ~F.isnan(income) & (F.abs(income) != float("inf")), income <= ceiling)


_DOB = "CASE o_orderkey % 5 WHEN 0 THEN CAST(1900 + o_orderkey % 99 AS STRING) WHEN 1 THEN concat('1/', CAST(1 + o_orderkey % 12 AS STRING), '/', CAST(1920 + o_orderkey % 50 AS STRING)) WHEN 2 THEN '31.02.1940' WHEN 3 THEN concat('19', CAST(20 + o_orderkey % 50 AS STRING), '-06-15') END"
_ON = "CASE WHEN o_orderkey % 7 = 0 THEN '2001' WHEN o_orderkey % 11 <> 0 THEN '15/06/2001' END"


@query("rule_check_age", f"""WITH d AS (SELECT o_orderkey AS case_id, {date_sql(_DOB)} AS b, {date_sql(_ON)} AS o FROM orders), f AS (SELECT *, CASE WHEN length(b) = 4 THEN b || '-12-31' ELSE b END AS full_b FROM d),
a AS (SELECT *, CASE WHEN length(o) > 4 THEN CAST(substr(o, 1, 4) AS INT) - CAST(substr(full_b, 1, 4) AS INT) - CASE WHEN substr(o, 6) < substr(full_b, 6) THEN 1 ELSE 0 END END AS years FROM f)
SELECT case_id, years >= {MIN_AGE} AS eligible, years AS age, coalesce(years IS NOT NULL AND length(b) = 4, FALSE) AS approximate FROM (SELECT * REPLACE (CASE WHEN years >= 0 THEN years END AS years) FROM a)""")
def rule_check_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an applicant is old enough on the day of the application, or not to be told."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("case_id"), check_age(F.expr(_DOB), F.expr(_ON)).alias("c")).select("case_id", "c.*")


_EARNED = "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 13 = 0 THEN 60000.0 ELSE o_totalprice END"


@query("rule_check_income", f"SELECT o_orderkey AS case_id, CASE WHEN x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) THEN x <= {CEILING} END AS eligible FROM (SELECT o_orderkey, CAST({_EARNED} AS DOUBLE) AS x FROM orders)")
def rule_check_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an income is at or below the ceiling, or not known."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), check_income(F.expr(f"CAST({_EARNED} AS DOUBLE)")).alias("eligible"))


def true_extension(name: Column, kind: Column) -> Column:
    """A file's name with an extension of the kind that its bytes are; a name that has one stays."""
    low, out = F.lower(name), name
    for k, known in EXTENSIONS.items():
        has = F.lit(False)
        for e in known:
            has = has | low.endswith(e)
        out = F.when((kind == k) & ~has, F.concat(name, F.lit(known[0]))).otherwise(out)
    return out


_KIND = "CASE page_id % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'heic' ELSE 'zip' END"
_FILE = "concat('scan', CAST(page_id AS STRING), CASE page_id % 7 WHEN 0 THEN '.JPEG' WHEN 1 THEN '.png' WHEN 2 THEN '.heif' WHEN 3 THEN '' WHEN 4 THEN '.Jpg' ELSE '.webp' END)"


@query("str_true_extension", f"""SELECT page_id, CASE WHEN kind = 'jpeg' AND NOT regexp_matches(lower(name), '\\.(jpg|jpeg)$') THEN name || '.jpg' WHEN kind = 'png' AND NOT regexp_matches(lower(name), '\\.png$') THEN name || '.png'
WHEN kind = 'webp' AND NOT regexp_matches(lower(name), '\\.webp$') THEN name || '.webp' WHEN kind = 'heic' AND NOT regexp_matches(lower(name), '\\.(heic|heif)$') THEN name || '.heic' ELSE name END AS named FROM (SELECT page_id, {_KIND} AS kind, {_FILE} AS name FROM pages)""")
def str_true_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of uploaded files with the extension that their content calls for."""
    return table(spark, sf_dir, "pages").select("page_id", true_extension(F.expr(_FILE), F.expr(_KIND)).alias("named"))


_SCAN = "concat(CASE page_id % 9 WHEN 0 THEN 'Aadhar_front' WHEN 1 THEN 'application' WHEN 2 THEN 'uid-form' WHEN 3 THEN 'BANK' WHEN 4 THEN 'cheque book' WHEN 5 THEN 'Voter' WHEN 6 THEN 'card' WHEN 7 THEN 'epic passbook' ELSE 'appl' END, CAST(page_id AS STRING), '.jpg')"


@query("str_type_from_name", f"""SELECT page_id, CASE WHEN contains(n, 'form') OR contains(n, 'application') THEN 'form' WHEN contains(n, 'aadhaar') OR contains(n, 'aadhar') OR contains(n, 'uid') THEN 'card' WHEN contains(n, 'passbook') OR contains(n, 'bank') OR contains(n, 'cheque') THEN 'passbook'
WHEN contains(n, 'epic') OR contains(n, 'voter') THEN 'epic' END AS kind FROM (SELECT page_id, lower({_SCAN}) AS n FROM pages)""")
def str_type_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that the name of a scanned file speaks of."""
    return table(spark, sf_dir, "pages").select("page_id", text.document_type(F.expr(_SCAN)).alias("kind"))


@query("math_check_digit", f"""WITH n AS (SELECT p_partkey AS id, CAST(p_partkey * 7919 + 2360000000 AS VARCHAR) AS digits FROM part), t AS (SELECT id, digits, unnest(range(10)) AS d FROM n), u AS (SELECT id, digits, d, digits || d AS w FROM t)
SELECT id, digits, CAST(d AS INT) AS digit FROM u WHERE list_reduce(list_prepend(0, list_transform(range(1, length(w) + 1), lambda i: list_extract({_P}, ((i - 1) % 8) * 10 + CAST(substr(reverse(w), i, 1) AS BIGINT) + 1))), lambda a, x: list_extract({_D}, a * 10 + x + 1)) = 0""")
def math_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digit that makes a number valid."""
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 + 2360000000).cast("string").alias("digits"))
    return n.withColumn("digit", text.check_digit(F.col("digits")))


@query("agg_screened_today", f"WITH {CASES} SELECT strftime(make_timestamp(screened_ms * 1000) + INTERVAL 330 MINUTE, '%Y-%m-%d') AS today, count(*) AS screened FROM cases WHERE NOT historical AND screened_ms IS NOT NULL GROUP BY 1")
def agg_screened_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases screened on each calendar day in India; the dashboard shows the last one."""
    c = cases(spark, sf_dir).where("NOT historical AND screened_ms IS NOT NULL")
    minutes = F.col("screened_ms") + 330 * 60_000
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(minutes / 86_400_000).cast("int"))
    return c.groupBy(F.date_format(day, "yyyy-MM-dd").alias("today")).agg(F.count("*").alias("screened"))


def first_name(name: str, parsed: str) -> Column:
    """What to call a person by: the first given name, else the first word, else Applicant; ``parsed`` is the column of parse_name()."""
    word = F.nullif(F.get(F.split(F.trim(name), r"\s+"), F.lit(0)), F.lit(""))
    return F.coalesce(F.nullif(F.get(F.col(f"{parsed}.given"), F.lit(0)), F.lit("")), word, F.lit("Applicant"))


@query("name_first")
def name_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name of every customer's and part's name, parsed once a different name."""
    t = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))).distinct()
    return t.withColumn("p", parse_name("name")).select("name", first_name("name", "p").alias("first"))
