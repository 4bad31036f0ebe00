"""Images, model calls and their replies for every order, as expressions that Spark and DuckDB both read.

An order k of person p has up to seven images: two pages of a form, a card, a passbook, a voter card, one of another kind and one that nobody
can identify. Each is read by calls, some of which fail, a few of them after a try that failed too; replies are JSON in the form of the model's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions.queries import _D, _P, date_sql, parsed_sql
from casemill.functions.text import verhoeff
from casemill.operators.casefile import FROM_NUMBER, KINDS, REPLY_FIELDS, SOURCES
from casemill.operators.screen import DOCUMENTS, NEEDED, TITLES
from casemill.operators.screen_queries import _CODE, _LAST4, NAMED, NAMES, PERSON, findings_sql
from casemill.sources.views import pick, spread, table

#: Image: (kind, whether an order has it, whether its last reading failed).
IMAGES = {
    "form1": ("application_form", "k % 31 <> 0", "k % 47 = 0"),
    "form2": ("application_form", "k % 3 = 0", "k % 9 = 0"),
    "card": ("aadhaar", "k % 37 <> 0", "k % 41 = 0"),
    "passbook": ("bank_passbook", "k % 43 <> 0", "k % 25 = 0"),
    "epic": ("epic", "k % 2 = 0", "k % 46 = 0"),
    "odd": ("other", "k % 28 = 0", "FALSE"),
    "lost": (None, "k % 29 = 0", "FALSE"),
}
#: Numbers of twelve digits with the right check digit.
VALID = tuple(f"{n}{c}" for n in (23456789012, 34567890123, 98765432101, 20000000001) for c in "0123456789" if verhoeff(f"{n}{c}") == 0)
_DAY = "lpad(CAST(1 + p % 28 AS STRING), 2, '0')"
_MONTH = "lpad(CAST(1 + p % 12 AS STRING), 2, '0')"
_YEAR = "CAST(1915 + p % 60 AS STRING)"
_WRITTEN = f"CASE WHEN p % 5 = 0 THEN {_YEAR} WHEN k % 3 = 0 THEN concat('DOB: ', {_DAY}, '/', {_MONTH}, '/', {_YEAR}) WHEN k % 3 = 1 THEN concat({_DAY}, '.', {_MONTH}, '.', {_YEAR}) ELSE concat({_YEAR}, '-', {_MONTH}, '-', {_DAY}) END"
_LOW = lambda test: f"CASE WHEN {test} THEN 'low' ELSE 'high' END"
_BLANK = lambda test: f"CASE WHEN {test} THEN 'blank' ELSE 'present' END"
_NUMBER = f"CASE WHEN k % 11 = 0 THEN {{valid}} WHEN k % 13 = 0 THEN concat('2345 67', lpad(CAST(k % 100 AS STRING), 2, '0'), ' ', {_LAST4}) WHEN k % 17 = 0 THEN '12 34' ELSE concat('XXXX-XXXX ', CASE WHEN k % 22 = 0 THEN '9999' ELSE {_LAST4} END) END"
#: (value, status, certainty) by image and field of the reply; what isn't listed is blank, of low certainty.
REPLIES = {
    ("form1", "applicant_name"): ("{form}", _BLANK("k % 19 = 0"), _LOW("k % 8 = 0")),
    ("form1", "father_or_husband_name"): ("'Khuraijam Tomba'", _BLANK("k % 3 <> 0"), "'medium'"),
    ("form1", "address"): ("CASE WHEN p % 11 = 0 THEN 'Relief  Camp 4, 2345 6789 0123' WHEN k % 20 = 0 THEN '  ' ELSE concat('ward ', CAST(p % 90 AS STRING)) END", "'present'", "'high'"),
    ("form1", "district"): ("concat('district ', CAST(p % 16 AS STRING))", "'present'", "'medium'"),
    ("form1", "aadhaar_number"): (f"concat('xxxx xxxx ', {_LAST4})", _BLANK("k % 33 = 0"), "'medium'"),
    ("form1", "ifsc"): (f"CASE WHEN k % 15 = 0 THEN 'BAD' ELSE {_CODE} END", "'present'", "'high'"),
    ("form1", "account_number"): ("CAST(210000000000 + p AS STRING)", "'present'", "'high'"),
    ("form1", "date_of_birth"): (f"CASE WHEN k % 39 = 0 THEN '31/02/1940' ELSE {_WRITTEN} END", _BLANK("k % 29 = 0"), _LOW("k % 12 = 0")),
    ("form1", "annual_income"): ("CASE WHEN k % 10 = 0 THEN 'Nil' WHEN k % 27 = 0 THEN 'not much' ELSE concat('Rs. ', CAST(CAST(floor(price / 4) AS BIGINT) AS STRING), '/-') END", _BLANK("k % 21 = 0"), "CASE WHEN k % 14 = 0 THEN 'low' ELSE 'medium' END"),
    ("form1", "signature_present"): ("CASE WHEN k % 16 = 0 THEN 'No' ELSE 'yes' END", "CASE WHEN k % 44 = 0 THEN 'unreadable' ELSE 'present' END", "'high'"),
    ("form1", "application_date"): ("CASE WHEN k % 9 = 0 THEN 'June' ELSE '30.06.2001' END", "'present'", "'high'"),
    ("form1", "marital_status_if_stated"): ("CASE WHEN p % 3 = 0 THEN 'Widow of X' WHEN p % 3 = 1 THEN 'Married' ELSE 'Spinster' END", "'present'", _LOW("k % 4 = 0")),
    ("form1", "disability_if_stated"): ("CASE WHEN p % 5 = 0 THEN '40 % locomotor' ELSE 'No' END", "'present'", "'high'"),
    ("form2", "applicant_name"): ("{form}", "'present'", "'medium'"),
    ("form2", "annual_income"): ("CAST(CAST(floor(price / 4) AS BIGINT) AS STRING)", "'present'", "CASE WHEN k % 6 = 0 THEN 'high' ELSE 'low' END"),
    ("form2", "date_of_birth"): (f"{_WRITTEN}", "CASE WHEN k % 6 = 0 THEN 'present' ELSE 'unreadable' END", "'medium'"),
    ("form2", "signature_present"): ("'yes'", _BLANK("k % 6 <> 0"), "'high'"),
    ("card", "name"): ("{card}", "'present'", _LOW("k % 27 = 0")),
    ("card", "dob_or_yob"): (f"CASE WHEN k % 14 = 0 THEN '01/01/1901' ELSE {_WRITTEN} END", "'present'", "'high'"),
    ("card", "gender"): ("CASE WHEN p % 2 = 0 THEN 'x / Female' ELSE 'MALE' END", "'present'", "'high'"),
    ("card", "aadhaar_number"): (_NUMBER, "'present'", _LOW("k % 35 = 0")),
    ("passbook", "account_holder_name"): ("{passbook}", "'present'", "'high'"),
    ("passbook", "account_number"): ("CASE WHEN k % 26 = 0 THEN '123' ELSE concat(' ', CAST(210000000000 + p AS STRING), '-') END", "'present'", "'high'"),
    ("passbook", "ifsc"): (f"CASE WHEN k % 33 = 0 THEN 'ABCD0999999' ELSE lower({_CODE}) END", "'present'", _LOW("k % 34 = 0")),
    ("passbook", "bank_name"): ("'Bank'", "'present'", "'high'"),
    ("epic", "name"): ("{epic}", "'present'", "'high'"),
    ("epic", "epic_number"): ("CASE WHEN k % 18 = 0 THEN 'AB12' ELSE concat('ABC', lpad(CAST(k % 10000000 AS STRING), 7, '0')) END", "'present'", "'high'"),
    ("epic", "dob_or_age"): (f"CASE WHEN k % 10 = 0 THEN 'Age as on 1.1.2001: 66' WHEN k % 35 = 0 THEN '1950' ELSE {_WRITTEN} END", "'present'", "'high'"),
}


def reply_field(image: str, field: str, duck: bool) -> tuple[str, str, str]:
    value, status, certainty = REPLIES.get((image, field), ("''", "'blank'", "'low'"))
    for d, at in NAMED.items():
        value = value.replace(f"{{{d}}}", pick(NAMES, at, duck))
    return value.replace("{valid}", pick(VALID, "k % 4", duck)), status, certainty


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), "o_orderkey")
    return o.select(F.col("o_orderkey").alias("k"), F.expr(PERSON).alias("p"), F.col("o_totalprice").alias("price"), F.date_format(F.col("o_orderdate"), "yyyy-MM-dd").alias("received"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).select(F.col("k").alias("case_id"), "received")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, document_id, position, opened, detected."""
    each = ", ".join(f"CASE WHEN {there} THEN named_struct('position', {i}, 'opened', {'k % 58 <> 0' if name == 'lost' else 'TRUE'}, 'detected', {repr(kind) if kind else 'CAST(NULL AS STRING)'}) END" for i, (name, (kind, there, _)) in enumerate(IMAGES.items()))
    rows = _base(spark, sf_dir).select(F.col("k").alias("case_id"), F.explode(F.expr(f"array({each})")).alias("i")).where("i IS NOT NULL")
    return rows.select("case_id", F.concat_ws("-", F.col("case_id").cast("string"), F.col("i.position").cast("string")).alias("document_id"), "i.*")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, stage, seq, status, error, result: a classification, sometimes a reading that failed, and the last reading.

    Readings are a scan for each image: as one array of all, to be taken apart, they are too large an expression for Spark to compile.
    """
    base, columns, none = _base(spark, sf_dir), ("document_id", "stage", "seq", "status", "error", "result"), "CAST(NULL AS STRING)"
    short, parts = [], []
    for i, (name, (kind, there, failed)) in enumerate(IMAGES.items()):
        call = lambda stage, seq, status, error: f"named_struct('position', {i}, 'stage', '{stage}', 'seq', {seq}, 'status', {status}, 'error', {error})"
        short.append(f"CASE WHEN {there} THEN {call('classify', 1, repr('OK' if kind else 'ERROR'), none if kind else repr('no answer'))} END")
        if kind in REPLY_FIELDS:
            entries = ", ".join(f"'{f}', named_struct('value', CAST({v} AS STRING), 'status', {s}, 'confidence', {c}, 'bbox', array(1D, 2D, 3D, 4D))" for f in REPLY_FIELDS[kind] for v, s, c in [reply_field(name, f, False)])
            reply = f"concat('Here it is: ', to_json(named_struct('legibility', 'good', 'notes', 'read', 'fields', named_struct({entries}))))"
            short.append(f"CASE WHEN {there} AND k % 13 = 0 THEN {call('extract', 2, repr('ERROR'), repr('timed out'))} END")
            row = (f"concat_ws('-', CAST(k AS STRING), '{i}')", "'extract'", "3", f"CASE WHEN {failed} THEN 'ERROR' ELSE 'OK' END", f"CASE WHEN {failed} THEN 'no answer' END", f"CASE WHEN NOT ({failed}) THEN {reply} END")
            parts.append(base.where(there).selectExpr(*[f"{x} AS {c}" for x, c in zip(row, columns)]))
    rows = base.selectExpr("k", f"explode(array({', '.join(short)})) AS c").where("c IS NOT NULL")
    rows = rows.selectExpr("concat_ws('-', CAST(k AS STRING), CAST(c.position AS STRING)) AS document_id", "c.stage", "c.seq", "c.status", "c.error", f"{none} AS result")
    return reduce(DataFrame.unionByName, parts, rows)


def _raw() -> str:
    parts = []
    for i, (name, (kind, there, failed)) in enumerate(IMAGES.items()):
        for f in REPLY_FIELDS.get(kind, ()):
            v, s, c = reply_field(name, f, True)
            parts.append(f"SELECT k, {i} AS position, '{kind}' AS kind, '{f}' AS field, trim(CAST({v} AS VARCHAR)) AS value, {s} AS status, {c} AS certainty FROM base WHERE {there} AND NOT ({failed})")
    return " UNION ALL ".join(parts)


_IMG = " UNION ALL ".join(f"SELECT k, {i} AS position, {repr(kind) if kind else 'NULL'} AS kind, {failed} AS failed, {'k % 58 <> 0' if name == 'lost' else 'TRUE'} AS opened FROM base WHERE {there}" for i, (name, (kind, there, failed)) in enumerate(IMAGES.items()))
_BASE = f"base AS (SELECT o_orderkey AS k, {PERSON} AS p, o_totalprice AS price, o_orderdate AS received FROM orders), img AS ({_IMG}), raw AS ({_raw()})"
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_SUM = f"list_reduce(list_prepend(0, list_transform(range(1, length({_DIGITS}) + 1), lambda i: list_extract({_P}, ((i - 1) % 8) * 10 + CAST(substr(reverse({_DIGITS}), i, 1) AS BIGINT) + 1))), lambda a, x: list_extract({_D}, a * 10 + x + 1))"
_EDGE = r"(^|[^0-9])([2-9][0-9]{3})[ -]?([0-9]{4})[ -]?([0-9]{4})($|[^0-9])"
#: CTEs of DuckDB's SQL: base (an order), img (an image), raw (a field of a reply that was read) and normal (masked, blank values null).
NORMAL = f"""{_BASE},
seen AS (SELECT k, position, kind, field, certainty, status AS said, CASE WHEN status = 'present' THEN nullif(value, '') END AS value FROM raw),
numbers AS (SELECT k, position, kind, value, regexp_extract(value, '^[Xx*•]{{4}}[\\s-]?[Xx*•]{{4}}[\\s-]?([0-9]{{4}})$', 1) AS printed, regexp_matches({_DIGITS}, '^[0-9]{{12}}$') AS twelve, certainty FROM seen WHERE field = 'aadhaar_number'),
ids AS (SELECT k, position, kind, value, CASE WHEN printed <> '' THEN printed WHEN twelve THEN substr({_DIGITS}, 9, 4) END AS last4, CASE WHEN value IS NULL OR printed <> '' THEN NULL WHEN twelve THEN {_SUM} = 0 AND regexp_matches({_DIGITS}, '^[2-9]') ELSE FALSE END AS valid FROM numbers),
normal AS (SELECT s.k, s.position, s.kind, s.field, s.certainty, CASE WHEN said = 'present' AND s.value IS NULL THEN 'blank' ELSE said END AS status, CASE WHEN s.value IS NULL THEN NULL WHEN s.field = 'account_number' THEN s.value WHEN s.field = 'aadhaar_number' THEN coalesce('XXXX XXXX ' || i.last4, '[unreadable number]') ELSE regexp_replace(s.value, '{_EDGE}', '\\1XXXX XXXX \\4\\5', 'g') END AS value
  FROM seen s LEFT JOIN ids i ON s.field = 'aadhaar_number' AND i.k = s.k AND i.position = s.position)"""


def _typed() -> str:
    parse = {"text": "nullif(trim({v}), '')", "date": date_sql("{v}"), "dob_or_age": date_sql("{v}"), "flag": f"CAST({parsed_sql('yes_no', '{v}')} AS VARCHAR)", "displaced": "CAST(regexp_matches(lower({v}), 'relief\\s*camp') AS VARCHAR)"}
    parse |= {"gender": parsed_sql("gender", "{v}"), "marital": parsed_sql("marital", "{v}"), "amount": f"CAST(CAST({parsed_sql('income', '{v}')} AS BIGINT) AS VARCHAR)"}
    kind_of, rows = {d: k for k, d in KINDS.items()}, []
    for i, d in enumerate(DOCUMENTS):
        for j, f in enumerate(DOCUMENTS[d]):
            source, parser = SOURCES[d].get(f, (None, None))
            value, sure = "NULL", "0.0"
            if source:
                value = parse[parser].replace("{v}", "b.value")
                sure = f"CASE WHEN b.conf IS NULL THEN 0.0 WHEN b.value IS NOT NULL AND ({value}) IS NULL THEN least(b.conf, 0.3) ELSE b.conf END"
            if parser == "displaced":
                sure = "CASE WHEN b.value IS NULL THEN 1.0 ELSE b.conf END"
            if parser == "dob_or_age":
                value, sure = f"CASE WHEN NOT contains(lower(b.value), 'age') THEN {value} END", f"CASE WHEN contains(lower(b.value), 'age') THEN 1.0 ELSE {sure} END"
            if (d, f) in FROM_NUMBER:
                source, sure = "aadhaar_number", "coalesce(b.conf, 0.0)"
                value = f"(SELECT {'last4' if FROM_NUMBER[d, f] == 'last4' else chr(39) + 'XXXX XXXX ' + chr(39) + ' || last4'} FROM who WHERE who.k = d.k AND who.kind = '{kind_of[d]}')"
            rows.append(f"SELECT d.k, '{d}' AS doc, {i} AS doc_at, '{f}' AS field, {j} AS pos, {str(f in NEEDED[d]).upper()} AS needed, CAST({value} AS VARCHAR) AS value, CAST({sure} AS DOUBLE) AS conf FROM docs d LEFT JOIN chosen b ON b.k = d.k AND b.kind = '{kind_of[d]}' AND b.field = '{source}' WHERE d.doc = '{d}' AND d.state = 'ok'")
    names = ", ".join(f"({i}, '{d}', '{kind_of[d]}', '{TITLES[d]}')" for i, d in enumerate(DOCUMENTS))
    return f"""{NORMAL},
chosen AS (SELECT *, CASE WHEN status = 'unreadable' THEN least(sure, 0.3) ELSE sure END AS conf FROM (SELECT *, CASE certainty WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.8 ELSE 0.4 END AS sure,
  row_number() OVER (PARTITION BY k, kind, field ORDER BY CASE WHEN value IS NOT NULL THEN 10 ELSE 0 END + CASE certainty WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, position) AS r FROM normal) WHERE r = 1),
who AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, kind ORDER BY last4 IS NULL, position) AS r FROM ids) WHERE r = 1),
lost AS (SELECT k, count(*) AS n, arg_min(CASE WHEN opened THEN 'no answer' ELSE 'the image could not be opened' END, position) AS why FROM img WHERE kind IS NULL GROUP BY k),
names(doc_at, doc, kind, title) AS (VALUES {names}),
docs AS (SELECT b.k, b.p, n.doc, n.doc_at, CASE WHEN i.got THEN 'ok' WHEN i.k IS NOT NULL OR (l.n > 0 AND n.doc <> 'epic') THEN 'failed' END AS state, CASE WHEN i.got THEN NULL WHEN i.k IS NOT NULL THEN 'no answer' WHEN l.n > 0 AND n.doc <> 'epic' THEN concat(l.n, ' image(s) could not be read (', l.why, '); the ', n.title, ' may be among them') END AS error
  FROM base b CROSS JOIN names n LEFT JOIN (SELECT k, kind, bool_or(NOT failed) AS got FROM img WHERE kind IS NOT NULL GROUP BY k, kind) i ON i.k = b.k AND i.kind = n.kind LEFT JOIN lost l ON l.k = b.k),
fields AS ({' UNION ALL '.join(rows)})"""


#: The same up to docs (a document of a case, and its state) and fields (its typed fields), and up to the findings.
TYPED = _typed()
CHECKED = "SELECT valid FROM who WHERE who.k = w.k AND who.kind = 'aadhaar'"
FOUND = findings_sql(TYPED, CHECKED)
