"""Queries of the screening: a typed case for every order, its findings, status, notice and duplicates.

The SQL is written from the rules as relations (a row a document, a field, a finding), not from the expressions of screen.py; verdicts on
names are the fixed values below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators.screen import DOCUMENTS, NEEDED, Rules, duplicates, screen
from casemill.plans.registry import query
from casemill.sources.views import pick, spread, table

# Two spellings of each of six people, and how the two compare; the fourth name is unsure unless Khuraijam is known.
NAMES = ("Okram Tomba Singh", "Okram Tombaa", "Khuraijam Loken Singh", "Kh. Loken Singh", "Ibemcha Devi", "Ibemchaa Debi", "Wangkhem Chaoba Meitei", "W. Chaoba", "Md. Abdul Hussain", "Abdul Husain", "Laishram Thoiba", "Laishram Thoiba Rajen")
UNLIKE_SAME = {(2, 3): "AMBIGUOUS", (4, 4): "LIKELY_SAME", (4, 5): "LIKELY_SAME", (5, 5): "LIKELY_SAME", (10, 11): "LIKELY_SAME"}
RULES = Rules(today="2001-09-01")
#: Who an order's applicant is: every seventh order is the customer's, the others are people of their own.
PERSON = "CASE WHEN o_orderkey % 7 = 0 THEN o_custkey ELSE o_orderkey + 1000000 END"
_DOB = "CASE WHEN p % 5 = 0 THEN CAST(1915 + p % 60 AS STRING) ELSE concat(CAST(1915 + p % 60 AS STRING), '-', lpad(CAST(1 + p % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + p % 28 AS STRING), 2, '0')) END"
_LAST4 = "lpad(CAST(p * 37 % 10000 AS STRING), 4, '0')"
_CODE = "concat('ABCD0', lpad(CAST(p % 1000000 AS STRING), 6, '0'))"
#: Which name stands on a document: now and then the next person's.
NAMED = {
    "form": "2 * (p % 6) + k % 2",
    "card": "2 * ((p + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END) % 6) + CAST(floor(k / 2) AS BIGINT) % 2",
    "epic": "2 * ((p + CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END) % 6) + CAST(floor(k / 4) AS BIGINT) % 2",
    "passbook": "2 * ((p + CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END) % 6) + CAST(floor(k / 8) AS BIGINT) % 2",
}
STATES = {
    "form": "CASE WHEN k % 31 = 0 THEN NULL WHEN k % 47 = 0 THEN 'failed' ELSE 'ok' END",
    "card": "CASE WHEN k % 37 = 0 THEN NULL WHEN k % 41 = 0 THEN 'failed' ELSE 'ok' END",
    "passbook": "CASE WHEN k % 43 = 0 THEN NULL WHEN k % 25 = 0 THEN 'failed' ELSE 'ok' END",
    "epic": "CASE WHEN k % 2 = 1 THEN NULL WHEN k % 46 = 0 THEN 'failed' ELSE 'ok' END",
}
CHECKSUM = "CASE WHEN k % 6 = 0 THEN NULL ELSE k % 13 <> 0 END"
#: (value, confidence) of fields, over k (the case), p (its person) and price; what isn't listed is blank and was not looked for.
READINGS = {
    ("form", "name"): (f"CASE WHEN k % 19 <> 0 THEN {{form}} END", "CASE WHEN k % 8 = 0 THEN 0.4 ELSE 0.95 END"),
    ("form", "relative"): ("CASE WHEN k % 3 = 0 THEN 'Khuraijam Tomba' END", "0.8"),
    ("form", "dob"): (f"CASE WHEN k % 29 <> 0 THEN {_DOB} END", "CASE WHEN k % 12 = 0 THEN 0.3 ELSE 0.95 END"),
    ("form", "marital"): ("CASE WHEN p % 3 = 0 THEN 'widowed' ELSE 'married' END", "CASE WHEN k % 4 = 0 THEN 0.4 ELSE 0.95 END"),
    ("form", "income"): ("CASE WHEN k % 21 <> 0 THEN CAST(CAST(floor(price / 4) AS BIGINT) AS STRING) END", "CASE WHEN k % 10 = 0 THEN 0.4 ELSE 0.8 END"),
    ("form", "address"): ("CASE WHEN k % 51 <> 0 THEN 'village' END", "0.95"),
    ("form", "disability"): ("CASE WHEN p % 5 = 0 THEN 'true' ELSE 'false' END", "0.95"),
    ("form", "displaced"): ("CASE WHEN p % 11 = 0 THEN 'true' ELSE 'false' END", "1.0"),
    ("form", "account"): ("CAST(10000000000 + p AS STRING)", "0.95"),
    ("form", "ifsc"): (f"CASE WHEN k % 15 = 0 THEN 'BAD' ELSE {_CODE} END", "0.95"),
    ("form", "last4"): (_LAST4, "0.8"),
    ("form", "signature"): ("CASE WHEN k % 16 = 0 THEN 'false' ELSE 'true' END", "CASE WHEN k % 32 = 0 THEN 0.4 ELSE 0.95 END"),
    ("form", "application_date"): ("CASE WHEN k % 9 <> 0 THEN '2001-06-30' END", "0.95"),
    ("card", "name"): ("{card}", "CASE WHEN k % 27 = 0 THEN 0.4 ELSE 0.95 END"),
    ("card", "dob"): (f"CASE WHEN k % 14 = 0 THEN '1901-01-01' ELSE {_DOB} END", "0.95"),
    ("card", "masked"): (f"concat('XXXX XXXX ', {_LAST4})", "CASE WHEN k % 5 = 0 THEN 0.4 ELSE 0.95 END"),
    ("card", "last4"): (f"CASE WHEN k % 22 = 0 THEN '9999' ELSE {_LAST4} END", "0.95"),
    ("passbook", "holder"): ("{passbook}", "0.95"),
    ("passbook", "account"): ("CASE WHEN k % 26 = 0 THEN '123' ELSE concat(' ', CAST(10000000000 + p AS STRING), '-') END", "0.95"),
    ("passbook", "ifsc"): (f"CASE WHEN k % 33 = 0 THEN 'ABCD0999999' ELSE lower({_CODE}) END", "CASE WHEN k % 34 = 0 THEN 0.4 ELSE 0.95 END"),
    ("passbook", "bank"): ("'Bank'", "0.95"),
    ("epic", "name"): ("{epic}", "0.95"),
    ("epic", "number"): ("CASE WHEN k % 18 = 0 THEN 'AB12' ELSE concat('ABC', lpad(CAST(k % 10000000 AS STRING), 7, '0')) END", "0.95"),
    ("epic", "dob"): (f"CASE WHEN k % 35 = 0 THEN '1950' ELSE {_DOB} END", "0.95"),
}


def reading(document: str, name: str, duck: bool) -> tuple[str, str]:
    value, confidence = READINGS.get((document, name), ("NULL", "0.0"))
    for d, at in NAMED.items():
        value = value.replace(f"{{{d}}}", pick(NAMES, at, duck))
    return value, confidence


def typed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed case for every order, from one scan."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), "o_orderkey")
    base = o.select(F.col("o_orderkey").alias("k"), F.expr(PERSON).alias("p"), F.col("o_totalprice").alias("price"), F.date_format(F.col("o_orderdate"), "yyyy-MM-dd").alias("received"))

    def document(d: str) -> str:
        fields = ", ".join(f"'{f}', named_struct('value', CAST({v} AS STRING), 'confidence', CAST({c} AS DOUBLE))" for f in DOCUMENTS[d] for v, c in [reading(d, f, False)])
        state, checked = STATES[d], f", 'checksum_valid', {CHECKSUM}" if d == "card" else ""
        return f"CASE WHEN ({state}) IS NOT NULL THEN named_struct('status', {state}, 'error', CASE WHEN ({state}) = 'failed' THEN 'no answer' END, 'fields', named_struct({fields}){checked}) END AS {d}"

    return base.selectExpr("k AS case_id", "received", *map(document, DOCUMENTS))


def findings_sql(given: str | None = None, checksum: str = CHECKSUM) -> str:
    """CTEs up to flags(k, step, a, b, code, severity, action, evidence) in DuckDB's SQL; a and b order the findings of a step.

    ``given``: CTEs base, docs and fields to begin with, in place of the typed cases of this module; checksum is SQL over w.k.
    """
    docs = " UNION ALL ".join(f"SELECT k, p, '{d}' AS doc, {i} AS doc_at, {s} AS state, 'no answer' AS error FROM base" for i, (d, s) in enumerate(STATES.items()))
    fields = " UNION ALL ".join(
        f"SELECT k, '{d}' AS doc, {i} AS doc_at, '{f}' AS field, {j} AS pos, {str(f in NEEDED[d]).upper()} AS needed, CAST({reading(d, f, True)[0]} AS VARCHAR) AS value, CAST({reading(d, f, True)[1]} AS DOUBLE) AS conf FROM base WHERE ({STATES[d]}) = 'ok'"
        for i, d in enumerate(DOCUMENTS) for j, f in enumerate(DOCUMENTS[d])
    )
    same = ", ".join(f"({i}, {j}, '{UNLIKE_SAME.get((min(i, j), max(i, j)), 'SAME')}')" for i in range(12) for j in range(12) if i // 2 == j // 2)
    at = {d: f"CAST({e} AS BIGINT)" for d, e in NAMED.items()}
    of = lambda d, f, x="value": f"(SELECT {x} FROM fields f WHERE f.k = b.k AND f.doc = '{d}' AND f.field = '{f}')"
    columns = [("form", "dob"), ("card", "dob"), ("epic", "dob"), ("form", "income"), ("form", "last4"), ("card", "last4"), ("card", "masked"), ("form", "signature"), ("form", "ifsc"), ("passbook", "ifsc"), ("form", "account"), ("passbook", "account"), ("epic", "number"), ("form", "name"), ("card", "name"), ("epic", "name"), ("passbook", "holder"), ("form", "application_date"), ("form", "marital"), ("form", "disability"), ("form", "displaced"), ("form", "relative")]
    wide = ", ".join(f"max(value) FILTER (WHERE doc = '{d}' AND field = '{f}') AS {d}_{f}, max(conf) FILTER (WHERE doc = '{d}' AND field = '{f}') AS {d}_{f}_c" for d, f in columns)
    ev = lambda d, f: f"concat('{d}.{f}=', coalesce({d}_{f}, ''))"
    differ = lambda x, y: f"coalesce(CASE WHEN length({x}) = 4 OR length({y}) = 4 THEN substr({x}, 1, 4) <> substr({y}, 1, 4) ELSE {x} <> {y} END, FALSE)"
    one = lambda step, a, code, severity, action, evidence, low, test: f"SELECT k, {step} AS step, {a} AS a, 0 AS b, '{code}' AS code, '{severity}' AS severity, '{action}' AS action, {evidence} AS evidence, {low} AS low FROM w WHERE {test}"
    low = lambda *fs: " OR ".join(f"coalesce({d}_{f}_c < 0.75, FALSE)" for d, f in fs)
    steps = [
        "SELECT k, 1, doc_at, 0, 'MISSING_DOCUMENT', 'critical', 'citizen', concat(doc, '.document='), FALSE FROM docs WHERE state IS NULL AND doc <> 'epic'",
        "SELECT k, 1, 10, 0, 'OPTIONAL_DOCUMENT_NOT_PROVIDED', 'info', 'none', concat(doc, '.document='), FALSE FROM docs WHERE state IS NULL AND doc = 'epic'",
        "SELECT k, 1, 20 + doc_at, 0, 'EXTRACTION_FAILED', 'warn', 'officer', concat(doc, '.document=', error), FALSE FROM docs WHERE state = 'failed'",
        "SELECT k, 2, doc_at, pos, 'MISSING_FIELD', 'critical', 'citizen', concat(doc, '.', field, '='), FALSE FROM fields WHERE needed AND value IS NULL AND conf >= 0.75",
        "SELECT k, 2, doc_at, 99, 'LOW_CONFIDENCE', 'warn', 'officer', string_agg(concat(doc, '.', field, '=', coalesce(value, '')), ';' ORDER BY pos), TRUE FROM fields WHERE conf < 0.75 AND (needed OR value IS NOT NULL) GROUP BY k, doc, doc_at",
        f"SELECT k, 3, 0, 0, 'AADHAAR_CHECKSUM_INVALID', 'critical', 'officer', {ev('card', 'masked')}, {low(('card', 'masked'))} FROM w WHERE card_masked_c IS NOT NULL AND ({checksum}) = FALSE",
        *[one(3, i + 1, "IFSC_INVALID", "critical", "citizen", ev(d, "ifsc"), low((d, "ifsc")), f"NOT regexp_full_match(upper({d}_ifsc), '[A-Z]{{4}}0[A-Z0-9]{{6}}')") for i, d in enumerate(("form", "passbook"))],
        one(3, 3, "EPIC_FORMAT_INVALID", "warn", "officer", ev("epic", "number"), low(("epic", "number")), "NOT regexp_full_match(epic_number, '[A-Z]{3}[0-9]{7}')"),
        one(3, 4, "AADHAAR_FORM_CARD_MISMATCH", "warn", "officer", f"concat({ev('form', 'last4')}, ';', {ev('card', 'last4')})", low(("form", "last4"), ("card", "last4")), "form_last4 <> card_last4"),
        one(3, 5, "MISSING_SIGNATURE", "critical", "citizen", ev("form", "signature"), low(("form", "signature")), "form_signature = 'false' AND form_signature_c >= 0.75"),
        one(4, 0, "BANK_DETAILS_MISMATCH", "critical", "citizen", f"concat({ev('form', 'account')}, ';', {ev('passbook', 'account')})", low(("form", "account"), ("passbook", "account")), "regexp_replace(form_account, '[^0-9]', '', 'g') <> regexp_replace(passbook_account, '[^0-9]', '', 'g')"),
        one(4, 1, "BANK_DETAILS_MISMATCH", "critical", "citizen", f"concat({ev('form', 'ifsc')}, ';', {ev('passbook', 'ifsc')})", low(("form", "ifsc"), ("passbook", "ifsc")), "upper(form_ifsc) <> upper(passbook_ifsc)"),
        f"""SELECT k, 5, a, 0, CASE verdict WHEN 'LIKELY_SAME' THEN 'NAME_VARIANT' WHEN 'AMBIGUOUS' THEN 'NAME_AMBIGUOUS' ELSE CASE WHEN doc = 'passbook' THEN 'BANK_HOLDER_NAME_MISMATCH' ELSE 'NAME_MISMATCH' END END,
 CASE verdict WHEN 'LIKELY_SAME' THEN 'info' WHEN 'AMBIGUOUS' THEN 'warn' ELSE 'critical' END, CASE verdict WHEN 'LIKELY_SAME' THEN 'none' WHEN 'AMBIGUOUS' THEN 'officer' ELSE 'citizen' END, concat(anchor_from, '.name=', anchor, ';', doc, '.', field, '=', value), anchor_low OR value_low FROM compared WHERE verdict <> 'SAME'""",
        one(6, 0, "DOB_MISMATCH", "critical", "citizen", f"concat_ws(';', CASE WHEN form_dob IS NOT NULL THEN {ev('form', 'dob')} END, CASE WHEN card_dob IS NOT NULL THEN {ev('card', 'dob')} END, CASE WHEN epic_dob IS NOT NULL THEN {ev('epic', 'dob')} END)", f"(form_dob IS NOT NULL AND ({low(('form', 'dob'))})) OR (card_dob IS NOT NULL AND ({low(('card', 'dob'))})) OR (epic_dob IS NOT NULL AND ({low(('epic', 'dob'))}))", f"{differ('form_dob', 'card_dob')} OR {differ('form_dob', 'epic_dob')} OR {differ('card_dob', 'epic_dob')}"),
        "SELECT k, 6, 1, 0, 'AGE_BELOW_MINIMUM', 'critical', 'officer', concat(best_doc, '.dob=', best), FALSE FROM best WHERE age < 60",
        "SELECT k, 6, 2, 0, 'DOB_YEAR_ONLY', 'info', 'none', concat(best_doc, '.dob=', best), FALSE FROM best WHERE length(best) = 4",
        one(6, 3, "INCOME_ABOVE_CEILING", "critical", "officer", ev("form", "income"), "FALSE", "form_income_c >= 0.75 AND TRY_CAST(form_income AS DOUBLE) > 60000"),
        f"SELECT d.k, 7, 0, d.first, 'DUPLICATE_SUSPECTED', 'critical', 'officer', concat('card.last4=', d.last4, ';', d.anchor_from, '.name=', d.anchor), FALSE FROM twice d",
    ]
    best = lambda test: "".join(f"WHEN {d}_dob IS NOT NULL AND {d}_dob_c >= 0.75 AND {test.format(d=d)} THEN '{d}' " for d in ("form", "card", "epic"))
    given = given or f"base AS (SELECT o_orderkey AS k, {PERSON} AS p, o_totalprice AS price, o_orderdate AS received FROM orders), docs AS ({docs}), fields AS ({fields})"
    return f"""{given},
w AS (SELECT k, {wide} FROM fields GROUP BY k),
same(i, j, verdict) AS (VALUES {same}),
idx AS (SELECT k, {', '.join(f'{e} AS i_{d}' for d, e in at.items())} FROM base),
anchored AS (SELECT w.*, CASE WHEN form_name IS NOT NULL THEN 'form' WHEN card_name IS NOT NULL THEN 'card' END AS anchor_from, coalesce(form_name, card_name) AS anchor,
  CASE WHEN form_name IS NOT NULL THEN i_form ELSE i_card END AS i_anchor, coalesce(CASE WHEN form_name IS NOT NULL THEN form_name_c ELSE card_name_c END < 0.75, FALSE) AS anchor_low, form_relative IS NOT NULL AS known, i_card, i_epic, i_passbook FROM w JOIN idx ON w.k = idx.k),
others AS (SELECT k, 0 AS a, 'card' AS doc, 'name' AS field, card_name AS value, card_name_c < 0.75 AS value_low, i_card AS j, anchor, anchor_from, anchor_low, i_anchor, known FROM anchored WHERE card_name IS NOT NULL AND anchor_from = 'form'
  UNION ALL SELECT k, 1, 'epic', 'name', epic_name, epic_name_c < 0.75, i_epic, anchor, anchor_from, anchor_low, i_anchor, known FROM anchored WHERE epic_name IS NOT NULL AND anchor_from IS NOT NULL
  UNION ALL SELECT k, 2, 'passbook', 'holder', passbook_holder, passbook_holder_c < 0.75, i_passbook, anchor, anchor_from, anchor_low, i_anchor, known FROM anchored WHERE passbook_holder IS NOT NULL AND anchor_from IS NOT NULL),
compared AS (SELECT o.*, CASE WHEN known AND s.verdict = 'AMBIGUOUS' THEN 'SAME' ELSE coalesce(s.verdict, 'DIFFERENT') END AS verdict FROM others o LEFT JOIN same s ON s.i = o.i_anchor AND s.j = o.j),
best AS (SELECT *, date_diff('year', CAST(full_dob AS DATE), CAST(applied AS DATE)) - CASE WHEN strftime(CAST(full_dob AS DATE), '%m-%d') > substr(applied, 6) THEN 1 ELSE 0 END AS age FROM
  (SELECT *, CASE WHEN length(best) = 4 THEN concat(best, '-12-31') ELSE best END AS full_dob FROM
    (SELECT *, CASE best_doc WHEN 'form' THEN form_dob WHEN 'card' THEN card_dob WHEN 'epic' THEN epic_dob END AS best FROM
      (SELECT *, CASE {best('length({d}_dob) > 4')} {best('TRUE')} END AS best_doc, CASE WHEN form_application_date_c >= 0.75 AND form_application_date IS NOT NULL THEN form_application_date ELSE '2001-09-01' END AS applied FROM w)))),
facts AS (SELECT a.k, a.card_last4 AS last4, b.best AS dob, a.anchor, a.anchor_from, a.i_anchor FROM anchored a JOIN best b ON a.k = b.k WHERE a.card_last4 <> '' AND b.best IS NOT NULL AND a.anchor IS NOT NULL),
persons AS (SELECT last4, dob, i_anchor, min(k) AS first, count(*) AS cases FROM facts GROUP BY ALL),
twice AS (SELECT f.k, f.last4, f.anchor, f.anchor_from, q.first FROM facts f JOIN persons q ON f.last4 = q.last4 AND CASE WHEN length(f.dob) = 4 OR length(q.dob) = 4 THEN substr(f.dob, 1, 4) = substr(q.dob, 1, 4) ELSE f.dob = q.dob END
  JOIN same s ON s.i = f.i_anchor AND s.j = q.i_anchor AND s.verdict <> 'AMBIGUOUS' WHERE q.cases > 1 OR NOT (q.dob = f.dob AND q.i_anchor = f.i_anchor)),
flags AS (SELECT k, step, a, b, code, severity, CASE WHEN action = 'citizen' AND low THEN 'officer' ELSE action END AS action, evidence FROM ({' UNION ALL '.join(steps)}) AS t(k, step, a, b, code, severity, action, evidence, low)),
state AS (SELECT d.k, coalesce(bool_or(code = 'DUPLICATE_SUSPECTED'), FALSE) AS doubled, coalesce(bool_or(action = 'citizen' AND severity = 'critical'), FALSE) AS correct, coalesce(bool_or(action = 'citizen'), FALSE) AS ask, coalesce(bool_or(action <> 'none'), FALSE) AS any_, count(code) AS n_flags FROM base d LEFT JOIN flags f ON d.k = f.k GROUP BY d.k)"""


_SQL = findings_sql()
_EVIDENCE = "array_join(transform(f.evidence, e -> concat(e.document, '.', e.field, '=', coalesce(e.value, ''))), ';') AS evidence"


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen(typed_cases(spark, sf_dir), RULES)


FLAG_ROWS = "SELECT k AS case_id, row_number() OVER (PARTITION BY k ORDER BY step, a, b) - 1 AS place, code, severity, action, evidence FROM flags"


def flag_rows(screened_: DataFrame) -> DataFrame:
    f = screened_.select("case_id", F.posexplode("flags").alias("place", "f"))
    return f.select("case_id", F.col("place").cast("long").alias("place"), "f.code", "f.severity", "f.action", F.expr(_EVIDENCE))


@query("screen_flags", f"WITH {_SQL} {FLAG_ROWS}")
def screen_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every case with its place in the list and its evidence."""
    return flag_rows(screened(spark, sf_dir))


@query("screen_status", f"""WITH {_SQL} SELECT s.k AS case_id, CASE WHEN correct AND NOT doubled THEN 'NEEDS_CITIZEN_CORRECTION' WHEN any_ THEN 'OFFICER_ATTENTION' ELSE 'READY' END AS status, n_flags, b.age,
 CAST(least(100, CASE WHEN b.age >= 80 THEN 30 ELSE 0 END + CASE WHEN form_marital = 'widowed' AND form_marital_c >= 0.75 THEN 20 ELSE 0 END + CASE WHEN form_disability = 'true' THEN 20 ELSE 0 END + CASE WHEN form_displaced = 'true' THEN 25 ELSE 0 END
 + least(25, greatest(0, date_diff('day', CAST(d.received AS DATE), DATE '2001-09-01')))) AS INT) AS priority FROM state s JOIN base d ON s.k = d.k LEFT JOIN best b ON b.k = s.k""")
def screen_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, number of findings, age and priority of every case."""
    return screened(spark, sf_dir).select("case_id", "status", F.size("flags").cast("long").alias("n_flags"), F.col("age").cast("long").alias("age"), "priority")


@query("screen_notice", f"""WITH {_SQL} SELECT k AS case_id, NOT doubled AND ask AS allowed, CASE WHEN doubled THEN 'DUPLICATE_SUSPECTED' ELSE '' END AS blocked_by, CASE WHEN doubled THEN 'A possible duplicate is settled first.' WHEN NOT ask THEN 'Nothing is asked of the citizen.' END AS reason FROM state""")
def screen_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a notice may go out, and if not, why."""
    return screened(spark, sf_dir).select("case_id", "notice.allowed", F.array_join("notice.blocked_by", ",").alias("blocked_by"), "notice.reason")


@query("screen_duplicates", f"WITH {_SQL} SELECT k AS case_id, count(*) AS persons, min(first) AS earliest FROM twice GROUP BY k")
def screen_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that other cases' persons agree with: how many persons, and the earliest case of any of them."""
    s = screened(spark, sf_dir)
    facts = s.where("last4 <> '' AND dob IS NOT NULL AND name <> ''").select("case_id", "last4", "dob", "name")
    found = facts.join(duplicates(facts), ["last4", "dob", "name"])
    return found.select("case_id", F.size("others").cast("long").alias("persons"), F.array_min(F.transform("others", lambda o: o["first"])).alias("earliest"))
