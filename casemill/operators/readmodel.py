"""Small operators of the read models: ordered findings, documents in slot order, counts and shares, field equality, birthdays, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions import text
from casemill.functions.dates import parse_date
from casemill.operators.filters import in_force
from casemill.plans.registry import query
from casemill.sources.views import AUDIT, CASES, EXTRACTIONS, FLAGS, audit_log, cases, extractions, flags, literal_and, table, with_district

RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END"
#: Documents in the order in which a case shows them; others come after.
SLOTS = ("form", "card", "passbook", "epic")
_KIND = "CASE document_id % 6 WHEN 0 THEN 'epic' WHEN 1 THEN 'form' WHEN 2 THEN 'passbook' WHEN 3 THEN 'card' WHEN 4 THEN 'letter' END"


def severity_rank() -> Column:
    return F.expr(RANK)


@query("agg_flags_caught_all", f"WITH {FLAGS} SELECT count(*) AS flags_caught_all FROM flags WHERE severity <> 'info'")
def agg_flags_caught_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that are more than a note, of all cases: historical and overridden ones too, which the other counts leave out."""
    return flags(spark, sf_dir).agg(F.count_if(F.col("severity") != "info").alias("flags_caught_all"))


@query("sort_flags", f"WITH {FLAGS} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY {RANK}, seq, part) - 1 AS place, code, severity FROM flags")
def sort_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's findings by severity, then in the order in which they were found."""
    w = Window.partitionBy("case_id").orderBy(severity_rank(), "seq", "part")
    return flags(spark, sf_dir).select("case_id", (F.row_number().over(w) - 1).cast("long").alias("place"), "code", "severity")


@query("sort_documents", f"WITH {EXTRACTIONS}, d AS (SELECT DISTINCT document_id, document_id // 7 AS case_id, {_KIND} AS kind FROM extractions) SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(list_position(['form', 'card', 'passbook', 'epic'], kind), 99), document_id) AS place, document_id, coalesce(kind, 'unsorted') AS slot FROM d")
def sort_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's documents in slot order; those of no slot last."""
    d = extractions(spark, sf_dir).select("document_id").distinct().select("document_id", F.expr("document_id div 7").alias("case_id"), F.expr(_KIND).alias("kind"))
    at = F.array_position(F.array(*map(F.lit, SLOTS)), F.col("kind"))
    w = Window.partitionBy("case_id").orderBy(F.when(at > 0, at).otherwise(99), "document_id")
    return d.select("case_id", F.row_number().over(w).cast("long").alias("place"), "document_id", F.coalesce("kind", F.lit("unsorted")).alias("slot"))


@query("agg_files_by_slot", f"WITH {EXTRACTIONS}, d AS (SELECT DISTINCT document_id, {_KIND} AS kind FROM extractions) SELECT coalesce(kind, 'unsorted') AS slot, count(*) AS files FROM d GROUP BY 1")
def agg_files_by_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by slot; those without one are unsorted."""
    d = extractions(spark, sf_dir).select("document_id").distinct().select(F.coalesce(F.expr(_KIND), F.lit("unsorted")).alias("slot"))
    return d.groupBy("slot").agg(F.count("*").alias("files"))


@query("agg_batch_progress", f"WITH {CASES} SELECT batch_id, count(*) AS total, count(screened_ms) AS done, count(*) FILTER (WHERE last4 IS NOT NULL) AS identified, count(screened_ms) = count(*) AS finished FROM cases GROUP BY batch_id")
def agg_batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each batch is: screened, identified, and whether all is done."""
    c = cases(spark, sf_dir).groupBy("batch_id")
    return c.agg(F.count("*").alias("total"), F.count("screened_ms").alias("done"), F.count("last4").alias("identified"), (F.count("screened_ms") == F.count("*")).alias("finished"))


@query("agg_bar_shares", f"WITH {CASES}, n AS (SELECT status, count(*) AS n FROM cases WHERE NOT historical GROUP BY status) SELECT status, n, round(n / greatest((SELECT coalesce(sum(n), 0) FROM n), 1)::DOUBLE, 6) AS share FROM n")
def agg_bar_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each status's share of the whole; a whole of nothing counts as one."""
    n = cases(spark, sf_dir).where("NOT historical").groupBy("status").agg(F.count("*").alias("n"))
    whole = F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1))  # a row for each status
    return n.select("status", "n", F.round(F.col("n") / whole, 6).alias("share"))


@query("agg_pending_notices", f"WITH {CASES}, {FLAGS}, f AS (SELECT case_id, bool_or(action = 'citizen' AND resolution <> 'OVERRIDDEN') AND NOT bool_or(code = 'DUPLICATE_SUSPECTED' AND resolution <> 'OVERRIDDEN') AS allowed FROM flags GROUP BY case_id) SELECT count(*) AS pending FROM cases c JOIN f ON c.case_id = f.case_id WHERE f.allowed AND c.sent_ms IS NULL AND NOT c.historical")
def agg_pending_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices that may go out and haven't."""
    f = flags(spark, sf_dir).groupBy("case_id").agg((F.some((F.col("action") == "citizen") & in_force()) & ~F.some((F.col("code") == "DUPLICATE_SUSPECTED") & in_force())).alias("allowed")).where("allowed")
    waiting = cases(spark, sf_dir).where("sent_ms IS NULL AND NOT historical").select("case_id")
    return waiting.join(f.select("case_id"), "case_id", "left_semi").agg(F.count("*").alias("pending"))


DATES, DIGITS = ("dob", "application_date"), ("account", "mobile")


def field_matches(name: Column, expected: Column, got: Column) -> Column:
    """Equality by the kind of field: dates by day, numbers by digits, income by amount, identifiers without blanks, text without case and marks; null equals null only."""
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    dates = F.coalesce(parse_date(expected) == parse_date(got), text.loose(expected) == text.loose(got))
    same = F.when(name.isin(*DATES), dates).when(name.isin(*DIGITS), digits(expected) == digits(got)).when(name == "income", text.income(expected).eqNullSafe(text.income(got)))
    same = same.when(name == "identity", text.compact_upper(expected) == text.compact_upper(got)).otherwise(text.loose(expected) == text.loose(got))
    return F.when(expected.isNull() | got.isNull(), expected.isNull() & got.isNull()).otherwise(same)


#: Field, expected, read, and whether they match.
MATCHES = (
    ("dob", "1950-02-01", "1/2/1950", True), ("dob", "DOB 01-02-1950", "1950-02-01", True), ("dob", "1950", "1950-02-01", False), ("dob", "n.a.", "N.A", True), ("account", "12-34 56", "123456", True), ("account", "123", "124", False),
    ("income", "Rs. 60,000", "60000", True), ("income", "nil", "0", True), ("income", "abc", "xyz", True), ("identity", "xxxx xxxx 12", "XXXXXXXX12", True), ("name", "Asha  Rai.", "asha rai", True), ("name", "Asha Rai", "Asha Ray", False),
    ("name", None, None, True), ("name", "x", None, False), ("mobile", None, "9", False),
)
_SHIFTED = "CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END"
MATCH_ROWS, MATCHES_SQL = literal_and(
    [(i, *m) for i, m in enumerate(MATCHES)], "id long, field string, expected string, got string, wanted boolean", "orders",
    id="o_orderkey + 1000", field="CASE o_orderkey % 3 WHEN 0 THEN 'dob' WHEN 1 THEN 'account' ELSE 'income' END", wanted="o_orderkey % 9 <> 0 AND (o_orderkey % 4 <> 0 OR o_orderkey % 3 <> 0)",
    expected=f"CASE o_orderkey % 3 WHEN 0 THEN concat('19', CAST(10 + o_orderkey % 80 AS STRING), '-0', CAST(1 + o_orderkey % 9 AS STRING), '-1', CAST(o_orderkey % 5 AS STRING)) WHEN 1 THEN CAST(o_orderkey + 100000 AS STRING) ELSE concat('Rs. ', CAST(o_orderkey + 100000 AS STRING)) END",
    got=f"CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 4 <> 0 THEN concat('1', CAST(o_orderkey % 5 + {_SHIFTED} AS STRING), '.', CAST(1 + o_orderkey % 9 AS STRING), '.19', CAST(10 + o_orderkey % 80 AS STRING)) END WHEN 1 THEN concat(CAST(o_orderkey + 100000 + {_SHIFTED} AS STRING), ' -') ELSE concat(CAST(o_orderkey + 100000 + {_SHIFTED} AS STRING), ' a year') END",
)


@query("eval_field_matches", f"SELECT id, field, wanted AS matches FROM {MATCHES_SQL}")
def eval_field_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MATCH_ROWS(spark, sf_dir).select("id", "field", field_matches(F.col("field"), F.col("expected"), F.col("got")).alias("matches"))


@query("date_birth_for_age", "SELECT o_orderkey AS case_id, strftime(CAST(o_orderdate AS DATE) - CAST(60 + o_orderkey % 30 AS INTEGER) * INTERVAL 1 YEAR - CAST(o_orderkey % 365 AS INTEGER) * INTERVAL 1 DAY, '%Y-%m-%d') AS dob, strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y') AS shown FROM orders")
def date_birth_for_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date of birth that makes a person so many years old on a day, up to 364 days before the last birthday that does; and a day as it is written."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    birth = F.date_sub(F.add_months("day", (-12 * (60 + F.col("o_orderkey") % 30)).cast("int")), (F.col("o_orderkey") % 365).cast("int"))
    return o.select(F.col("o_orderkey").alias("case_id"), F.date_format(birth, "yyyy-MM-dd").alias("dob"), F.date_format("day", "dd/MM/yyyy").alias("shown"))


#: Decisions with the states in which they are open to an officer, the permission they need, and the state they lead to (null: unchanged).
DECISIONS = (
    ("approve", "READY", "approve", "APPROVED"), ("correct", "READY,OFFICER_ATTENTION", "decide", "NEEDS_CITIZEN_CORRECTION"), ("reopen", "APPROVED,NEEDS_CITIZEN_CORRECTION", "decide", "OFFICER_ATTENTION"),
    ("forward", "READY,OFFICER_ATTENTION,NEEDS_CITIZEN_CORRECTION", "decide", "OFFICER_ATTENTION"), ("note", "READY,OFFICER_ATTENTION,NEEDS_CITIZEN_CORRECTION,APPROVED", "view", None),
)
MAY = {"senior": ("view", "decide", "approve"), "officer": ("view", "decide"), "viewer": ("view",)}


def decide(requests: DataFrame) -> DataFrame:
    """requests with outcome (200, 400, 403, 404 or 409) and the new state, for one decision a row against the case as it stands.

    requests has decision, role, status (null: no such case), processing, blocking (open findings that block approval) and reason. In order: an
    unknown decision or a reason under three characters is 400, a missing case 404, a role without the permission 403; a case in processing,
    in another state than the decision needs, or with blocking findings at an approval is 409.
    """
    known = F.create_map(*[x for d, states, need, to in DECISIONS for x in (F.lit(d), F.struct(F.split(F.lit(states), ",").alias("states"), F.lit(need).alias("need"), F.lit(to).cast("string").alias("to")))])
    may = F.create_map(*[x for role, of in MAY.items() for x in (F.lit(role), F.array(*map(F.lit, of)))])
    rule, allowed = F.try_element_at(known, F.col("decision")), F.try_element_at(may, F.col("role"))
    short = F.length(F.trim(F.coalesce("reason", F.lit("")))) < 3
    outcome = F.when(rule.isNull() | short, 400).when(F.col("status").isNull(), 404).when(~F.coalesce(F.array_contains(allowed, rule["need"]), F.lit(False)), 403)
    stuck = F.col("processing") | ~F.array_contains(rule["states"], F.col("status")) | ((F.col("decision") == "approve") & (F.col("blocking") > 0))
    outcome = outcome.when(stuck, 409).otherwise(200)
    return requests.withColumn("outcome", outcome).withColumn("state", F.when(F.col("outcome") == 200, F.coalesce(rule["to"], F.col("status"))).otherwise(F.col("status")))


_NEW = "CASE decision WHEN 'approve' THEN 'APPROVED' WHEN 'correct' THEN 'NEEDS_CITIZEN_CORRECTION' WHEN 'reopen' THEN 'OFFICER_ATTENTION' WHEN 'forward' THEN 'OFFICER_ATTENTION' ELSE status END"
_ASKS = {
    "decision": "CASE event_id % 7 WHEN 0 THEN 'approve' WHEN 1 THEN 'correct' WHEN 2 THEN 'reopen' WHEN 3 THEN 'forward' WHEN 4 THEN 'note' WHEN 5 THEN 'approve' ELSE 'reject' END",
    "role": "CASE event_id % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'officer' ELSE 'senior' END",
    "reason": "CASE WHEN event_id % 11 = 0 THEN ' x ' ELSE 'seen the papers' END",
}


@query("rule_decide", f"""WITH {CASES}, {FLAGS}, b AS (SELECT case_id, count(*) FILTER (WHERE (severity = 'critical' AND resolution <> 'OVERRIDDEN') OR (severity = 'warn' AND resolution = 'OPEN')) AS blocking FROM flags GROUP BY case_id),
r AS (SELECT event_id, user_id AS case_id, {', '.join(f'{v} AS {k}' for k, v in _ASKS.items())} FROM events),
j AS (SELECT r.*, c.status, c.screened_ms IS NULL AS processing, coalesce(b.blocking, 0) AS blocking FROM r LEFT JOIN cases c ON c.case_id = r.case_id LEFT JOIN b ON b.case_id = r.case_id),
o AS (SELECT *, CASE WHEN decision = 'reject' OR length(trim(reason)) < 3 THEN 400 WHEN status IS NULL THEN 404 WHEN role = 'viewer' AND decision <> 'note' OR role = 'officer' AND decision = 'approve' THEN 403
 WHEN processing THEN 409 WHEN decision = 'approve' AND (status <> 'READY' OR blocking > 0) THEN 409 WHEN decision = 'correct' AND status NOT IN ('READY', 'OFFICER_ATTENTION') THEN 409
 WHEN decision = 'reopen' AND status NOT IN ('APPROVED', 'NEEDS_CITIZEN_CORRECTION') THEN 409 WHEN decision = 'forward' AND status = 'APPROVED' THEN 409 ELSE 200 END AS outcome FROM j)
SELECT event_id, case_id, decision, outcome, CASE WHEN outcome = 200 THEN {_NEW} ELSE status END AS state FROM o""")
def rule_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every requested decision against its case: allowed or why not, and the state after it."""
    r = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("case_id"), *[F.expr(v).alias(k) for k, v in _ASKS.items()])
    block = ((F.col("severity") == "critical") & in_force()) | ((F.col("severity") == "warn") & (F.col("resolution") == "OPEN"))
    b = flags(spark, sf_dir).where(block).groupBy("case_id").agg(F.count("*").alias("blocking"))
    c = cases(spark, sf_dir).select("case_id", "status", F.col("screened_ms").isNull().alias("processing"))
    asked = r.join(c, "case_id", "left").join(b, "case_id", "left").na.fill(0, ["blocking"])
    return decide(asked).select("event_id", "case_id", "decision", "outcome", "state")


#: What an audit entry says, by action; {k} stands for the field of that name in its JSON.
SENTENCES = {"signup": "The application was received", "purchase": "The case was approved", "error": "A document could not be read (try {k})", "click": "A finding was resolved (number {k})", "view": "The case was opened"}


@query("audit_describe", f"""WITH {AUDIT} SELECT audit_id, CASE action WHEN 'signup' THEN 'The application was received' WHEN 'purchase' THEN 'The case was approved' WHEN 'error' THEN 'A document could not be read (try ' || coalesce(json_extract_string(after_json, '$.k'), '—') || ')'
 WHEN 'click' THEN 'A finding was resolved (number ' || coalesce(json_extract_string(after_json, '$.k'), '—') || ')' WHEN 'view' THEN 'The case was opened' ELSE upper(substr(action, 1, 1)) || lower(replace(substr(action, 2), '_', ' ')) END || ' by ' || actor AS said FROM audit_log""")
def audit_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry of the log as a sentence; an action without one of its own is its code in words."""
    said = F.try_element_at(F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv]), F.col("action"))
    k = F.coalesce(F.get_json_object("after_json", "$.k"), F.lit("—"))
    return audit_log(spark, sf_dir).select("audit_id", F.concat(F.coalesce(F.replace(said, F.lit("{k}"), k), text.humanise(F.col("action"))), F.lit(" by "), F.col("actor")).alias("said"))


@query("case_detail", f"""WITH {CASES}, {FLAGS}, f AS (SELECT case_id, count(*) AS findings, count(*) FILTER (WHERE resolution = 'OPEN') AS open_, count(*) FILTER (WHERE severity = 'critical' AND resolution <> 'OVERRIDDEN') AS critical, count(*) FILTER (WHERE action = 'citizen' AND resolution = 'OPEN') AS citizen_open,
 string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM flags GROUP BY case_id)
SELECT c.case_id, c.reference, c.status, c.priority, coalesce(c.district, 'Not stated') AS district, 'XXXX XXXX ' || c.last4 AS masked_id, c.dob, c.received_ms, c.screened_ms - c.received_ms AS screening_ms, c.decided_ms, c.sent_ms IS NOT NULL AS notice_sent, c.historical,
 coalesce(f.findings, 0) AS findings, coalesce(f.open_, 0) AS open_findings, coalesce(f.critical, 0) AS critical, coalesce(f.citizen_open, 0) AS citizen_open, coalesce(f.codes, '') AS codes FROM cases c LEFT JOIN f ON c.case_id = f.case_id""")
def case_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of every case: its own columns, what was found, and how much of it is open."""
    open_ = F.col("resolution") == "OPEN"
    f = flags(spark, sf_dir).groupBy("case_id").agg(
        F.count("*").alias("findings"), F.count_if(open_).alias("open_findings"), F.count_if((F.col("severity") == "critical") & in_force()).alias("critical"), F.count_if((F.col("action") == "citizen") & open_).alias("citizen_open"),
        F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"),
    )
    c = with_district(cases(spark, sf_dir), sf_dir).join(f, "case_id", "left").na.fill(0, ["findings", "open_findings", "critical", "citizen_open"]).na.fill("", ["codes"])
    return c.select(
        "case_id", "reference", "status", "priority", F.coalesce("district", F.lit("Not stated")).alias("district"), F.concat(F.lit("XXXX XXXX "), "last4").alias("masked_id"), "dob", "received_ms",
        (F.col("screened_ms") - F.col("received_ms")).alias("screening_ms"), "decided_ms", F.col("sent_ms").isNotNull().alias("notice_sent"), "historical", "findings", "open_findings", "critical", "citizen_open", "codes",
    )
