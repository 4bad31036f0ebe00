"""Safeguards and small rules around cases: trust figures, permissions, reasons, redaction modes, status tokens, seeded draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions.queries import _phonetic_sql
from casemill.functions.names import SURNAMES
from casemill.functions.text import phonetic_key
from casemill.operators.audit import KEY
from casemill.plans.registry import query
from casemill.sources.views import AUDIT, CASES, EXTRACTIONS, FLAGS, audit_log, cases, extractions, flags, literal_and, table

# Roles and what they may do; only one may approve.
PERMISSIONS = {"viewer": ("read",), "clerk": ("read", "note", "correct"), "officer": ("read", "note", "correct", "override", "forward"), "approver": ("read", "note", "correct", "override", "forward", "approve")}
REASONS = {"DOC_SEEN": "Original document seen", "SPELLING": "Known spelling variant", "CLERICAL": "Clerical error"}
M32 = 0xFFFFFFFF


@query("trust_safeguards", f"""WITH {CASES}, {FLAGS}, {AUDIT}, live AS (SELECT case_id FROM cases WHERE NOT historical), f AS (SELECT * FROM flags WHERE case_id IN (SELECT case_id FROM live))
SELECT (SELECT count(*) FROM audit_log) AS audit_rows, (SELECT count(*) FROM cases WHERE historical) AS historical, count(*) FILTER (WHERE resolution <> 'OPEN') AS decided,
round(avg(CASE WHEN resolution <> 'OPEN' THEN CAST(resolution = 'OVERRIDDEN' AS INT) END), 6) AS override_rate, coalesce(bool_and(resolved_by IS NOT NULL) FILTER (WHERE resolution <> 'OPEN'), TRUE) AS all_by_officers FROM f""")
def trust_safeguards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The safeguards' figures: one row, each part aggregated by itself and put side by side."""
    c = cases(spark, sf_dir)
    f = flags(spark, sf_dir).join(c.where("NOT historical").select("case_id"), "case_id", "left_semi")
    decided = F.col("resolution") != "OPEN"
    own = f.agg(
        F.count_if(decided).alias("decided"), F.round(F.avg(F.when(decided, (F.col("resolution") == "OVERRIDDEN").cast("int"))), 6).alias("override_rate"),
        F.coalesce(F.every(F.when(decided, F.col("resolved_by").isNotNull())), F.lit(True)).alias("all_by_officers"),
    )
    one = F.lit(1)  # each side has one row
    parts = [audit_log(spark, sf_dir).agg(F.count("*").alias("audit_rows")), c.agg(F.count_if("historical").alias("historical")), own]
    rows = [p.withColumn("one", one) for p in parts]
    return rows[0].join(rows[1], "one").join(rows[2], "one").drop("one")


@query("trust_model_usage", f"""WITH {EXTRACTIONS} SELECT count(*) AS calls, count(DISTINCT document_id) AS documents, count(*) FILTER (WHERE status = 'ERROR') AS errors, round(sum(input_tokens * 2.0::DOUBLE + output_tokens * 10.0::DOUBLE) / 1000000 / count(DISTINCT document_id), 4) AS usd_each FROM extractions""")
def trust_model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    usd = F.sum(F.col("input_tokens") * 2.0 + F.col("output_tokens") * 10.0) / 1_000_000 / F.countDistinct("document_id")
    return extractions(spark, sf_dir).agg(F.count("*").alias("calls"), F.countDistinct("document_id").alias("documents"), F.count_if(F.col("status") == "ERROR").alias("errors"), F.round(usd, 4).alias("usd_each"))


def role(actor: Column) -> Column:
    """Demonstration roles by the number of an officer."""
    names = F.array(*map(F.lit, PERMISSIONS))
    return F.element_at(names, (F.regexp_extract(actor, "([0-9]+)", 1).cast("long") % 4 + 1).cast("int"))


@query("rule_permissions", f"""WITH {AUDIT}, r AS (SELECT audit_id, list_extract(['viewer', 'clerk', 'officer', 'approver'], CAST(regexp_extract(actor, '([0-9]+)', 1) AS BIGINT) % 4 + 1) AS role, action FROM audit_log)
SELECT role, count(*) AS asked, count(*) FILTER (WHERE CASE action WHEN 'purchase' THEN role = 'approver' WHEN 'error' THEN role IN ('officer', 'approver') WHEN 'signup' THEN role <> 'viewer' ELSE TRUE END) AS allowed FROM r GROUP BY role""")
def rule_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked-for actions against what the actor's role may do; the matrix is a dimension of a fixed size."""
    matrix = spark.createDataFrame([(r, p) for r, ps in PERMISSIONS.items() for p in ps], "role string, need string")
    need = F.when(F.col("action") == "purchase", "approve").when(F.col("action") == "error", "override").when(F.col("action") == "signup", "correct").otherwise("read")
    asked = audit_log(spark, sf_dir).select("audit_id", role(F.col("actor")).alias("role"), need.alias("need"))
    may = asked.join(F.broadcast(matrix.withColumn("may", F.lit(True))), ["role", "need"], "left")
    return may.groupBy("role").agg(F.count("*").alias("asked"), F.count("may").alias("allowed"))


GIVEN, GIVEN_SQL = literal_and([(1, "SPELLING", None), (2, "SPELLING", " seen "), (3, None, "ok"), (4, None, " long enough "), (5, "NOPE", "a free text"), (6, None, None)], "id long, code string, txt string", "orders", id="o_orderkey + 1000", code="CASE o_orderkey % 5 WHEN 0 THEN 'DOC_SEEN' WHEN 1 THEN 'SPELLING' WHEN 2 THEN 'CLERICAL' WHEN 3 THEN o_orderstatus END", txt="CASE WHEN o_orderkey % 3 = 0 THEN substr(o_orderpriority, 1, CAST(o_orderkey % 7 AS INT)) END")


@query("rule_reason", f"""SELECT id, CASE WHEN p IS NOT NULL AND t <> '' THEN concat(p, ': ', t) WHEN p IS NOT NULL THEN p WHEN length(t) >= 3 THEN t END AS reason FROM (SELECT id, CASE code WHEN 'DOC_SEEN' THEN 'Original document seen' WHEN 'SPELLING' THEN 'Known spelling variant' WHEN 'CLERICAL' THEN 'Clerical error' END AS p, coalesce(trim(txt), '') AS t FROM {GIVEN_SQL})""")
def rule_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reason of a decision: a preset one, with a remark if there is one, or a free text of three characters; else null, which refuses it."""
    preset = F.try_element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), F.col("code"))
    text = F.coalesce(F.trim("txt"), F.lit(""))
    reason = F.when(preset.isNotNull() & (text != ""), F.concat_ws(": ", preset, text)).when(preset.isNotNull(), preset).when(F.length(text) >= 3, text)
    return GIVEN(spark, sf_dir).select("id", reason.alias("reason"))


@query("rule_redaction_mode", "SELECT p_partkey AS image, CASE WHEN p_size % 4 <> 0 THEN 'none' WHEN p_size % 8 = 0 THEN 'box' ELSE 'blur' END AS mode, CASE WHEN p_size % 8 = 0 THEN concat_ws(',', greatest(0, p_size - 10), greatest(0, 30 - 10), least(100, p_size + 50 + 10), least(100, 60 + 10)) END AS box FROM part")
def rule_redaction_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an image is shown: as it is, with the identifier's box (ten more pixels on each side, inside the image) covered, or blurred where the box is unknown."""
    size = F.col("p_size")
    box = F.concat_ws(",", *[x.cast("string") for x in (F.greatest(F.lit(0), size - 10), F.lit(20), F.least(F.lit(100), size + 60), F.lit(70))])
    mode = F.when(size % 4 != 0, "none").when(size % 8 == 0, "box").otherwise("blur")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), mode.alias("mode"), F.when(size % 8 == 0, box).alias("box"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex as Spark expressions: a hash over two padded keys."""
    block = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _blob(x: int) -> str:
    return "'" + "".join(f"\\x{b ^ x:02X}" for b in KEY.ljust(64, b"\0")) + "'::BLOB"


@query("math_status_token", f"WITH {CASES} SELECT case_id, substr(sha256({_blob(0x5C)} || unhex(sha256({_blob(0x36)} || encode(reference)))), 1, 12) AS token FROM cases")
def math_status_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public token of a case's status page."""
    return cases(spark, sf_dir).select("case_id", F.substring(hmac_sha256(KEY, F.col("reference")), 1, 12).alias("token"))


def times32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two numbers below 2**32, held in longs."""
    high = F.shiftright(a, 16) * b
    return ((a.bitwiseAND(F.lit(0xFFFF)) * b) + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(M32))


def draw(seed: Column) -> Column:
    """The first number of a public 32-bit generator (mulberry32) with a seed, 0 to 1."""
    a = (seed + F.lit(0x6D2B79F5)).bitwiseAND(F.lit(M32))
    t = times32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + times32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(M32)))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(float(1 << 32))


@query("math_seeded_draw", f"""WITH a AS (SELECT p_partkey AS id, (p_partkey + 1831565813) & {M32} AS a FROM part), t AS (SELECT id, CAST((CAST(xor(a, a >> 15) AS HUGEINT) * (a | 1)) % 4294967296 AS BIGINT) AS t FROM a),
u AS (SELECT id, xor(t, CAST((t + (CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61)) % 4294967296) % 4294967296 AS BIGINT)) AS t FROM t) SELECT id, xor(t, t >> 14) / 4294967296.0::DOUBLE AS x FROM u""")
def math_seeded_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reproducible draws for synthetic cases: the same seed gives the same number on any cluster."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), draw(F.col("p_partkey")).alias("x"))


@query("gen_cases", f"""WITH a AS (SELECT range AS n, (range * 7919 + 2026 + 1831565813) & {M32} AS a FROM range(1, 401)), t AS (SELECT n, CAST((CAST(xor(a, a >> 15) AS HUGEINT) * (a | 1)) % 4294967296 AS BIGINT) AS t FROM a),
u AS (SELECT n, xor(t, CAST((t + (CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61)) % 4294967296) % 4294967296 AS BIGINT)) AS t FROM t), d AS (SELECT n, xor(t, t >> 14) / 4294967296.0::DOUBLE AS x FROM u)
SELECT n AS case_id, CASE WHEN x < 0.55 THEN 'READY' WHEN x < 0.8 THEN 'NEEDS_CITIZEN_CORRECTION' ELSE 'OFFICER_ATTENTION' END AS status, CAST(1 + floor(x * 60) AS BIGINT) AS days_ago FROM d""")
def gen_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic(spark, 400, 2026)


def synthetic(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """count cases with statuses at fixed shares and the days since they came; any part can be made again by itself."""
    x = F.col("x")
    rows = spark.range(1, count + 1).select(F.col("id").alias("case_id"), draw(F.col("id") * 7919 + seed).alias("x"))
    status = F.when(x < 0.55, "READY").when(x < 0.8, "NEEDS_CITIZEN_CORRECTION").otherwise("OFFICER_ATTENTION")
    return rows.select("case_id", status.alias("status"), (1 + F.floor(x * 60)).alias("days_ago"))


WRITTEN, WRITTEN_SQL = literal_and([(1, "Khuraijam"), (2, "Kuraijam"), (3, "Tokchom"), (4, "Wangkhem"), (5, "Vangkem"), (6, "Smith"), (7, None)], "id long, surname string", "customer", id="c_custkey + 1000", surname="CASE c_custkey % 6 WHEN 0 THEN 'Khuraijaam' WHEN 1 THEN 'Tokchom' WHEN 2 THEN 'wangkhem' WHEN 3 THEN 'Laisram' WHEN 4 THEN c_mktsegment ELSE c_name END")


@query("join_gazetteer", f"""WITH g AS (SELECT *, {_phonetic_sql('name')} AS k FROM (VALUES {', '.join(f"({i}, '{s}', '{c}')" for i, (s, c, _) in enumerate(SURNAMES))}) v(ord, name, community)), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS r FROM g) WHERE r = 1)
SELECT w.id, w.surname, o.name AS canonical, o.community FROM {WRITTEN_SQL} w LEFT JOIN o ON o.k = {_phonetic_sql('w.surname')}""")
def join_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surnames as written against the list by phonetic key; of entries with one key the first counts."""
    listed = spark.createDataFrame([(i, s, c) for i, (s, c, _) in enumerate(SURNAMES)], "ord int, canonical string, community string").withColumn("k", phonetic_key(F.col("canonical")))
    first = listed.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("ord"))).where("r = 1").select("k", "canonical", "community")
    return WRITTEN(spark, sf_dir).withColumn("k", phonetic_key(F.col("surname"))).join(F.broadcast(first), "k", "left").select("id", "surname", "canonical", "community")


@query("join_audit_documents", f"""WITH {AUDIT} SELECT a.audit_id, d.source FROM audit_log a LEFT JOIN documents d ON d.doc_id = a.case_id WHERE a.action = 'error'""")
def join_audit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that an action was about."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "source")
    return audit_log(spark, sf_dir).where("action = 'error'").select("audit_id", "case_id").join(d, "case_id", "left").select("audit_id", "source")


@query("agg_retention_sums", f"WITH {CASES} SELECT status, count(*) AS cases, sum(length(reference))::BIGINT AS bytes FROM cases WHERE NOT historical AND decided_ms IS NOT NULL GROUP BY status")
def agg_retention_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes that retention frees."""
    return cases(spark, sf_dir).where("NOT historical AND decided_ms IS NOT NULL").groupBy("status").agg(F.count("*").alias("cases"), F.sum(F.length("reference")).alias("bytes"))


@query("str_path_parts", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1) AS extension, regexp_replace(url, '[\\x00-\\x1f]', '', 'g') AS cleaned FROM pages")
def str_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.substring_index("url", "/", -1).alias("name"), F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1).alias("extension"), F.regexp_replace("url", r"[\x00-\x1f]", "").alias("cleaned"))


MODELS, MODELS_SQL = literal_and([(1, "vision-large-4-1"), (2, "vision-small-3"), (3, "other"), (4, None)], "id long, model string", "part", id="p_partkey + 1000", model="CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE concat('vision-', CASE WHEN p_partkey % 2 = 0 THEN 'large' ELSE 'small' END, '-', CAST(p_size AS STRING), CASE WHEN p_partkey % 5 = 0 THEN '-2' ELSE '' END) END")


@query("str_model_label", f"""SELECT id, CASE WHEN regexp_extract(model, '^vision-([a-z]+)-([0-9]+)', 1) <> '' THEN concat(upper(substr(regexp_extract(model, '^vision-([a-z]+)', 1), 1, 1)), substr(regexp_extract(model, '^vision-([a-z]+)', 1), 2), ' ', replace(regexp_extract(model, '-([0-9-]+)$', 1), '-', '.')) ELSE model END AS label FROM {MODELS_SQL}""")
def str_model_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.regexp_extract("model", "^vision-([a-z]+)-([0-9]+)", 1)
    label = F.concat(F.initcap(family), F.lit(" "), F.replace(F.regexp_extract("model", "-([0-9-]+)$", 1), F.lit("-"), F.lit(".")))
    return MODELS(spark, sf_dir).select("id", F.when(family != "", label).otherwise(F.col("model")).alias("label"))


@query("arr_brief", f"WITH {FLAGS}, k AS (SELECT case_id, list_sort(list(DISTINCT code)) AS xs FROM flags GROUP BY case_id) SELECT case_id, concat(array_to_string(list_slice(xs, 1, 3), ', '), CASE WHEN len(xs) > 3 THEN concat(' +', CAST(len(xs) - 3 AS VARCHAR), ' more') ELSE '' END) AS brief FROM k")
def arr_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three codes and how many more there are."""
    k = flags(spark, sf_dir).groupBy("case_id").agg(F.array_sort(F.collect_set("code")).alias("xs"))
    more = F.when(F.size("xs") > 3, F.concat(F.lit(" +"), (F.size("xs") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return k.select("case_id", F.concat(F.array_join(F.slice("xs", 1, 3), ", "), more).alias("brief"))


@query("date_dob_conflict", f"WITH {CASES} SELECT case_id, CASE WHEN length(dob) = 4 THEN substr(dob, 1, 4) <> '1930' ELSE dob <> '1930-01-01' END OR substr(dob, 1, 4) <> '1930' AS conflict, greatest(0, date_diff('day', DATE '1930-01-01', CAST(CASE WHEN length(dob) = 4 THEN dob || '-12-31' ELSE dob END AS DATE)))::INT AS days FROM cases")
def date_dob_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any two of a case's dates of birth (its own, a full one, a year) disagree, and the days between two dates, never below 0."""
    year, whole = F.substring("dob", 1, 4), F.length("dob") == 4
    conflict = F.when(whole, year != "1930").otherwise(F.col("dob") != "1930-01-01") | (year != "1930")
    full = F.when(whole, F.concat("dob", F.lit("-12-31"))).otherwise(F.col("dob")).cast("date")
    return cases(spark, sf_dir).select("case_id", conflict.alias("conflict"), F.greatest(F.datediff(full, F.lit("1930-01-01").cast("date")), F.lit(0)).alias("days"))
