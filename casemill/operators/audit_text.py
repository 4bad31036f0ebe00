"""What an audit entry says, in one line for each kind of action, from the entry's own values and the officer's and document's names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions.text import humanise
from casemill.plans.registry import query
from casemill.sources.views import table

# Actions, names of kinds of documents and of statuses.
ACTIONS = (
    "CASE_CREATED", "DOCUMENT_UPLOADED", "TYPE_SET_BY_OFFICER", "AI_CLASSIFICATION", "AI_EXTRACTION", "RULE_RESULT", "FIELD_EDITED", "OFFICER_ACCEPT", "OFFICER_OVERRIDE", "OFFICER_APPROVE", "SENT_FOR_CORRECTION",
    "FORWARDED_FOR_APPROVAL", "OFFICER_NOTE", "STATUS_CHANGE", "PIPELINE_ERROR", "NOTICE_SENT", "TEMPLATE_EDITED", "DEMO_RESET", "NOTICE_GENERATED",
)
KINDS = {"application_form": "application form", "aadhaar": "identity card", "bank_passbook": "bank passbook", "epic": "voter card", "other": "other paper"}
STATUSES = {"READY": "Ready", "NEEDS_CITIZEN_CORRECTION": "Needs citizen correction", "OFFICER_ATTENTION": "Officer attention", "APPROVED": "Approved by officer"}


def _named(names: dict[str, str], c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), c)


def described(log: DataFrame) -> Column:
    """The line of an entry: action, before_json, after_json, entity_id, reason, officer (name or null), file and kind (of its document or null).

    An action without a line of its own is shown as it is; what an entry doesn't hold is shown by a general word.
    """
    after = lambda field: F.get_json_object("after_json", f"$.{field}")
    before = F.get_json_object("before_json", "$.value")
    who, image = F.coalesce("officer", F.lit("Officer")), F.coalesce("file", F.lit("image"))
    document = F.coalesce(_named(KINDS, F.col("kind")), F.col("file"), F.lit("document"))
    reason = F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" (reason: "), "reason", F.lit(")"))).otherwise("")
    failed, kind = after("ok") == "false", F.coalesce(_named(KINDS, after("detectedType")), F.lit(KINDS["other"]))
    ms = after("latencyMs").try_cast("double")
    how = F.concat(F.lit(" ("), F.coalesce(after("model"), F.lit("model")), F.when(after("cacheHit") == "true", ", cached").otherwise(F.when(ms.isNotNull(), F.concat(F.lit(", "), F.format_string("%.1f", ms / 1000), F.lit(" s"))).otherwise("")), F.lit(")"))
    recorded = F.coalesce(after("model").startswith("fixture"), F.lit(False))
    quoted = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "(blank)").otherwise(F.concat(F.lit('"'), c, F.lit('"')))
    serious, title = F.coalesce(after("issues"), F.lit("0")), humanise(F.coalesce(after("code"), F.lit("")))
    fields = F.coalesce(F.concat(after("fieldsRead"), F.lit(" fields")), F.lit("fields"))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    plural = lambda n: F.when(n == "1", "").otherwise("s")
    images = F.coalesce(after("images"), F.lit("?"))
    lines = {
        "CASE_CREATED": say("Packet received: ", images, " image", plural(images), " by ", F.coalesce(after("source"), F.lit("desk"))),
        "DOCUMENT_UPLOADED": say("Uploaded ", F.coalesce(after("originalName"), F.lit("image")), F.when(after("decoded") == "false", ", which could not be opened").otherwise("")),
        "TYPE_SET_BY_OFFICER": say("An officer put ", image, " down as ", kind),
        "AI_CLASSIFICATION": F.when(failed, say("The model could not tell what ", image, " is: ", F.coalesce(after("error"), F.lit("error")))).when(recorded, say(image, " is recorded as ", kind)).otherwise(say("The model took ", image, " for ", kind, how)),
        "AI_EXTRACTION": F.when(failed, say("The model could not read the ", document, ": ", F.coalesce(after("error"), F.lit("error")))).when(recorded, say(fields, " of the ", document, " are recorded")).otherwise(say("The model read ", fields, " of the ", document, how)),
        "RULE_RESULT": say("Rules checked", F.coalesce(say(" after ", after("trigger")), F.lit("")), ": ", serious, " issue", plural(serious), ", ", F.coalesce(_named(STATUSES, after("status")), F.lit(""))),
        "FIELD_EDITED": say(who, " changed ", humanise(F.coalesce(after("field"), F.lit(""))), " on the ", F.coalesce(after("document"), document), " from ", quoted(before), " to ", quoted(after("value")), reason),
        "OFFICER_ACCEPT": say(who, " accepted: ", title, reason),
        "OFFICER_OVERRIDE": say(who, " overrode: ", title, reason),
        "OFFICER_APPROVE": say(who, " approved the case", reason),
        "SENT_FOR_CORRECTION": say(who, " sent the case back for correction", reason),
        "FORWARDED_FOR_APPROVAL": say(who, " passed the case on for approval"),
        "OFFICER_NOTE": say(who, " noted: ", F.coalesce(after("text"), F.lit(""))),
        "STATUS_CHANGE": say("Status is now ", F.coalesce(_named(STATUSES, after("status")), F.lit(""))),
        "PIPELINE_ERROR": F.lit("Processing failed; the case goes to an officer"),
        "NOTICE_SENT": say(who, " marked the notice as sent by ", F.replace(F.coalesce(after("channel"), F.lit("print")), F.lit("_"), F.lit(" "))),
        "TEMPLATE_EDITED": say(who, " edited the template ", F.coalesce("entity_id", F.lit(""))),
        "DEMO_RESET": F.lit("Everything was reset"),
        "NOTICE_GENERATED": say(who, " wrote a notice"),
    }
    out = F.col("action")
    for action, line in reversed(lines.items()):
        out = F.when(F.col("action") == action, line).otherwise(out)
    return out


def describe(log: DataFrame, officers: DataFrame, documents: DataFrame) -> DataFrame:
    """log with said. officers: actor and officer (name); documents: entity_id, file and kind. Both are joined by key, absent ones are general words."""
    return log.join(officers, "actor", "left").join(documents, "entity_id", "left").withColumn("said", described(log)).select(*log.columns, "said")


_K = "event_id % 23"
_ACTION = f"CASE {' '.join(f'WHEN {_K} = {i} THEN {a!r}' for i, a in enumerate(ACTIONS))} ELSE upper(event_type) END"


@query("audit_lines", f"""WITH e AS (SELECT event_id, {_K} AS a, event_id // 23 AS k, event_type, s_name AS officer, p_name AS file, event_id // 23 % 4 AS kind FROM events LEFT JOIN supplier ON s_suppkey = user_id AND user_id % 5 <> 0 LEFT JOIN part ON p_partkey = event_id AND event_id % 3 <> 0),
n AS (SELECT *, coalesce(officer, 'Officer') AS who, coalesce(file, 'image') AS image, CASE WHEN file IS NULL THEN 'document' ELSE ['application form', 'identity card', 'bank passbook', 'voter card'][kind + 1] END AS paper, CASE WHEN k % 2 = 0 THEN concat(' (reason: ', event_type, ')') ELSE '' END AS why,
 CASE WHEN k % 4 = 1 THEN ' (vision, cached)' ELSE concat(' (vision, ', CAST(k % 90 AS VARCHAR), '.5 s)') END AS how, ['Ready', 'Needs citizen correction', 'Officer attention', 'Approved by officer'][k % 4 + 1] AS status FROM e)
SELECT event_id, CASE a WHEN 0 THEN concat('Packet received: ', k % 3, ' image', CASE WHEN k % 3 = 1 THEN '' ELSE 's' END, ' by desk') WHEN 1 THEN concat('Uploaded x.jpg', CASE WHEN k % 2 = 0 THEN ', which could not be opened' ELSE '' END) WHEN 2 THEN concat('An officer put ', image, ' down as bank passbook')
 WHEN 3 THEN CASE WHEN k % 4 = 0 THEN concat('The model could not tell what ', image, ' is: no answer') WHEN k % 4 = 3 THEN concat(image, ' is recorded as bank passbook') ELSE concat('The model took ', image, ' for bank passbook', how) END
 WHEN 4 THEN CASE WHEN k % 4 = 0 THEN concat('The model could not read the ', paper, ': no answer') WHEN k % 4 = 3 THEN concat(k % 3, ' fields of the ', paper, ' are recorded') ELSE concat('The model read ', k % 3, ' fields of the ', paper, how) END
 WHEN 5 THEN concat('Rules checked after edit: ', k % 3, ' issue', CASE WHEN k % 3 = 1 THEN '' ELSE 's' END, ', ', status) WHEN 6 THEN concat(who, ' changed Annual income on the ', paper, ' from ', CASE WHEN k % 3 = 0 THEN '(blank)' ELSE concat('"', k, '"') END, ' to "', k + 1, '"', why)
 WHEN 7 THEN concat(who, ' accepted: Missing field', why) WHEN 8 THEN concat(who, ' overrode: Missing field', why) WHEN 9 THEN concat(who, ' approved the case', why) WHEN 10 THEN concat(who, ' sent the case back for correction', why) WHEN 11 THEN concat(who, ' passed the case on for approval')
 WHEN 12 THEN concat(who, ' noted: ', event_type) WHEN 13 THEN concat('Status is now ', status) WHEN 14 THEN 'Processing failed; the case goes to an officer' WHEN 15 THEN concat(who, ' marked the notice as sent by text message') WHEN 16 THEN concat(who, ' edited the template ', event_id) WHEN 17 THEN 'Everything was reset'
 WHEN 18 THEN concat(who, ' wrote a notice') ELSE upper(event_type) END AS said FROM n""")
def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an audit entry of one of all kinds, with its line."""
    k = F.floor(F.col("event_id") / 23)
    statuses = F.element_at(F.array(*map(F.lit, STATUSES)), (k % 4 + 1).cast("int"))
    after = F.struct(
        (k % 3).alias("images"), F.lit("x.jpg").alias("originalName"), (k % 2 != 0).alias("decoded"), F.lit("bank_passbook").alias("detectedType"), (k % 4 != 0).alias("ok"), F.lit("no answer").alias("error"), F.when(k % 4 == 3, "fixture:1").otherwise("vision").alias("model"), (k % 4 == 1).alias("cacheHit"),
        (k % 90 * 1000 + 500).alias("latencyMs"), (k % 3).alias("fieldsRead"), F.lit("edit").alias("trigger"), (k % 3).alias("issues"), statuses.alias("status"), F.lit("annual_income").alias("field"), (k + 1).alias("value"), F.lit("MISSING_FIELD").alias("code"), F.col("event_type").alias("text"), F.lit("text_message").alias("channel"),
    )
    e = table(spark, sf_dir, "events")
    log = e.select("event_id", F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("officer:"), F.col("user_id").cast("string"))).otherwise("system").alias("actor"), F.expr(_ACTION).alias("action"), F.col("event_id").cast("string").alias("entity_id"), F.when(k % 2 == 0, F.col("event_type")).alias("reason"), F.to_json(after).alias("after_json"), F.to_json(F.struct(F.when(k % 3 != 0, k).alias("value"))).alias("before_json"))
    officers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("officer:"), F.col("s_suppkey").cast("string")).alias("actor"), F.col("s_name").alias("officer"))
    names = ("application_form", "aadhaar", "bank_passbook", "epic")
    kind = F.element_at(F.array(*map(F.lit, names)), (F.floor(F.col("p_partkey") / 23) % 4 + 1).cast("int"))
    documents = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("file"), kind.alias("kind"))
    return describe(log, officers, documents).select("event_id", "said")
