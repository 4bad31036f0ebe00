"""From stored model replies to typed cases: replies checked and masked, images of a kind merged field by field, outcomes of documents, and the
structs that screen() reads.

Images have case_id, document_id, position, opened and detected (a kind of reply, 'other' or null). Calls have document_id, stage ('classify' or
'extract'), seq, status ('OK' or 'ERROR'), error and result (JSON). All is native expressions with one shuffle of calls by document, one of
images by document and one by case; a document's calls and a case's images are aggregated before they are shuffled, so neither may be too many.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import text
from casemill.functions.dates import parse_date
from casemill.functions.text import checksum, redact_id
from casemill.operators.screen import DOCUMENTS, FIELD, TITLES, Rules, screen, typed_schema
from casemill.sources.shared import once, shuffled

# Kinds of a reply and the documents they are; fields that a reply of each kind has; stated certainty as a number and as a rank,
# the cap of what is unreadable or can't be parsed; the form of a number printed as a mask.
KINDS = {"application_form": "form", "aadhaar": "card", "bank_passbook": "passbook", "epic": "epic"}
REPLY_FIELDS = {
    "application_form": ("applicant_name", "father_or_husband_name", "address", "district", "category", "aadhaar_number", "mobile", "bank_name", "branch", "ifsc", "account_number", "date_of_birth", "age", "annual_income", "signature_present", "application_date", "marital_status_if_stated", "disability_if_stated"),
    "aadhaar": ("name", "dob_or_yob", "gender", "aadhaar_number", "address"),
    "bank_passbook": ("account_holder_name", "account_number", "ifsc", "bank_name", "branch"),
    "epic": ("name", "relative_name", "epic_number", "dob_or_age"),
}
CONFIDENCE = {"high": 0.95, "medium": 0.8, "low": 0.4}
CERTAIN = {"high": 3, "medium": 2, "low": 1}
CAP = 0.3
PRINTED_MASK = r"^[Xx*•]{4}[\s-]?[Xx*•]{4}[\s-]?(\d{4})$"
STATUSES, LEGIBLE = ("present", "blank", "unreadable"), ("good", "poor")
NUMBER, UNREDACTED = "aadhaar_number", ("account_number", "aadhaar_number")

REPLY = "struct<legibility:string,notes:string,fields:map<string,struct<value:string,status:string,confidence:string>>>"
READING = "struct<legibility:string,notes:string,fields:map<string,struct<value:string,status:string,confidence:string>>,identity:struct<masked:string,last4:string,valid:boolean>>"

#: Where a typed field comes from: field of the reply and parser ('flag' and 'amount' become text). What isn't listed is not on the document.
SOURCES: dict[str, dict[str, tuple[str, str]]] = {
    "form": {
        "name": ("applicant_name", "text"), "relative": ("father_or_husband_name", "text"), "dob": ("date_of_birth", "date"), "marital": ("marital_status_if_stated", "marital"), "income": ("annual_income", "amount"), "address": ("address", "text"),
        "district": ("district", "text"), "disability": ("disability_if_stated", "flag"), "displaced": ("address", "displaced"), "account": ("account_number", "text"), "ifsc": ("ifsc", "text"), "signature": ("signature_present", "flag"), "application_date": ("application_date", "date"),
    },
    "card": {"name": ("name", "text"), "dob": ("dob_or_yob", "date"), "gender": ("gender", "gender")},
    "passbook": {"holder": ("account_holder_name", "text"), "account": ("account_number", "text"), "ifsc": ("ifsc", "text"), "bank": ("bank_name", "text"), "branch": ("branch", "text")},
    "epic": {"name": ("name", "text"), "number": ("epic_number", "text"), "relative": ("relative_name", "text"), "dob": ("dob_or_age", "dob_or_age")},
}
#: Typed fields that come from the masked identifier.
FROM_NUMBER = {("form", "last4"): "last4", ("card", "masked"): "masked", ("card", "last4"): "last4"}


def _amount(c: Column) -> Column:
    n = text.income(c)
    return F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))


PARSERS: dict[str, Callable[[Column], Column]] = {
    "text": lambda c: F.nullif(F.trim(c), F.lit("")),
    "date": parse_date,
    "dob_or_age": parse_date,
    "gender": text.gender,
    "marital": text.marital,
    "amount": _amount,
    "flag": lambda c: text.yes_no(c).cast("string"),
    "displaced": lambda c: text.displaced(c).cast("string"),
}


def number_of(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x if isinstance(x, Column) else F.lit(x) for kv in values.items() for x in kv]), key)


def parsed(reply: Column) -> Column:
    """The outermost JSON object of a reply, however it is wrapped; null if there is none. The parser itself ends at the object's end."""
    return F.from_json(F.substr(reply, F.instr(reply, "{")), REPLY)


def problem(kind: Column, reply: Column) -> Column:
    """What is wrong with a parsed reply, null if nothing: its kind, its object, its legibility, fields too few or too many, a field's status or certainty."""
    wanted = number_of({k: F.array(*map(F.lit, sorted(v))) for k, v in REPLY_FIELDS.items()}, kind)
    fields, values = reply["fields"], F.map_values(reply["fields"])
    missing, extra = F.array_except(wanted, F.map_keys(fields)), F.sort_array(F.array_except(F.map_keys(fields), wanted))
    bad = lambda f, known: F.size(F.array_except(values[f], F.array(*map(F.lit, known)))) > 0
    # all of it is compiled: lambdas over each field of each reply cost more than the parse
    return (
        F.when(wanted.isNull(), "unknown kind").when(reply.isNull() | fields.isNull(), "no object").when(~F.coalesce(reply["legibility"].isin(*LEGIBLE), F.lit(False)), "unknown legibility")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ","))).when((F.size(fields) > F.size(wanted)) & (F.size(extra) > 0), F.concat(F.lit("not asked for: "), F.array_join(extra, ",")))
        .when(bad("status", STATUSES), "unknown status").when(bad("confidence", tuple(CONFIDENCE)), "unknown certainty").when(F.size(F.array_except(F.array(F.lit(None).cast("string")), values["value"])) == 0, "a value is null")
    )


def identity(field: Column) -> Column:
    """masked, last4 and valid of a reply's number field: null without the field, nulls for a blank one, never more than the last four digits."""
    value = F.when(field["status"] == "present", F.nullif(F.trim(field["value"]), F.lit("")))
    printed, digits = F.regexp_extract(value, PRINTED_MASK, 1), F.regexp_replace(value, r"\D", "")
    twelve = digits.rlike(r"^\d{12}$")
    last4 = F.when(printed != "", printed).when(twelve, F.substring(digits, 9, 4))
    valid = F.when(printed != "", None).when(twelve, (checksum(digits) == 0) & digits.rlike("^[2-9]")).when(value.isNotNull(), False)
    return F.when(field.isNotNull(), F.struct(F.concat(F.lit("XXXX XXXX "), last4).alias("masked"), last4.alias("last4"), valid.alias("valid")))


def seen(f: Column) -> Column:
    """The text of a reply's field, null if it is blank or unreadable."""
    text_ = F.trim(f["value"])
    return F.when((f["status"] == "present") & (text_ != ""), text_)


def reading_of(name: Column | str, f: Column, said: Column, who: Column) -> Column:
    """A field of a reading, from that of a reply, its text and the reply's identity: see normalised()."""
    if isinstance(name, str):
        kept = F.coalesce(who["masked"], F.lit("[unreadable number]")) if name == NUMBER else said if name in UNREDACTED else redact_id(said)
    else:
        kept = F.when(name == NUMBER, F.coalesce(who["masked"], F.lit("[unreadable number]"))).when(name.isin(*UNREDACTED), said).otherwise(redact_id(said))
    blank = (f["status"] == "present") & said.isNull()
    return F.struct(F.when(said.isNotNull(), kept).alias("value"), F.when(blank, "blank").otherwise(f["status"]).alias("status"), f["confidence"].alias("confidence"))


def normalised(reply: Column) -> Column:
    """A parsed reply as a reading: identifiers masked at once, a present but blank value is blank, what is blank or unreadable has no value.

    Numbers in other texts are masked, but account numbers stay, which may have twelve digits. Notes are masked.
    """
    who = identity(reply["fields"][NUMBER])
    fields = F.transform_values(reply["fields"], lambda name, f: reading_of(name, f, seen(f), who))
    return F.when(reply.isNotNull(), F.struct(reply["legibility"].alias("legibility"), redact_id(F.trim(reply["notes"])).alias("notes"), fields.alias("fields"), who.alias("identity")))


def stated(v: Column) -> Column:
    """How sure a reading is: its certainty as a number, at most CAP if unreadable."""
    c = number_of(CONFIDENCE, v["confidence"])
    return F.when(v["status"] == "unreadable", F.least(c, F.lit(CAP))).otherwise(c)


def convert(v: Column, value: Column, sure: Column, parser: str) -> Column:
    """A typed field of a reading v, its parsed value and how sure it is: absent is (null, 0), blank keeps its confidence, what can't be parsed is unreadable and never counts as blank."""
    read = F.when(v["value"].isNotNull() & value.isNull(), F.least(sure, F.lit(CAP))).otherwise(sure)
    if parser == "displaced":  # nothing is known without an address, and that is sure
        read = F.when(v["value"].isNull(), 1.0).otherwise(sure)
    elif parser == "dob_or_age":  # an age is not a date of birth
        age = F.lower(v["value"]).contains("age")
        value, read = F.when(~age, value), F.when(age, 1.0).otherwise(read)
    return F.struct(value.alias("value"), F.coalesce(read, F.lit(0.0)).alias("confidence"))


def answered(images: DataFrame, calls: DataFrame) -> DataFrame:
    """images with outcome ('extracted', 'failed', 'unidentified' or 'other'), error and reply (parsed, not masked yet), by the latest call of each stage.

    A reply that doesn't hold to its kind's form counts as failed, with what is wrong.
    """
    last = lambda stage: F.max_by(F.struct("status", "error", "result"), F.when(F.col("stage") == stage, F.col("seq"))).alias(stage)
    by = images.join(shuffled(calls.groupBy("document_id").agg(last("classify"), last("extract"))), "document_id", "left")
    known = F.col("detected").isin(*KINDS)
    by = once(by, reply=F.when(known & (F.col("extract.status") == "OK"), parsed(F.col("extract.result"))))
    by = once(by, wrong=F.when(F.col("extract.status") == "OK", problem(F.col("detected"), F.col("reply"))).otherwise(F.coalesce("extract.error", F.lit("not read"))))
    outcome = F.when(~F.col("opened"), "unidentified").when(F.col("detected") == "other", "other").when(~F.coalesce(known, F.lit(False)), "unidentified").when(F.col("wrong").isNull(), "extracted").otherwise("failed")
    error = F.when(~F.col("opened"), "the image could not be opened").when(F.col("outcome") == "unidentified", F.coalesce("classify.error", F.lit("its kind could not be told"))).when(F.col("outcome") == "failed", F.col("wrong"))
    out = by.withColumn("outcome", outcome).withColumn("error", error)
    return out.select(*images.columns, "outcome", "error", F.when(F.col("outcome") == "extracted", F.col("reply")).alias("reply"))


def outcomes(images: DataFrame, calls: DataFrame) -> DataFrame:
    """answered() with a reading, which is masked, for the reply."""
    return answered(images, calls).select(*images.columns, "outcome", "error", normalised(F.col("reply")).alias("reading"))


def merged(read: DataFrame) -> DataFrame:
    """case_id and, for each document, state, error, identity and fields of all its images, from rows of answered(); lost and why, of images that nobody could identify.

    Of a field's readings one with a value wins, then the surer one, then the earlier image's. Of masked numbers the first with digits wins.
    Only what is merged is read and masked, a column for each field, before anything is shuffled.
    """
    raw, said, who, readings, aggregates = {}, {}, {}, {}, []
    for number, d in enumerate(KINDS.values()):
        mine, failed = F.col("__mine") == number, F.col("__failed") == number
        first = F.struct("position", "document_id")
        numbered = d in {x for x, _ in FROM_NUMBER}
        for source in sorted({s for s, _ in SOURCES[d].values()} | ({NUMBER} if numbered else set())):
            at = f"{d}__{source}"
            raw[f"{d}__f_{source}"] = F.when(mine, F.col("reply.fields")[source])
            if source == NUMBER:  # beside the fields: with its lambdas Spark compiles them in pieces, not as one method too large for the JVM to optimise
                who[f"{d}__who"] = identity(raw[f"{d}__f_{source}"])
            f = F.col(f"{d}__f_{source}")
            said[f"{d}__t_{source}"] = seen(f)
            readings[at] = F.when(f.isNotNull(), reading_of(source, f, F.col(f"{d}__t_{source}"), F.col(f"{d}__who") if numbered else F.lit(None)))
            v = F.col(at)
            rank = F.when(v["value"].isNotNull(), 10).otherwise(0) + number_of(CERTAIN, v["confidence"])
            # one value and not max_by's two: a row of partial results is as wide as all fields of all documents
            aggregates.append(F.max(F.when(v.isNotNull(), F.struct(rank, -F.col("position"), "document_id", v.alias("v")))).alias(at))
        aggregates += [
            F.max(F.when(mine, 2).when(failed, 1)).alias(f"{d}__state"),
            F.min_by("error", F.when(failed, first)).alias(f"{d}__error"),
        ]
        if numbered:
            aggregates.append(F.min_by(f"{d}__who", F.when(mine, F.struct(F.col(f"{d}__who.last4").isNull(), first))).alias(f"{d}__identity"))
    gone = F.col("outcome") == "unidentified"
    lost = [F.count_if(gone).alias("lost"), F.min_by("error", F.when(gone, F.struct("position", "document_id"))).alias("why"), F.every(F.col("outcome").isin("unidentified", "failed")).alias("all_failed")]
    columns = ("case_id", "document_id", "position", "outcome", "error")
    number = number_of({k: i for i, k in enumerate(KINDS)}, F.col("detected"))
    read = read.select(*columns, "reply", F.when(F.col("outcome") == "extracted", number).alias("__mine"), F.when(F.col("outcome") == "failed", number).alias("__failed"))
    read = read.select(*columns, "__mine", "__failed", *[c.alias(n) for n, c in (raw | who).items()]).withColumns(said).withColumns(readings)
    return read.groupBy("case_id").agg(*aggregates, *lost).withColumns({at: F.col(at)["v"] for at in readings})


def typed_cases(cases: DataFrame, images: DataFrame, calls: DataFrame, rules: Rules) -> DataFrame:
    """The typed case of every row of cases (case_id, received), as screen() reads it, with all_failed (null for a case without images).

    An image that nobody could identify may be a missing document, so that a required one that is absent then counts as failed.
    """
    of = merged(answered(images, calls))
    # parsed values are columns of their own first, so that a struct names them and doesn't repeat them
    values = {f"{d}__v_{f}": PARSERS[parser](F.col(f"{d}__{source}")["value"]) for d in DOCUMENTS for f, (source, parser) in SOURCES[d].items()}
    of = of.withColumns(values | {f"{d}__s_{source}": stated(F.col(f"{d}__{source}")) for d in DOCUMENTS for source in {x for x, _ in SOURCES[d].values()}})
    documents = []
    for d in DOCUMENTS:
        fields = []
        for f in DOCUMENTS[d]:
            if (d, f) in FROM_NUMBER:
                v = F.struct(F.col(f"{d}__identity")[FROM_NUMBER[d, f]].alias("value"), F.coalesce(stated(F.col(f"{d}__{NUMBER}")), F.lit(0.0)).alias("confidence"))
            elif f in SOURCES[d]:
                source, parser = SOURCES[d][f]
                v = convert(F.col(f"{d}__{source}"), F.col(f"{d}__v_{f}"), F.col(f"{d}__s_{source}"), parser)
            else:
                v = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"))
            fields.append(v.cast(FIELD).alias(f))
        perhaps = F.concat(F.col("lost").cast("string"), F.lit(" image(s) could not be read ("), F.col("why"), F.lit(f"); the {TITLES[d]} may be among them"))
        error = F.when(F.col(f"{d}__state") == 1, F.col(f"{d}__error")).when(F.col(f"{d}__state").isNull() & (F.lit(d in rules.required) & (F.col("lost") > 0)), perhaps)
        parts = [F.when(F.col(f"{d}__state") == 2, "ok").otherwise("failed").alias("status"), error.alias("error"), F.when(F.col(f"{d}__state") == 2, F.struct(*fields)).alias("fields")]
        if d == "card":
            parts.append(F.col("card__identity.valid").alias("checksum_valid"))
        documents.append(F.when((F.col(f"{d}__state") == 2) | error.isNotNull(), F.struct(*parts)).alias(d))
    # joined as whole documents: a join of all fields of all documents is more than one method can hold
    out = cases.select("case_id", "received").join(shuffled(of.select("case_id", *documents, "all_failed")), "case_id", "left")
    kinds = {f.name: f.dataType for f in typed_schema()}
    return out.select("case_id", "received", *[F.col(d).cast(kinds[d]).alias(d) for d in DOCUMENTS], "all_failed")


def screened(cases: DataFrame, images: DataFrame, calls: DataFrame, rules: Rules, **how: object) -> DataFrame:
    """screen() over stored replies, with processing: 'EXTRACTION_FAILED' where every image failed, else 'SCREENED'."""
    typed = typed_cases(cases, images, calls, rules)
    typed = typed.withColumn("processing", F.when(F.col("all_failed"), "EXTRACTION_FAILED").otherwise("SCREENED")).drop("all_failed")
    return screen(typed, rules, kept=("processing",), **how)


def from_packets(packets: DataFrame, received: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, images, calls) of labelled packets on disk (see sources.storage.packets): each file an image read in full, surely, as it is labelled.

    A null or absent value is blank on the document; files of no known kind are 'other'.
    """
    rows = packets.select(F.col("packet_id").alias("case_id"), F.posexplode_outer("documents").alias("position", "file", "d"))
    cases = packets.select(F.col("packet_id").alias("case_id"), F.lit(received).alias("received"))
    files = rows.where("file IS NOT NULL").select("case_id", F.concat_ws("/", "case_id", "file").alias("document_id"), F.col("d.type").alias("kind"), F.col("d.fields").alias("fields"), "position")
    images = files.select("case_id", "document_id", "position", F.lit(True).alias("opened"), F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("other").alias("detected"))
    wanted = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], F.array(*map(F.lit, kv[1]))), REPLY_FIELDS.items(), F.when(F.col("kind").isNull(), F.array().cast("array<string>")))

    def read(name: Column) -> Column:
        value = F.coalesce(F.try_element_at("fields", name), F.lit(""))
        return F.struct(value.alias("value"), F.when(value == "", "blank").otherwise("present").alias("status"), F.lit("high").alias("confidence"), F.array().cast("array<double>").alias("bbox"))

    reply = F.struct(F.lit("good").alias("legibility"), F.lit("").alias("notes"), F.map_from_arrays(wanted, F.transform(wanted, read)).alias("fields"))
    calls = files.where(F.col("kind").isin(*KINDS)).select("document_id", F.lit("extract").alias("stage"), F.lit(1).alias("seq"), F.lit("OK").alias("status"), F.lit(None).cast("string").alias("error"), F.to_json(reply).alias("result"))
    return cases, images, calls
