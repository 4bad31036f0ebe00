"""From replies and packets on disk to findings: golden packets, merges, masks, outcomes, damaged replies."""

import json

import pytest
from pyspark.sql import functions as F

from casemill.functions.text import contains_id, verhoeff
from casemill.operators.casefile import CAP, REPLY_FIELDS, from_packets, outcomes, screened, typed_cases
from casemill.operators.screen import Rules
from casemill.sources.storage import packets

RULES = Rules(today="2024-03-01")
CASES, IMAGES = "case_id string, received string", "case_id string, document_id string, position int, opened boolean, detected string"
CALLS = "document_id string, stage string, seq int, status string, error string, result string"
FORM = {"applicant_name": "Okram Tomba Singh", "father_or_husband_name": "Okram Ibohal", "address": "Wangkhei", "district": "East", "aadhaar_number": "XXXX XXXX 1234", "bank_name": "Bank", "ifsc": "abcd0 123456", "account_number": "123456789012", "date_of_birth": "01.05.1950", "annual_income": "Rs. 24,000/-", "signature_present": "yes", "application_date": "1/2/2024", "marital_status_if_stated": "Widow", "disability_if_stated": "No"}
CARD = {"name": "Okram Tomba Singh", "dob_or_yob": "01/05/1950", "gender": "MALE", "aadhaar_number": "XXXX XXXX 1234"}
BOOK = {"account_holder_name": "OKRAM TOMBA SINGH", "account_number": "123456789012", "ifsc": "ABCD0123456", "bank_name": "Bank", "branch": "East"}
EPIC = {"name": "Okram Tomba Singh", "relative_name": "Okram Ibohal", "epic_number": "ABC1234567", "dob_or_age": "Age as on 1.1.2024: 73"}
FULL = {"form.jpg": ("application_form", FORM), "card.jpg": ("aadhaar", CARD), "book.jpg": ("bank_passbook", BOOK), "voter.jpg": ("epic", EPIC)}


def numbered(last4):
    return {"form.jpg": {"aadhaar_number": f"XXXX XXXX {last4}"}, "card.jpg": {"aadhaar_number": f"XXXX XXXX {last4}"}}


#: Packet: (files left out, fields changed by file, findings but notes, status).
GOLDEN = {
    "clean": ((), {}, [], "READY"),
    "no_epic": (("voter.jpg",), {}, ["OPTIONAL_DOCUMENT_NOT_PROVIDED"], "READY"),
    "no_card": (("card.jpg",), {}, ["MISSING_DOCUMENT"], "NEEDS_CITIZEN_CORRECTION"),
    "blank_account": ((), {"form.jpg": {"account_number": None}}, ["MISSING_FIELD"], "NEEDS_CITIZEN_CORRECTION"),
    "unsigned": ((), {"form.jpg": {"signature_present": "No"}}, ["MISSING_SIGNATURE"], "NEEDS_CITIZEN_CORRECTION"),
    "worded_date": ((), {"form.jpg": {"date_of_birth": "twelfth of May"}}, ["LOW_CONFIDENCE"], "OFFICER_ATTENTION"),
    "births": ((), {"card.jpg": {"dob_or_yob": "02/05/1950"}}, ["DOB_MISMATCH"], "NEEDS_CITIZEN_CORRECTION"),
    "young": ((), {"form.jpg": {"date_of_birth": "1.5.1970"}, "card.jpg": {"dob_or_yob": "1.5.1970"}}, ["AGE_BELOW_MINIMUM"], "OFFICER_ATTENTION"),
    "rich": ((), {"form.jpg": {"annual_income": "1,20,000 a year"}}, ["INCOME_ABOVE_CEILING"], "OFFICER_ATTENTION"),
    "digits": ((), {"form.jpg": {"aadhaar_number": "XXXX XXXX 9999"}}, ["AADHAAR_FORM_CARD_MISMATCH"], "OFFICER_ATTENTION"),
    "bank": ((), {"book.jpg": {"account_number": "99", "account_holder_name": "Abdul Hussain"}}, ["BANK_DETAILS_MISMATCH", "BANK_HOLDER_NAME_MISMATCH"], "NEEDS_CITIZEN_CORRECTION"),
    "camp": ((), {"form.jpg": {"address": "Relief Camp 4"}}, [], "READY"),
}


@pytest.fixture(scope="module")
def from_disk(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("packets")
    for i, (name, (gone, change, *_)) in enumerate(GOLDEN.items()):
        own = numbered(5000 + i)
        files = {f: {"type": k, "fields": fields | own.get(f, {}) | change.get(f, {})} for f, (k, fields) in FULL.items() if f not in gone}
        (top / name).mkdir()
        (top / name / "truth.json").write_text(json.dumps({"packet_id": name, "expected_status": GOLDEN[name][3], "documents": files, "name_checks": [], "expected_flags": []}))
    (top / "broken").mkdir()
    (top / "broken" / "truth.json").write_text("{")
    given = packets(spark, str(top)).where("packet_id IS NOT NULL")
    return {r.case_id: r for r in screened(*from_packets(given, "2024-02-20"), RULES).collect()}


@pytest.mark.parametrize("name", GOLDEN)
def test_packets_on_disk(from_disk, name):
    row = from_disk[name]
    assert ([f.code for f in row.flags], row.status, row.processing) == (GOLDEN[name][2], GOLDEN[name][3], "SCREENED"), [(f.code, f.reason) for f in row.flags]
    assert "widowed" in row.priority_reasons and ("displaced" in row.priority_reasons) == (name == "camp")
    assert len(from_disk) == len(GOLDEN)


def reply(kind, values, status=None, certainty=None, text="good"):
    status, certainty = status or {}, certainty or {}
    fields = {f: {"value": values.get(f) or "", "status": status.get(f, "present" if values.get(f) else "blank"), "confidence": certainty.get(f, "high"), "bbox": []} for f in REPLY_FIELDS[kind]}
    return "```json\n" + json.dumps({"legibility": text, "notes": "saw 2345 6789 0123", "fields": fields}) + "\n```"


def read(spark, *rows):
    """Images and calls of one case: (kind or None, opened, calls as (stage, status, error, result))."""
    images = [("c", f"d{i}", i, opened, kind) for i, (kind, opened, _) in enumerate(rows)]
    calls = [(f"d{i}", stage, n, status, error, result) for i, (*_, made) in enumerate(rows) for n, (stage, status, error, result) in enumerate(made)]
    return spark.createDataFrame([("c", "2024-02-20")], CASES), spark.createDataFrame(images, IMAGES), spark.createDataFrame(calls, CALLS)


def ok(kind, values, *args, **more):
    return (kind, True, [("classify", "OK", None, None), ("extract", "OK", None, reply(kind, values, *args, **more))])


def test_two_pages_are_merged_and_the_surer_value_wins(spark):
    one = ok("application_form", FORM | {"annual_income": None, "date_of_birth": "nobody knows"}, certainty={"applicant_name": "low", "address": "medium"})
    two = ok("application_form", {"applicant_name": "Okram T", "annual_income": "nil", "address": "elsewhere", "date_of_birth": "1.5.1950"}, certainty={"address": "medium", "date_of_birth": "low", "annual_income": "low"})
    f = typed_cases(*read(spark, one, two), RULES).first().form.fields
    assert (f.name.value, f.income.value, f.income.confidence, f.address.value, f.account.value) == ("Okram T", "0", 0.4, "Wangkhei", "123456789012")
    assert (f.dob.value, f.dob.confidence) == (None, CAP)  # the surer reading won, and can't be parsed
    assert (f.gender.value, f.gender.confidence, f.marital.value, f.disability.value, f.displaced.value) == (None, 0.0, "widowed", "false", "false")


def test_identifiers_never_leave_whole(spark):
    good = next(f"23456789012{c}" for c in "0123456789" if verhoeff(f"23456789012{c}") == 0)
    for number, want in ((good, (good[-4:], True)), (good[:-1] + str((int(good[-1]) + 1) % 10), (None, False)), ("1" + good[1:], (good[-4:], False)), ("12 34", (None, False)), ("xxxx-xxxx 4321", ("4321", None)), (None, (None, None))):
        given = read(spark, ok("aadhaar", CARD | {"aadhaar_number": number, "address": f"ward 2 {good}"}), ok("bank_passbook", BOOK | {"account_number": good}))
        row = typed_cases(*given, RULES).first()
        assert (row.card.fields.last4.value if want[0] else None, row.card.checksum_valid) == want
        assert row.card.fields.masked.value == (f"XXXX XXXX {row.card.fields.last4.value}" if row.card.fields.last4.value else None)
        assert row.passbook.fields.account.value == good  # an account may have twelve digits
        readings = outcomes(*given[1:]).where("detected = 'aadhaar'").select(F.to_json("reading").alias("r"))
        assert not readings.where(contains_id(F.col("r"))).count()


def test_an_unreadable_value_is_not_blank_and_an_age_is_no_date(spark):
    row = typed_cases(*read(spark, ok("epic", EPIC, status={"name": "unreadable"})), RULES).first()
    assert (row.epic.fields.name.value, row.epic.fields.name.confidence) == (None, CAP)
    assert (row.epic.fields.dob.value, row.epic.fields.dob.confidence) == (None, 1.0)


def test_outcomes_by_the_latest_call(spark):
    late = ("aadhaar", True, [("extract", "OK", None, reply("aadhaar", CARD)), ("extract", "ERROR", "timed out", None)])
    again = ("epic", True, [("extract", "ERROR", "timed out", None), ("extract", "OK", None, reply("epic", EPIC))])
    odd = ("bank_passbook", True, [("extract", "OK", None, reply("epic", EPIC))])
    unread = [("other", True, []), (None, True, [("classify", "ERROR", "no answer", None)]), ("epic", False, []), ("application_form", True, []), ("selfie", True, [])]
    got = {r.position: (r.outcome, r.error) for r in outcomes(*read(spark, late, again, odd, *unread)[1:]).collect()}
    assert got[0] == ("failed", "timed out") and got[1] == ("extracted", None) and got[2][0] == "failed" and got[2][1].startswith("missing: account_holder_name")
    assert [got[i] for i in range(3, 8)] == [("other", None), ("unidentified", "no answer"), ("unidentified", "the image could not be opened"), ("failed", "not read"), ("unidentified", "its kind could not be told")]


def test_an_image_nobody_can_identify_may_be_the_missing_document(spark):
    lost = (None, True, [("classify", "ERROR", "no answer", None)])
    row = screened(*read(spark, ok("application_form", FORM), lost), RULES).first()
    assert [(f.code, f.action) for f in row.flags] == [("OPTIONAL_DOCUMENT_NOT_PROVIDED", "none"), ("EXTRACTION_FAILED", "officer"), ("EXTRACTION_FAILED", "officer")]
    assert "identity card may be among them" in row.flags[1].reason and row.processing == "SCREENED"
    assert screened(*read(spark, lost, lost), RULES).first().processing == "EXTRACTION_FAILED"


def test_no_images_no_calls_no_cases(spark):
    cases = spark.createDataFrame([("a", "2024-01-01")], CASES)
    none = spark.createDataFrame([], IMAGES), spark.createDataFrame([], CALLS)
    row = screened(cases, *none, RULES).first()
    assert [f.code for f in row.flags] == ["MISSING_DOCUMENT"] * 3 + ["OPTIONAL_DOCUMENT_NOT_PROVIDED"] and row.processing == "SCREENED"
    assert screened(cases.limit(0), *none, RULES).count() == 0


def test_a_case_with_very_many_images_and_a_document_with_very_many_calls(spark):
    images = spark.range(20_000).select(F.lit("c").alias("case_id"), F.col("id").cast("string").alias("document_id"), F.col("id").cast("int").alias("position"), F.lit(True).alias("opened"), F.lit("epic").alias("detected"))
    calls = spark.range(40_000).select(F.when(F.col("id") < 20_000, F.lit("7")).otherwise((F.col("id") - 20_000).cast("string")).alias("document_id"), F.lit("extract").alias("stage"), F.col("id").cast("int").alias("seq"), F.lit("OK").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(reply("epic", EPIC)).alias("result"))
    row = typed_cases(spark.createDataFrame([("c", "2024-01-01")], CASES), images, calls, RULES).first()
    assert row.epic.fields.number.value == "ABC1234567"
