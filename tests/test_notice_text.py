"""Notices from templates: one for every code in three scripts, the fallback, values that look like placeholders, masked numbers, tallies of reviews."""

import copy

import pytest
from pyspark.sql import functions as F

from casemill.operators.notice_text import BLOCKS, DEFAULT, ITEM, asked_of_citizen, checked, compiled, entries, items, plain, reviews, written_field
from casemill.operators.notices import transliterate
from casemill.operators.screen import EVIDENCE
from casemill.sources.views import CODES

FLAGS = f"array<struct<code:string,severity:string,action:string,reason:string,evidence:{EVIDENCE},resolution:string>>"
A = {"document": "form", "field": "dob", "value": "1950-05-01", "confidence": 0.9}
B = {"document": "card", "field": "dob", "value": "1950-05-02", "confidence": 0.9}
#: What the English line of each code is for the evidence above; codes that no template has show their reason.
ENGLISH = {
    "MISSING_DOCUMENT": "We have no application form of yours.", "EXTRACTION_FAILED": "Your application form cannot be read; hand in a clear copy.", "MISSING_FIELD": "Fill in the date of birth on the application form.", "MISSING_SIGNATURE": "Sign the application form.",
    "NAME_MISMATCH": "Your name is 1950-05-01 on the application form and 1950-05-02 on the identity card.", "BANK_HOLDER_NAME_MISMATCH": "The account is 1950-05-02's, the application 1950-05-01's.", "BANK_DETAILS_MISMATCH": "The date of birth is 1950-05-01 on the application form, but 1950-05-02 on the identity card.",
    "IFSC_INVALID": "1950-05-01 on the application form is not a bank code.", "DOB_MISMATCH": "You were born on 1950-05-01 by the application form, on 1950-05-02 by the identity card.", "AADHAAR_FORM_CARD_MISMATCH": "The form ends in 1950-05-01, the card in 1950-05-02.",
}


def flag(code, *evidence, action="citizen", resolution="OPEN", reason="because of it"):
    return {"code": code, "severity": "critical", "action": action, "reason": reason, "evidence": list(evidence), "resolution": resolution}


def noticed(spark, flags, templates=DEFAULT, name="Asha Rai", **how):
    df = spark.createDataFrame([(name, flags)], f"name string, flags {FLAGS}").select("name", asked_of_citizen(F.col("flags"), resolved=True).alias("flags"))
    df = df.select("name", items(F.col("flags"), how.pop("written", None)).alias("items"))
    return df.select(compiled(templates)(F.col("name"), F.lit("CM-1"), F.lit("1 March"), F.lit("East"), F.col("items"), **how).alias("n")).select("n.*", *[plain(F.col("n"), s).alias(f"plain_{s}") for s in ("en", "mni_beng", "mni_mtei")]).first()


@pytest.fixture(scope="module")
def every(spark):
    return noticed(spark, [flag(c, A, B) for c in CODES])


@pytest.mark.parametrize(("place", "code"), list(enumerate(CODES)))
def test_one_line_for_every_code_in_three_scripts(every, place, code):
    assert every.en["items"][place] == ENGLISH.get(code, "because of it")
    assert every.codes[place] == (code if code in ENGLISH else "GENERIC")
    beng, mtei = every.mni_beng["items"][place], every.mni_mtei["items"][place]
    assert beng and mtei and not any("ঀ" <= c <= "৿" for c in mtei)
    if code == "MISSING_SIGNATURE":
        assert beng == "ফর্ম: সই করুন।"
    if code == "AADHAAR_FORM_CARD_MISMATCH":
        assert mtei == "1950-05-01 1950-05-02"  # someone wrote this one
    assert "{" not in every.en["items"][place] + beng + mtei


def test_blocks_and_message(every, spark):
    assert every.en.title == "About your application CM-1" and every.en.intro == "On 1 March the welfare office of East looked at your papers and asks you to mend this:"
    assert every.plain_en.split("\n")[:6] == [every.en.title, "", "Dear Asha Rai,", every.en.intro, "1. We have no application form of yours.", "2. because of it"]
    assert every.plain_en.endswith("\nQuestions: 0385-000-0000\n\nFor the welfare office of East")
    want = spark.createDataFrame([(every.mni_beng.not_rejection,)], "t string").select(transliterate(F.col("t"))).first()[0]
    assert every.mni_mtei.not_rejection == want != every.mni_beng.not_rejection
    assert (every.pending, every.mayek) == (2 + 3, "auto")  # blocks and templates that nobody has reviewed


def test_values_are_not_templates_and_numbers_are_masked(spark):
    odd = {"document": "passbook", "field": "holder", "value": "{name} {x} 2345 6789 0123", "confidence": 0.9}
    n = noticed(spark, [flag("NAME_MISMATCH", odd), flag("IFSC_INVALID", {**odd, "value": None})], name="{ref}", days=F.lit(7), helpline=F.lit("112"))
    assert n.en["items"] == ["Your name is {name} {x} XXXX XXXX 0123 on the bank passbook and — on the —.", "— on the bank passbook is not a bank code."]
    assert n.en.greeting == "Dear {ref}," and n.en.bring.startswith("Come within 7 days") and n.en.helpline == "Questions: 112"
    assert noticed(spark, [], name=None).en.greeting == "Dear —," and noticed(spark, []).en["items"] == []


def test_who_is_asked_and_what_is_shown(spark):
    full = {"document": "card", "field": "masked", "value": "XXXX XXXX 1234", "confidence": 0.9}
    flags = [flag("EXTRACTION_FAILED", {**A, "field": "document"}, action="officer"), flag("EXTRACTION_FAILED", {**A, "field": "document"}, action="officer", resolution="ACCEPTED"), flag("MISSING_FIELD", A, resolution="OVERRIDDEN"), flag("INCOME_ABOVE_CEILING", A, action="officer", resolution="ACCEPTED")]
    flags += [flag("DOB_MISMATCH", A, {**A, "document": "epic"}, B), flag("AADHAAR_FORM_CARD_MISMATCH", full, {**full, "field": "last4"}), flag("MISSING_FIELD")]
    df = spark.createDataFrame([(flags,)], f"flags {FLAGS}").select(asked_of_citizen(F.col("flags"), resolved=True).alias("f"))
    got = [tuple(i)[:6] for i in df.select(items(F.col("f"))).first()[0]]
    assert got == [("EXTRACTION_FAILED", "form", None, None, "1950-05-01", None), ("DOB_MISMATCH", "form", "card", "dob", "1950-05-01", "1950-05-02"), ("AADHAAR_FORM_CARD_MISMATCH", "card", "card", "masked", "1234", "1234"), ("MISSING_FIELD", None, None, None, None, None)]
    written = F.create_map(F.lit("form.dob"), F.lit("1.5.50"), F.lit("card.masked"), F.lit("234567891234"))
    assert [(i.value_a, i.value_b) for i in df.select(items(F.col("f"), written)).first()[0]][1:3] == [("1.5.50", "1950-05-02"), ("1234", "1234")]
    assert (written_field("form", "dob"), written_field("card", "masked"), written_field("epic", "dob"), written_field("x", "y")) == ("date_of_birth", None, "dob_or_age", None)


def test_sets_are_checked_and_reviews_tallied(spark):
    less = copy.deepcopy(DEFAULT)
    less["blocks"] = less["blocks"][1:]
    less["templates"] = less["templates"][:-1]
    with pytest.raises(ValueError, match="title, GENERIC"):
        checked(less)
    odd = copy.deepcopy(DEFAULT)
    del odd["templates"][0]["mni_mtei"]
    with pytest.raises(ValueError, match="MISSING_DOCUMENT"):
        compiled(odd)
    assert {(r.kind, r.reviewed, r.entries, r.mayek) for r in reviews(entries(spark)).collect()} == {("block", 6, 8, 1), ("template", 8, 11, 1)}
    whole = copy.deepcopy(DEFAULT)
    for e in whole["blocks"] + whole["templates"]:
        e["mni_mtei"], e["reviewed"] = "ꯀ {name}", True
    n = noticed(spark, [flag("MISSING_FIELD", A)], whole)
    assert (n.pending, n.mayek, n.mni_mtei.title) == (0, "manual", "ꯀ Asha Rai") and len(BLOCKS) == 8
    assert ITEM.startswith("array<struct<code")
