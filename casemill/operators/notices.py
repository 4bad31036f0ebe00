"""Notices: public status, items, rendered text, transliteration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.plans.registry import query
from casemill.sources.views import CASES, FLAGS, cases, flags, literal_and, pick, with_district

TEMPLATE = "Dear {name}, about {reference}: {items}. Please reply by {due}."
# What a notice says for a finding.
ITEMS = {"MISSING_DOCUMENT": "a document is missing", "MISSING_FIELD": "a field is blank", "IFSC_INVALID": "the bank code is wrong", "MISSING_SIGNATURE": "the form is not signed"}
# Bengali letters, signs and digits with their Meetei Mayek letters; those of several letters; and the closing forms of nine consonants.
LETTERS = {
    "ক": "ꯀ", "খ": "ꯈ", "গ": "ꯒ", "ঘ": "ꯘ", "ঙ": "ꯉ", "চ": "ꯆ", "ছ": "ꯆ", "জ": "ꯖ", "ঝ": "ꯓ", "ঞ": "ꯅ", "ট": "ꯇ", "ঠ": "ꯊ", "ড": "ꯗ", "ঢ": "ꯙ", "ণ": "ꯅ", "ত": "ꯇ", "থ": "ꯊ", "দ": "ꯗ", "ধ": "ꯙ",
    "ন": "ꯅ", "প": "ꯄ", "ফ": "ꯐ", "ব": "ꯕ", "ভ": "ꯚ", "ম": "ꯃ", "য": "ꯌ", "র": "ꯔ", "ৰ": "ꯔ", "ল": "ꯂ", "ৱ": "ꯋ", "শ": "ꯁ", "ষ": "ꯁ", "স": "ꯁ", "হ": "ꯍ", "\u09df": "ꯌ", "\u09dc": "ꯔ", "\u09dd": "ꯔ",
}
SIGNS = {
    "অ": "ꯑ", "ই": "ꯏ", "ঈ": "ꯏ", "উ": "ꯎ", "ঊ": "ꯎ", "া": "ꯥ", "ি": "ꯤ", "ী": "ꯤ", "ু": "ꯨ", "ূ": "ꯨ", "ে": "ꯦ", "ৈ": "ꯩ", "ো": "ꯣ", "ৌ": "ꯧ", "ং": "ꯡ", "ঁ": "ꯪ", "ৎ": "ꯠ", "।": "꯫", "॥": "꯫",
    "০": "꯰", "১": "꯱", "২": "꯲", "৩": "꯳", "৪": "꯴", "৫": "꯵", "৬": "꯶", "৭": "꯷", "৮": "꯸", "৯": "꯹",
}
LONG = {"আ": "ꯑꯥ", "ঋ": "ꯔꯤ", "এ": "ꯑꯦ", "ঐ": "ꯑꯩ", "ও": "ꯑꯣ", "ঔ": "ꯑꯧ", "ৃ": "꯭ꯔꯤ", "ঃ": ""}
CLOSING = {"ক": "ꯛ", "ল": "ꯜ", "ম": "ꯝ", "প": "ꯞ", "ন": "ꯟ", "ণ": "ꯟ", "ত": "ꯠ", "ট": "ꯠ", "ঙ": "ꯡ"}
#: Signs that two code points may stand for: a letter with a dot below, and the two-part vowels.
PAIRS = {"য\u09bc": "\u09df", "ড\u09bc": "\u09dc", "ঢ\u09bc": "\u09dd", "\u09c7\u09be": "\u09cb", "\u09c7\u09d7": "\u09cc"}
JOIN, STOP, CLOSE = "꯭", "\u09cd", "\ue000"  # joins two consonants; takes a consonant's vowel; marks a closing consonant on the way
IN_WORD = "\u0980-\u09e3\u09f0-\u09ff"


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with its {placeholders} filled; one without a value, or with a null, shows a dash."""
    out = reduce(lambda text, kv: F.replace(text, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1], F.lit("—"))), values.items(), F.lit(template))
    return F.regexp_replace(out, r"\{\w+\}", "—")


def transliterate(c: Column) -> Column:
    """Bengali script to Meetei Mayek; text in other scripts stays.

    A cluster at the start of a word is joined; inside a word its first consonant takes its closing form, or is joined to r, l, y or w, or
    stays plain; a bare consonant at the end of a word takes its closing form. Staged replacements, each looking at what is still Bengali.
    """
    any_, closing = "".join(LETTERS), "".join(CLOSING)
    out = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), PAIRS.items(), c)
    for pattern, to in (
        (f"(?<![{IN_WORD}])([{any_}]){STOP}(?=[{any_}])", f"$1{JOIN}"),
        (f"([{closing}]){STOP}(?=[{any_}])", f"$1{CLOSE}"),
        (f"([{any_}]){STOP}(?=[রৰলযৱ])", f"$1{JOIN}"),
        (f"([{any_}]){STOP}(?=[{any_}])", "$1"),
        (f"([{closing}]){STOP}", f"$1{CLOSE}"),
        (f"([{closing}])(?![{IN_WORD}{CLOSE}{JOIN}])", f"$1{CLOSE}"),
    ):
        out = F.regexp_replace(out, pattern, to)
    whole = {k + CLOSE: v for k, v in CLOSING.items()} | LONG | {STOP: "", "\u09bc": "", CLOSE: ""}
    out = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), whole.items(), out)
    letters = LETTERS | SIGNS
    return F.translate(out, "".join(letters), "".join(letters.values()))


@query("notice_public_status", f"WITH {CASES} SELECT case_id, CASE WHEN screened_ms IS NULL THEN 'Received' WHEN status = 'APPROVED' THEN 'Approved' WHEN status = 'NEEDS_CITIZEN_CORRECTION' THEN 'Correction needed' ELSE 'Under review' END AS shown FROM cases")
def notice_public_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("screened_ms").isNull(), "Received").when(F.col("status") == "APPROVED", "Approved").when(F.col("status") == "NEEDS_CITIZEN_CORRECTION", "Correction needed").otherwise("Under review")
    return cases(spark, sf_dir).select("case_id", shown.alias("shown"))


_WORDING = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ITEMS.items())


@query("notice_render", f"""WITH {CASES}, {FLAGS}, i AS (SELECT case_id, array_to_string(list_sort(list(DISTINCT CASE code {_WORDING} ELSE 'please see the office' END)), '; ') AS items FROM flags WHERE action = 'citizen' AND resolution <> 'OVERRIDDEN' GROUP BY case_id)
SELECT c.case_id, concat('Dear ', coalesce(c.district, '—'), ', about ', c.reference, ': ', i.items, '. Please reply by —.') AS notice FROM cases c JOIN i ON c.case_id = i.case_id WHERE c.status = 'NEEDS_CITIZEN_CORRECTION'""")
def notice_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    wording = F.create_map(*[F.lit(x) for kv in ITEMS.items() for x in kv])
    item = F.coalesce(F.try_element_at(wording, F.col("code")), F.lit("please see the office"))
    items = flags(spark, sf_dir).where("action = 'citizen' AND resolution <> 'OVERRIDDEN'").groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set(item)), "; ").alias("items"))
    c = with_district(cases(spark, sf_dir).where("status = 'NEEDS_CITIZEN_CORRECTION'"), sf_dir).join(items, "case_id")
    return c.select("case_id", fill(TEMPLATE, {"name": F.col("district"), "reference": F.col("reference"), "items": F.col("items")}).alias("notice"))


@query("notice_list", f"""WITH {CASES}, {FLAGS}, f AS (SELECT case_id, bool_or(action = 'citizen' AND resolution <> 'OVERRIDDEN') AS citizen FROM flags GROUP BY case_id)
SELECT c.case_id, c.reference, c.sent_ms IS NOT NULL AS sent FROM cases c LEFT JOIN f ON c.case_id = f.case_id WHERE NOT c.historical AND (coalesce(f.citizen, FALSE) OR c.status = 'NEEDS_CITIZEN_CORRECTION')""")
def notice_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live cases with something to tell the citizen, unsent ones first."""
    f = flags(spark, sf_dir).groupBy("case_id").agg(F.some((F.col("action") == "citizen") & (F.col("resolution") != "OVERRIDDEN")).alias("citizen"))
    c = cases(spark, sf_dir).where("NOT historical").join(f, "case_id", "left").where(F.coalesce("citizen", F.lit(False)) | (F.col("status") == "NEEDS_CITIZEN_CORRECTION"))
    return c.select("case_id", "reference", F.col("sent_ms").isNotNull().alias("sent")).orderBy("sent", "reference")


#: Lines with what they become, written out by the rules.
LINES = (
    ("কলম", "ꯀꯂꯝ"), ("প্রেম", "ꯄ꯭ꯔꯦꯝ"), ("বন্ধু", "ꯕꯟꯙꯨ"), ("শিক্ষক", "ꯁꯤꯛꯁꯛ"), ("বিশ্ব", "ꯕꯤꯁꯕ"), ("সূর্য", "ꯁꯨꯔ꯭ꯌ"), ("ধন্যবাদ", "ꯙꯟꯌꯕꯥꯗ"), ("দুঃখ", "ꯗꯨꯈ"), ("চাঁদ", "ꯆꯥꯪꯗ"), ("ঋণ", "ꯔꯤꯟ"), ("কৃষি", "ꯀ꯭ꯔꯤꯁꯤ"),
    ("১০ টাকা।", "꯱꯰ ꯇꯥꯀꯥ꯫"), ("জ\u09af\u09bc", "ꯖꯌ"), ("ব\u09dc", "ꯕꯔ"), ("ক\u09c7\u09be", "ꯀꯣ"), ("স্ত্রী", "ꯁ꯭ꯠꯔꯤ"), ("মণ ও মন", "ꯃꯟ ꯑꯣ ꯃꯟ"), ("বাক্", "ꯕꯥꯛ"), ("plain {text} 12, মন.", "plain {text} 12, ꯃꯟ."), ("ꯃꯅꯤꯄꯨꯔ", "ꯃꯅꯤꯄꯨꯔ"), ("", ""),
)
LINE_ROWS, _ = literal_and([(i, x) for i, (x, _) in enumerate(LINES)] + [(len(LINES), None)], "id long, line string", "part", id="p_partkey + 1000", line=pick(tuple(x for x, _ in LINES), f"p_partkey % {len(LINES)}", False))
_WANTED = ", ".join(f"({i}, '{y}', {str(any(chr(0x980) <= c <= chr(0x9ff) for c in x)).upper()})" for i, (x, y) in enumerate(LINES))


@query("notice_translit", f"WITH w(id, mayek, bengali) AS (VALUES {_WANTED}, ({len(LINES)}, NULL, NULL)) SELECT * FROM w UNION ALL SELECT p_partkey + 1000, mayek, bengali FROM part JOIN w ON w.id = p_partkey % {len(LINES)}")
def notice_translit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in Meetei Mayek, and whether they held Bengali script: those above, and one for every part."""
    return LINE_ROWS(spark, sf_dir).select("id", transliterate(F.col("line")).alias("mayek"), F.col("line").rlike("[ঀ-৿]").alias("bengali"))
