"""Column functions for identifiers, names and free text. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered respellings of the phonetic key.
RESPELLINGS = (("ph", "f"), ("sh", "s"), ("kh", "k"), ("th", "t"), ("bh", "b"), ("dh", "d"), ("gh", "g"), ("wor$", "war"), ("[wv]", "b"), ("ee", "i"), ("oo", "u"))
FULL_ID = r"(?<!\d)([2-9]\d{3})[ -]?(\d{4})[ -]?(\d{4})(?!\d)"
# How a relative's name begins after a person's own, the words of answers, and what is dropped before an amount.
RELATION = r"(?:^|[\s,;:])(?:(?:wd|[sdwch])\s*[/\\|]\s*[o0]|[sdwc]\.[o0]\.|son\s+of|daughter\s+of|wife\s+of|widow\s+of|husband\s+of|care\s+of)(?![a-z]).*$"
GENDERS = (("female", r"^(f|female|mahila|woman)\b|/ female"), ("male", r"^(m|male|purush|man)\b|/ male"), ("other", r"^(t|transgender|other)\b"))
NO_INCOME = r"^(nil|none|no income|0+)\b"
BESIDE_AMOUNTS = r"(rs\.?|inr|₹|/-|,|\s)"
NO = r"^(no|nil|none|n/a|na|not applicable|-)\b"
YES = r"^(yes|y|true)\b|\d+\s*%|(locomotor|blind|deaf|disab|pwd)"
MARITAL = (("widowed", "widow"), ("unmarried", "unmarried|single|spinster|bachelor"), ("divorced", "divorc"), ("separated", "separat"), ("married", "married"))
RELIEF_CAMP = r"relief\s*camp"
FILE_NAMES = (("form", "form|application"), ("card", "aadhaar|aadhar|uid"), ("passbook", "passbook|bank|cheque"), ("epic", "epic|voter"))
UUID_OR_HASH = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\b[0-9a-f]{64}\b"


def letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def phonetic_key(c: Column) -> Column:
    """A spelling-insensitive key of one name part: respellings in order, then doubled letters collapse."""
    out = letters(c)
    for pattern, to in RESPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, r"(.)\1+", "$1")


def contains_id(c: Column) -> Column:
    """Whether a text holds a full twelve-digit identifier (first digit 2 to 9), not inside a longer run; UUIDs and hashes don't count."""
    return F.regexp_replace(c, UUID_OR_HASH, " ").rlike(FULL_ID)


def redact_id(c: Column) -> Column:
    return F.regexp_replace(c, FULL_ID, "XXXX XXXX $3")


def mask_id(c: Column) -> Column:
    """XXXX XXXX and the last four of a twelve-digit identifier, else null."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(digits.rlike(r"^\d{12}$"), F.concat(F.lit("XXXX XXXX "), F.substring(digits, 9, 4)))


def _tables() -> tuple[list[int], list[int]]:
    """Multiplication of the dihedral group of order ten, and the powers of the position permutation, flat."""

    def times(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
        return 5 + (a - b) % 5 if b < 5 else (a - b) % 5

    step, row, rows = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], list(range(10)), []
    for _ in range(8):
        rows += row
        row = [step[x] for x in row]
    return [times(a, b) for a in range(10) for b in range(10)], rows


DIHEDRAL, PERMUTED = _tables()


def checksum(c: Column) -> Column:
    """The Verhoeff checksum of a string of digits; 0 is valid. Null for a text that isn't digits."""
    d, p = F.array(*map(F.lit, DIHEDRAL)), F.array(*map(F.lit, PERMUTED))
    digits = F.transform(F.split(F.reverse(c), ""), lambda x: x.cast("int"))
    placed = F.transform(digits, lambda x, i: F.element_at(p, i % 8 * 10 + x + 1))
    return F.when(c.rlike(r"^\d+$"), F.aggregate(placed, F.lit(0), lambda a, x: F.element_at(d, a * 10 + x + 1)))


def verhoeff(digits: str) -> int:
    """The checksum of a string of digits, for numbers known while a query is built."""
    a = 0
    for i, x in enumerate(reversed(digits)):
        a = DIHEDRAL[a * 10 + PERMUTED[i % 8 * 10 + int(x)]]
    return a


def check_digit(c: Column) -> Column:
    """The digit that makes a string of digits valid when it is put at its end; null for a text that isn't digits."""
    inverse = F.array(*[F.lit(next(x for x in range(10) if DIHEDRAL[a * 10 + x] == 0)) for a in range(10)])
    return F.element_at(inverse, checksum(F.concat(c, F.lit("0"))) + 1)


def compact_upper(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s", ""))


def is_ifsc(c: Column) -> Column:
    return compact_upper(c).rlike("^[A-Z]{4}0[A-Z0-9]{6}$")


def is_epic(c: Column) -> Column:
    return compact_upper(c).rlike("^[A-Z]{3}[0-9]{7}$")


def loose(c: Column) -> Column:
    """Lower case without punctuation, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[.,:;'\"`]", ""), r"\s+", " "))


def repair_ocr(c: Column) -> Column:
    """Digits that stand for letters beside letters: 0 for o, 1 for l."""
    out = F.regexp_replace(c, "(?i)(?<=[a-z])0|0(?=[a-z])", "o")
    return F.regexp_replace(out, "(?i)(?<=[a-z])1|1(?=[a-z])", "l")


def strip_relation(c: Column) -> Column:
    """A name without what follows S/o, D/o, W/o, C/o, son of and the like."""
    return F.trim(F.regexp_replace(c, f"(?is){RELATION}", " "))


def humanise(c: Column) -> Column:
    """A code as words: MISSING_FIELD is Missing field."""
    words = F.lower(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1000))


def first_named(c: Column, named: tuple[tuple[str, str], ...]) -> Column:
    """The first name whose pattern is found in a text (lower case, trimmed), else null."""
    low = F.lower(F.trim(c))
    return F.coalesce(*[F.when(low.rlike(pattern), name) for name, pattern in named])


def gender(c: Column) -> Column:
    """female, male or other, by an answer's first word, or by what stands after a stroke and a blank; female is tried first."""
    return first_named(c, GENDERS)


def income(c: Column) -> Column:
    """The number that a text begins with, after currency and commas; nil and the like are 0, and so is all that begins with a lone zero, "0.50" too."""
    low = F.lower(F.trim(c))
    n = F.regexp_extract(F.regexp_replace(low, BESIDE_AMOUNTS, ""), r"^\d+(\.\d+)?", 0)
    return F.when(low.rlike(NO_INCOME), 0.0).when(n != "", n.try_cast("double"))


def yes_no(c: Column) -> Column:
    """No by its first word (a dash counts only before a letter or digit); yes by its first word, a percentage or a named disability."""
    low = F.lower(F.trim(c))
    return F.when(low.rlike(NO), False).when(low.rlike(YES), True)


def marital(c: Column) -> Column:
    return first_named(c, MARITAL)


def displaced(c: Column) -> Column:
    """Whether an address is a relief camp; null for null."""
    return F.lower(c).rlike(RELIEF_CAMP)


def document_type(c: Column) -> Column:
    """The document that a file's name speaks of; null for a name that says nothing."""
    return first_named(c, FILE_NAMES)


def json_with(c: Column, **fields: Column) -> Column:
    """A JSON object with fields set to other values, which keep their types; its other fields stay as they are."""
    kept = F.map_filter(F.from_json(c, "map<string,variant>"), lambda k, _: ~k.isin(*fields))
    new = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.parse_json(F.coalesce(v.cast("string"), F.lit("null"))))])
    return F.to_json(F.map_concat(new, kept))


def worst(verdicts: Column) -> Column:
    """The gravest of an array of verdicts."""
    order = F.array(*map(F.lit, ("DIFFERENT", "AMBIGUOUS", "LIKELY_SAME", "SAME")))
    return F.element_at(order, F.array_min(F.transform(verdicts, lambda v: F.array_position(order, v))).cast("int"))
