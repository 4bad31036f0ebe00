"""Personal data (operator 10): regular expressions propose spans, checksums and ranges confirm them, words nearby adjust the score.

Base kinds are email, ip, card and phone, each leftmost and non-overlapping within its kind; a proposal that fails its check is dropped and
not tried again. The method adds IBANs (country's length, mod-97), national identifiers with check digits, IPv6 and hardware addresses, and
secrets in known forms, whose randomness is checked; social security numbers and plain passwords count only beside a context word. Base spans
always stay: context moves their score, never their presence. Patterns are anchored so that each text takes linear time.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import parts_of, with_columns

#: Base kinds in the order of the digest; then the kinds that the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "aadhaar", "cpf", "dni", "ipv6", "mac", "secret")
# The proposals of the contract, with runs made possessive or anchored where that can't change a match.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Characters of an IBAN, by country.
IBAN_LENGTHS = {
    n: int(length)
    for length, names in (
        ("15", "NO"), ("16", "BE"), ("18", "DK FI FK FO GL NL SD"), ("19", "MK SI"), ("20", "AT BA EE KZ LT LU MN XK"), ("21", "CH HR LI LV"),
        ("22", "BG BH CR DE GB GE IE ME RS VA"), ("23", "AE GI IL IQ OM SO TL"), ("24", "AD CZ ES MD PK RO SA SE SK TN VG"), ("25", "LY PT ST"),
        ("26", "IS TR"), ("27", "BI DJ FR GR IT MC MR SM"), ("28", "AL AZ BY CY DO GT HN HU LB NI PL SV"), ("29", "BR EG PS QA UA"),
        ("30", "JO KW MU YE"), ("31", "MT SC"), ("32", "LC"), ("33", "RU"),
    )
    for n in names.split()
}
AADHAAR = re.compile(r"(?<![0-9A-Za-z-])[2-9][0-9]{3}([\x20-]?)[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z-])")
CPF = re.compile(r"(?<![0-9.])[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}(?![0-9])")
DNI = re.compile(r"(?<![0-9A-Za-z])[0-9]{8}-?[A-HJ-NP-TV-Z](?![0-9A-Za-z])")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
MAC = re.compile(r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![0-9A-Za-z:-])")
# How keys and tokens of widely used services begin, with the characters that follow.
SECRET_FORMS = (
    "AKIA[0-9A-Z]{16}", "ASIA[0-9A-Z]{16}", "gh[pousr]_[0-9A-Za-z]{36}", "github_pat_[0-9A-Za-z_]{22,90}", "glpat-[0-9A-Za-z_-]{20}", "xox[abprs]-[0-9A-Za-z-]{10,80}", "sk-[0-9A-Za-z_-]{20,80}",
    "AIza[0-9A-Za-z_-]{35}", "[rs]k_live_[0-9A-Za-z]{16,64}", "npm_[0-9A-Za-z]{36}", "hf_[0-9A-Za-z]{30,40}", "eyJ[0-9A-Za-z_-]{8,}\\.eyJ[0-9A-Za-z_-]{8,}\\.[0-9A-Za-z_-]{8,}",
)
SECRET = re.compile(r"(?<![0-9A-Za-z_-])(?:" + "|".join(SECRET_FORMS) + r")(?![0-9A-Za-z_-])")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
#: An assignment to a name that says what it holds; the value is the span.
ASSIGNED = re.compile(r"(?i:api[_-]?key|secret|token|passwd|password|access[_-]?key)[\"']?[\x20\t]{0,4}[:=][\x20\t]{0,4}[\"']?([0-9A-Za-z+/_=.-]{16,200})(?![0-9A-Za-z+/_=-])")
#: The least bits a character of a secret, so that words and runs of one letter don't count.
RANDOM = 3.0
ALNUM = re.compile(r"[A-Za-z0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: Words whose presence near a span makes it likelier, by kind; and words that make any number less likely to be personal.
CONTEXT = {
    "email": {"mail", "email", "contact", "write", "correo", "courriel", "reply"},
    "ip": {"ip", "address", "host", "server", "login", "adresse"},
    "card": {"card", "credit", "visa", "pay", "karte", "carte", "tarjeta"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"},
    "iban": {"iban", "bank", "account", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security", "number"},
    "aadhaar": {"aadhaar", "uid", "identity"},
    "cpf": {"cpf", "contribuinte"},
    "dni": {"dni", "nif", "documento"},
    "ipv6": {"ip", "address", "host", "server"},
    "mac": {"mac", "address", "device"},
    "secret": {"key", "secret", "token", "password", "credential"},
}
AGAINST = {"version", "isbn", "serial", "example", "sample", "page"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "aadhaar": 0.6, "cpf": 0.9, "dni": 0.7, "ipv6": 0.7, "mac": 0.7, "secret": 0.9}
#: Characters looked at on either side, the step of the score, and the least score of an added span.
NEAR, STEP, LEAST = 40, 0.25, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def verhoeff(digits: str) -> bool:
    """Whether the check digit of the dihedral group's scheme holds."""
    at = 0
    for i, x in enumerate(reversed(digits)):
        at = _TIMES[at][_TURNED[i % 8][ord(x) - 48]]
    return at == 0


def _verhoeff_tables() -> tuple[list[list[int]], list[list[int]]]:
    def times(a: int, b: int) -> int:
        turned = (a + b if a < 5 else a - b) % 5
        return turned + 5 * ((a < 5) != (b < 5))

    step, row, rows = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], list(range(10)), []
    for _ in range(8):
        rows.append(row)
        row = [step[x] for x in row]
    return [[times(a, b) for b in range(10)] for a in range(10)], rows


_TIMES, _TURNED = _verhoeff_tables()


def cpf(digits: str) -> bool:
    """The two check digits of the Brazilian number; eleven equal digits are none."""
    d = [ord(x) - 48 for x in digits]
    return len(set(d)) > 1 and all(sum(x * (n + 1 - i) for i, x in enumerate(d[:n])) * 10 % 11 % 10 == d[n] for n in (9, 10))


def dni(number: str) -> bool:
    """The check letter of the Spanish number."""
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(number[:8]) % 23] == number[-1]


def bits(text: str) -> float:
    """Entropy of the characters, in bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Keys and tokens in known forms, headers of private keys, and random values of names that say so, in order."""
    low = text.lower()
    found = [m.span() for m in SECRET.finditer(text)] if any(h in text for h in SECRET_HINTS) else []
    if "PRIVATE KEY" in text:
        found += [m.span() for m in PRIVATE_KEY.finditer(text)]
    if any(h in low for h in ASSIGNED_HINTS):
        found += [m.span(1) for m in ASSIGNED.finditer(text) if bits(m[1]) >= RANDOM and DIGIT.search(m[1])]
    done = 0
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= done:
            yield a, b
            done = b


SECRET_HINTS = ("AKIA", "ASIA", "gh", "glpat-", "xox", "sk-", "AIza", "k_live_", "npm_", "hf_", "eyJ")
ASSIGNED_HINTS = ("key", "secret", "token", "passw")
DIGIT = re.compile("[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each @ outwards: a scan from the left would look at a long run again and again."""
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and LOCAL.match(text, start - 1):
                start -= 1
            if start < at and (m := DOMAIN.match(text, at)):
                end = m.end()
                yield start, end
        at = text.find("@", at + 1)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """IBANs, which words in capitals and numbers may follow: cut to the country's length; of an unlisted country, the longest end at a word's end that holds."""
    done = 0
    for m in IBAN.finditer(text):
        if (start := m.start()) < done:
            continue
        length, n, ends = IBAN_LENGTHS.get(text[start : start + 2]), 4, []
        for end in range(m.end() + 1, m.end(1) + 1):
            n += text[end - 1] != " "
            if text[end - 1] != " " and n >= 15 and n == (length or n) and not ALNUM.match(text, end):
                ends.append(end)
        for end in reversed(ends):
            if mod97(text[start:end].replace(" ", "")):
                yield start, end
                done = end
                break


def confirmed(kind: str, text: str) -> bool:
    """Whether the checksum, range or length of a proposal holds."""
    if kind == "ip":
        return all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in text.split("."))
    if kind == "card":
        return 16 <= len(d := NOT_DIGIT.sub("", text)) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(NOT_DIGIT.sub("", text)) <= 15
    if kind == "iban":
        return mod97(text.replace(" ", ""))
    if kind == "aadhaar":
        return verhoeff(NOT_DIGIT.sub("", text))
    if kind == "cpf":
        return cpf(NOT_DIGIT.sub("", text))
    if kind == "dni":
        return dni(text)
    if kind == "ipv6":
        parts = text.split(":")
        gaps = text.count("::")
        return ":::" not in text and any(p for p in parts) and (gaps == 1 and len([p for p in parts if p]) <= 7 or gaps == 0 and len(parts) == 8 and all(parts)) and len(text) > 6
    if kind == "ssn":
        return text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"
    return True


def score(kind: str, text: str, start: int, end: int) -> float:
    near = set(re.findall(r"[^\W\d_]+", f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()))
    s = PRIOR[kind] + STEP * bool(near & CONTEXT[kind]) - STEP * bool(near & AGAINST)
    return round(min(1.0, max(0.05, s)), 2)


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by kind as in KINDS, then start."""
    if not text:
        return []
    out: list[tuple[str, int, int, float]] = []
    digits, taken = NUMBER.search(text) is not None, bytearray(len(text))
    for kind in KINDS:
        if kind == "email":
            found = emails(text) if "@" in text else ()
        elif kind == "secret":
            found = secrets(text)
        elif not digits or kind == "phone" and "+" not in text or kind == "ipv6" and text.count(":") < 2 or kind == "cpf" and "-" not in text:
            continue
        elif kind == "iban":
            found = ibans(text)
        else:
            found = (m.span() for m in PATTERNS[kind].finditer(text))
        for a, b in found:
            if confirmed(kind, text[a:b]):
                s = score(kind, text, a, b)
                if kind in BASE or s >= LEAST and not any(taken[a:b]):
                    out.append((kind, a, b, s))
                    if kind != "email":
                        taken[a:b] = b"\1" * (b - a)
    return out


NUMBER = re.compile(r"[0-9]")
PATTERNS = {"ip": IP, "card": CARD, "phone": PHONE, "ssn": SSN, "aadhaar": AADHAAR, "cpf": CPF, "dni": DNI, "ipv6": IPV6, "mac": MAC}
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def mask(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """text with each span, or run of overlapping spans, replaced by its first kind in capitals between angle brackets."""
    out, done = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def find(df: DataFrame, text: str = "text", spans: str = "pii", masked: str | None = None) -> DataFrame:
    """df with its spans (empty for null and empty texts), and with ``masked``, which may be the text column itself, holding the masked text.

    A null text stays null in ``masked``. Rows keep their other columns; repeated rows stay; whole texts of any length are searched.
    """
    added = {spans: SPANS} | ({masked: "string"} if masked else {})
    kept = [f for f in df.schema if f.name not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in parts_of(batches):
            texts = b.column(text).to_pylist()
            found = [spans_of(x) for x in texts]
            columns = [*(b.column(f.name) for f in kept), pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in x] for x in found], kind)]
            if masked:
                columns.append(pa.array([mask(x, s) if x and s else x for x, s in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *added])

    return df.mapInArrow(run, with_columns(df, (), **added))


def _joined(found: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds, a digest of the base spans, all spans as kind:start:end (code points, end exclusive), and their scores.

    Null and empty texts have no spans; repeated rows each give a row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans_of(x.as_py()) for x in b.column(1)]
            base = [[s for s in x if s[0] in BASE] for x in found]
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in BASE]
            shas = pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base], pa.string())
            scores = pa.array([",".join(str(s[3]) for s in x) for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, shas, pa.array(map(_joined, found), pa.string()), scores], names=[key, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, scores string")


