"""Which characters the tokenizers' own engine takes for letters and numbers, how it lowers them, and which marks its NFC does not know.

Its tables are of other Unicode versions than Python's. They are read from it once, on the driver, over all code points, and go to the
workers as a few kilobytes; the texts themselves are tokenized without it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple


class Tables(NamedTuple):
    """letters, numbers and unknown as the inside of a character class; lower as pairs of a character and what it becomes."""

    letters: str
    numbers: str
    lower: tuple[tuple[str, str], ...]
    unknown: str


def character_class(points: list[int]) -> str:
    """Rising code points as the inside of a character class."""
    out, at = [], 0
    while at < len(points):
        end = at
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(f"\\U{points[at]:08x}" + (f"-\\U{points[end]:08x}" if end > at else ""))
        at = end + 1
    return "".join(out)


@lru_cache(1)
def probe() -> Tables:
    """The tables of the installed library."""
    from tokenizers import Regex, normalizers

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    chars = [chr(c) for c in points]

    def each(normalizer, strings: list[str]) -> list[str]:
        """What becomes of each string, many a call: a line break ends each, and neither step crosses one."""
        out: list[str] = []
        for at in range(0, len(strings), 4096):
            out += normalizer.normalize_str("\n".join(strings[at : at + 4096])).split("\n")
        return out

    def matching(pattern: str) -> str:
        gone = normalizers.Replace(Regex(f"{pattern}+"), "")
        kept = set().union(*(gone.normalize_str("".join(chars[at : at + 4096])) for at in range(0, len(chars), 4096)))
        return character_class([c for c, x in zip(points, chars) if x not in kept])

    visible = [x for x in chars if x != "\n"]
    lower = tuple((x, y) for x, y in zip(visible, each(normalizers.Lowercase(), visible)) if y != x.lower())
    nfc, unknown = normalizers.NFC(), set()
    # a mark that the library knows changes places with one of another class
    marks = [x for x in chars if unicodedata.combining(x)]
    tried = [f"xͅ{x}" if unicodedata.combining(x) < 240 else f"x{x}̴" for x in marks]
    unknown |= {x for x, s, got in zip(marks, tried, each(nfc, tried)) if got != unicodedata.normalize("NFC", s)}
    whole = [x for x in chars if unicodedata.decomposition(x)[:1] not in ("", "<")]
    apart = [unicodedata.normalize("NFD", x) for x in whole]
    for x, parts, got in zip(whole, apart, each(nfc, apart)):
        if got != unicodedata.normalize("NFC", x):
            unknown |= {x, *parts[1:]}
    return Tables(matching(r"\p{L}"), matching(r"\p{N}"), lower, character_class(sorted(map(ord, unknown))))


class Normalizer:
    """The library's NFC and lower case."""

    def __init__(self, tables: Tables):
        # to the library these are characters like any other: nothing joins them or moves past them
        self.cut = re.compile(f"([{tables.unknown}])") if tables.unknown else None
        self.lowered = dict(tables.lower)
        self.special = re.compile(f"[{re.escape(''.join(self.lowered))}]") if self.lowered else None

    def nfc(self, text: str) -> str:
        if self.cut and self.cut.search(text):
            return "".join([unicodedata.normalize("NFC", x) for x in self.cut.split(text)])
        return unicodedata.normalize("NFC", text)

    def lower(self, text: str) -> str:
        # the library lowers each character by itself, so a final sigma isn't special
        if self.special and self.special.search(text):
            return "".join([self.lowered.get(x) or x.lower() for x in text])
        return text.replace("Σ", "σ").lower()
