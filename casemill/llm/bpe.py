"""BPE encoding and decoding (operator 1).

Encoding follows the backtracking method: for every position of a pre-token an Aho-Corasick automaton over the vocabulary gives the
longest token that starts there; tokens are taken left to right, each checked against its left neighbour with the table of compatible
pairs, with shorter prefixes and backtracking where a pair is not what the merges would leave. Each position is ruled out at most once,
so the work is linear in the text, and the result is exactly that of the merges. Decoding gathers token strings from one byte blob by an
offset table.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import parts_of, with_columns
from casemill.llm.unicode_tables import Normalizer, Tables, probe

#: Entries of each generation of a worker's caches.
CACHE = 250_000
#: Entries of the table of compatible pairs, which is filled as pairs are met.
PAIRS = 400_000
#: Unicode white space, as the tokenizers' patterns know it; str.split also cuts at four ASCII control characters.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTROL = re.compile(r"[\x1c-\x1f]")


@lru_cache(1)
def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class OffsetTable:
    """Strings by token id: one blob and where each string starts in it."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.blob = np.frombuffer(b"".join(strings), np.uint8)

    def gather(self, ids: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(ids), 1 << 16):  # in pieces: the index takes 8 bytes for each byte of the result
            part = ids[at : at + (1 << 16)]
            size = self.size[part]
            end = np.cumsum(size)
            out.append(self.blob[np.repeat(self.start[part] - end + size, size) + np.arange(end[-1])].tobytes())
        return b"".join(out)


class BacktrackingBpe:
    """Merges of a rank-ordered BPE vocabulary, where a later merge has a larger id."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None):
        self.suffix = suffix or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.merged = {(vocab[a], vocab[b]): vocab[a + b] for a, b in pairs}
        self.parts = {v: k for k, v in self.merged.items()}
        forms = {i: f for s, i in vocab.items() if (f := self.form(s))}
        self.symbols = {i: len(f) for i, f in forms.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        ids = {f: i for i, f in forms.items()}
        self.automaton = ahocorasick.Automaton()
        #: Tokens that merges don't make of their own string are never taken.
        for i, f in forms.items():
            if self.merge([ids[x] for x in f]) == [i]:
                self.automaton.add_word(f, (i, len(f)))
        self.automaton.make_automaton()
        #: For each token the longest other token that it starts with.
        self.shorter = {i: next((self.automaton.get(f[:k])[0] for k in range(len(f) - 1, 0, -1) if f[:k] in self.automaton), None) for i, f in forms.items()}

    def merge(self, ids: list[int]) -> list[int]:
        """The plain rule, for the short strings of the vocabulary: again and again join the leftmost pair of the lowest rank."""
        while len(ids) > 1:
            best, k = min((self.merged.get(p, 1 << 60), k) for k, p in enumerate(zip(ids, ids[1:])))
            if best == 1 << 60:
                break
            ids = [*ids[:k], best, *ids[k + 2 :]]
        return ids

    def form(self, token: str) -> str:
        """A token as one character a symbol: a last byte with the word-end suffix becomes a private character."""
        if self.suffix and token.endswith(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(0xE000 + ord(token[-1]))
        return token

    def stays(self, a: int, b: int) -> bool:
        """Whether merging a's and b's text leaves the tokens a, b: no merge across the border comes before the border is closed."""
        if (known := self.compatible.get((a, b))) is not None:
            return known
        left, right, limit, fits = a, b, 1 << 60, None
        while fits is None:
            if self.merged.get((left, right), limit) < limit:
                fits = False
            elif left > right and left in self.parts:
                limit, left = left, self.parts[left][1]
            elif right in self.parts and right >= left:
                limit, right = right + 1, self.parts[right][0]
            elif left in self.parts:
                limit, left = left, self.parts[left][1]
            elif right in self.parts:
                limit, right = right + 1, self.parts[right][0]
            else:
                fits = True
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[a, b] = fits
        return fits

    def encode(self, form: str) -> list[int]:
        """Token ids of a pre-token in the form of ``form``."""
        longest: list[int | None] = [None] * (len(form) + 1)
        for end, (i, size) in self.automaton.iter(form):
            longest[end + 1 - size] = i  # ends come in rising order
        token, symbols = longest[0], self.symbols
        if token is not None and symbols[token] == len(form):
            return [token]
        known, shorter_of = self.compatible.get, self.shorter
        tokens, open_, at, last = [], bytearray(b"\1") * (len(form) + 1), 0, None
        while token is not None:
            end = at + symbols[token]
            if open_[end] and (last is None or (fits := known((last, token))) or fits is None and self.stays(last, token)):
                tokens.append(token)
                at, last, token = end, token, longest[end]
            elif (shorter := shorter_of[token]) is not None:
                token = shorter
            else:
                open_[at] = 0
                if last is None:
                    raise ValueError("the vocabulary has no token for a byte")
                token = tokens.pop()  # its end is closed now, so the next turn tries a shorter one
                at -= symbols[token]
                last = tokens[-1] if tokens else None
        return tokens


class Recent(dict):
    """A cache of make(key) in two generations: what is used again outlives the rest, and at most 2 * size entries stay."""

    def __init__(self, make: Callable[[str], object], size: int = CACHE):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> object:
        if (value := self.old.get(key)) is None:
            value = self.make(key)
            if len(key) > 100:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordTokenizer:
    """A tokenizer file whose texts are NFC, lower case, without white space, and whose words end with a suffix."""

    def __init__(self, path: str, tables: Tables):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.word, self.normal = re.compile(with_classes(pattern, tables)), Normalizer(tables)
        self.bpe = BacktrackingBpe(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.chars = byte_chars()
        strings = dict((v, k) for k, v in (model["vocab"] | self.special).items())
        size = max(strings) + 1
        self.decimal = OffsetTable([b"%d " % i for i in range(size)])
        #: Without a decoder, the library joins token strings with a space.
        self.strings = OffsetTable([strings.get(i, "").encode() + b" " for i in range(size)])
        self.width, self.code = (np.uint16, "H") if size <= 1 << 16 else (np.uint32, "I")
        self.escape = {i: c for i, c in enumerate(self.chars) if chr(i) != c}
        self.words, self.chunks = Recent(self.of_word, CACHE // 3), Recent(self.of_chunk)
        self.split = re.compile(f"[^{SPACE}]+").findall

    def of_word(self, word: str) -> bytes:
        form = word.encode().decode("latin-1").translate(self.escape)
        return array(self.code, self.bpe.encode(form[:-1] + chr(0xE000 + ord(form[-1])))).tobytes()

    def of_chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space; no pre-token crosses white space, and special strings hold none."""
        if chunk.isascii():  # most chunks are letters, perhaps with one mark after them
            if chunk.isalpha():
                return self.words[chunk.lower()]
            if chunk[:-1].isalpha() and chunk[-1] in ".,!?;:":
                return self.words[chunk[:-1].lower()] + self.words[chunk[-1]]
        if "<|" not in chunk:
            return self.of_piece(chunk)
        return b"".join([array(self.code, [self.special[x]]).tobytes() if x in self.special else self.of_piece(x) for x in self.cut.split(chunk)])

    def of_piece(self, piece: str) -> bytes:
        return b"".join([self.words[w] for w in self.word.findall(self.normal.lower(self.normal.nfc(piece)))])

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        chunks = self.split(text) if CONTROL.search(text) else text.split()
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, chunks)), self.width)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.strings.gather(ids)[:-1]


def with_classes(pattern: str, tables: Tables) -> str:
    """A tokenizer's pattern with its letters, numbers and white space spelt out; letters and numbers may stand in brackets or alone."""
    spelt = {r"\p{L}": tables.letters, r"\p{N}": tables.numbers, r"\s": SPACE}
    inside = re.sub(r"\[\^?((?:\\p\{[LN]\}|\\s)+)\]", lambda m: re.sub(r"\\p\{[LN]\}|\\s", lambda k: spelt[k[0]], m[0]), pattern)
    return re.sub(r"\\p\{[LN]\}|\\s", lambda k: f"[{spelt[k[0]]}]", inside).replace(r"\S", f"[^{SPACE}]")


@lru_cache(2)
def load(path: str, tables: Tables | None = None) -> WordTokenizer:
    return WordTokenizer(path, tables or probe())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with the token ids (array<int>) of a text column; null counts as the empty text, whose ids are an empty array.

    Every row of any size is encoded whole; repeated rows stay; a column already named as ``ids`` is replaced.
    """

    tables = probe()  # on the driver, once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path, tables)
        for b in parts_of(batches):
            rows = [t.encode(x.as_py()).astype(np.int32) for x in b.column(text)]
            values = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32), np.concatenate([np.zeros(0, np.int32), *rows]))
            kept = [n for n in b.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), values], names=[*kept, ids])

    return df.mapInArrow(run, with_columns(df, (), **{ids: "array<int>"}))


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """df with the text that the library's decode gives for an array of token ids; a null or empty array gives the empty text."""

    tables = probe()  # on the driver, once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path, tables)
        for b in batches:
            out = [t.decode(np.array(x or [], np.int64)).decode() for x in b.column(ids).to_pylist()]
            kept = [n for n in b.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(out, pa.string())], names=[*kept, text])

    return df.mapInArrow(run, with_columns(df, (), **{text: "string"}))


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its key, n_tokens, and SHA-256 of the ids and of the decoded text, without shipping either out of Python."""

    tables = probe()  # on the driver, once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path, tables)
        for b in batches:
            rows = []
            for x in b.column(1):
                ids = t.encode(x.as_py())
                rows.append((len(ids), hashlib.sha256(t.decimal.gather(ids)[:-1]).hexdigest(), hashlib.sha256(t.decode(ids)).hexdigest()))
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
