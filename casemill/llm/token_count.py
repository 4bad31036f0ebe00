"""Token counts with a whole-token shortcut (operator 9).

Which vocabulary strings the merges turn into exactly one token is proved once, on the driver, from the merge table; the proven strings
go to the executors. A pre-token among them counts one without merging; only the rest is merged.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.bpe import SPACE, Recent, byte_chars, with_classes
from casemill.llm.unicode_tables import Tables, probe

#: The split of byte-level tokenizers with use_regex (a fixed pattern of the format).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs that pre-tokens never cross: a word with the blank before it, or white space.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


@lru_cache(2)
def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["model"]["end_of_word_suffix"]:
        raise ValueError(f"{path} is not a plain byte-level BPE file")
    return spec


class Merges:
    """Ranked merges over the byte characters of a byte-level vocabulary."""

    def __init__(self, merges: list):
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(merges)}

    def apply(self, form: str) -> list[str]:
        """Tokens of a pre-token: the leftmost pair of the lowest rank is joined until none is left, in n log n steps."""
        parts: list[str | None] = list(form)
        rank, n = self.rank, len(form)
        heap = [(r, i) for i, p in enumerate(zip(form, form[1:])) if (r := rank.get(p)) is not None]
        if not heap:
            return parts
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = heapq.heappop(heap)
            if (a := parts[i]) is None or (j := after[i]) >= n or rank.get((a, parts[j])) != r:
                continue
            a = parts[i] = a + parts[j]
            parts[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((a, parts[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((parts[h], a))) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in parts if p is not None]


@lru_cache(2)
def pretoken(tables: Tables | None = None) -> re.Pattern:
    return re.compile(with_classes(PRETOKEN, tables or probe()))


@lru_cache(2)
def prove(path: str) -> frozenset[str]:
    """The vocabulary strings (as text) that encode alone as one token, each run through the merges and the split."""
    spec = _spec(path)
    merges, byte_of = Merges(spec["model"]["merges"]), {c: b for b, c in enumerate(byte_chars())}
    out, split = set(), pretoken()
    for form in spec["model"]["vocab"]:
        try:
            text = bytes(byte_of[c] for c in form).decode()
        except (UnicodeDecodeError, KeyError):
            continue
        if merges.apply(form) == [form] and split.findall(text) == [text]:
            out.add(text)
    return frozenset(out)


class Counter:
    """Counts of whole texts; kept by a worker between tasks."""

    def __init__(self, path: str, proven: frozenset[str], tables: Tables | None = None):
        spec = _spec(path)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.merges, self.proven, self.chars = Merges(spec["model"]["merges"]), proven, byte_chars()
        self.escape = {i: c for i, c in enumerate(self.chars) if chr(i) != c}
        self.split = pretoken(tables).findall
        self.chunks = Recent(self.of_chunk)

    def of_chunk(self, chunk: str) -> int:
        n = 0
        for p in self.split(chunk):
            n += 1 if p in self.proven else len(self.merges.apply(p.encode().decode("latin-1").translate(self.escape)))
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        n, pieces = 0, [text]
        if self.cut and any(s in text for s in self.special):  # each stands for one token, and splits run between them
            pieces = self.cut.split(text)
            n = len(pieces) - 1
        for piece in pieces:
            n += sum(map(self.chunks.__getitem__, CHUNK.findall(piece)))
        return n


_COUNTERS: dict[str, Counter] = {}


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """One row a document: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null counts as the empty text: 0 bytes, 0 tokens. Repeated rows each give a row; other columns are not read.
    """
    proven, tables = df.sparkSession.sparkContext.broadcast(prove(path)), probe()  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path, proven.value, tables)
        count = _COUNTERS[path].count
        for b in batches:
            n = [count(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[key].dataType.simpleString()
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    return df.select(F.col(key), size, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
