"""Token counts by offset-mapped attribution.

A whole document is encoded once. Each token's bytes give its span of characters, and the sorted token spans are joined
with the sorted spans of the document's sections. A token that crosses a boundary goes by an explicit rule:

* ``start``: to the section of its first character;
* ``end``: to the section of its last character;
* ``most``: to the section that has most of its characters, the earlier one of equals.

A token that begins inside a character (a character's bytes may be several tokens) counts as beginning with it. Sections
are the text's lines, each with its line end; ``fields`` counts several columns instead, put together with a separator
that counts for the field before it. Each token goes to one section, so a document's sections add up to its tokens.

The vocabulary is a file of byte-level ranks; the driver reads it from ``path`` and broadcasts it. It is refused
beyond ``max_bytes``.

Nulls: a null or empty text has no token and no section; a null field counts as empty. Repeated rows each come back. Columns
other than those named are not read. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, sliced

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_BYTES = 32 << 20
RULES = ("start", "end", "most")
# Fixed value: the public byte-level vocabulary's pattern of words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    def __init__(self, ranks: bytes):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.lengths[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end character of each token."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        if text.isascii():
            return starts, ends
        lead = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
        upto = np.concatenate([[0], np.cumsum(lead)])  # characters begun before each byte
        first = upto[starts] - ~lead[starts]
        return first, upto[ends]


@cache
def encoder(ranks: bytes) -> Encoder:
    return Encoder(ranks)


def line_starts(text: str) -> np.ndarray:
    """Start of each line; a line end closes its line, so a text that ends with one has no empty line more."""
    at = [0]
    while (n := text.find("\n", at[-1])) >= 0 and n + 1 < len(text):
        at.append(n + 1)
    return np.array(at if text else [], np.int64)


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, length: int, rule: str = "start") -> np.ndarray:
    """Tokens of each section: token spans [first, last) and section starts are in order."""
    if not len(starts):
        return np.zeros(0, np.int64)
    section = lambda at: np.searchsorted(starts, at, "right") - 1
    a, b = section(first), section(np.maximum(last - 1, first))
    if rule == "start":
        where = a
    elif rule == "end":
        where = b
    else:
        ends = np.append(starts[1:], length)
        where = a.copy()
        for i in np.nonzero(a != b)[0]:  # tokens across a boundary are few
            parts = range(a[i], b[i] + 1)
            where[i] = max(parts, key=lambda s: (min(last[i], ends[s]) - max(first[i], starts[s]), -s))
    return np.bincount(np.maximum(where, 0), minlength=len(starts))


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", fields: tuple[str, ...] | None = None, separator: str = "\n", path: str = PATH, rule: str = "start", max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_sections and section_tokens (the tokens of each section in order) of every row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    ship(df.sparkSession)
    if os.path.getsize(path) > max_bytes:
        raise ValueError(f"{path} has over {max_bytes} bytes")
    with open(path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    columns = fields or (text,)
    chosen = df.select(F.col(key).alias("doc_id"), *(F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(columns)))

    def one(parts: list[str | None]) -> list[int]:
        if fields:
            joined = [(p or "") + separator * (i + 1 < len(parts)) for i, p in enumerate(parts)]
            whole, starts = "".join(joined), np.cumsum([0, *map(len, joined[:-1])])
        else:
            whole = parts[0] or ""
            starts = line_starts(whole)
        first, last = own().spans(whole)
        return attribute(first, last, starts, len(whole), rule).tolist()

    def own() -> Encoder:
        return encoder(ranks.value)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [one(list(parts)) for parts in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(sum, rows), pa.int64()), pa.array(map(len, rows), pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "n_tokens", "n_sections", "section_tokens"])

    kind = chosen.schema["doc_id"].dataType
    return chosen.mapInArrow(scan, T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("n_sections", T.LongType()), T.StructField("section_tokens", T.ArrayType(T.LongType()))]))
