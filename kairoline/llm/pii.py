"""Personal data in texts, with offset-preserving deobfuscation.

Four kinds are found: email, ip, card and phone. They are first looked for in the text as it stands. Then a chain of
transducers rewrites the text, each keeping where its output came from:

1. look-alike letters, mathematical and circled ones, digits of other scripts, full-width forms, dashes and spaces become
   ASCII (one for one);
2. characters of no width go;
3. spelled digits ("four one one ...", "plus one double two ..."), in English, German, French and Spanish, become digits;
4. disguised "at" and "dot", in brackets, as words or as signs apart, become ``@`` and ``.``. A bare word "at" before a domain
   with plain dots is left alone: prose says "at example.com" of places.

The same detectors run on the rewritten text, and each span found is carried back through the chain to characters of the
source. A span that overlaps one found in the plain text is dropped, so plain spans always stay.

Whole texts are used, however long; every detector is linear in the text's length. Offsets count code points, the end
exclusive. A null or empty text has no spans. Rows are independent: repeated rows, null keys and empty tables need
nothing special, and columns other than key and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, sliced

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_WORD = _LOCAL - {"."}
# a failed match inside a run of digits fails from each of its digits: start at the run's first digit only
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for g in m.groups()):
            yield m.span()


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * d - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def plain_spans(text: str) -> dict[str, list[Span]]:
    return {kind: list(_FIND[kind](text)) for kind in KINDS}


# Letters of other scripts that look like ASCII letters, and the ASCII letter for each.
_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l",
}
# Dashes, spaces and signs, and the ASCII character for each.
_SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ", "․": ".", "。": ".", "﹒": ".", "﹫": "@"}
_WIDTHLESS = "​‌‍⁠﻿­"


def _to_ascii() -> dict[int, str]:
    table = {ord(k): v for k, v in (_LOOKALIKES | _SIGNS).items()}
    table |= {c + 0xFEE0: chr(c) for c in range(0x21, 0x7F)}  # full width
    # letters and digits of one character in mathematical, circled and letter-like forms
    for c in (*range(0x2100, 0x2150), *range(0x2460, 0x2500), *range(0x1D400, 0x1D800)):
        plain = unicodedata.normalize("NFKC", chr(c))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            table[c] = plain
    table |= {c: str(unicodedata.decimal(chr(c))) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"}
    return table


def _char_class(points: list[int]) -> str:
    """The points as ranges for a regular expression's brackets."""
    runs: list[list[int]] = []
    for c in sorted(points):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


_ASCII = _to_ascii()
_ODD = re.compile(f"[{_char_class(list(_ASCII))}]")
_NO_WIDTH = re.compile(f"[{_WIDTHLESS}]+")

# The words for the ten digits in four languages, and those that repeat a digit.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_REPEATS = {"double": 2, "triple": 3}
_DIGIT_WORD = "|".join(sorted(_DIGITS, key=lambda w: (-len(w), w)))
_ONE = rf"(?:(?:{'|'.join(_REPEATS)})[ \t-]+)?(?:{_DIGIT_WORD})"
_SPELLED = re.compile(rf"(?<![a-z0-9])(?:plus[ \t]+)?(?:{_ONE}(?:[ \t-]+|(?=[^a-z0-9-])|\Z)|[0-9]+[ \t-]+(?=(?:[0-9]+[ \t-]+)?{_ONE}(?![a-z0-9]))){{2,}}(?:[0-9]+(?![a-z0-9]))?", re.I | re.A)
_SPELLED_PART = re.compile(rf"(plus)[ \t]+|(?:({'|'.join(_REPEATS)})[ \t-]+)?(?<![a-z])({_DIGIT_WORD})(?![a-z])(?:[ \t-]+(?=[a-z0-9]))?|(?<=[0-9])[ \t-]+(?=[a-z])", re.I | re.A)
# a single digit word between the dots of an ip
_SPELLED_DOTTED = re.compile(rf"(?<![a-z0-9])({_DIGIT_WORD})(?=[ \t]+dot[ \t])|(?<=[ \t]dot[ \t])({_DIGIT_WORD})(?![a-z0-9])", re.I | re.A)
# a quick look for what these match: a digit word next to a dot, or right after a number or another such word
_DOT_WORD = re.compile(r"[ \t]dot[ \t]", re.I)
_AFTER_GAP = re.compile(rf"[ \t-](?:{_DIGIT_WORD})(?![a-z])", re.I | re.A)
_LAST_WORD = re.compile(r"[0-9]\Z|[^\W\d_]+\Z")


def _has_spelled(text: str) -> bool:
    if _DOT_WORD.search(text):
        return True
    for m in _AFTER_GAP.finditer(text):
        before = text[max(0, m.start() - 64) : m.start()].rstrip(" \t-")
        if (last := _LAST_WORD.search(before)) and ((w := last[0].lower()) in _DIGITS or w in _REPEATS or w.isdigit()) or not before and m.start() > 64:
            return True
    return False


_BRACKET_AT = re.compile(r"[ \t]?[(\[{<][ \t]?(?:at|@)[ \t]?[)\]}>][ \t]?", re.I)
_BRACKET_DOT = re.compile(r"[ \t]?[(\[{<][ \t]?(?:dot|\.)[ \t]?[)\]}>][ \t]?", re.I)
_WORD_DOT = re.compile(r"(?<=[A-Za-z0-9])[ \t]+dot[ \t]+(?=[A-Za-z0-9])", re.I)
# bare words count only in a whole address, or between the numbers of an ip
_WORD_AT = re.compile(r"(?<=[A-Za-z0-9])[ \t]+at[ \t]+(?=[A-Za-z0-9-]+(?:(?:\.[A-Za-z0-9-]+)*[ \t]+dot[ \t]+[A-Za-z0-9-]+))", re.I)
# an at sign apart, before a domain whose dots may stand apart too
_APART_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])[ \t]{1,3}@[ \t]{1,3}(?=(?:[A-Za-z0-9-]+(?:\.|[ \t]\.[ \t]))+[A-Za-z]{2,}(?![A-Za-z0-9-]))")
_APART_TAIL = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|[ \t]\.[ \t])[A-Za-z0-9-]+)+")
_APART_DOT = re.compile(r"[ \t]\.[ \t]")
_WORD_TAIL = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|[ \t]+dot[ \t]+)[A-Za-z0-9-]+)+", re.I)
_WORD_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\.|[ \t]+dot[ \t]+)[0-9]{1,3}){3}(?![0-9])", re.I)


class Rewriting:
    """A text with some spans replaced; back() gives the source span of a span of the result."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self.pieces: list[tuple[int, int, int, bool]] = []  # start here, start and end in the source, kept as it was
        out, at, n = [], 0, 0
        for a, b, new in edits:
            for x, y, s in ((at, a, text[at:a]), (a, b, new)):
                if s:
                    self.pieces.append((n, x, y, s is not new))
                    out.append(s)
                    n += len(s)
            at = b
        if at < len(text):
            self.pieces.append((n, at, len(text), True))
            out.append(text[at:])
        self.text = "".join(out)

    def _piece(self, at: int) -> tuple[int, int, int, bool]:
        lo, hi = 0, len(self.pieces)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.pieces[mid][0] <= at else (lo, mid)
        return self.pieces[lo]

    def back(self, start: int, end: int) -> Span:
        n, a, _, kept = self._piece(start)
        first = a + start - n if kept else a
        n, a, b, kept = self._piece(end - 1)
        return first, a + end - n if kept else b


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits, taken = [], []
    for m in _SPELLED.finditer(text):
        taken.append(m.span())
        for p in _SPELLED_PART.finditer(text, *m.span()):
            digit = _DIGITS[p[3].lower()] * _REPEATS.get((p[2] or "").lower(), 1) if p[3] else ""
            edits.append((p.start(), p.end(), "+" if p[1] else digit))
    ends = list(accumulate((b for _, b in taken), max))
    single = [(*m.span(m.lastindex), _DIGITS[m[m.lastindex].lower()]) for m in _SPELLED_DOTTED.finditer(text) if not _overlaps(taken, ends, *m.span())]
    return sorted(edits + single)


def _head(text: str, end: int) -> int:
    """Where the local part starts that ends at ``end``: words joined by dots or by "dot"."""

    def back(at: int, chars: frozenset[str] | str) -> int:
        while at and text[at - 1] in chars:
            at -= 1
        return at

    start = back(end, _LOCAL_WORD)
    while start:
        at = start - 1
        if text[at] != ".":
            dot = back(start, " \t")
            at = back(dot - 3, " \t") if dot < start and text[max(0, dot - 3) : dot].lower() == "dot" else dot
            if at >= dot - 3:
                break
        first = back(at, _LOCAL_WORD)
        if first == at:
            break
        start = first
    return start


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    edits = {m.span(): "@" for m in _BRACKET_AT.finditer(text)} | {m.span(): "." for m in _BRACKET_DOT.finditer(text)}
    for m in _WORD_AT.finditer(text):
        edits[m.span()] = "@"
        tail = _WORD_TAIL.match(text, m.end())
        edits |= {d.span(): "." for d in _WORD_DOT.finditer(text, m.end(), tail.end() if tail else m.end())}
        edits |= {d.span(): "." for d in _WORD_DOT.finditer(text, _head(text, m.start()), m.start())}
    for m in _APART_AT.finditer(text):
        edits[m.span()] = "@"
        edits |= {d.span(): "." for d in _APART_DOT.finditer(text, m.end(), _APART_TAIL.match(text, m.end()).end())}
    # the domain of a bracketed or plain at sign may still spell its dots
    for sign in re.finditer(r"@|[)\]}>]", text):
        if tail := _WORD_TAIL.match(text, sign.end() + (text[sign.end() : sign.end() + 1] == " ")):
            edits |= {d.span(): "." for d in _WORD_DOT.finditer(text, sign.end(), tail.end())}
    for m in _WORD_IP.finditer(text):
        edits |= {d.span(): "." for d in _WORD_DOT.finditer(text, *m.span())}
    out, last = [], 0
    for (a, b), new in sorted(edits.items()):
        if a >= last:
            out.append((a, b, new))
            last = b
    return out


_ADDRESS_GATE = re.compile(r"[(\[{<][ \t]?(?:at|@|dot|\.)[ \t]?[)\]}>]|[ \t]dot[ \t]|[ \t]@[ \t]", re.I)


def hidden_spans(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that show only once disguises are off, in the source's offsets."""
    chain: list[Rewriting] = []
    now, changed = text, False
    if not text.isascii() and _ODD.search(text):
        now, changed = text.translate(_ASCII), True  # one for one: offsets stay
    for gate, edits in ((_NO_WIDTH.search, lambda t: [(*m.span(), "") for m in _NO_WIDTH.finditer(t)]), (_has_spelled, _spelled_edits), (_ADDRESS_GATE.search, _address_edits)):
        if gate(now) and (found := edits(now)):
            chain.append(Rewriting(now, found))
            now, changed = chain[-1].text, True
    if not changed:
        return {kind: [] for kind in KINDS}
    taken = sorted(s for spans in plain.values() for s in spans)
    ends = list(accumulate((b for _, b in taken), max))
    out: dict[str, list[Span]] = {}
    for kind in KINDS:
        out[kind] = []
        for a, b in _FIND[kind](now):
            for step in reversed(chain):
                a, b = step.back(a, b)
            if not _overlaps(taken, ends, a, b):
                out[kind].append((a, b))
        taken = sorted([*taken, *out[kind]])
        ends = list(accumulate((b for _, b in taken), max))
    return out


def _overlaps(spans: list[Span], ends: list[int], a: int, b: int) -> bool:
    """spans: in order; ends: the furthest end of each and those before it."""
    lo, hi = 0, len(spans)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if spans[mid][0] < b else (lo, mid)
    return lo > 0 and ends[lo - 1] > a


def all_spans(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Spans of the plain text, and all spans."""
    plain = plain_spans(text or "")
    hidden = hidden_spans(text or "", plain)
    return plain, {kind: sorted(plain[kind] + hidden[kind]) for kind in KINDS}


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; where kinds overlap, the earlier one's name."""
    if not text:
        return text
    _, spans = all_spans(text)
    merged: list[list] = []
    for a, b, kind in sorted((a, b, kind) for kind in KINDS for a, b in spans[kind]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    return Rewriting(text, [(a, b, f"<{kind.upper()}>") for a, b, kind in merged]).text if merged else text


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the number of plain spans of each kind, base_sha256 of the plain spans and all spans as a string."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [all_spans(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([len(plain[kind]) for plain, _ in rows], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(_joined(plain).encode()).hexdigest() for plain, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([_joined(spans) for _, spans in rows], pa.string())], names)

    names = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"]
    ship(df.sparkSession)
    chosen = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    types = [chosen.schema["doc_id"].dataType, *[T.LongType()] * 4, T.StringType(), T.StringType()]
    return chosen.mapInArrow(scan, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))


def redact_pii(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """df with personal data in its text replaced; ``length``, where the table has that column, follows the text."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [redacted(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    ship(df.sparkSession)
    names, at = df.columns, df.columns.index(text)
    out = df.mapInArrow(clean, df.schema)
    if length in df.columns:
        out = out.withColumn(length, F.length(text).cast(df.schema[length].dataType))
    return out
