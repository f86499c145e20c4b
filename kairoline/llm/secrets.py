"""Secrets in texts, also in nested encodings, by a worklist of layers.

Three kinds are found: assign (a password, secret, token or API key with its value), access (key ids that begin with AKIA) and
hex (runs of lower-case hex digits). The text itself is the first layer. Each layer on the worklist is scanned, and what can be
unwrapped in it gives further layers:

* URL and Unicode escapes (``%41``, ``\\x41``, ``\\u0041``, ``\\U00000041``, ``\\u{41}``, ``&#65;``, ``&#x41;``): the whole layer with all its escapes
  undone, each character knowing where it came from. Bytes that aren't UTF-8 stand for the character of their number;
* base64 (standard and URL-safe, padded or not, in lines or not): the text of a run of 16 characters or more, UTF-8 or UTF-16, each
  byte mapped to its characters. A run that isn't text as a whole is read at each of its four alignments for printable parts;
* compressed bytes (gzip, zlib, bzip2, xz, zstandard), within base64 or written with URL or ``\\x`` escapes: all of what comes out maps to the whole
  run.

The list is worked until nothing new comes. A layer is known by its hash and the part of the source that it stands for, and a
stream of bytes by its hash within its chain: one seen before isn't opened again, so streams that unpack to themselves end. Undoing
escapes 32 times in a chain is followed by one step, linear in the text, that undoes all that are left; so escapes nested without end
cost no more, and only their last layer is scanned.

Whole texts are used, and each step is linear in its layer. Unpacked streams of one document are kept below ``max_bytes`` in
all; streams beyond aren't opened, and are counted in ``n_unopened``, so none goes unseen.

Offsets count code points of the source, the end exclusive. The matches of the plain text, called base, are always reported; those of other
layers are added, but for those that lie in a match of their kind which shows their text already. A null or empty text has none. Rows are independent: repeated rows, null keys and
empty tables need nothing special, and columns other than key and text are not read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, sliced
from .pii import Rewriting

KINDS = ("assign", "access", "hex")
Span = tuple[int, int]
#: Steps in a chain of escapes after which the rest is undone at once.
PASSES = 32
MAX_BYTES = 16 << 20

_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """kind, start and end of all that one layer shows."""
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        yield from (("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12)
    if "AKIA" in text:
        yield from (("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18)
    yield from (("hex", *m.span()) for m in _HEX.finditer(text))


@dataclass
class Layer:
    text: str
    #: From a span of this layer to one of the source.
    back: Callable[[int, int], Span]
    chain: tuple[str, ...]
    passes: int = 0


# escapes ------------------------------------------------------------------------------------------------------------

_ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\x[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
_NUMBER = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})")
# one escape for an ASCII character at the end of what has been read
_LAST = re.compile(r"(?:%|\\x)([0-7][0-9A-Fa-f])\Z|\\u00([0-7][0-9A-Fa-f])\Z|\\u\{0{0,4}([0-7]?[0-9A-Fa-f])\}\Z|\\U000000([0-7][0-9A-Fa-f])\Z|&#0{0,4}([0-9]{1,3});\Z|&#[xX]0{0,4}([0-7]?[0-9A-Fa-f]);\Z")


def _character(number: int) -> str | None:
    return chr(number) if number <= 0x10FFFF and not 0xD800 <= number < 0xE000 else None


def _byte_edits(at: int, width: int, raw: bytes) -> Iterator[tuple[int, int, str]]:
    """Of a run of escapes of ``width`` characters, each a byte."""
    for c in raw.decode("utf-8", "surrogateescape"):
        units = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
        yield at, at + units * width, chr(ord(c) - 0xDC00) if "\udc80" <= c <= "\udcff" else c
        at += units * width


def _escape_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ESCAPED.finditer(text):
        run, a = m[0], m.start()
        if run[0] == "%":
            yield from _byte_edits(a, 3, bytes.fromhex(run.replace("%", "")))
        elif run.startswith("\\x"):
            yield from _byte_edits(a, 4, bytes.fromhex(run.replace("\\x", "")))
        elif run[0] == "&":
            if (c := _character(int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1]))) is not None:
                yield a, m.end(), c
        else:
            high: tuple[int, int] | None = None
            for u in _NUMBER.finditer(run):
                number = int(u[1] or u[2] or u[3], 16)
                if high and high[1] == u.start() and 0xDC00 <= number < 0xE000:
                    number = 0x10000 + (high[2] - 0xD800 << 10) + number - 0xDC00
                    yield a + high[0], a + u.end(), chr(number)
                elif (c := _character(number)) is not None:
                    yield a + u.start(), a + u.end(), c
                high = (u.start(), u.end(), number) if 0xD800 <= number < 0xDC00 else None


class _Settled:
    """A text whose ASCII escapes are all undone, however deeply nested, in one pass: what is read so far never ends in one."""

    def __init__(self, text: str):
        chars: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        for i, c in enumerate(text):
            chars.append(c)
            self.starts.append(i)
            self.ends.append(i + 1)
            while chars[-1] in "0123456789abcdefABCDEF};" and (m := _LAST.search("".join(chars[-12:]))):
                number = int(next(g for k, g in enumerate(m.groups()) if g), 10 if m[5] else 16)
                if number > 127:
                    break
                n = m.end() - m.start()
                del chars[-n:], self.ends[-n:], self.starts[len(self.starts) - n + 1 :]
                chars.append(chr(number))
                self.ends.append(i + 1)
        self.text = "".join(chars)

    def back(self, a: int, b: int) -> Span:
        return self.starts[a], self.ends[b - 1]


def _unescaped(layer: Layer) -> Layer | None:
    text = layer.text
    if not ("%" in text or "\\" in text or "&#" in text):
        return None
    if layer.passes == PASSES:
        step: Rewriting | _Settled = _Settled(text)
    else:
        step = Rewriting(text, list(_escape_edits(text)))
    if step.text == text:
        return None
    return Layer(step.text, lambda a, b: layer.back(*step.back(a, b)), (*layer.chain, "escape"), layer.passes + 1)


# bytes --------------------------------------------------------------------------------------------------------------

_MAGIC = {b"\x1f\x8b": "gzip", b"\x78\x01": "zlib", b"\x78\x5e": "zlib", b"\x78\x9c": "zlib", b"\x78\xda": "zlib", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")


class _TooLarge(Exception):
    pass


def _unpacked(kind: str, data: bytes, most: int) -> bytes:
    """What a stream holds, as far as it can be read; at most ``most`` bytes, else raises."""
    out, size = [], 0
    make = {"gzip": lambda: zlib.decompressobj(47), "zlib": lambda: zlib.decompressobj(47), "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}
    try:
        if kind == "zstd":
            reader = zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(data, read_across_frames=True)
            while chunk := reader.read(1 << 16):
                out.append(chunk)
                if (size := size + len(chunk)) > most:
                    raise _TooLarge
            return b"".join(out)
        while data:  # streams may follow each other
            d = make[kind]()
            chunk = d.decompress(data, most - size + 1)
            out.append(chunk)
            if (size := size + len(chunk)) > most:
                raise _TooLarge
            data = d.unused_data if d.eof and chunk and _MAGIC.get(d.unused_data[:2]) == kind else b""
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        pass
    return b"".join(out)


class _Budget:
    """How many bytes a document's streams may still unpack to, and how many streams were left closed."""

    def __init__(self, left: int):
        self.left, self.unopened = left, 0


def _open(data: bytes, budget: _Budget) -> tuple[bytes, list[str]]:
    """What is in a stream of streams, and their kinds. It ends at bytes that are no stream, or that came before."""
    seen, kinds = set(), []
    while kind := next((k for m, k in _MAGIC.items() if data.startswith(m)), None):
        if (digest := hashlib.sha256(data).digest()) in seen:
            break
        seen.add(digest)
        try:
            inner = _unpacked(kind, data, budget.left)
        except _TooLarge:
            budget.unopened += 1
            break
        if not inner:
            break
        budget.left -= len(inner)
        data = inner
        kinds.append(kind)
    return data, kinds


def _as_text(data: bytes) -> tuple[str, str] | None:
    """The text that bytes hold, and its encoding."""
    if len(data) % 2 == 0 and len(data) >= 4 and data[1::2].count(0) * 4 > len(data):
        encoding = "utf-16-le"
    else:
        encoding = "utf-8"
    try:
        text = data.decode(encoding)
    except UnicodeDecodeError:
        return None
    return (text, encoding) if text and not _CONTROL.search(text) else None


class _Bytes:
    """A text decoded from bytes, whose spans are those of bytes."""

    def __init__(self, text: str, encoding: str):
        self.text, self.encoding = text, encoding

    @cached_property
    def upto(self) -> np.ndarray:
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        widths = 2 + 2 * (points > 0xFFFF) if self.encoding == "utf-16-le" else 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        return np.concatenate([[0], np.cumsum(widths)])

    def back(self, a: int, b: int) -> Span:
        if self.encoding == "utf-8" and self.text.isascii():
            return a, b
        return int(self.upto[a]), int(self.upto[b])


# base64 -------------------------------------------------------------------------------------------------------------

_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_LINE = r"(?:[A-Za-z0-9+/_-]{4}){4,32}+(?![A-Za-z0-9+/_-])"
# full lines, and a shorter one after them; without a second full line the short one must be padded
_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-]){_LINE}(?:(?:\r?\n{_LINE})++(?:\r?\n[A-Za-z0-9+/_-]{{2,}}+={{0,2}}|={{1,2}})?|\r?\n[A-Za-z0-9+/_-]{{2,}}+={{1,2}})")
_BREAK = re.compile(r"\r?\n")


def _decoded(run: str) -> bytes:
    """The bytes of a run, of which characters that are left over at the end are dropped."""
    run = run.rstrip("=").translate({45: 43, 95: 47})
    run = run[: len(run) - (len(run) % 4 == 1)]
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except binascii.Error:
        return b""


def _base64_layers(layer: Layer, budget: _Budget) -> Iterator[Layer]:
    text = layer.text
    taken = 0
    runs = [(m.start(), m.end(), True) for m in _LINES.finditer(text)] if "\n" in text else []
    runs += [(m.start(), m.end(), False) for m in _RUN.finditer(text)]
    for a, b, lines in sorted(runs, key=lambda r: (r[0], -r[1])):
        if b <= taken:
            continue
        run = text[a:b]
        places: list[int] | None = None
        if lines:
            places = [i for i, c in enumerate(run) if c not in "\r\n"]
            run = _BREAK.sub("", run)
        data = _decoded(run)
        inner, kinds = _open(data, budget)
        name = (*layer.chain, "base64", *kinds)
        if found := _as_text(inner):
            taken = max(taken, b) if lines else taken
            yield _from_bytes(layer, name, *found, a, b, places, bool(kinds))
        elif not lines and not kinds:
            for phase in range(4):
                data = _decoded(run[phase:])
                for m in _PRINTABLE.finditer(data):
                    yield _from_bytes(layer, name, m[0].decode(), "utf-8", a + phase, b, None, False, m.start())


def _from_bytes(layer: Layer, name: tuple[str, ...], text: str, encoding: str, a: int, b: int, places: list[int] | None, packed: bool, skip: int = 0) -> Layer:
    """The layer of a run's text: bytes map to characters of the run, or all to the whole of it if they were packed."""
    if packed:
        return Layer(text, lambda x, y: layer.back(a, b), name)
    inner = _Bytes(text, encoding)

    def back(x: int, y: int) -> Span:
        x, y = inner.back(x, y)
        first, last = (x + skip) * 4 // 3, -(-(y + skip) * 4 // 3) - 1
        if places:
            first, last = places[first], places[last]
        return layer.back(a + first, a + last + 1)

    return Layer(text, back, name)


# compressed bytes written with escapes -------------------------------------------------------------------------------

_PACKED = re.compile(r"(?:%1[fF]%8[bB]|(?:%78|x)%(?:01|5[eE]|9[cC]|[dD][aA])|(?:%28|\()%[bB]5(?:%2[fF]|/)%[fF][dD])(?:%[0-9A-Fa-f]{2}|[^%\s\"'<>])+")
_PACKED_X = re.compile(r"(?:\\x1[fF]\\x8[bB]|(?:\\x78|x)\\x(?:01|5[eE]|9[cC]|[dD][aA])|(?:\\x28|\()\\x[bB]5(?:\\x2[fF]|/)\\x[fF][dD])(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv0'\"\\]|[ !#-&(-\[\]-~])+")
_SHORT = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "0": 0}
_UNIT = re.compile(r"\\x([0-9A-Fa-f]{2})|\\(.)|([^\\])")


def _literal_bytes(run: str) -> bytes:
    return bytes(int(m[1], 16) if m[1] else _SHORT.get(m[2], ord(m[2])) if m[2] else ord(m[3]) for m in _UNIT.finditer(run))


def _packed_layers(layer: Layer, budget: _Budget) -> Iterator[Layer]:
    text = layer.text
    runs = [(m.span(), "url", lambda run: unquote_to_bytes(run)) for m in _PACKED.finditer(text)] if "%" in text else []
    runs += [(m.span(), "escape", _literal_bytes) for m in _PACKED_X.finditer(text)] if "\\x" in text else []
    for (a, b), name, read in runs:
        inner, kinds = _open(read(text[a:b]), budget)
        if kinds and (found := _as_text(inner)):
            yield _from_bytes(layer, (*layer.chain, name, *kinds), *found, a, b, None, True)


# worklist -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    end: int
    base: bool
    layers: str
    value: str


def layers(text: str, budget: _Budget) -> Iterator[Layer]:
    """The text and all that it unwraps to."""
    work = deque([Layer(text, lambda a, b: (a, b), ())])
    seen: set[tuple[bytes, Span]] = set()
    while work:
        layer = work.popleft()
        yield layer
        child = _unescaped(layer)
        for new in (*([child] if child else []), *_base64_layers(layer, budget), *_packed_layers(layer, budget)):
            if not new.text:
                continue
            known = hashlib.sha256(new.text.encode("utf-8", "surrogatepass")).digest(), new.back(0, len(new.text))
            if known not in seen:
                seen.add(known)
                work.append(new)


def secrets(text: str | None, max_bytes: int = MAX_BYTES) -> tuple[list[Found], int, int]:
    """All that is found, in order of start and kind; the number of layers, and of streams that weren't opened."""
    budget, count = _Budget(max_bytes), 0
    found: dict[tuple[str, int, int], Found] = {}
    for layer in layers(text or "", budget):
        count += 1
        for kind, a, b in matches(layer.text):
            start, end = layer.back(a, b)
            found.setdefault((kind, start, end), Found(kind, start, end, not layer.chain, ">".join(layer.chain), layer.text[a:b]))
    return sorted(_telling(found.values()), key=lambda f: (f.start, KINDS.index(f.kind), f.end)), count, budget.unopened


def _telling(found: Iterable[Found]) -> Iterator[Found]:
    """Without those that lie in another of their kind which shows their text already; base ones all stay."""
    widest: dict[str, Found] = {}
    for f in sorted(found, key=lambda f: (f.start, -f.end)):
        w = widest.get(f.kind)
        if f.base or not (w and f.end <= w.end and f.value in w.value):
            yield f
        if not w or f.end > w.end:
            widest[f.kind] = f


_FOUND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("layers", pa.string()), ("value", pa.string())])
_RESULT = "found array<struct<kind string, start long, end long, base boolean, layers string, value string>>, n_layers long, n_unopened long"


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, found (in order of start, then kind as in KINDS: kind, start, end, whether it is of the plain text, the layers it was
    under, and its text there), n_layers and n_unopened."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [secrets(t, max_bytes) for t in batch.column(1).to_pylist()]
            found = pa.array([[vars(f) for f in each] for each, _, _ in rows], pa.list_(_FOUND))
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), found, *counts], ["doc_id", "found", "n_layers", "n_unopened"])

    ship(df.sparkSession)
    chosen = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(scan, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, {_RESULT}")


def joined(found: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    """Of find_secrets(): the number of base matches of each kind, base_sha256 of them, all spans, n_layers and n_unopened."""
    base = F.filter("found", lambda f: f["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: f["base"] & (f["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), "n_layers", "n_unopened")


def redacted(text: str | None, max_bytes: int = MAX_BYTES) -> str | None:
    """The text with each secret, or the run that hides it, replaced by its kind in angle brackets."""
    if not text:
        return text
    merged: list[list] = []
    for f in secrets(text, max_bytes)[0]:
        if merged and f.start < merged[-1][1]:
            merged[-1][1] = max(f.end, merged[-1][1])
        else:
            merged.append([f.start, f.end, f.kind])
    return Rewriting(text, [(a, b, f"<{kind.upper()}>") for a, b, kind in merged]).text if merged else text


def redact_secrets(df: DataFrame, text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """df with secrets in its text replaced."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = list(batch.columns)
            columns[at] = pa.array([redacted(t, max_bytes) for t in columns[at].to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    ship(df.sparkSession)
    names, at = df.columns, df.columns.index(text)
    return df.mapInArrow(clean, df.schema)
