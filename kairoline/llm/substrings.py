"""Exact removal of repeated substrings by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of a smaller id, or in the
same document before. Sorting all suffixes of all documents would move a hundred times the input, so suffixes are sorted
where repeats can be, without losing any:

1. *Anchors.* Every window of ``length`` bytes holds a ``gram``-byte string of the least hash, the leftmost of equals. Equal
   windows have it at the same offset, so windows can only be equal if they share their anchor's string. Windows of
   one anchor are consecutive; together they are its context, at most 2 * length - gram bytes.
2. *Equal contexts.* Each task keeps the first of equal contexts (by the 128-bit BLAKE2b of their bytes and of the anchor's place
   in them) and removes the others. What is left is dealt by anchor string, and again all but the first of equal
   contexts go. Anchors whose string occurs in one context only are done with. So copies, however many, leave
   one context for each task before the shuffle, and one after it.
3. *Merge sort.* The other contexts are suffixes from the anchor on, followed by what precedes the anchor, reversed. Each task
   sorts its own, front-codes the run and sends it to the anchor's bucket. A loser tree that knows common prefixes merges
   the runs of a bucket. Contexts of an anchor come out together; how much each shares with its neighbours tells which
   of its windows may be repeats at all, and those are compared byte by byte, earlier documents first.
4. *Crowded anchors.* An anchor with more than ``crowd`` different contexts sends its windows each by itself, as strings of
   ``length`` bytes, dealt by their own hash: runs hold equal strings once, so no bucket gathers the crowd.

Nulls: a null text is empty. Documents are in order of doc_id, null last; rows of one doc_id are in order of a hash of
their text, and of equal rows all but one count as later copies. Empty texts and tables are fine. Columns other than key and text
are not read. Texts of any length are cut into overlapping pieces, so memory is bounded by the largest single text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frontcode
from .common import Scratch, ship, sliced

LENGTH = 100
GRAM = 24
CROWD = 5000
#: Bytes hashed at once, and anchors whose contexts a task compares before it sends them on.
PIECE = 1 << 20
HELD = 1 << 20
#: Crowded anchors whose list may be broadcast, at 16 bytes each; beyond, it is joined by a shuffle.
MAX_CROWDS = 1_000_000
#: Bytes of strings that a task sorts into one run, and contexts in a bucket on average.
RUN_BYTES = 24 << 20
BUCKET = 40_000

_BYTE = [bytes([k]) for k in range(256)]
_OWN = "<qqBB"  # document, anchor, bytes from the first and from the last window's start to the anchor
_MANTISSA = np.uint64(0xFF51AFD7ED558CCD)
_BACK, _FORTH = 14, 7  # bits of the packed place of an anchor below its position, and of the first part of these


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _MANTISSA
    return x ^ (x >> np.uint64(29))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random word for each byte, and powers of an odd base and of its inverse modulo 2**64."""
    words = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    # room for a last piece with the bytes that it shares with the next
    size = PIECE + (1 << 16)
    up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return words, np.cumprod(up), np.cumprod(down)


def _least_in_windows(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w values, the place of the least, the leftmost of equals. w is below 128."""
    n = len(h) - w + 1
    padded = np.full(-(-len(h) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    # seven bits tell the place in its block of w; so the leftmost of equals is the least
    padded[: len(h)] = h & ~np.uint64(127)
    grid = padded.reshape(-1, w) | np.arange(w, dtype=np.uint64)
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    head = np.minimum.accumulate(grid, axis=1).ravel()[w - 1 : w - 1 + n]
    at = np.arange(n)
    by_tail = (tail >> np.uint64(7)) <= (head >> np.uint64(7))
    inside = np.where(by_tail, tail, head) & np.uint64(127)
    return np.where(by_tail, at, at + w - 1) // w * w + inside.astype(np.int64)


def contexts(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """pieces: document, offset in it and bytes. Anchor hash, the two halves of the context's hash, document, anchor, first and
    last window start of each context; offsets are in the document."""
    pieces = [p for p in pieces if len(p[2]) >= length]
    if not pieces:
        return tuple(np.zeros(0, np.uint64 if k < 3 else np.int64) for k in range(7))
    words, up, down = _powers()
    joined = b"".join(p[2] for p in pieces)
    data = np.frombuffer(joined, np.uint8)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words[data] * up[:n], out=sums[1:])
    h = _mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    anchor = _least_in_windows(h, length - gram + 1)
    sizes = np.array([len(p[2]) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    valid = np.zeros(n - length + 1, bool)
    for a, size in zip(starts, sizes, strict=True):
        valid[a : a + size - length + 1] = True
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    lo, hi = np.nonzero(first)[0], np.nonzero(last)[0]
    q = anchor[lo]
    # a context is told by its bytes, and by where in it the anchor is
    digest = hashlib.blake2b
    digests = b"".join([digest(joined[a:b] + _BYTE[k], digest_size=16).digest() for a, b, k in zip(lo.tolist(), (hi + length).tolist(), (q - lo).tolist(), strict=True)])
    context = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    piece = np.searchsorted(starts, lo, "right") - 1
    shift = np.array([p[1] for p in pieces])[piece] - starts[piece]
    return h[q], context[:, 0], context[:, 1], np.array([p[0] for p in pieces])[piece], q + shift, lo + shift, hi + shift


def pieces_of(document: int, data: bytes, length: int, size: int = PIECE) -> Iterator[tuple[int, int, bytes]]:
    """A text as pieces whose windows are the text's, each once."""
    for at in range(0, max(1, len(data) - length + 1), size):
        yield document, at, data[at : at + size + length - 1]


def _joined_ranges(document: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges that touch or overlap as one; of a document's ranges, later starts have later ends."""
    order = np.lexsort((a, document))
    document, a, b = document[order], a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (document[1:] != document[:-1]) | (a[1:] > b[:-1])
    at = np.nonzero(new)[0]
    return document[at], a[at], b[np.append(at[1:], len(b)) - 1] if len(b) else b


_ROW = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "context", "check", "rid", "place")])


def _row_batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], _ROW.names)


def _first_contexts(length: int, gram: int):
    """rid, text -> rows of contexts, each task's first of equals; and ranges to remove, which have place < 0:
    context is the start and -place the end."""

    def settle(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        anchor, context, check, rid, q, lo, hi = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((q, rid, check, context, anchor))
        anchor, context, check, rid, q, lo, hi = (c[order] for c in (anchor, context, check, rid, q, lo, hi))
        again = np.zeros(len(q), bool)
        again[1:] = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1]) & (check[1:] == check[:-1])
        keep = ~again
        place = (q << _BACK) | ((q - lo) << _FORTH) | (q - hi)
        for i in range(0, int(keep.sum()), 1 << 16):
            yield _row_batch(*(c[keep][i : i + (1 << 16)] for c in (anchor, context, check, rid, place)))
        rid, a, b = _joined_ranges(rid[again], lo[again], hi[again] + length)
        if len(rid):
            yield _row_batch(_mixed(rid.astype(np.uint64)), a, a, rid, -b)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, pieces, size = [], 0, [], 0
        for batch in sliced(batches):
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in pieces_of(rid, (text or "").encode("utf-8", "surrogatepass"), length):
                    if size + len(piece[2]) > PIECE and pieces:
                        parts.append(contexts(pieces, length, gram))
                        held += len(parts[-1][0])
                        pieces, size = [], 0
                    pieces.append(piece)
                    size += len(piece[2])
                    if held >= HELD:
                        yield from settle(parts)
                        parts, held = [], 0
        if pieces:
            parts.append(contexts(pieces, length, gram))
        if parts:
            yield from settle(parts)

    return scan


_FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "rid", "a", "b")])


def _by_anchor(length: int):
    """Rows in order of anchor, context, check, rid and place -> ranges to remove (anchor null: rid, start, end), and the
    contexts of anchors that have several (a: place, b: 0)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None, None)  # anchor and context of the row before
        pending = None  # an anchor's only context so far
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, context, check, rid, place = (c.to_numpy() for c in batch.columns)
            ready = place < 0
            out = [(np.zeros(int(ready.sum()), np.int64), np.zeros(int(ready.sum()), bool), rid[ready], context[ready], -place[ready])]
            anchor, context, check, rid, place = (c[~ready] for c in (anchor, context, check, rid, place))
            if len(anchor):
                same_anchor, same = np.zeros(len(anchor), bool), np.zeros(len(anchor), bool)
                same_anchor[1:] = anchor[1:] == anchor[:-1]
                same[1:] = same_anchor[1:] & (context[1:] == context[:-1]) & (check[1:] == check[:-1])
                same_anchor[0] = anchor[0] == last[0]
                same[0] = same_anchor[0] and (context[0], check[0]) == last[1:]
                q = place[same] >> _BACK
                lo, hi = q - (place[same] >> _FORTH & 127), q - (place[same] & 127)
                out.append((np.zeros(len(q), np.int64), np.zeros(len(q), bool), rid[same], lo, hi + length))
                heads = np.nonzero(~same)[0]
                if len(heads):
                    follows = same_anchor[heads]  # a context of the same anchor comes before
                    followed = np.append(follows[1:], False)
                    if pending is not None and follows[0]:
                        out.append(tuple(np.array([x]) for x in (pending[0], True, pending[1], pending[2], 0)))
                    some = heads[follows | followed]
                    out.append((anchor[some], np.ones(len(some), bool), rid[some], place[some], np.zeros(len(some), np.int64)))
                    alone = not (follows[-1] or followed[-1])
                    pending = (anchor[heads[-1]], rid[heads[-1]], place[heads[-1]]) if alone else None
                last = (anchor[-1], context[-1], check[-1])
            known, valid, *rest = (np.concatenate(c) for c in zip(*out, strict=True))
            if len(known):
                yield pa.RecordBatch.from_arrays([pa.array(known, mask=~valid), *map(pa.array, rest)], _FOUND.names)

    return scan


def _sorted_runs(length: int, buckets: int):
    """rid, text and its contexts -> bucket and a front-coded run."""

    def bucket_of(key: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "big") % buckets

    def flush(by_bucket: dict[int, list[frontcode.Item]]) -> Iterator[pa.RecordBatch]:
        for bucket, items in sorted(by_bucket.items()):
            items.sort()
            whole = []
            for key, own in items:  # crowded windows: the first of equals, as runs need it once
                if own[0:1] == b"w" and whole and whole[-1][0] == key and whole[-1][1][0:1] == b"w":
                    whole[-1] = (key, whole[-1][1] + own[1:])
                else:
                    whole.append((key, own))
            for i in range(0, len(whole), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([frontcode.encode(_few(whole[i : i + (1 << 16)]))], pa.binary())], ["bucket", "run"])

    def _few(items: list[frontcode.Item]) -> list[frontcode.Item]:
        """What goes with a string must fit into a run's head: more places than that make the string come again."""
        out = []
        for key, own in items:
            if len(own) <= 1 + 16 * 4000:
                out.append((key, own))
            else:
                out.extend((key, b"w" + own[j : j + 16 * 4000]) for j in range(1, len(own), 16 * 4000))
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[frontcode.Item]] = {}
        size = 0
        for batch in sliced(batches):
            for rid, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                for x in found:
                    place = x["place"]
                    q = place >> _BACK
                    lo, hi = q - (place >> _FORTH & 127), q - (place & 127)
                    if x["crowded"]:
                        items = [(data[s : s + length], b"w" + struct.pack("<qq", rid, s)) for s in range(lo, hi + 1)]
                        for key, own in items:
                            by_bucket.setdefault(bucket_of(key), []).append((key, own))
                        size += (length + 100) * len(items)
                    else:
                        key = data[q : hi + length] + data[lo:q][::-1]
                        by_bucket.setdefault(x["anchor"] % buckets, []).append((key, b"c" + struct.pack(_OWN, rid, q, q - lo, q - hi)))
                        size += len(key) + 100
                if size >= RUN_BYTES:
                    yield from flush(by_bucket)
                    by_bucket, size = {}, 0
        yield from flush(by_bucket)

    return scan


_RANGE = T.StructType([T.StructField(n, T.LongType()) for n in ("rid", "a", "b")])


def repeated_windows(runs: list[bytes], length: int, gram: int) -> Iterator[tuple[int, int]]:
    """Document and start of each window in the merged runs that also starts earlier."""

    def windows(group: list[tuple[bytes, bytes, int]]) -> Iterator[tuple[int, int]]:
        if len(group) < 2:
            return
        seen: set[bytes] = set()
        # the first document first; most: what the context shares with any other, at most
        for rid, q, back, forth, key, most in sorted((*struct.unpack(_OWN, own[1:]), key, most) for key, own, most in group):
            right = length - forth  # bytes from the anchor on: the last window starts furthest right
            text = key[right:][::-1] + key[:right]
            # a window that starts i bytes before the anchor has length - i bytes from the anchor on
            for i in range(back, max(forth, length - most) - 1, -1):
                window = text[back - i : back - i + length]
                if window in seen:
                    yield rid, q - i
                else:
                    seen.add(window)

    group: list[tuple[bytes, bytes, int]] = []
    places: list[tuple[int, int]] = []
    crowded, since = b"", 0  # since: what the next string shares with the last context, at most
    for key, shared, own in frontcode.merge(runs):
        shared = since = min(since, shared)
        if own[0:1] == b"w":
            if key != crowded:
                yield from sorted(places)[1:]
                places, crowded = [], key
            places.extend(struct.iter_unpack("<qq", own[1:]))
            continue
        if group and shared < gram:
            yield from windows(group)
            group = []
        elif group:
            group[-1] = (*group[-1][:2], max(group[-1][2], shared))
        group.append((key, own, shared if group else 0))
        since = len(key)
    yield from windows(group)
    yield from sorted(places)[1:]


def _merged(length: int, gram: int):
    """bucket and run, in order of bucket -> ranges to remove."""

    def ranges(runs: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = repeated_windows(runs, length, gram)
        while some := list(islice(found, 1 << 16)):  # ranges may touch those of the next lot; they are joined at the end
            rid, s = np.array(sorted(some), np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _joined_ranges(rid, s, s + length)], _RANGE.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, now = [], None
        for batch in batches:
            for bucket, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now:
                    yield from ranges(runs)
                    runs, now = [], bucket
                runs.append(run)
        yield from ranges(runs)

    return scan


def _numbered(df: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """rid, doc_id, text and copies: documents in order of rid. Equal rows are one, with their number.

    As a rule doc_ids are there and differ, and are the numbers."""
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = docs.select("doc_id").groupBy("doc_id").count().agg(F.max("count").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if not ids["nulls"] and (ids["most"] or 1) == 1:
        return docs.select(F.col("doc_id").cast("long").alias("rid"), "doc_id", "text", F.lit(1).cast("long").alias("copies"))
    once = docs.groupBy("doc_id", F.xxhash64("text").alias("h"), F.sha2(F.col("text").cast("binary"), 256).alias("s")).agg(F.count("*").alias("copies"))
    span = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("h", "s")) - 1
    # ids from 0 up, null after the last, each with room for the most rows that one id has
    number = (F.coalesce(F.col("doc_id"), F.lit(high + 1)) - low) * ids["most"] + rank
    table = scratch.write(once.withColumn("rid", number.cast("long")))
    named = docs.withColumn("s", F.sha2(F.col("text").cast("binary"), 256)).dropDuplicates(["doc_id", "s"])
    return named.alias("d").join(table.alias("t"), F.expr("d.doc_id <=> t.doc_id AND d.s = t.s")).select("t.rid", "d.doc_id", "d.text", "t.copies")


def repeated_ranges(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """rid, a, b: byte ranges to remove from docs (rid, text); they may overlap."""
    if not 1 <= gram < length <= gram + 126:
        raise ValueError("gram must be below length, by 126 at most")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("rid", "text").mapInArrow(_first_contexts(length, gram), _ROW)
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "context", "check", "rid", "place")
    found = scratch.write(dealt.mapInArrow(_by_anchor(length), _FOUND))
    several = found.where(F.col("anchor").isNotNull())
    n = several.count()
    ready = found.where(F.col("anchor").isNull()).select("rid", "a", "b")
    if not n:
        return ready
    crowds = several.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor", F.lit(True).alias("crowded"))
    if n // crowd <= MAX_CROWDS:  # there are no more crowds than that
        crowds = F.broadcast(crowds)
    marked = several.join(crowds, "anchor", "left").select("rid", F.struct("anchor", F.col("a").alias("place"), F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("x"))
    by_document = marked.groupBy("rid").agg(F.collect_list("x").alias("found"))
    texts = docs.select("rid", "text").join(by_document, "rid").select("rid", "text", "found")
    runs = texts.mapInArrow(_sorted_runs(length, max(1, n // BUCKET)), "bucket long, run binary")
    merged = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merged(length, gram), _RANGE)
    return ready.unionByName(scratch.write(merged))


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, apart from each other and in order) and kept (the remaining bytes)
    of every row."""
    scratch = Scratch(df.sparkSession, "substrings")
    docs = _numbered(df, key, text, scratch)
    spans = repeated_ranges(docs, scratch, length, gram, crowd).groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("found"))
    joined = docs.join(spans, "rid", "left").select("doc_id", "text", "copies", "found")
    span = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc, text_, copies, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text_ or "").encode("utf-8", "surrogatepass")
                own = merged_spans([(x["a"], x["b"]) for x in found or ()])
                rows.append((doc, len(data), own, _kept(data, own)))
                if copies > 1:  # later copies of a row keep only what is too short to be a repeat
                    gone = [(0, len(data))] if len(data) >= length else []
                    rows.extend([(doc, len(data), gone, _kept(data, gone))] * (copies - 1))
            docs_, sizes, removed, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(docs_, batch.schema.field(0).type), pa.array(sizes, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in r] for r in removed], kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    schema = T.StructType([T.StructField("doc_id", joined.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(scan, schema)


def report(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return removed.select("doc_id", "n_bytes", total.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
