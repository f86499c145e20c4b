"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint is the majority of each bit over the XXH64 of its shingles. Texts with equal fingerprints form a
class. The fingerprints of classes are joined within ``threshold`` bits by a covering code (see covering.py): every fingerprint
is at home at one anchor, and is replicated to all anchors within the covering radius plus the threshold; per anchor,
what is at home is compared with what visits. Every linked pair meets where the smaller one is at home. Links are
between classes, so copies of a text, however many, add none; nothing is collected.

Fingerprints spread over 2**26 anchors. A crowded anchor is a skewed partition of a sort-merge join, which AQE
splits.

Nulls: a null or wordless text has fingerprint zero, linked like any other. A null doc_id is in its component, but isn't
its smallest doc_id unless there is no other. Repeated rows each come back. Other columns are not read. Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import covering
from .common import Scratch, fresh, ship, sliced
from .components import connected_components

SHINGLE = 3
THRESHOLD = 2
SEED = 42
#: Names of rows that may be broadcast, at 17 bytes each.
MAX_BROADCAST_ROWS = 1_000_000
#: Shingles whose bits are unpacked at once.
_CHUNK = 1 << 15


def shingle_digests(text: str, size: int, seed: int) -> Iterator[list[bytes]]:
    """XXH64 of each run of words, as bytes, in lists of _CHUNK at most."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only; at the six ASCII spaces
    if not words:
        return
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_digest
    for i in range(0, len(words) - size + 1, _CHUNK):
        j = min(i + _CHUNK, len(words) - size + 1)
        yield [digest(joined[a : b - 1], seed) for a, b in zip(starts[i:j], ends[i + size - 1 : j + size - 1], strict=True)]


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    total, n = np.zeros(64, np.int64), 0
    for part in shingle_digests(text or "", size, seed):
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.uint32)
        n += len(part)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    ship(df.sparkSession)
    chosen = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, size, seed) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return chosen.mapInArrow(scan, T.StructType([chosen.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _at_anchors(classes: DataFrame, beyond: int) -> DataFrame:
    """anchor, fp."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2048):
                words = batch.column(0).slice(part, 2048).to_numpy()
                index, anchor = covering.anchors(words.view(np.uint64), beyond)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(words[index])], ["anchor", "fp"])

    return classes.select("fp").mapInArrow(scan, "anchor long, fp long")


def links(classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """u, v: pairs of different fingerprints (fp) at most ``threshold`` bits apart, v the smaller, each once."""
    ship(classes.sparkSession)
    home = _at_anchors(classes, 0).select("anchor", F.col("fp").alias("v"))
    visitors = _at_anchors(classes, threshold).select("anchor", F.col("fp").alias("u"))
    return visitors.join(home, "anchor").where((F.col("v") < F.col("u")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold)).select("u", "v")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) of every row."""
    scratch = Scratch(df.sparkSession, "simhash")
    docs = scratch.write(fingerprints(df, key, text, size, seed))
    classes = scratch.write(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(classes, threshold), scratch)
    rooted = classes.join(roots, classes["fp"] == roots["vertex"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    components = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # two joins on narrow rows, so that a large class or component is only a skewed partition
    of_class = scratch.write(rooted.join(components, "root").select("fp", "component_id"))
    return docs.join(of_class, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast_rows: int = MAX_BROADCAST_ROWS, **how) -> DataFrame:
    """df's rows with one of each component: that of the smallest doc_id (null last), of several texts with that doc_id the
    one of the smallest hash, of equal rows any.

    All columns stay, whatever their names; of them only key and text are read.
    Where no more rows go than may be broadcast, their names are, and texts aren't shuffled."""
    scratch = Scratch(df.sparkSession, "keep")
    h = F.xxhash64(F.col(text))
    names = df.select(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("k"), h.alias("h")).alias("doc_id"), F.col(text).alias("text"))
    found = scratch.write(near_duplicates(names, "doc_id", "text", **how).select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
    rows = found.groupBy("doc_id", "kept").count()
    n = rows.agg(F.count_if(~F.col("kept")).alias("gone"), F.max(F.when(F.col("kept"), F.col("count"))).alias("most")).first()
    k, g = fresh(df.columns, "k", "h")
    picked = lambda kept: found.where(F.col("kept") == kept).select(F.col("doc_id.k").alias(k), F.col("doc_id.h").alias(g)).distinct()
    same = df[key].eqNullSafe(F.col(k)) & (F.xxhash64(df[text]) == F.col(g))
    if n["gone"] <= max_broadcast_rows:
        out = df.join(F.broadcast(picked(False)), same, "left_anti")
    else:
        out = df.join(picked(True), same, "left_semi")
    return out.dropDuplicates([key, text]) if (n["most"] or 1) > 1 else out
