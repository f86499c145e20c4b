"""The fill-in-the-middle transformation, by an index of distinct texts.

Documents are grouped by the SHA-256 of their text, and the groups are verified: the set of a group's texts, compared
character by character, must be one, else the job stops. For each distinct text the boundaries of its units (code points, words or lines, as byte offsets) are
computed once, as an Elias-Fano list. Documents, which carry no text then, are joined back to the index as the members of its groups,
and each takes two boundaries from the list by its own seeded hashes; outputs are cut from the text's bytes in the JVM. A text that
no two documents share is shuffled once.

A text that many documents share is dealt out: a group larger than a quarter of a shuffle partition's share of
documents is split by the hash of the key into parts that don't exceed it. At most four groups for each shuffle partition are that
large, so their list may be broadcast. A part computes its list once, and has no more members than a quarter of a partition.

Form: ``plain`` where the text is empty or contains a marker, or where the third hash says so; of the others ``spm`` (suffix, prefix,
middle) where the fourth hash says so, else ``psm`` (prefix, suffix, middle). A null text counts as empty, a null key as the empty
key. Repeated rows come back as often as they are; rows with one key and one text get one cut. Columns other than key, text and
``keep`` are not read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import elias_fano
from .common import Scratch, ship

MARKERS = ("<P>", "<S>", "<M>")
UNITS = ("chars", "words", "lines")
#: Percent of documents cut, and of these the percent with the suffix first.
RATE = 90
SUFFIX_FIRST = 20
_CHUNK = 1 << 20


def _starts(text: bytes, units: str) -> Iterator[np.ndarray]:
    """Byte offsets at which units start, in chunks. A word goes on to the next one; space before the first is a unit."""
    for a in range(0, len(text), _CHUNK):
        # one byte before the chunk tells whether its first begins a unit
        b = np.frombuffer(text, np.uint8, min(_CHUNK, len(text) - a) + (a > 0), a - (a > 0))
        if units == "chars":
            new = (b & 0xC0) != 0x80
        elif units == "lines":
            new = np.concatenate([[a == 0], b[:-1] == 10])
        else:
            space = (b == 32) | (b >= 9) & (b <= 13)
            new = np.concatenate([[a == 0], space[:-1] & ~space[1:]])
        yield np.flatnonzero(new[1:] if a else new) + a


def boundaries(text: bytes, units: str = "chars") -> bytes:
    """The Elias-Fano list of where the units start, and of the text's end: one number more than units."""
    n = sum(map(len, _starts(text, units)))

    def parts() -> Iterator[np.ndarray]:
        yield from _starts(text, units)
        yield np.array([len(text)])

    return elias_fano.encode(parts(), n + 1, len(text))


def _cuts(units: str):
    """The distinct text's bytes, and the hashes of its documents -> for each of these the number of units, and the two boundaries
    that its hashes choose, in units and in bytes."""

    def cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        out: list[tuple[int, ...]] = []
        sizes = [0]
        for text, xs, ys in zip(texts, first.to_pylist(), second.to_pylist(), strict=True):
            code = boundaries(text.as_py(), units)
            n = elias_fano.count(code) - 1
            chosen = [sorted((x % (n + 1), y % (n + 1))) for x, y in zip(xs, ys, strict=True)]
            at = elias_fano.select(code, [k for pair in chosen for k in pair])
            out += [(n, lo, hi, at[2 * k], at[2 * k + 1]) for k, (lo, hi) in enumerate(chosen)]
            sizes.append(len(out))
        columns = [pa.array([row[k] for row in out], pa.int64()) for k in range(5)]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, ["n", "lo", "hi", "a", "b"]))

    return F.arrow_udf(cuts, "array<struct<n long, lo long, hi long, a long, b long>>")


def seeded(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits: the leading hex digits of the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers))
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _dealt(df: DataFrame, many: DataFrame) -> DataFrame:
    part = F.pmod(F.xxhash64("_own.doc_id"), F.coalesce("_parts", F.lit(1)))
    return df.join(F.broadcast(many), "_digest", "left").withColumn("_part", part).drop("_parts")


def fill_in_middle(df: DataFrame, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, units: str = "chars", markers: tuple[str, str, str] = MARKERS, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, n (units of the text), form, prefix_chars, middle_chars (code points; null if plain), output."""
    if units not in UNITS:
        raise ValueError(f"units are one of {UNITS}")
    if len({*markers}) < 3 or any(m[0] in m[1:] for m in markers) or len({m[0] for m in markers}) > 1:
        raise ValueError("markers must differ, and begin with one character that they don't repeat, so that cuts can't make one")
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "infill")
    whole = F.coalesce(F.col(text), F.lit(""))
    if len({"doc_id", *(k.lower() for k in keep)}) <= len(keep):
        raise ValueError("columns to keep can't be named doc_id or as another one")
    # in a struct, whose fields clash with no name used here
    chosen = df.select(F.struct(F.col(key).alias("doc_id"), *keep).alias("_own"), whole.alias("_text"))
    digest = F.unhex(F.sha2("_text", 256)).alias("_digest")
    docs = scratch.write(chosen.select("_own", digest))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = max(16, docs.count() // (4 * parts))
    many = docs.groupBy("_digest").agg(F.count("*").alias("n")).where(F.col("n") > share).select("_digest", F.ceil(F.col("n") / share).alias("_parts"))
    # a set of one text: all of the group's texts are equal
    groups = _dealt(chosen.select("_own", "_text", digest), many).groupBy("_digest", "_part").agg(F.collect_set("_text").alias("_texts"))
    verified = F.when(F.size("_texts") == 1, F.col("_texts")[0]).otherwise(F.raise_error(F.lit("two texts have one SHA-256")))
    index = groups.select("_digest", "_part", verified.cast("binary").alias("_bytes"))

    h1, h2, h3, h4 = (h.alias(f"h{k}") for k, h in enumerate(seeded(F.col("_own.doc_id"), seed), 1))
    own = F.struct("_own", h1, h2, h3, h4)
    members = _dealt(docs, many).groupBy("_digest", "_part").agg(F.collect_list(own).alias("_docs"))
    joined = index.join(members, ["_digest", "_part"]).withColumn("_cuts", _cuts(units)("_bytes", "_docs.h1", "_docs.h2"))
    cut = joined.select("_bytes", F.explode(F.arrays_zip("_docs", "_cuts")).alias("_x")).select("_bytes", F.col("_x._docs").alias("_d"), F.col("_x._cuts").alias("_c"))
    h3, h4 = F.col("_d.h3"), F.col("_d.h4")
    piece = lambda a, b: F.substring("_bytes", (a + 1).cast("int"), (b - a).cast("int"))
    a, b = F.col("_c.a"), F.col("_c.b")
    p, m, s = piece(F.lit(0), a), piece(a, b), piece(b, F.length("_bytes").cast("long"))
    string = F.col("_bytes").cast("string")
    marked = F.lit(False)
    for x in markers:
        marked = marked | F.contains(string, F.lit(x))
    form = F.when((F.length("_bytes") == 0) | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    at = {k: F.lit(v.encode()) for k, v in zip("psm", markers, strict=True)}
    shaped = F.when(F.col("form") == "psm", F.concat(at["p"], p, at["s"], s, at["m"], m)).when(F.col("form") == "spm", F.concat(at["s"], s, at["p"], p, at["m"], m)).otherwise(F.col("_bytes"))
    cut_only = lambda c: F.when(F.col("form") != "plain", F.length(c.cast("string")).cast("long"))
    return cut.withColumn("form", form).select(*(F.col("_d._own")[c].alias(c) for c in ("doc_id", *keep)), F.col("_c.n").alias("n"), "form", cut_only(p).alias("prefix_chars"), cut_only(m).alias("middle_chars"), shaped.cast("string").alias("output"))
