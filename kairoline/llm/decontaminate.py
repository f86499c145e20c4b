"""Benchmark decontamination against a broadcast hash set of test n-grams.

Words are lower-cased runs of a-z, 0-9 and non-ASCII characters. An item's windows are its runs of 13 consecutive
words, or all its words where it has fewer. Windows are kept once each, under the XXH64 of all their words and their
number. Every position of a training text looks up the window that starts there, in each length that the benchmark has,
and a hit is verified word by word. A document's word is hit if it lies in any verified window. What is hit can go by
itself (``remove_spans``) or with its document (``drop_contaminated``).

All of it is built-in expressions. The set is broadcast if its measured size is at most ``max_broadcast_bytes``: then words
are split once for each document, positions are exploded and probed in the same code-generated stage, and only hits, with
one marker row for each document, are shuffled. A larger set is joined by a shuffle of the positions' hashes
alone, a few bytes for each word; texts then meet only the positions whose hash is in the set.

Nulls: a null text has no words (n_words 0, not contaminated). Items with null or wordless text have no window; a null
item_id is left out of the lists. Repeated rows each come back. Documents are told apart by doc_id and the text's
SHA-256, so equal or null doc_ids may repeat. Empty tables on either side are fine. ``drop_contaminated`` and
``remove_spans`` keep all columns of the table, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, lower_ascii

N = 13
#: Measured size of the windows that may be broadcast.
MAX_BROADCAST_BYTES = 64 << 20
#: Digests of texts that may be broadcast, at 64 bytes each.
MAX_BROADCAST_ROWS = 500_000

# a word in a lower-cased text, and one in any text
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(f"({_WORD})"), F.lit(1))


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _window_hash(array: Column, at: Column | int, n: int) -> Column:
    """Of n words from a position; 0-based. The number of words is hashed too, so that lengths don't mix."""
    return F.xxhash64(F.lit(n), *(F.get(array, at + k) for k in range(n)))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """key, n, window (its words) and items (ids as strings), a row for each different window."""
    split = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    each = split.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i") + 1, n).alias("window"))
    once = each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("n", F.size("window"))
    key = reduce(lambda rest, p: F.when(F.col("n") == p, _window_hash(F.col("window"), F.lit(0), p)).otherwise(rest), range(1, n), _window_hash(F.col("window"), F.lit(0), n))
    return once.select(key.alias("key"), "n", "window", "items")


def _probes(lengths: list[int], at: Column) -> Column:
    """key and n of the windows that start at a position, in each length; null where it doesn't fit any more."""
    fits = lambda n: at + n <= F.size("w")
    return F.array(*(F.when(fits(n), F.struct(_window_hash(F.col("w"), at, n).alias("key"), F.lit(n).alias("n"))) for n in lengths))


def find_contamination(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """doc_id, digest (of the text), n_words, hits (start and number of words of verified windows), n_hit, n_items, items
    and contaminated (hit words are at least a twentieth of all) of every row."""
    windows = benchmark_windows(benchmark)
    size = windows.agg(F.sum(F.length(F.concat_ws(" ", "window")) + F.length(F.concat_ws(" ", "items")) + 24).alias("bytes"), F.collect_set("n").alias("lengths")).first()
    docs = df.select(F.col(key).alias("doc_id"), words(F.col(text)).alias("w"), _digest(F.col(text)).alias("digest"))
    lengths = sorted(size["lengths"]) or [N]
    found = (_by_broadcast if (size["bytes"] or 0) <= max_broadcast_bytes else _by_shuffle)(docs, windows, lengths)
    # hits are in order of their start: count what reaches beyond the words counted so far
    first = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("total"))
    end = lambda h: h["i"] + h["n"]
    covered = F.aggregate("hits", first, lambda a, h: F.struct(F.greatest(a["upto"], end(h)).alias("upto"), (a["total"] + F.greatest(end(h) - F.greatest(a["upto"], h["i"]), F.lit(0))).alias("total")))["total"]
    counted = found.withColumn("n_hit", covered.cast("long"))
    return counted.select("doc_id", "digest", F.col("n_words").cast("long").alias("n_words"), "hits", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def _gathered() -> list[Column]:
    return [F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")]


def _by_broadcast(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, digest, n_words, hits and items of every row, in one pass over the texts."""
    marker = windows.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("window"), F.array().cast("array<string>").alias("items"))
    grams = F.broadcast(windows.unionByName(marker))
    # position -1 is the document's marker: it finds the set's marker, so that documents without hits stay. A window whose
    # hash is the marker's key is told from it by its length
    at = docs.select("doc_id", "digest", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("i"))
    keys = [F.when(F.col("i") >= 0, _window_hash(F.col("w"), F.col("i"), n)).otherwise(F.lit(0) if k == 0 else F.lit(None)) for k, n in enumerate(lengths)]
    probes = at.withColumn("key", keys[0]) if len(keys) == 1 else at.withColumn("key", F.explode(F.array(*keys)))
    verified = (F.col("i") < 0) & (F.col("n") == 0) | (F.col("i") >= 0) & (F.col("n") > 0) & (F.slice("w", F.greatest(F.col("i"), F.lit(0)) + 1, F.greatest(F.col("n"), F.lit(1))) == F.col("window"))
    hits = probes.join(grams, "key").where(verified)
    marked = hits.select("doc_id", "digest", F.when(F.col("i") < 0, F.size("w")).alias("n_words"), F.when(F.col("i") >= 0, F.struct("i", "n")).alias("hit"), "items")
    found = marked.groupBy("doc_id", "digest").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("rows"), *_gathered())
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("copy", "rows")


def _by_shuffle(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same where the set is too large to broadcast: first the positions whose hash is in the set, by hashes alone."""
    at = docs.select("digest", "w", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("i"))
    probes = at.select("digest", "i", F.explode(_probes(lengths, F.col("i"))).alias("p")).select("digest", "i", "p.key", "p.n").where("key IS NOT NULL")
    some = probes.join(windows.select("key"), "key", "left_semi").distinct()
    # a text that many rows have counts once from here on
    by_text = some.groupBy("digest").agg(F.collect_list(F.struct("i", "key", "n")).alias("at"))
    texts = docs.join(by_text.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("w").alias("w"))
    read = texts.join(by_text, "digest").select("digest", "w", F.explode("at").alias("p"))
    asked = read.select("digest", F.struct("p.i", "p.n").alias("hit"), F.col("p.key").alias("key"), F.slice("w", F.col("p.i") + 1, F.col("p.n")).alias("window"))
    hits = asked.join(windows.select("key", "window", "items"), ["key", "window"]).groupBy("digest").agg(*_gathered())
    rows = docs.select("doc_id", "digest", F.size("w").alias("n_words")).join(hits, "digest", "left")
    none = "cast(array() as array<struct<i:int,n:int>>)"
    return rows.select("doc_id", "digest", "n_words", F.coalesce("hits", F.expr(none)).alias("hits"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def contamination_report(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(df, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose text isn't contaminated, unchanged.

    Where no more texts are contaminated than may be broadcast, their digests are, and texts aren't shuffled."""
    (dirty,) = fresh(df.columns, "dirty")
    gone = find_contamination(df, benchmark, key, text).where("contaminated").select(F.col("digest").alias(dirty)).distinct()
    gone = Scratch(df.sparkSession, "dirty").write(gone)
    if gone.count() <= max_broadcast_rows:
        gone = F.broadcast(gone)
    return df.join(gone, _digest(df[text]) == F.col(dirty), "left_anti")


def remove_spans(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df with the hit words of its texts removed, whether a document counts as contaminated or not. A run of hit words goes
    with what stands between them and with the gap after it; the rest stays as it was, its case too."""
    found = find_contamination(df, benchmark, key, text).where("n_hit > 0").select("digest", F.explode(F.col("hits")).alias("h")).distinct()
    order = Window.partitionBy("digest").orderBy("h.i", "h.n")
    furthest = F.max(F.col("h.i") + F.col("h.n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("h.i") > furthest, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = found.withColumn("run", run).groupBy("digest", "run").agg(F.min("h.i").alias("a"), F.max(F.col("h.i") + F.col("h.n")).alias("b"))
    digest, spans, own, gaps = fresh(df.columns, "digest", "spans", "own", "gaps")
    by_text = runs.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias(spans)).withColumnRenamed("digest", digest)
    by_text = Scratch(df.sparkSession, "spans").write(by_text)
    if by_text.count() <= max_broadcast_rows:
        by_text = F.broadcast(by_text)
    split = df.join(by_text, _digest(df[text]) == F.col(digest), "left").withColumn(own, F.regexp_extract_all(F.col(text), F.lit(f"({_ANY_CASE})"), F.lit(1))).withColumn(gaps, F.split(F.col(text), _ANY_CASE, -1))

    def between(a: Column, b: Column) -> Column:
        """Words a to b - 1, each with the gap after it."""
        return F.array_join(F.zip_with(F.slice(own, a + 1, b - a), F.slice(gaps, a + 2, b - a), lambda w, g: F.concat(w, g)), "")

    # what stays: before each run, from the end of the one before it; and after the last
    ends = F.transform(spans, lambda s: s["b"])
    starts = F.concat(F.transform(spans, lambda s: s["a"]), F.array(F.size(own)))
    kept = F.zip_with(F.concat(F.array(F.lit(0)), ends), starts, between)
    cut = F.concat(F.get(gaps, 0), F.array_join(kept, ""))
    return split.select(*(F.when(F.col(spans).isNull(), F.col(text)).otherwise(cut).alias(c) if c == text else split[c] for c in df.columns))
