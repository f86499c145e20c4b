"""Transcripts: timed tokens (conv_id, segment, pos, text, start_cs, end_cs, probability) to words and segments.

A token that begins with white space begins a word. Times never run backwards: each start is at least the largest end
before it, which is a running maximum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPACE = r"[\s\p{Z}]+"


def is_special(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike(r"(?s)^<\|.*\|>$") | t.rlike(r"^\[[A-Z0-9_\-:.]+\]$")


def normalize_spacing(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def without_special(text: Column) -> Column:
    return F.array_join(F.filter(F.split(normalize_spacing(text), " "), lambda x: (x != "") & ~is_special(x)), " ")


def probability(p: Column) -> Column:
    return F.when(F.isnan(p), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def clamp_segments(segments: DataFrame, group: str, order: str) -> DataFrame:
    """start_cs and end_cs made monotone within a group."""
    raw_start = F.greatest(F.col("start_cs"), F.lit(0))
    raw_end = F.greatest(F.col("end_cs"), F.lit(0))
    w = Window.partitionBy(group).orderBy(order)
    before = F.coalesce(F.max(F.greatest(raw_start, raw_end)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.greatest(raw_start, before)
    return segments.withColumn("_s", start).withColumn("_e", F.greatest(raw_end, start)).withColumn("start_cs", F.col("_s")).withColumn("end_cs", F.col("_e")).drop("_s", "_e")


def words(tokens: DataFrame, segments: DataFrame) -> DataFrame:
    """conv_id, segment, word (a number from 1), text, start_cs, end_cs and probability. segments gives the clamped
    start and end of each; special, blank and untimed tokens drop out."""
    one = F.struct("pos", "text", F.col("start_cs").cast("long").alias("start_cs"), F.col("end_cs").cast("long").alias("end_cs"), F.col("probability").cast("double").alias("probability"))
    lists = tokens.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(one)).alias("tokens"))
    return words_of(lists.join(segments.select("conv_id", "segment", "start_cs", "end_cs"), ["conv_id", "segment"]))


def words_of(lists: DataFrame) -> DataFrame:
    """``words`` of segments whose tokens are lists (conv_id, segment, its clamped start_cs and end_cs, and tokens in their order: text, start_cs,
    end_cs, probability). Nothing is shuffled or sorted; many segments are worked out over the arrays of one batch."""
    space, end = r"[ \t\n\x0B\f\r\p{Z}]", r"(\r\n|[\n\r\x{85}\x{2028}\x{2029}])?$"
    special = (r"(?s)^<\|.*\|>" + end, r"^\[[A-Z0-9_\-:.]+\]" + end)
    kind = "struct<word: int, text: string, start_cs: bigint, end_cs: bigint, probability: double>"
    made = pa.list_(pa.struct([("word", pa.int32()), ("text", pa.string()), ("start_cs", pa.int64()), ("end_cs", pa.int64()), ("probability", pa.float64())]))

    def assembled(tokens: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        n = len(tokens)
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
        flat = tokens.flatten()
        text, since, until, chance = (pc.struct_field(flat, i) for i in ("text", "start_cs", "end_cs", "probability"))
        bare = pc.utf8_trim(text, " ")
        odd = pc.or_(pc.match_substring_regex(bare, special[0]), pc.match_substring_regex(bare, special[1]))
        real = pc.and_(pc.and_(pc.not_equal(bare, ""), pc.invert(odd)), pc.and_(pc.is_valid(since), pc.is_valid(until)))
        used = np.flatnonzero(pc.fill_null(real, False).to_numpy(zero_copy_only=False))
        row, text = row[used], text.take(pa.array(used))
        since, until = (x.take(pa.array(used)).to_numpy() for x in (since, until))
        chance = chance.take(pa.array(used)).to_numpy(zero_copy_only=False), chance.take(pa.array(used)).is_null().to_numpy(zero_copy_only=False)
        chance = np.where(chance[1], 1.0, np.clip(np.nan_to_num(chance[0].astype(float), nan=0.0), 0.0, 1.0))
        starts = pc.match_substring_regex(text, "^" + space).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(starts | np.r_[True, np.diff(row) != 0]) if len(row) else np.zeros(0, np.int64)
        if not len(heads):
            return pa.array([[]] * n, made)
        piece = pc.if_else(pa.array(starts), pc.utf8_ltrim(text, " "), text)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[heads, len(row)], pa.int32()), piece), "")
        whole = pc.utf8_trim(pc.replace_substring_regex(joined, space + "+", " "), " ")
        a = np.maximum(since, 0)
        first, last = np.minimum.reduceat(a, heads), np.maximum.reduceat(np.maximum(until, a), heads)
        mean = np.add.reduceat(chance, heads) / np.diff(np.r_[heads, len(row)])
        kept = np.flatnonzero(pc.not_equal(whole, "").to_numpy(zero_copy_only=False))
        own, whole, first, last, mean = row[heads][kept], whole.take(pa.array(kept)), first[kept], last[kept], mean[kept]
        low, high = low.to_numpy()[own], high.to_numpy()[own]
        start, stop = np.maximum(low, np.minimum(first, high)), np.minimum(last, high)
        # a word starts at the largest end before it in its segment, at least
        bounds = np.searchsorted(own, np.arange(n + 1))
        reached = np.maximum(start, stop)
        before = low.copy()
        for i, j in zip(bounds, bounds[1:], strict=False):
            if j - i > 1:
                before[i + 1 : j] = np.maximum.accumulate(reached[i : j - 1])
        start = np.maximum(start, before)
        number = np.arange(len(own)) - bounds[own] + 1
        out = pa.StructArray.from_arrays([pa.array(number.astype(np.int32)), whole, pa.array(start), pa.array(np.maximum(stop, start)), pa.array(mean)], fields=list(made.value_type))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), out).cast(made)

    every = F.arrow_udf(assembled, f"array<{kind}>")
    bound = lambda c: F.col(c).cast("long")
    return lists.select("conv_id", "segment", F.explode(every("tokens", bound("start_cs"), bound("end_cs"))).alias("_w")).select("conv_id", "segment", "_w.*")


def segment_confidence(words_: DataFrame, fallback: float = 1.0) -> DataFrame:
    return words_.groupBy("conv_id", "segment").agg(F.coalesce(F.avg("probability"), F.lit(fallback)).alias("confidence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("start_cs").alias("start_cs"), F.max("end_cs").alias("end_cs"))


def to_moments(words_: DataFrame) -> DataFrame:
    """Words and their segments as moment rows with seconds and an indexed payload."""
    payload = lambda index: F.to_json(F.struct(F.lit(1).alias("v"), index.alias("index"), F.col("text")))
    one = lambda df, kind, confidence, index: df.select("conv_id", F.lit(kind).alias("kind"), (F.col("start_cs") / 100.0).alias("start_seconds"), (F.col("end_cs") / 100.0).alias("end_seconds"), F.col(confidence).alias("confidence"), payload(index).alias("payload"))
    word = F.row_number().over(Window.partitionBy("conv_id").orderBy("segment", "word")) - 1
    segs = segment_confidence(words_)
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("segment")) - 1
    return one(words_.withColumn("_i", word), "transcript_word", "probability", F.col("_i")).unionByName(one(segs.withColumn("_i", number), "transcript_segment", "confidence", F.col("_i")))
