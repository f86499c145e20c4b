"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words. Each source gets a share of all sizes by its weight, at most ``max_repeat``
times its own size; what that leaves over goes to the other sources by weight. A source takes every document
floor(target / size) times, and the documents below a hash threshold once more.

The threshold comes without sorting documents: sum sizes by source and the top bits of the hash, find the bucket in
which the running sum crosses the budget, and repeat on the next bits for the documents in that bucket alone. After the first
level only those are read again. Six levels use up all 60 bits of the hash, so the last bucket holds one hash value: it is taken if that brings the sum nearer
to the budget. A larger budget takes all that a smaller one takes.

Nothing is collected. A histogram has at most 1024 rows for each source, summed before the shuffle; the weights
need one row for each source in one place.

Nulls: a null text has size 0 and is taken as its hash says, for no words, never more than ``max_repeat`` times; a null source is a source, last of all; a
null doc_id hashes as the empty text. Documents with equal doc_id share a hash and go together. A source without
words has target 0. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Bits of the hash that each histogram resolves.
LEVELS = (10, 10, 10, 10, 10, 10)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5, from 0 up: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """sizes: source, source_size. Adds target (double): the shares that fill to the common level or to the cap.

    A source is at its cap when the level reaches cap / weight. In the order of that ratio, the level at which the
    first i sources are capped is what these leave, by the weight of the rest; the capped ones are the leading
    sources whose ratio is below the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    each = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", each).withColumn("cap", F.col("source_size") * max_repeat)
    ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    # what is left of the sum over all sources, as a frame that reaches to the end is summed anew for each row
    rest = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / rest
    filled = ranked.withColumn("level", level).withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
    common = F.max(F.when(F.col("free"), F.col("level"))).over(whole)  # the first free source's level; later ones are lower
    return filled.withColumn("common", common).select("source", "source_size", F.when(F.col("free"), F.col("common") * F.col("w")).otherwise(F.col("cap")).cast("double").alias("target"))


def measured(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size and h: all that mixing needs of a document."""
    return df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key_hash(F.col(key)).alias("h"))


def plan(narrow: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """s, source_size, target, full (copies of every document) and cut (the hash below which there is one more), a row
    for each source of what ``measured`` gives."""
    targets = scratch.write(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = targets.withColumn("full", full.cast("long")).withColumn("budget", F.col("target") - F.col("full") * F.col("source_size"))
    cuts = _thresholds(narrow, budgets.select(F.col("source").alias("s"), "budget"), scratch)
    both = budgets.join(cuts, budgets["source"].eqNullSafe(cuts["s"]), "left")
    return scratch.write(both.select(F.col("source").alias("s"), "source_size", "target", "full", F.when(F.col("budget") > 0, F.coalesce("cut", F.lit(0).cast("long"))).otherwise(0).alias("cut")))


def _copies(h: Column, full: str = "full", cut: str = "cut") -> Column:
    return (F.col(full) + F.when(h < F.col(cut), 1).otherwise(0)).cast("long")


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 to max_repeat) and taken (size * copies) of every row."""
    scratch = Scratch(df.sparkSession, "mix")
    narrow = scratch.write(measured(df, key, text, source))  # the text is read once
    by_source = plan(narrow, scratch, weights, max_repeat)
    out = narrow.join(by_source, narrow["source"].eqNullSafe(by_source["s"]), "left").withColumn("copies", _copies(F.col("h")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, key: str = "doc_id", text: str = "text", source: str = "source", copy: str = "copy") -> DataFrame:
    """The mixed corpus: df's rows, each as often as the mix takes it, numbered from 1 in a column more,
    which takes the place of one of that name.

    The plan has a row for each source, so rows of df find their number of copies without a shuffle of texts as
    long as Spark can broadcast it."""
    scratch = Scratch(df.sparkSession, "mix")
    by_source = plan(scratch.write(measured(df, key, text, source)), scratch, weights, max_repeat)
    s, full, cut, copies = fresh([*df.columns, copy], "s", "full", "cut", "copies")
    named = by_source.select(F.col("s").alias(s), F.col("full").alias(full), F.col("cut").alias(cut))
    found = df.join(named, df[source].eqNullSafe(F.col(s)), "left").withColumn(copies, _copies(key_hash(df[key]), full, cut))
    kept = [c for c in df.columns if c != copy]
    return found.where(F.col(copies) > 0).select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copy))


def _thresholds(narrow: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """s, cut: documents of the source with a hash below the cut are taken once more."""
    # low: the hash from which the boundary bucket starts; base: what lies below it; done: the hash all lie below
    state = budgets.select("s", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("base"))
    shift = sum(LEVELS)
    for level, bits in enumerate(LEVELS):
        above, shift = shift, shift - bits
        if level == 1:
            # from here on only the boundary buckets' rows count, a thousandth of all
            edge = state.select(F.col("s").alias("e"), F.col("low").alias("from"))
            narrow = scratch.write(narrow.join(edge, narrow["source"].eqNullSafe(edge["e"]) & (F.shiftright("h", above) == F.shiftright("from", above)), "left_semi"))
        inside = narrow.join(state, narrow["source"].eqNullSafe(state["s"]) & (F.shiftright("h", above) == F.shiftright("low", above)))
        hist = inside.groupBy("s", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"), F.first("budget").alias("budget"), F.first("base").alias("base"))
        w = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        running = hist.withColumn("upto", F.col("base") + F.sum("n").over(w))
        # the first bucket whose end passes the budget, or the last one
        passes = F.col("upto") > F.col("budget")
        pick = F.coalesce(F.min(F.when(passes, F.struct("b", "n", "upto"))), F.max(F.struct("b", "n", "upto")))
        found = running.groupBy("s").agg(F.first("budget").alias("budget"), pick.alias("p"))
        state = scratch.write(found.select("s", "budget", F.shiftleft("p.b", shift).alias("low"), (F.col("p.upto") - F.col("p.n")).alias("base"), F.col("p.n").alias("n")))
        last, state = state, state.drop("n")
    # the last bucket is one hash value: in if the sum then is nearer to the budget
    nearer = F.col("base") + F.col("n") - F.col("budget") < F.col("budget") - F.col("base")
    return last.select("s", (F.col("low") + F.when(nearer, 1).otherwise(0)).alias("cut"))
