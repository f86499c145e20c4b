"""Joins of half-open intervals of any spread of lengths, by dyadic levels.

An interval belongs to the level whose cells, 2**level wide, are as long as it is or longer, so it touches two cells at most, a clip of ten
million ticks as well as one of ten. What looks for it looks into its own cell of each level that occurs (at most 63, one for each power of two
between the shortest and the longest). The plan is an equality join on key, level and cell, which Spark can shuffle, sort and split; an
inequality alone would be a nested loop. Lengths up to ``width`` share the lowest level, so that usual data have one or two.

Starts and lengths are whole numbers. Intervals without length, and nulls, meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level_of(length: Column, width: int, widest: int | None = None) -> Column:
    """The level of a length: of ``width`` at least, of ``widest`` at most."""
    whole = F.ceil(length).cast("long")
    own = F.greatest(F.when(whole <= 1, 0).otherwise(F.length(F.bin(whole - 1))), F.lit(max(0, width.bit_length() - 1)))
    return F.least(own, F.lit(widest.bit_length() - 1)) if widest else own


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level))


def _stored(df: DataFrame, span: tuple[str, str], width: int, widest: int | None = None) -> DataFrame:
    """df with _level and _cell: a row for each cell that an interval touches on its level, two at most where no widest is given."""
    a, n = span
    own = df.where(F.col(n) > 0).withColumn("_level", level_of(F.col(n), width, widest))
    first, last = _cell(F.col(a), F.col("_level")), _cell(F.col(a) + F.col(n) - 1, F.col("_level"))
    return own.withColumn("_cell", F.explode(F.sequence(first, F.greatest(first, last))))


def _levels(df: DataFrame, length: str, width: int, widest: int | None = None) -> DataFrame:
    """One row: the levels that occur."""
    return F.broadcast(df.where(F.col(length) > 0).agg(F.collect_set(level_of(F.col(length), width, widest)).alias("_levels")))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of left and right rows of equal keys whose intervals (start, length) overlap. Other columns must differ in
    name. ``how``: inner, or left_semi and left_anti for rows of left with or without a partner.

    Of a pair the one of the higher level lies stored, and the other looks for it there, in two cells at most; of one level, left lies. A
    pair counts in the cell in which the later of the two starts, so it comes once."""
    (a, n), (b, m) = left_span, right_span

    def looking(df: DataFrame, span: tuple[str, str], levels: DataFrame, least: int) -> DataFrame:
        s, d = span
        own = level_of(F.col(d), width)
        seen = df.where(F.col(d) > 0).crossJoin(levels).withColumn("_level", F.explode(F.filter("_levels", lambda x: x >= own + least))).drop("_levels")
        first, last = _cell(F.col(s), F.col("_level")), _cell(F.col(s) + F.col(d) - 1, F.col("_level"))
        return seen.withColumn("_cell", F.explode(F.sequence(first, F.greatest(first, last))))

    x = _stored(left, left_span, width).withColumn("_lies", F.lit(True)).unionByName(looking(left, left_span, _levels(right, m, width), 1).withColumn("_lies", F.lit(False)))
    y = _stored(right, right_span, width).withColumn("_lies", F.lit(False)).unionByName(looking(right, right_span, _levels(left, n, width), 0).withColumn("_lies", F.lit(True)))
    meet = (F.col(a) < F.col(b) + F.col(m)) & (F.col(b) < F.col(a) + F.col(n))
    once = _cell(F.greatest(a, b), F.col("_level")) == F.col("_cell")
    pairs = x.join(y, [*keys, "_level", "_cell", "_lies"]).where(meet & once).drop("_level", "_cell", "_lies")
    if how == "inner":
        return pairs
    found = pairs.select(*left.columns).distinct()
    return left.join(found, left.columns, how)


def stab_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, span: tuple[str, str], width: int, widest: int | None = None) -> DataFrame:
    """Points with the intervals of equal keys that hold them. widest: cells are no wider, and longer intervals are stored in several, for
    joins that give a row for each point of an interval anyway."""
    a, n = span
    x = points.crossJoin(_levels(intervals, n, width, widest)).withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_cell", _cell(F.col(at), F.col("_level")))
    y = _stored(intervals, span, width, widest)
    return x.join(y, [*keys, "_level", "_cell"]).where((F.col(at) >= F.col(a)) & (F.col(at) < F.col(a) + F.col(n))).drop("_level", "_cell")


def overlaps_before(df: DataFrame, keys: list[str], start: str, dur: str, order: list[str]) -> Column:
    """Whether an interval begins before all earlier ones of its keys have ended."""
    w = Window.partitionBy(*keys).orderBy(start, *order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.col(start) + F.col(dur)).over(w) > F.col(start), F.lit(False))
