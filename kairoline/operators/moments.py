"""The moments index: typed points and half-open spans of media, queried in a stable order.

A record has content_key, start_seconds, end_seconds, kind, confidence, analyzer, version and payload. A batch is all
records of one (content_key, analyzer, version); it is replaced as a whole, and may be empty.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ("content_key", "analyzer", "version")
DEFAULT_LIMIT, MAX_LIMIT = 256, 4096
MAX_PAYLOAD = 16 * 1024


def span_matches(start: Column, end: Column, query_start, query_end) -> Column:
    """A point matches [a, b) if a <= point < b; a span if it overlaps; an empty query matches nothing."""
    a, b = F.lit(query_start) if not isinstance(query_start, Column) else query_start, F.lit(query_end) if not isinstance(query_end, Column) else query_end
    return (a < b) & (start < b) & F.when(start == end, start >= a).otherwise(end > a)


@dataclass(frozen=True)
class MomentQuery:
    """Filters that may each be left out; they are one predicate, which Spark pushes to the scan where it can."""

    kind: str | None = None
    time_range: tuple[float, float] | None = None
    minimum_confidence: float | None = None

    def with_kind(self, kind: str) -> MomentQuery:
        return replace(self, kind=kind)

    def with_time_range(self, start: float, end: float) -> MomentQuery:
        if not 0 <= start <= end < float("inf"):
            raise ValueError("a range needs 0 <= start <= end, finite")
        return replace(self, time_range=(start, end))

    def with_minimum_confidence(self, least: float) -> MomentQuery:
        if not 0 <= least <= 1:
            raise ValueError("confidence is from 0 to 1")
        return replace(self, minimum_confidence=least)

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.kind is not None:
            out = out & (F.col("kind") == self.kind)
        if self.minimum_confidence is not None:
            out = out & (F.col("confidence") >= self.minimum_confidence)
        if self.time_range is not None:
            out = out & span_matches(F.col("start_seconds"), F.col("end_seconds"), *self.time_range)
        return out


def canonical_order() -> list[Column]:
    return [F.col("content_key"), F.col("start_seconds"), F.col("end_seconds"), F.col("kind"), F.col("analyzer"), F.col("version"), F.col("confidence").desc(), F.col("payload").asc_nulls_first()]


def filter_and_sort(df: DataFrame, query: MomentQuery) -> DataFrame:
    return df.where(query.predicate()).orderBy(*canonical_order())


def query_with_limit(df: DataFrame, query: MomentQuery, limit: int = DEFAULT_LIMIT, tie: str | None = None) -> DataFrame:
    """The first ``limit`` records in order, with a column that tells whether there were more. One record more than the
    limit is fetched, so only limit + 1 rows of each task travel."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be from 1 to {MAX_LIMIT}")
    order = canonical_order() + ([F.col(tie)] if tie else [])
    some = df.where(query.predicate()).orderBy(*order).limit(limit + 1)
    numbered = some.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return numbered.withColumn("truncated", F.max("position").over(Window.partitionBy(F.lit(0))) > limit).where(F.col("position") <= limit)


def violations() -> Column:
    """Names of the rules that a record breaks."""
    bad = lambda name, rule: F.when(~F.coalesce(rule, F.lit(False)), name)
    start, end, c = F.col("start_seconds"), F.col("end_seconds"), F.col("confidence")
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.array_compact(
        F.array(
            bad("content_key", F.col("content_key").rlike("^[0-9a-f]{64}$")),
            bad("span", finite(start) & finite(end) & (start >= 0) & (end >= start)),
            bad("kind", F.col("kind").rlike(r"^[a-z][a-z0-9._-]*$") & (F.octet_length("kind") <= 64)),
            bad("confidence", finite(c) & c.between(0, 1)),
            bad("analyzer", F.col("analyzer").rlike(r"^[a-z0-9][a-z0-9._/-]*$") & (F.octet_length("analyzer") <= 128)),
            bad("version", F.col("version").between(1, 2**32 - 1)),
            bad("payload", F.col("payload").isNull() | (F.octet_length("payload") <= MAX_PAYLOAD) & ~F.col("payload").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")),
        )
    )


def encode_key(key: Column) -> Column:
    return F.lower(F.hex(key))


def decode_key(text: Column) -> Column:
    """The key's 32 bytes; null for what isn't 64 hexadecimal digits."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))


def replace_batch(records: DataFrame, batches: DataFrame, scope: dict, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and batch markers after a batch has been replaced; the marker stays even if ``new`` is empty."""
    own = F.lit(True)
    for name, value in scope.items():
        own = own & F.col(name).eqNullSafe(F.lit(value))
    marker = batches.sparkSession.range(1).select(*(F.lit(scope[n]).cast(batches.schema[n].dataType).alias(n) for n in SCOPE))
    return records.where(~own).unionByName(new), batches.where(~own).select(*SCOPE).unionByName(marker)


def replace_batches(records: DataFrame, new: DataFrame, scopes: DataFrame) -> DataFrame:
    """The same for many batches: records of the named scopes go, new ones come."""
    return records.join(scopes.select(*SCOPE).distinct(), list(SCOPE), "left_anti").unionByName(new.select(*records.columns))


def delete_batches(records: DataFrame, batches: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = scopes.select(*SCOPE).distinct()
    return records.join(gone, list(SCOPE), "left_anti"), batches.join(gone, list(SCOPE), "left_anti")


def batch_exists(batches: DataFrame, scope: dict) -> bool:
    for name, value in scope.items():
        batches = batches.where(F.col(name) == value)
    return bool(batches.limit(1).count())


def duplicate_records(df: DataFrame, position: str) -> DataFrame:
    """Records that equal an earlier one of their batch, with both positions."""
    key = [*SCOPE, "start_seconds", "end_seconds", "kind", "confidence", "payload"]
    first = F.min(position).over(Window.partitionBy(*key))
    return df.withColumn("first_position", first).where(F.col(position) > F.col("first_position"))
