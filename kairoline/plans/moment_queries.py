"""Queries of the moments index and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import moments as M
from .fixtures import MOMENTS, moments

LO, HI = 1_704_100_000.0, 1_704_900_000.0
_ORDER = "content_key, start_seconds, end_seconds, kind, analyzer, version, confidence DESC, payload NULLS FIRST"
_COLS = "content_key, start_seconds, end_seconds, kind, confidence, analyzer, version, payload, event_id"
_MATCH = "({a} < {b} AND start_seconds < {b} AND CASE WHEN start_seconds = end_seconds THEN start_seconds >= {a} ELSE end_seconds > {a} END)"


def _bounds(spark, sf):
    """A tenth of the events' time, from its middle."""
    return moments(spark, sf).agg(((F.min("start_seconds") + F.max("start_seconds")) / 2).alias("a"), ((F.max("start_seconds") - F.min("start_seconds")) / 10).alias("w"))


_BOUNDS = "b AS (SELECT (min(start_seconds) + max(start_seconds)) / 2 AS a, (max(start_seconds) - min(start_seconds)) / 10 AS w FROM moments)"


def m1_moment_query(spark, sf):
    q = M.MomentQuery().with_kind("purchase").with_minimum_confidence(0.5)
    return moments(spark, sf).where(q.predicate())


def m2_time_match(spark, sf):
    return moments(spark, sf).crossJoin(F.broadcast(_bounds(spark, sf))).where(M.span_matches(F.col("start_seconds"), F.col("end_seconds"), F.col("a"), F.col("a") + F.col("w"))).drop("a", "w")


def m4_validation(spark, sf):
    rows = moments(spark, sf).withColumn("version", F.when(F.col("event_id") % 11 == 0, 0).otherwise(F.col("version"))).withColumn("confidence", F.when(F.col("event_id") % 13 == 0, 1.5).otherwise(F.col("confidence"))).withColumn("kind", F.when(F.col("event_id") % 17 == 0, "Bad Kind").otherwise(F.col("kind")))
    return rows.select("event_id", F.explode(M.violations()).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def m5_hex_key(spark, sf):
    m = moments(spark, sf).select("content_key").distinct()
    return m.select("content_key", M.encode_key(M.decode_key(F.upper("content_key"))).alias("round_trip"), F.octet_length(M.decode_key(F.col("content_key"))).cast("long").alias("n_bytes"), M.decode_key(F.substring("content_key", 2, 63)).isNull().alias("short_is_null"))


def o1_canonical_order(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("content_key").orderBy(*M.canonical_order(), "event_id")
    return moments(spark, sf).select("event_id", F.row_number().over(w).cast("long").alias("position"))


def o2_filter_and_sort(spark, sf):
    return M.filter_and_sort(moments(spark, sf), M.MomentQuery(kind="error", minimum_confidence=0.25)).select("event_id", "kind", "confidence")


def o3_limit_truncation(spark, sf):
    return M.query_with_limit(moments(spark, sf), M.MomentQuery(kind="purchase"), 100, "event_id").select("event_id", F.col("position").cast("long").alias("position"), "truncated")


def u1_replace_batches(spark, sf):
    m = moments(spark, sf)
    scopes = m.where("version = 2 AND analyzer = 'driver/events-1'").select(*M.SCOPE).distinct()
    new = m.where("version = 2 AND analyzer = 'driver/events-1' AND kind = 'click'").withColumn("confidence", F.lit(1.0))
    return M.replace_batches(m, new, scopes)


def u2_duplicate_records(spark, sf):
    m = moments(spark, sf).withColumn("start_seconds", F.floor(F.col("start_seconds") / 86400 / 30).cast("double")).withColumn("end_seconds", F.col("start_seconds")).withColumn("confidence", F.round("confidence", 1)).withColumn("payload", F.lit(None).cast("string"))
    return M.duplicate_records(m, "event_id").select("event_id", "first_position")


def u3_delete_batches(spark, sf):
    m = moments(spark, sf)
    gone = m.where("version = 1 AND analyzer = 'driver/events-2'")
    records, batches = M.delete_batches(m, m.select(*M.SCOPE).distinct(), gone)
    return records.groupBy(*M.SCOPE).agg(F.count("*").alias("n")).join(batches, list(M.SCOPE))


def g18_batch_exists(spark, sf):
    m = moments(spark, sf)
    batches = m.select(*M.SCOPE).distinct().where("version = 1")
    return m.select("content_key", "analyzer").distinct().join(batches, ["content_key", "analyzer"], "left").select("content_key", "analyzer", F.col("version").isNotNull().alias("found"))


QUERIES = {f.__name__: f for f in (m1_moment_query, m2_time_match, m4_validation, m5_hex_key, o1_canonical_order, o2_filter_and_sort, o3_limit_truncation, u1_replace_batches, u2_duplicate_records, u3_delete_batches, g18_batch_exists)}

ORACLE_SQL = {
    "m1_moment_query": f"WITH {MOMENTS} SELECT * FROM moments WHERE kind = 'purchase' AND confidence >= 0.5",
    "m2_time_match": f"WITH {MOMENTS}, {_BOUNDS} SELECT {_COLS} FROM moments, b WHERE " + _MATCH.format(a="a", b="(a + w)"),
    "m4_validation": f"""WITH {MOMENTS}, r AS (SELECT event_id, unnest(['version', 'confidence', 'kind']) AS rule FROM moments)
      SELECT rule, count(*) AS n, min(event_id) AS first_event FROM r
      WHERE (rule = 'version' AND event_id % 11 = 0) OR (rule = 'confidence' AND event_id % 13 = 0) OR (rule = 'kind' AND event_id % 17 = 0) GROUP BY rule""",
    "m5_hex_key": f"WITH {MOMENTS} SELECT DISTINCT content_key, lower(hex(unhex(upper(content_key)))) AS round_trip, octet_length(unhex(content_key))::BIGINT AS n_bytes, true AS short_is_null FROM moments",
    "o1_canonical_order": f"WITH {MOMENTS} SELECT event_id, row_number() OVER (PARTITION BY content_key ORDER BY {_ORDER}, event_id) AS position FROM moments",
    "o2_filter_and_sort": f"WITH {MOMENTS} SELECT event_id, kind, confidence FROM moments WHERE kind = 'error' AND confidence >= 0.25",
    "o3_limit_truncation": f"""WITH {MOMENTS}, r AS (SELECT event_id, row_number() OVER (ORDER BY {_ORDER}, event_id) AS position, count(*) OVER () AS n FROM moments WHERE kind = 'purchase')
      SELECT event_id, position, n > 100 AS truncated FROM r WHERE position <= 100""",
    "u1_replace_batches": f"""WITH {MOMENTS} SELECT {_COLS} FROM moments WHERE NOT (version = 2 AND analyzer = 'driver/events-1')
      UNION ALL SELECT {_COLS.replace("confidence,", "1.0::DOUBLE AS confidence,")} FROM moments WHERE version = 2 AND analyzer = 'driver/events-1' AND kind = 'click'""",
    "u2_duplicate_records": f"""WITH {MOMENTS}, r AS (SELECT event_id, min(event_id) OVER (PARTITION BY content_key, analyzer, version, floor(start_seconds / 86400 / 30), kind, round(confidence, 1)) AS first_position FROM moments)
      SELECT * FROM r WHERE event_id > first_position""",
    "u3_delete_batches": f"WITH {MOMENTS} SELECT content_key, analyzer, version, count(*) AS n FROM moments WHERE NOT (version = 1 AND analyzer = 'driver/events-2') GROUP BY ALL",
    "g18_batch_exists": f"WITH {MOMENTS} SELECT content_key, analyzer, bool_or(version = 1) AS found FROM moments GROUP BY ALL",
}
