"""Projects as JSON documents: read to tables of tracks, clips and markers, and written back.

A document may be the project itself or an envelope that holds it under ``project``. The schema's version is a number or
a kind with a version; unknown versions are refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
_PROJECT = """struct<
  name: string, tracks: array<struct<id: bigint, kind: string, name: string, enabled: boolean, muted: boolean, locked: boolean,
    clips: array<struct<id: bigint, start: bigint, duration: bigint, media: bigint, src_start: bigint, link: bigint>>>>,
  markers: array<struct<id: bigint, tick: bigint, name: string, color: string>>>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """path and project (a struct) of each document; a version that isn't known, or broken JSON, raises."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    inner = F.coalesce(F.get_json_object("value", "$.project"), F.col("value"))
    docs = text.withColumn("doc", inner)
    number = F.coalesce(F.get_json_object("doc", "$.schema.version"), F.get_json_object("doc", "$.schema")).cast("int")
    known = number.between(1, VERSION)
    parsed = F.from_json("doc", _PROJECT.replace("\n", " "), {"mode": "FAILFAST"})
    return docs.select("path", F.when(F.coalesce(known, F.lit(False)), parsed).otherwise(F.raise_error(F.concat(F.lit("unknown project schema in "), F.col("path")))).alias("project"))


def tracks(projects: DataFrame) -> DataFrame:
    t = projects.select("path", F.posexplode("project.tracks").alias("order_idx", "t"))
    flag = lambda name, default: F.coalesce(F.col(f"t.{name}"), F.lit(default)).alias(name)
    return t.select("path", F.col("t.id").alias("track_id"), "order_idx", "t.kind", "t.name", flag("enabled", True), flag("muted", False), flag("locked", False))


def clips(projects: DataFrame) -> DataFrame:
    c = projects.select("path", F.explode("project.tracks").alias("t")).select("path", F.col("t.id").alias("track_id"), F.explode("t.clips").alias("c"))
    return c.select("path", "track_id", F.col("c.id").alias("clip_id"), F.col("c.start").alias("start_tick"), F.col("c.duration").alias("dur_tick"), F.col("c.media").alias("media_id"), "c.src_start", "c.link")


def markers(projects: DataFrame) -> DataFrame:
    return projects.select("path", F.explode("project.markers").alias("m")).select("path", "m.*").orderBy("path", "tick", "id")


def document(name: str, tracks_: DataFrame, clips_: DataFrame, markers_: DataFrame) -> DataFrame:
    """One row, value: the project's JSON, with tracks in lane order, clips by start and markers by tick."""
    c = F.struct(F.col("clip_id").alias("id"), F.col("start_tick").alias("start"), F.col("dur_tick").alias("duration"), F.col("media_id").alias("media"), "src_start", "link")
    own = clips_.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("start_tick", "clip_id", c.alias("c")))).alias("all")).select("track_id", F.transform("all", lambda x: x["c"]).alias("clips"))
    t = F.struct(F.col("track_id").alias("id"), "kind", "name", "enabled", "muted", "locked", F.coalesce("clips", F.expr("array()").cast(own.schema["clips"].dataType)).alias("clips"))
    lanes = tracks_.join(own, "track_id", "left").agg(F.array_sort(F.collect_list(F.struct("order_idx", t.alias("t")))).alias("all")).select(F.transform("all", lambda x: x["t"]).alias("tracks"))
    m = markers_.agg(F.array_sort(F.collect_list(F.struct("tick", "id", "name", "color"))).alias("markers"))
    return lanes.crossJoin(m).select(F.to_json(F.struct(F.struct(F.lit("project").alias("kind"), F.lit(VERSION).alias("version")).alias("schema"), F.lit(name).alias("name"), "tracks", "markers")).alias("value"))


def save(doc: DataFrame, path: str) -> None:
    """One file, which takes the old one's place in a single step: a reader finds one or the other, and a failed write leaves
    the old one."""
    spark, temp = doc.sparkSession, f"{path}.{uuid.uuid4().hex}"
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    fs = target.getFileSystem(conf)
    try:
        doc.coalesce(1).write.text(temp)
        part = next(s.getPath() for s in fs.listStatus(hadoop.Path(temp)) if s.getPath().getName().startswith("part-"))
        rename = getattr(hadoop, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(target), how)
    finally:
        fs.delete(hadoop.Path(temp), True)
