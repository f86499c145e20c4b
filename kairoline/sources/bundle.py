"""Bundles: a template with its media in one folder, to be handed on.

A bundle holds ``bundle.json`` (its layout's version, a name, and the least version of documents that it needs), the template's
folder, and ``media/``, files named by their place. Files are copied from file system to file system in small blocks; only names
and sizes are known here.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import project as documents

FORMAT = 1
_ENTRY = re.compile(r"media/\d+\.[a-z0-9]+")


class BundleError(ValueError):
    """A bundle that can't be written or read, with the reason."""


class _Files:
    def __init__(self, spark: SparkSession):
        self.hadoop, self.conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def at(self, path: str):
        p = self.hadoop.Path(path)
        return p.getFileSystem(self.conf), p

    def copy(self, source: str, target: str) -> None:
        (a, p), (b, q) = self.at(source), self.at(target)
        if not a.exists(p) or not a.getFileStatus(p).isFile():
            raise BundleError(f"no such file: {source}")
        b.mkdirs(q.getParent())
        self.hadoop.FileUtil.copy(a, p, b, q, False, True, self.conf)


def write(project, path: str) -> None:
    """A project as a bundle. Its media must exist; the bundle's template names the copies."""
    files = _Files(project.spark)
    rows = project.state.media.select("media_id", "path").orderBy("media_id").collect()  # names only
    entries = []
    for i, r in enumerate(rows):
        ending = re.sub(r"[^a-z0-9]", "", r["path"].rsplit(".", 1)[-1].lower()) if "." in r["path"] else ""
        entries.append((r["media_id"], f"media/{i}.{ending or 'bin'}"))
        files.copy(r["path"], f"{path}/{entries[-1][1]}")
    project.save(f"{path}/template", "template", media=_renamed(project, entries))
    manifest = {"format_version": FORMAT, "name": project.state.name, "min_schema_version": documents.VERSION}
    documents.save(project.spark.createDataFrame([(json.dumps(manifest),)], "value string"), f"{path}/bundle.json")


def _renamed(project, entries: list[tuple[int, str]]):
    names = project.spark.createDataFrame(entries, "media_id long, _path string")
    return project.state.media.join(names, "media_id").withColumn("path", F.col("_path")).select(*project.state.media.columns)


def manifest(spark: SparkSession, path: str) -> dict:
    try:
        out = json.loads(spark.read.text(f"{path}/bundle.json", wholetext=True).first()[0])
    except Exception as bad:
        raise BundleError(f"no bundle at {path}: {bad}") from bad
    if out["format_version"] > FORMAT or out["min_schema_version"] > documents.VERSION:
        raise BundleError(f"the bundle is of a later version: {out}")
    return out


def install(project, path: str, target: str) -> None:
    """A bundle's template as this project, its media copied below target. Entries outside ``media/`` are refused. What is left at
    target opens as a template without the bundle."""
    manifest(project.spark, path)
    project.load(f"{path}/template", "template")
    rows = project.state.media.select("media_id", "path").orderBy("media_id").collect()
    if bad := [r["path"] for r in rows if not _ENTRY.fullmatch(r["path"])]:
        raise BundleError(f"not an entry of a bundle: {bad[0]}")
    files = _Files(project.spark)
    for r in rows:
        files.copy(f"{path}/{r['path']}", f"{target}/{r['path']}")
    project.save(f"{target}/template", "template", media=_renamed(project, [(r["media_id"], f"{target}/{r['path']}") for r in rows]))
    project.load(f"{target}/template", "template")
