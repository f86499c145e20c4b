"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one under /tmp where none is set and all tasks run
    in the driver's own process. On a cluster a local folder would lose rows, so that raises."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{given or 'file:///tmp/checkpoints'}/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application. Results that were not written yet can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, *by: str) -> DataFrame:
        """df as written; ``by``: columns that get a folder for each value, so that a filter on them reads only its own."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._kept = [*getattr(self, "_kept", []), out]  # an id stays one table's
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if sc.applicationId in _shipped or not os.path.isdir(package):  # in an archive already: it was sent
        return
    with tempfile.TemporaryDirectory() as folder:
        copy = shutil.copytree(package, os.path.join(folder, "own", os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
        # executors fetch it from the driver as long as the application runs
        place = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        archive = shutil.make_archive(os.path.join(place, f"{os.path.basename(package)}-{uuid.uuid4().hex[:8]}"), "zip", os.path.dirname(copy))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, so that few texts at once are Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names that no column of a table has, whatever its case: with underscores added until they differ."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is. lower() is far quicker, and the same on ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def crc_mod(key: Column, m: int) -> Column:
    """crc32 of a key's text, modulo m; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(m))
