"""The moments index as a folder of Parquet versions.

Records and batch markers are dealt to buckets by the first two digits of their content key. A write makes new folders for
the bucket of its batch alone, and then a small commit file that names the folder of every bucket; readers take the
highest commit, so they see the old version or the new one, never a part of either. A query of one key reads one bucket.
``vacuum`` removes what no recent version names. Opening checks the schema and fails closed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import moments as M

SCHEMA_VERSION = 1
RECORDS = T.StructType([
    T.StructField("content_key", T.StringType()), T.StructField("start_seconds", T.DoubleType()), T.StructField("end_seconds", T.DoubleType()), T.StructField("kind", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("analyzer", T.StringType()), T.StructField("version", T.LongType()), T.StructField("payload", T.StringType()),
])
BATCHES = T.StructType([f for f in RECORDS.fields if f.name in M.SCOPE])


def bucket_of(key: str) -> str:
    return key[:2]


class CorruptStore(ValueError):
    """A store whose schema or rows are not what they should be."""


class MomentStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._number() == 0:
            self._commit({})
        self.records()  # a store that can't be read is refused at once

    def _numbers(self) -> list[int]:
        """The versions that have been committed, the latest first."""
        if not self.fs.exists(self.fs_path(self.path)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.fs_path(self.path))]
        return sorted((int(n[1:-7]) for n in names if n.endswith(".commit")), reverse=True)

    def _number(self) -> int:
        return next(iter(self._numbers()), 0)

    def _folders(self, number: int) -> dict[str, str]:
        """The folder of each bucket that has one: 256 at most."""
        lines = [r[0] for r in self.spark.read.text(f"{self.path}/v{number}.commit", wholetext=True).collect()]
        schema, *rest = (lines[0] if lines else "").splitlines() or [""]
        if schema != str(SCHEMA_VERSION) or any(len(r.split(" ")) != 2 for r in rest):
            raise CorruptStore(f"schema version {schema or 'missing'}")
        return dict(r.split(" ") for r in rest)

    def _commit(self, folders: dict[str, str], after: int = 0) -> None:
        text = "\n".join([str(SCHEMA_VERSION), *(f"{b} {f}" for b, f in sorted(folders.items()))])
        # of two writers that saw the same version, the second finds the file there and fails
        out = self.fs.create(self.fs_path(f"{self.path}/v{after + 1}.commit"), False)
        out.write(bytearray(f"{text}\n".encode()))
        out.close()

    def _publish(self, key: str, change) -> None:
        """A version in which ``change`` was made to the records and markers of a key's bucket."""
        number, bucket, name = self._number(), bucket_of(key), uuid.uuid4().hex
        folders = self._folders(number)
        old = {bucket: folders[bucket]} if bucket in folders else {}
        records, batches = change(self._read("records", RECORDS, old), self._read("batches", BATCHES, old))
        records.write.parquet(f"{self.path}/{name}/records")
        batches.write.parquet(f"{self.path}/{name}/batches")
        self._commit(folders | {bucket: name}, number)

    def vacuum(self, keep: int = 2) -> int:
        """Remove the folders that none of the latest ``keep`` versions names, and older commits. Returns how many folders."""
        numbers = self._numbers()
        named = {f for n in numbers[:keep] for f in self._folders(n).values()}
        gone = [s.getPath() for s in self.fs.listStatus(self.fs_path(self.path)) if s.isDirectory() and s.getPath().getName() not in named]
        for path in (*gone, *(self.fs_path(f"{self.path}/v{n}.commit") for n in numbers[keep:])):
            self.fs.delete(path, True)
        return len(gone)

    def _read(self, what: str, schema: T.StructType, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.parquet(*(f"{self.path}/{f}/{what}" for f in folders.values()))
        if [(f.name, f.dataType) for f in found.schema] != [(f.name, f.dataType) for f in schema]:
            raise CorruptStore(f"schema of {what}: {found.schema.simpleString()}")
        return found

    def _of(self, what: str, schema: T.StructType, key: str | None) -> DataFrame:
        folders = self._folders(self._number())
        if key is None:
            return self._read(what, schema, folders)
        own = {b: f for b, f in folders.items() if b == bucket_of(key)}
        return self._read(what, schema, own).where(F.col("content_key") == key)

    def records(self, key: str | None = None) -> DataFrame:
        """All records, or those of one content key."""
        return self._of("records", RECORDS, key)

    def batches(self, key: str | None = None) -> DataFrame:
        return self._of("batches", BATCHES, key)

    def checked(self) -> DataFrame:
        """Records; reading one that breaks a rule raises, with the rules' names."""
        broken = M.violations()
        return self.records().where(F.when(F.size(broken) > 0, F.raise_error(F.concat(F.lit("corrupt record: "), F.array_join(broken, ", "))).cast("boolean")).otherwise(True))

    def query(self, query: M.MomentQuery, limit: int = M.DEFAULT_LIMIT, key: str | None = None) -> DataFrame:
        return M.query_with_limit(self.records(key), query, limit)

    def replace_batch(self, scope: dict, rows: DataFrame) -> None:
        new = rows.select(*(F.col(f.name).cast(f.dataType) for f in RECORDS))
        bad = new.where(F.size(M.violations()) > 0)
        own = F.lit(True)
        for name, value in scope.items():
            own = own & F.col(name).eqNullSafe(F.lit(value))
        if bad.limit(1).count() or new.where(~own).limit(1).count():
            raise ValueError("rows break a rule or are of another batch")
        if new.groupBy(*new.columns).count().where("count > 1").limit(1).count():
            raise ValueError("equal rows in a batch")
        self._publish(scope["content_key"], lambda records, batches: M.replace_batch(records, batches, scope, new))

    def delete_batch(self, scope: dict) -> bool:
        if not M.batch_exists(self.batches(scope["content_key"]), scope):
            return False
        gone = self.spark.createDataFrame([tuple(scope[n] for n in M.SCOPE)], BATCHES)
        self._publish(scope["content_key"], lambda records, batches: M.delete_batches(records, batches, gone))
        return True
