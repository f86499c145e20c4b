"""Intermediate tables of jobs that use one table several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in a folder of this application that driver and executors share: spark.checkpoint.dir, or one under /tmp where none is set and
    all tasks run in the driver's own process."""
    spark = df.sparkSession
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{given or 'file:///tmp/checkpoints'}/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
