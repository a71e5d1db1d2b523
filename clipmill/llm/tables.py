"""Work tables bucketed by a key, so that later joins on it do not shuffle them again, and smaller Arrow batches for wide rows."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from clipmill.session import new_path


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write ``df`` to the shared folder in as many buckets of ``key`` as there are shuffle partitions, and read it back."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).format("parquet").option("compression", "zstd").option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Jobs run inside send at most ``rows`` rows at a time to Python: texts and sets make rows of many kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
