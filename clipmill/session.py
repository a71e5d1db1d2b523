"""Session settings and working folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clipmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or one beside the warehouse tables where that is unset.

    A machine-local temporary folder is never used: executors of a cluster would not see each other's files in it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if not warehouse:
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = f"{warehouse.rstrip('/')}/clipmill_work"
    return named.rstrip("/")


#: Folder of the run in this context, if its caller opened one.
_RUN: ContextVar[str | None] = ContextVar("clipmill_run", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the run's folder (``work_folder``) or the shared folder."""
    return f"{_RUN.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def work_folder(spark: SparkSession) -> Iterator[str]:
    """Work tables made inside go to one folder, which is removed at the end with the catalog's tables that lie in it.

    Results are lazy and read these tables: write or collect them before the block ends.
    """
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        inside = files.makeQualified(place).toUri().getPath() + "/"
        catalog, named = spark._jsparkSession.sessionState().catalog(), spark._jvm.org.apache.spark.sql.catalyst.TableIdentifier
        for table in spark.catalog.listTables():
            if not table.isTemporary and inside in str(catalog.getTableMetadata(named(table.name)).location()):
                spark.sql(f"drop table if exists `{table.name}`")
        files.delete(place, True)


def stored(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_rows(df: DataFrame) -> list:
    """Rows of a table whose size its user fixes (a contract, one row per label of it), on the driver."""
    return df.collect()


def require_empty(violations: DataFrame) -> None:
    """Strict edge: raise when a violations table holds anything."""
    first = violations.take(5)
    if first:
        raise ValueError("; ".join(str(r.asDict()) for r in first))
