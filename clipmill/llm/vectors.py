"""Vectors as integers in blocks: one row holds the ids, labels and components of some thousand vectors, for exact work in numpy.

A vector is kept when it is not null, not empty and holds only finite components. Integer components beyond ±2^27 would leave 64-bit
distances inexact and end the query with an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.session import new_path

#: Vectors of one block, and the bound of an integer component.
BLOCK, MOST = 2048, 1 << 27
#: Stored bounds are in sixteenths of a unit; this is the exact factor of squared distances.
STEP, STEP2 = 16, 256


def finite(vector: Column) -> Column:
    """True for vectors that are not null and hold neither null nor a value that is not finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok, F.lit(False)) & (F.size(vector) > 0)


def whole(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column whose rows have equal length: one row per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(flat * scale)
    if len(out) and np.abs(out).max() >= MOST:
        raise ValueError(f"a component reaches {MOST} after scaling by {scale}")
    return out.astype(np.int64).reshape(len(column), -1)


def narrow(x: np.ndarray) -> bytes:
    """Components as 16-bit numbers where they fit, else as 32-bit numbers."""
    small = not x.size or (x.min() >= -(1 << 15) and x.max() < 1 << 15)
    return x.astype("<i2" if small else "<i4").tobytes()


def wide(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * n * dim else "<i4").reshape(n, dim).astype(np.int64)


def blocks(kept: DataFrame, scale: int) -> DataFrame:
    """(ids, labels, v) from (id, label, vec), vectors of one length."""
    id_type, label_type = kept.schema["id"].dataType.simpleString(), kept.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                one = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(one, part.column(0)), pa.ListArray.from_arrays(one, part.column(1)), pa.array([narrow(whole(part.column(2), scale))], pa.binary())],
                    names=["ids", "labels", "v"])

    return kept.select("id", "label", "vec").mapInArrow(run, f"ids array<{id_type}>, labels array<{label_type}>, v binary")


def floor_root(d: np.ndarray) -> np.ndarray:
    """floor(16 * sqrt(d)), exact, for squared distances below 2^44; larger ones count as 2^44, which is a lower bound too."""
    d = np.minimum(d, 1 << 44)
    root = np.floor(STEP * np.sqrt(d.astype(np.float64))).astype(np.int64)
    root -= root * root > STEP2 * d
    return root


def ceil_root(d: np.ndarray) -> np.ndarray:
    """ceil(16 * sqrt(d)), exact, for a few squared distances."""
    return np.array([0 if x == 0 else math.isqrt(STEP2 * int(x) - 1) + 1 for x in d.ravel()], np.int64).reshape(d.shape)


def beyond(bound: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Does a stored lower bound prove a squared distance greater than ``d``, without equality."""
    return bound * bound > STEP2 * d


def kept_from(df: DataFrame, name: str, before: str | None) -> tuple[DataFrame, str]:
    """Store ``df`` in the shared folder and then remove the table it was made from: of a loop's states one stays."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if before is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(before)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return spark.read.schema(df.schema).parquet(path), path
