"""Text lines with their file and line number, read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipmill.session import stored


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of all lines that are not blank; line numbers start at 1.

    Files are split over tasks. Inside a file block rows keep their order, so a row's place is its
    offset in the block plus the rows of the blocks before it. Only block counts meet in one place.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    blank = F.regexp_replace("value", r"(?U)\s", "") == ""
    full = raw.withColumn("full", ~blank)
    blocks = full.groupBy("path", "block").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        "path", "block", "first_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    blocks = stored(blocks, "line-blocks")  # one row per file block; Spark sends the table to the tasks while it is small
    kept = full.filter("full").join(blocks, ["path", "block"])
    return kept.select("path", (F.col("id") - F.col("first_id") + F.col("n0") + 1).alias("line_no"), "value")


def head_lines(lines: DataFrame, max_samples: int | None) -> DataFrame:
    """The first ``max_samples`` records in file order."""
    return lines if max_samples is None else lines.orderBy("path", "line_no").limit(max_samples)
