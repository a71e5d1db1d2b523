"""Media listings, path rules and incremental work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmill.constants import MEDIA_SUFFIXES
from clipmill.functions.text import strip


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1))


def list_media(spark: SparkSession, root: str, suffixes: Sequence[str] = MEDIA_SUFFIXES) -> DataFrame:
    """(path, name, length) of the media files under ``root``; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.filter(suffix(F.col("path")).isin(*suffixes)).select("path", base_name(F.col("path")).alias("name"), "length")


def in_name_order(media: DataFrame) -> DataFrame:
    return media.orderBy(F.lower("name"), "path")


def resolve_media_path(clips: DataFrame, listing: DataFrame) -> DataFrame:
    """First existing of ``candidates[]`` per clip; clips without a file keep a null path."""
    tries = clips.select("clip_id", F.posexplode("candidates").alias("priority", "path"))
    found = tries.join(listing.select("path"), "path", "left_semi").groupBy("clip_id").agg(F.min_by("path", "priority").alias("path"))
    return clips.drop("candidates").join(found, "clip_id", "left")


def safe_relative_path(pose_path: Column, sample_id: Column) -> Column:
    """struct(path, error): blank falls back to ``<sample_id>.npz``; absolute or climbing paths are refused."""
    blank = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    path = F.coalesce(blank(pose_path), F.concat(blank(sample_id), F.lit(".npz")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))

    def step(acc: Column, part: Column) -> Column:
        d = acc["depth"] + F.when(part.isin("", "."), 0).when(part == "..", -1).otherwise(1)
        return F.struct(d.alias("depth"), F.least(acc["low"], d).alias("low"))

    low = F.aggregate(F.split(path, "/"), start, step)["low"]
    error = F.when(path.isNull(), "no_path").when(path.startswith("/"), "absolute_path").when(low < 0, "escapes_root")
    return F.struct(F.when(error.isNull(), path).alias("path"), error.alias("error"))


def training_pairs(metadata: DataFrame, archives: DataFrame) -> DataFrame:
    """Metadata rows whose archive ``<sample_id>.npz`` is listed."""
    known = [c for c in ("sample_id", "gloss", "split", "signer_id", "video_id") if c in metadata.columns]
    have = archives.select(F.regexp_extract(base_name(F.col("path")), r"^(.*)\.npz$", 1).alias("sample_id"), F.col("path").alias("pose_path"))
    return metadata.select(*known).join(have, "sample_id")


def incremental_pending(work: DataFrame, built: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pending, skipped because built, errors ``missing_video_path``) of ``work(sample_id, video_path)``."""
    done = built.select("sample_id")
    skipped = work.join(done, "sample_id", "left_semi")
    open_ = work.join(done, "sample_id", "left_anti")
    no_path = strip(F.coalesce("video_path", F.lit(""))) == ""
    errors = open_.filter(no_path).select(F.lit("missing_video_path").alias("rule"), F.col("sample_id").alias("key"), F.lit("").alias("detail"))
    return open_.filter(~no_path), skipped, errors
