"""Train/val/test splits, their manifests and leakage checks."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.constants import SPLITS, TRAIN_RATIO, VAL_RATIO
from clipmill.functions.text import strip
from clipmill.operators.ranking import assign_splits, top_k_first_seen
from clipmill.operators.skew import spread_join

PAIRS = tuple(combinations(SPLITS, 2))


def check_ratios(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("split ratios must sum to 1")


def _at_least_one(x: Column) -> Column:
    return F.greatest(F.lit(1), x.cast("bigint"))


def stratified_sizes(n: Column, train: float = TRAIN_RATIO, val: float = VAL_RATIO) -> tuple[Column, Column]:
    """Sizes for a label with ``n`` rows; what is left over is the test part."""
    t = F.when(n >= 3, _at_least_one(F.rint(n * F.lit(train)))).otherwise(_at_least_one(n - 1))
    left = n - t
    v = F.when(left > 1, F.rint(n * F.lit(val)).cast("bigint")).otherwise(F.least(F.lit(1), left))
    return t, F.when(left - v < 0, left).otherwise(v)


def stratified_min1_sizes(n: Column, train: float = TRAIN_RATIO, val: float = VAL_RATIO) -> tuple[Column, Column]:
    """Sizes that always leave one row for each split (n >= 3)."""
    t, v = _at_least_one(F.rint(n * F.lit(train))), _at_least_one(F.rint(n * F.lit(val)))
    full = t + v > n - 1
    return F.when(full, _at_least_one(n - 2)).otherwise(t), F.when(full, F.lit(1)).otherwise(v)


def group_sizes(g: Column, train: float = TRAIN_RATIO, val: float = VAL_RATIO) -> tuple[Column, Column]:
    """As above, over groups."""
    t, v = _at_least_one(F.rint(g * F.lit(train))), _at_least_one(F.rint(g * F.lit(val)))
    full = t + v >= g
    return F.when(full, _at_least_one(g - 2)).otherwise(t), F.when(full, F.lit(1)).otherwise(v)


def stratified_split(df: DataFrame, label: str, key: str, seed: int, train=TRAIN_RATIO, val=VAL_RATIO, test=None) -> DataFrame:
    check_ratios(train, val, round(1 - train - val, 9) if test is None else test)
    return assign_splits(df, [label], key, seed, lambda n: stratified_sizes(n, train, val))


def stratified_split_min1(df: DataFrame, label: str, key: str, ordinal: str, seed: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the k most frequent labels with their split, labels that have fewer than 3 rows)."""
    top = top_k_first_seen(df, label, ordinal, k)
    kept = df.join(top.select(label), label, "left_semi")
    too_small = top.filter("n < 3").select(F.lit("fewer_than_3_rows").alias("rule"), F.col(label).alias("key"), F.col("n").cast("string").alias("detail"))
    return assign_splits(kept, [label], key, seed, stratified_min1_sizes), too_small


def group_independent_split(df: DataFrame, group: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows with a split shared by all rows of their group, violations: rows without a group)."""
    groups = df.select(group).filter(F.col(group).isNotNull()).distinct()
    placed = assign_splits(groups, [], group, seed, group_sizes)
    bad = df.filter(F.col(group).isNull())
    return spread_join(df, placed, group), bad


def split_counts(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """label, total, train, val, test."""
    return df.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(split) == s).alias(s) for s in SPLITS]
    )


def split_manifest(df: DataFrame, label: str, strategy: str, version: str, split: str = "split") -> DataFrame:
    """One row: samples, labels, rows per split, strategy, version."""
    return split_counts(df, label, split).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("num_samples"),
        F.count(F.lit(1)).alias("num_glosses"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in SPLITS],
        F.lit(strategy).alias("strategy"),
        F.lit(version).alias("version"),
    )


def shared_values(df: DataFrame, value: str, split: str = "split") -> DataFrame:
    """value + one flag per split; a value in two splits has two flags. One shuffle, no sets."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.col(value).cast("string").alias("value"))
        .agg(*[F.max(F.col(split) == s).alias(s) for s in SPLITS])
    )


def overlap_rows(df: DataFrame, value: str, split: str = "split") -> DataFrame:
    """Leaked values, one row per pair of splits they share: pair, value."""
    pairs = F.filter(
        F.array(*[F.when(F.col(a) & F.col(b), F.lit(f"{a}_{b}")) for a, b in PAIRS]), lambda p: p.isNotNull()
    )
    return shared_values(df, value, split).select(F.explode(pairs).alias("pair"), "value")


def overlap_counts(df: DataFrame, value: str, split: str = "split") -> DataFrame:
    """One row: shared values per pair of splits and whether there is any leakage."""
    counts = shared_values(df, value, split).agg(
        *[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in PAIRS]
    )
    total = reduce(lambda x, y: x + y, [F.col(f"{a}_{b}") for a, b in PAIRS])
    return counts.withColumn("has_leakage", total > 0)


def official_split_manifest(
    clips: DataFrame, media: DataFrame, n_frames: int, split_source: str = "official", dataset: str = "full",
    image_size: tuple[int, int] = (224, 224), glosses: DataFrame | None = None, max_samples: int | None = None,
) -> DataFrame:
    """One row per considered clip: a manifest row with its frame paths, or a failure with its ``reason``.

    ``clips(ordinal, sample_id, gloss, video_id, split, instance_id, signer_id, source)``, ``media(video_id, path)`` one row per
    clip. ``glosses(gloss)`` keeps only their clips. ``max_samples`` stops after that many written rows: only clips up to that ordinal
    are considered. Frame paths are relative to the dataset's folder.
    """
    if glosses is not None:
        clips = clips.join(glosses.select("gloss").distinct(), "gloss", "left_semi")
    seen = clips.join(media.select("video_id", "path"), "video_id", "left")
    if max_samples is not None:
        last = seen.filter(F.col("path").isNotNull()).select("ordinal").orderBy("ordinal").limit(max_samples)
        end = last.agg(F.max("ordinal"), F.count(F.lit(1))).first()
        if end[1] == max_samples:
            seen = seen.filter(F.col("ordinal") <= F.lit(end[0]))
    hit = F.col("path").isNotNull()
    names = F.array(*[F.lit(f"frame_{i:03d}.jpg") for i in range(n_frames)])
    folder = F.concat(F.lit("frames/"), F.col("gloss"), F.lit("/"), F.col("video_id"), F.lit("/"))
    if_hit = lambda c: F.when(hit, c)
    return seen.withColumn("_folder", folder).select(
        "ordinal", F.lit(dataset).alias("dataset"), "sample_id", "gloss", "video_id", "split", if_hit(F.lit(split_source)).alias("split_source"),
        if_hit(F.transform(names, lambda n: F.concat(F.col("_folder"), n))).alias("frame_paths"), if_hit(F.lit(n_frames)).alias("num_frames"),
        if_hit(F.array(*[F.lit(x) for x in image_size])).alias("image_size"), F.col("path").alias("source_video_path"),
        *[if_hit(F.col(c)).alias(c) for c in ("instance_id", "signer_id", "source")], F.when(~hit, "missing_preprocessed_clip").alias("reason"))


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """(split, considered, written, failed)."""
    return manifest.groupBy("split").agg(
        F.count(F.lit(1)).alias("considered"), F.count_if(F.col("reason").isNull()).alias("written"), F.count_if(F.col("reason").isNotNull()).alias("failed"))


def manifest_dedupe(*manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first row of each sample_id in train, val, test order, failure rows).

    Rows are (ordinal, sample_id, split, video_relpath); ``ordinal`` orders rows inside a manifest.
    """
    union = reduce(
        DataFrame.unionByName, [m.withColumn("source", F.lit(i)) for i, m in enumerate(manifests)]
    )
    sid, rel = strip(F.coalesce(F.col("sample_id"), F.lit(""))), strip(F.coalesce(F.col("video_relpath"), F.lit("")))
    union = union.withColumn("sample_id", sid).withColumn("video_relpath", rel)
    failures = union.filter((F.col("sample_id") == "") | (F.col("video_relpath") == "")).select(
        "source", "ordinal", "sample_id",
        F.when(F.col("sample_id") == "", "missing_sample_id").otherwise("missing_video_relpath").alias("reason"),
    )
    split = F.coalesce(F.nullif(strip(F.col("split")), F.lit("")), F.lit("unknown"))
    first = (
        union.filter((F.col("sample_id") != "") & (F.col("video_relpath") != ""))
        .groupBy("sample_id")
        .agg(F.min(F.struct("source", "ordinal", split.alias("split"), "video_relpath")).alias("r"))
        .select("sample_id", "r.source", "r.ordinal", "r.split", "r.video_relpath")
    )
    return first, failures


def minimum_groups(df: DataFrame, group: str, least: int = 3) -> DataFrame:
    """Violation row when there are fewer than ``least`` groups."""
    return (
        df.agg(F.count_distinct(group).alias("n"))
        .filter(F.col("n") < least)
        .select(F.lit("too_few_groups").alias("rule"), F.lit(group).alias("key"), F.col("n").cast("string").alias("detail"))
    )
