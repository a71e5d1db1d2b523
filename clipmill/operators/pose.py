"""Pose and feature sequences, one row per frame. No clip is ever gathered whole, however long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill import constants as K
from clipmill.functions.arrays import covered, even_indices, q64_char, q64_row, rotate_xy
from clipmill.functions.text import normalize_gloss, parse_input_block, strip
from clipmill.operators.ranking import hash_number, spread_sequence
from clipmill.operators.skew import spread_join
from clipmill.session import stored



def feature_stats(df: DataFrame) -> DataFrame:
    """(clip_id, mean[], std[]) from (clip_id, f[]): map-side partial sums, one row per clip and feature."""
    per = df.select("clip_id", F.posexplode("f").alias("k", "v")).groupBy("clip_id", "k").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s")
    )
    return per.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("k", "m", "s"))).alias("st"))


def zscore_clip(df: DataFrame) -> DataFrame:
    """Per clip and feature: (x - mean) / max(std, 1e-6), non-finite values become 0."""
    def one(v: Column, st: Column) -> Column:
        z = (v - st["m"]) / F.greatest(st["s"], F.lit(K.EPS))
        bad = z.isNull() | F.isnan(z) | (F.abs(z) == F.lit(float("inf")))
        return F.when(bad, F.lit(0.0)).otherwise(z)

    return spread_join(df, feature_stats(df), "clip_id", ["frame_idx"]).withColumn("f", F.zip_with("f", "st", one)).drop("st")


def clip_lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("clip_id").agg((F.max("frame_idx") + 1).cast("bigint").alias("n_src"))


def resample_linear(
    df: DataFrame, targets: DataFrame, zero_target: str = "error", lengths: DataFrame | None = None
) -> DataFrame:
    """(clip_id, frame_idx, f[]) -> ``n_target`` frames per clip of ``targets(clip_id, n_target)``.

    Each source frame works out which target positions it touches (exact whole-number arithmetic)
    and sends its features only there: one shuffle keyed (clip, target), so long clips do not pile up.
    A target of 0 or less gives no rows (``error``) or one frame (``one``). ``lengths(clip_id, n_src)``
    saves counting frames when they are known.
    """
    size = targets.join(clip_lengths(df) if lengths is None else lengths, "clip_id")
    if zero_target == "one":
        size = size.withColumn("n_target", F.greatest(F.col("n_target"), F.lit(1)))
    t, s = F.col("n_target").cast("bigint"), F.col("n_src")
    i = F.col("frame_idx").cast("bigint")
    j = spread_join(df, size.filter(F.col("n_target") > 0), "clip_id", ["frame_idx"])
    none = F.array().cast("array<bigint>")

    def span(x: Column) -> Column:
        """Target positions whose lower source frame is x."""
        lo = _ceil_div(x * (t - 1), s - 1)
        hi = _ceil_div((x + 1) * (t - 1), s - 1) - 1
        return F.when(x == s - 1, F.array(t - 1)).when((x < 0) | (hi < lo), none).otherwise(F.sequence(lo, hi))

    one_source, one_target, same = s == 1, t == 1, s == t
    zero = F.lit(0).cast("bigint")
    as_lo = (
        F.when(same, F.array(i)).when(one_source, F.sequence(zero, t - 1))
        .when(one_target, F.when(i == 0, F.array(zero)).otherwise(none)).otherwise(span(i))
    )
    as_hi = F.when(same | one_source | one_target | (i == 0), none).otherwise(F.when(i - 1 == s - 1, none).otherwise(span(i - 1)))
    frac = F.when(same | one_source | one_target, F.lit(0.0)).otherwise((F.col("pos") * (s - 1)) % (t - 1) / (t - 1))
    lo = j.select("clip_id", "f", "n_src", "n_target", F.explode(as_lo).alias("pos")).select(
        "clip_id", "pos", frac.alias("w"), F.col("f").alias("a"), F.lit(None).cast(df.schema["f"].dataType).alias("b"))
    hi = j.select("clip_id", "f", "n_src", "n_target", F.explode(as_hi).alias("pos")).select(
        "clip_id", "pos", F.lit(None).cast("double").alias("w"), F.lit(None).cast(df.schema["f"].dataType).alias("a"), F.col("f").alias("b"))
    pair = lo.unionByName(hi).groupBy("clip_id", "pos").agg(
        F.max("w").alias("w"), F.first("a", True).alias("a"), F.first("b", True).alias("b")
    )
    mixed = F.when(
        (F.col("w") > 0) & F.col("b").isNotNull(),
        F.zip_with("a", "b", lambda x, y: x * (F.lit(1.0) - F.col("w")) + y * F.col("w")),
    ).otherwise(F.col("a").cast("array<double>"))
    return pair.select("clip_id", F.col("pos").alias("frame_idx"), mixed.alias("f"))


def _ceil_div(a: Column, b: Column) -> Column:
    """Whole-number ceiling of a / b for a >= 0, b > 0."""
    top = a + b - 1
    return ((top - top % b) / b).cast("bigint")


def q64_rows(df: DataFrame, stride: int = 1) -> DataFrame:
    """(clip_id, frame_idx, chars): one encoded row per kept frame."""
    kept = df if stride == 1 else df.filter(F.col("frame_idx") % stride == 0)
    return kept.select("clip_id", "frame_idx", q64_row(F.col("f")).alias("chars"))


def q64_payload(rows: DataFrame) -> DataFrame:
    """(clip_id, payload): rows joined by ``|`` in frame order.

    A record is one text, so one row holds a clip whatever its length: 65 characters a frame and 64 features, 7 MB for an hour of video.
    """
    return (
        rows.groupBy("clip_id")
        .agg(F.sort_array(F.collect_list(F.struct("frame_idx", "chars"))).alias("s"))
        .select("clip_id", F.array_join(F.transform("s", lambda x: x["chars"]), "|").alias("payload"))
    )


def q64_summary(df: DataFrame) -> DataFrame:
    """(clip_id, summary): ``m=`` means and ``d=`` last-first over the width of the shortest frame."""
    n = df.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("f")).alias("w"))
    per = df.select("clip_id", "frame_idx", F.posexplode("f").alias("k", "v")).groupBy("clip_id", "k").agg(
        F.avg("v").alias("m"), (F.max_by("v", "frame_idx") - F.min_by("v", "frame_idx")).alias("d")
    )
    lists = per.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("k", "m", "d"))).alias("s"))
    kept = F.filter("s", lambda x: x["k"] < F.col("w"))
    chars = lambda f: F.array_join(F.transform(kept, lambda x: q64_char(x[f])), "")
    text = F.concat(F.lit("m="), chars("m"), F.lit("\nd="), chars("d"))
    return n.join(lists, "clip_id", "left").select("clip_id", F.coalesce(text, F.lit("m=\nd=")).alias("summary"))


def export_q64_records(df: DataFrame, clips: DataFrame, mode: str) -> DataFrame:
    """(clip_id, instruction, input, output) of one mode: q64_full, q64_stride2, q64_summary. One record per clip.

    ``clips(clip_id, sample_id, output)``.
    """
    facts = df.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("f")).alias("w"))
    if mode == "q64_summary":
        body = q64_summary(df).select("clip_id", F.col("summary").alias("body"))
    else:
        stride = {"q64_full": 1, "q64_stride2": 2}[mode]
        body = q64_payload(q64_rows(df, stride)).select("clip_id", F.concat(F.lit("pose_q64="), F.col("payload")).alias("body"))
    shape = {
        "q64_full": F.format_string("frames=%d features_per_frame=%d", "n", "w"),
        "q64_stride2": F.format_string(
            "frames_used=%d original_frames=%d features_per_frame=%d", F.floor((F.col("n") + 1) / 2), F.col("n"), F.col("w")),
        "q64_summary": F.format_string("original_frames=%d features_per_frame=%d", "n", "w"),
    }[mode]
    text = F.concat(
        F.lit("sample_id="), F.col("sample_id"), F.lit(f"\nencoding={mode} clip=4 alphabet={K.Q64_ALPHABET}\n"), shape, F.lit("\n"), F.col("body")
    )
    return clips.join(facts, "clip_id").join(body, "clip_id").select(
        "clip_id", F.lit(K.Q64_INSTRUCTION).alias("instruction"), text.alias("input"), "output"
    )


def export_manifest(records: DataFrame) -> DataFrame:
    """One row: samples and mean characters per record."""
    chars = F.length("instruction") + F.length("input") + F.length("output")
    return records.agg(F.count(F.lit(1)).alias("samples"), F.rint(F.avg(chars)).cast("bigint").alias("avg_chars"))


def validate_q64_records(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Violations (rule, key, detail) of records against ``expected(sample_id, expected_gloss, frames, features)``."""
    r = parse_input_block(records, "input").withColumn("sample_id", F.col("p.sample_id")).join(expected, "sample_id", "left")
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    rows = F.split("p.pose_q64", r"\|")
    bad_payload = (F.size(rows) != F.col("frames")) | F.exists(rows, lambda x: F.length(x) != F.col("features"))
    rules = F.array_compact(F.array(
        *[F.when(blank(c), F.lit(f"missing_{c}")) for c in ("instruction", "input", "output")],
        F.when(F.col("expected_gloss").isNull(), "unknown_sample_id"),
        F.when(~F.col("p.encoding").eqNullSafe(F.lit(f"{K.Q64_ENCODING} clip=4 alphabet={K.Q64_ALPHABET}")), "encoding_line"),
        F.when(~F.coalesce(F.col("p.shape_ok"), F.lit(False)), "malformed_shape")
        .when((F.col("p.frames") != F.col("frames")) | (F.col("p.features") != F.col("features")), "shape_mismatch"),
        F.when(F.coalesce("p.pose_q64", F.lit("")) == "", "missing_payload").when(bad_payload, "payload_shape"),
        F.when(normalize_gloss(F.col("output")) != F.col("expected_gloss"), "label_mismatch"),
    ))
    return r.select(F.explode(rules).alias("rule"), F.coalesce("sample_id", F.lit("")).alias("key"), F.lit("").alias("detail"))


def verify_pose_vs_records(features: DataFrame, clips: DataFrame, records: DataFrame) -> DataFrame:
    """Re-encode archives on the frame count of their reference record and report per sample.

    ``features(clip_id, frame_idx, f)``, ``clips(clip_id, sample_id, archive_id, expected_gloss)``,
    ``records(instruction, input, output)``.
    """
    ref = parse_input_block(records, "input").select("p", normalize_gloss(F.col("output")).alias("record_gloss")).select(
        F.col("p.sample_id").alias("sample_id"), "record_gloss", F.col("p.frames").alias("ref_frames"), F.col("p.features").alias("ref_features"))
    facts = features.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("source_frames"), (F.max("frame_idx") + 1).cast("bigint").alias("n_src"),
        F.min(F.size("f")).cast("bigint").alias("features"))
    meta = clips.join(facts, "clip_id").join(ref, "sample_id", "left")
    rule = (
        F.when(F.col("archive_id").isNotNull() & (F.col("archive_id") != F.col("sample_id")), "archive_sample_id_mismatch")
        .when(F.col("record_gloss").isNull(), "sample_id_not_found")
        .when(F.col("record_gloss") != F.col("expected_gloss"), "expected_gloss_mismatch")
        .when(F.col("ref_frames").isNull(), "missing_shape")
        .when(F.col("ref_features") != F.col("features"), "feature_mismatch")
        .when(F.col("ref_frames") <= 0, "frame_count_not_positive")
    )
    meta = meta.withColumn("problem", rule)
    meta = stored(meta, "verify-clips")  # one row per clip, read three times below
    good = meta.filter("problem is null")
    again = resample_linear(
        zscore_clip(features.join(good.select("clip_id"), "clip_id", "left_semi")),
        good.select("clip_id", F.col("ref_frames").alias("n_target")),
        lengths=good.select("clip_id", "n_src"),
    )
    out = q64_rows(again).groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.length("chars")).alias("payload_chars"))
    return meta.join(out, "clip_id", "left").select(
        "sample_id", "expected_gloss", "source_frames", "frames", "features", "payload_chars", "problem",
        (F.col("problem").isNull() & (F.col("frames") == F.col("ref_frames")) & (F.col("payload_chars") == F.col("frames") * F.col("features"))).alias("verified"),
    )


def component_coverage(df: DataFrame, components: Sequence[str]) -> DataFrame:
    """(clip_id, component, frames, joints, coordinates, covered_frames)."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("component"), F.size(c).alias("j"), F.size(F.get(F.col(c), F.lit(0))).alias("x"), covered(F.col(c)).alias("hit"))
        for c in components
    ])
    return (
        df.select("clip_id", F.explode(rows).alias("r")).filter("r.j >= 0")
        .groupBy("clip_id", F.col("r.component").alias("component"))
        .agg(
            F.count(F.lit(1)).alias("frames"), F.max("r.j").cast("bigint").alias("joints"),
            F.max("r.x").cast("bigint").alias("coordinates"), F.count_if("r.hit").alias("covered_frames"),
        )
    )


def _unit(seed: int, what: str) -> Column:
    """Number in [-1, 1] for a clip, from md5 of (seed, purpose, clip)."""
    return hash_number(F.lit(seed), F.lit(what), F.col("clip_id")) % 1_000_000 / F.lit(999_999.0) * 2 - 1


def augmentation_angle(rotation_degrees: float, seed: int) -> Column:
    return F.radians(_unit(seed, "angle") * rotation_degrees)


def augmentation_plan(lengths: DataFrame, rotation_degrees: float, speed_variation: float, seed: int) -> DataFrame:
    """(clip_id, radians, n_target): hash-seeded angle and length after the speed change, per clip."""
    scale = F.lit(1.0) + _unit(seed, "speed") * speed_variation
    return lengths.select(
        "clip_id", augmentation_angle(rotation_degrees, seed).alias("radians"),
        F.greatest(F.lit(1), F.rint(F.col("n_src") / F.greatest(scale, F.lit(1e-3))).cast("bigint")).alias("n_target"),
    )


def augment_pose(df: DataFrame, components: Sequence[str], rotation_degrees: float, speed_variation: float, seed: int) -> DataFrame:
    """Rotate every component in the xy plane and change the speed: (clip_id, frame_idx, f[])."""
    lengths = clip_lengths(df)
    plan = augmentation_plan(lengths, rotation_degrees, speed_variation, seed)
    angles = df.withColumn("radians", augmentation_angle(rotation_degrees, seed))  # from the clip id alone
    flat = F.flatten(F.concat(*[rotate_xy(F.col(c), F.col("radians")) for c in components]))
    return resample_linear(angles.select("clip_id", "frame_idx", flat.alias("f")), plan.select("clip_id", "n_target"), lengths=lengths)


def pad_and_mask(df: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames padded with zeros to the longest clip of their batch + mask, violations).

    ``batches(clip_id, batch_id)``. Padding rows are made from lengths alone and spread over tasks.
    """
    per = df.groupBy("clip_id").agg(
        (F.max("frame_idx") + 1).cast("bigint").alias("length"), F.max(F.size("f")).alias("w"), F.min(F.size("f")).alias("w0")
    ).join(batches, "clip_id")
    longest = per.groupBy("batch_id").agg(F.max("length").alias("padded"), F.max("w").alias("bw"), F.min("w0").alias("bw0"))
    bad = longest.filter("bw <> bw0").select(F.lit("mixed_feature_width").alias("rule"), F.col("batch_id").cast("string").alias("key"), F.lit("").alias("detail"))
    meta = per.join(longest, "batch_id")
    real = df.join(meta.select("clip_id", "batch_id", "length"), "clip_id").select(
        "batch_id", "clip_id", F.col("frame_idx").cast("bigint").alias("t"), F.col("f").cast("array<double>").alias("f"), F.lit(True).alias("mask"), "length")
    pad = spread_sequence(meta.select("clip_id", "batch_id", "length", "padded", "bw"), F.col("padded") - F.col("length"), "i").select(
        "batch_id", "clip_id", (F.col("length") + F.col("i")).alias("t"),
        F.array_repeat(F.lit(0.0), F.col("bw")).alias("f"), F.lit(False).alias("mask"), "length")
    return real.unionByName(pad), bad


def pose_summary(frames: DataFrame, by: str = "request_id") -> DataFrame:
    """(by, frame_count, first_ts_ms, last_ts_ms) by frame index."""
    return frames.groupBy(by).agg(
        F.count(F.lit(1)).alias("frame_count"), F.min_by("ts_ms", "frame_idx").alias("first_ts_ms"),
        F.max_by("ts_ms", "frame_idx").alias("last_ts_ms"),
    )


def missing_requests(requests: DataFrame, frames: DataFrame, by: str = "request_id") -> DataFrame:
    """Requests without any frame, as violations."""
    return requests.join(frames.select(by).distinct(), by, "left_anti").select(
        F.lit("no_frames").alias("rule"), F.col(by).cast("string").alias("key"), F.lit("").alias("detail"))


def even_sample(frames: DataFrame, k: int, few: str = "all") -> DataFrame:
    """The k evenly spaced frames of each clip, with their place ``slot``."""
    picks = clip_lengths(frames).select("clip_id", F.posexplode(even_indices(F.col("n_src"), k, few)).alias("slot", "frame_idx"))
    return picks.join(frames.withColumn("frame_idx", F.col("frame_idx").cast("bigint")), ["clip_id", "frame_idx"])


def fixed_fps_plan(clips: DataFrame, fps: float = K.TARGET_FPS, max_frames: int = K.MAX_FRAMES) -> tuple[DataFrame, DataFrame]:
    """((clip_id, frame, source_frame, ts_ms), violations FRAME_COUNT_EXCEEDED).

    ``clips(clip_id, duration_seconds, src_fps, n_frames)``.
    """
    expected = F.when(F.col("duration_seconds") <= 0, 0).otherwise(F.ceil(F.col("duration_seconds") * F.lit(fps) - F.lit(1e-9)))
    c = clips.withColumn("expected", expected.cast("bigint"))
    over = c.filter(F.col("expected") > max_frames).select(
        F.lit("FRAME_COUNT_EXCEEDED").alias("rule"), F.col("clip_id").cast("string").alias("key"), F.col("expected").cast("string").alias("detail"))
    ok = c.filter((F.col("expected") > 0) & (F.col("expected") <= max_frames)).withColumn(
        "frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("expected") - 1)))
    src = F.when(F.col("src_fps") > 0, F.col("src_fps")).otherwise(F.lit(fps))
    t = F.col("frame") / F.lit(fps)
    return ok.select(
        "clip_id", "frame", F.least(F.rint(t * src).cast("bigint"), F.col("n_frames").cast("bigint") - 1).alias("source_frame"),
        F.rint(t * F.lit(1000.0)).cast("bigint").alias("ts_ms"),
    ), over
