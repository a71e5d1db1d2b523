"""Array rules for pose frames: joints are ARRAY<ARRAY<num>>, features ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipmill.constants import EPS, Q64_ALPHABET, Q64_CLIP


def normalize_landmarks(joints: Column, first: int, second: int) -> Column:
    """Centre xyz between two joints and divide by their distance; further channels stay."""
    axis = lambda j, k: F.element_at(F.get(joints, F.lit(j)), k).cast("double")
    gap = [axis(first, k) - axis(second, k) for k in (1, 2, 3)]
    dist = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2])
    scale = F.when(dist > EPS, dist).otherwise(F.lit(1.0))
    mid = [(axis(first, k) + axis(second, k)) / 2.0 for k in (1, 2, 3)]
    ref = F.struct(scale.alias("s"), *[m.alias(f"m{k}") for k, m in enumerate(mid, 1)])
    # One-element array: the reference values are computed once, not once per joint.
    return F.get(
        F.transform(
            F.array(ref),
            lambda r: F.transform(
                joints,
                lambda j: F.concat(
                    F.array(*[(j[k - 1].cast("double") - r[f"m{k}"]) / r["s"] for k in (1, 2, 3)]),
                    F.transform(F.slice(j, 4, F.greatest(F.size(j) - 3, F.lit(0))), lambda v: v.cast("double")),
                ),
            ),
        ),
        F.lit(0),
    )


def cut_channels(joints: Column, keep: int = 3) -> Column:
    return F.transform(joints, lambda j: F.slice(j, 1, keep))


def flatten_joints(*components: Column) -> Column:
    """Row-major features of the present components, in the given order, as doubles."""
    parts = [F.coalesce(F.flatten(c).cast("array<double>"), F.array().cast("array<double>")) for c in components]
    return F.concat(*parts)


def zscore_frame(f: Column) -> Column:
    """Across one frame's features: (x - mean) / max(std, 1e-6)."""
    n = F.size(f)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    stats = F.transform(F.array(total(f) / n), lambda m: F.struct(m.alias("m"), F.sqrt(total(F.transform(f, lambda v: (v - m) * (v - m))) / n).alias("s")))
    return F.get(F.transform(stats, lambda r: F.transform(f, lambda v: (v - r["m"]) / F.greatest(r["s"], F.lit(EPS)))), F.lit(0))


def q64_char(v: Column, clip: float = Q64_CLIP) -> Column:
    """One of 64 characters for a value clamped to ±clip, half to even."""
    c = F.greatest(F.lit(-clip), F.least(F.lit(clip), v.cast("double")))
    return F.substr(F.lit(Q64_ALPHABET), F.rint((c + clip) / (2 * clip) * 63).cast("int") + 1, F.lit(1))


def q64_row(f: Column) -> Column:
    return F.array_join(F.transform(f, lambda v: q64_char(v)), "")


def covered(joints: Column) -> Column:
    return F.coalesce(F.exists(F.flatten(joints), lambda v: F.abs(v) > 0), F.lit(False))


def rotate_xy(joints: Column, radians: Column) -> Column:
    """True rotation of x and y; the source is read before either is replaced."""
    return F.transform(
        joints,
        lambda j: F.concat(
            F.array(
                j[0].cast("double") * F.cos(radians) - j[1].cast("double") * F.sin(radians),
                j[0].cast("double") * F.sin(radians) + j[1].cast("double") * F.cos(radians),
            ),
            F.transform(F.slice(j, 3, F.greatest(F.size(j) - 2, F.lit(0))), lambda v: v.cast("double")),
        ),
    )


def even_indices(n: Column, k: int, few: str = "all") -> Column:
    """k frame numbers over 0..n-1, ends included, half to even.

    With fewer than k frames: ``error`` gives null, ``all`` every frame, ``repeat`` repeats frames.
    """
    n = n.cast("bigint")
    if k <= 0:
        raise ValueError("k must be positive")
    one = F.array(F.lit(0).cast("bigint"))
    picks = one if k == 1 else F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / F.lit(k - 1)).cast("bigint")
    )
    none = F.lit(None).cast("array<bigint>")
    every = F.sequence(F.lit(0).cast("bigint"), n - 1)
    short = {"error": none, "all": F.when(n > 0, every), "repeat": F.when(n > 0, picks)}[few]
    enough = n > k if few == "all" else n >= k
    return F.when(enough, picks).otherwise(short)
