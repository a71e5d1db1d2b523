"""Ranks, cuts and quantiles that stay exact when one group holds a third of all rows.

A plain ``row_number() over (partition by label)`` sorts a whole label in one task. Here rows fall
into hash buckets per group; bucket counts (a partial aggregate) give each bucket its offset, and
only rows of the few buckets that a cut runs through are ranked one by one. A bucket that is still
too large is split further by more hash digits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipmill.session import stored

DIGITS = 3  # hex digits per level: 4096 buckets
MAX_RANK_ROWS = 1_000_000  # rows that one task may rank
BLOCK_ROWS = 10  # power of two: sorted rows that are summed as one block


def seeded_hash(seed: int | str, key: Column) -> Column:
    """Order that stands in for a seeded shuffle: md5 of ``seed|key``."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_number(*parts: Column) -> Column:
    """Non-negative 60-bit number from md5 of the parts joined by ``|``."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.left(digest, F.lit(15)), 16, 10).cast("bigint")


def _prefix(digits: int) -> Column:
    return F.left("_h", F.lit(digits))


def _last_below(cut: str) -> Column:
    """The bucket a cut runs through: the last one that starts below it, with its start and size."""
    return F.max(F.when(F.col("_start") < F.col(f"_p{cut}"), F.struct("_b", "_start", "_c"))).alias(f"_cut{cut}")


def _bucket_cuts(rows: DataFrame, by: list[str], sizes) -> DataFrame:
    """by, _p1, _p2 (first ranks of val and test) and the buckets both run through."""
    buckets = rows.groupBy(*by, _prefix(DIGITS).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    inside = W.partitionBy(*by)
    train_n, val_n = sizes(F.col("_n"))
    return (
        buckets.withColumn("_start", F.sum("_c").over(inside.orderBy("_b")) - F.col("_c"))
        .withColumn("_n", F.sum("_c").over(inside))
        .withColumn("_p1", train_n.cast("bigint"))
        .withColumn("_p2", F.col("_p1") + val_n.cast("bigint"))
        .groupBy(*by)
        .agg(F.max("_p1").alias("_p1"), F.max("_p2").alias("_p2"), _last_below("1"), _last_below("2"))
    )


def _finer_cuts(rows: DataFrame, by: list[str], cuts: DataFrame, digits: int) -> DataFrame:
    """The same cuts with buckets of ``digits + DIGITS`` hex digits, from the rows of the cut buckets only."""
    b = _prefix(digits)
    on = F.array_compact(F.array(*[
        F.when(b == F.col(f"_cut{c}._b"), F.struct(F.lit(c).alias("c"), F.col(f"_cut{c}._start").alias("s"))) for c in ("1", "2")
    ]))
    near = rows.join(cuts, by).select(*by, "_p1", "_p2", _prefix(digits + DIGITS).alias("_b"), F.explode(on).alias("_w"))
    near = near.groupBy(*by, "_w", "_b").agg(F.count(F.lit(1)).alias("_c"), F.max("_p1").alias("_p1"), F.max("_p2").alias("_p2"))
    inside = W.partitionBy(*by, "_w").orderBy("_b")
    near = near.withColumn("_start", F.sum("_c").over(inside) - F.col("_c") + F.col("_w.s"))
    pick = lambda c: F.max(F.when((F.col("_w.c") == c) & (F.col("_start") < F.col(f"_p{c}")), F.struct("_b", "_start", "_c"))).alias(f"_cut{c}")
    fresh = near.groupBy(*by).agg(pick("1"), pick("2"))
    return cuts.select(*by, "_p1", "_p2").join(fresh, by, "left")


def assign_splits(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    seed: int | str,
    sizes: Callable[[Column], tuple[Column, Column]],
    out: str = "split",
    max_rank_rows: int = MAX_RANK_ROWS,
) -> DataFrame:
    """Give each row train/val/test by its hash rank inside ``by``.

    ``sizes(n)`` returns the train and val sizes for a group of ``n`` rows. Ties go to ``key`` order.
    """
    rows = df.withColumn("_h", seeded_hash(seed, F.col(key)))
    groups = list(by)
    if not groups:
        rows, groups = rows.withColumn("_all", F.lit(0)), ["_all"]
    digits = DIGITS
    cuts = stored(_bucket_cuts(rows, groups, sizes), "cuts")
    largest = lambda: cuts.agg(F.max(F.greatest("_cut1._c", "_cut2._c"))).first()[0] or 0
    while largest() > max_rank_rows and digits < 30:
        cuts = stored(_finer_cuts(rows, groups, cuts, digits), "cuts")
        digits += DIGITS
    placed = rows.join(cuts, groups).withColumn("_b", _prefix(digits))
    at = lambda c: F.coalesce(F.col("_b") == F.col(f"{c}._b"), F.lit(False))
    below = lambda c: F.coalesce(F.col("_b") < F.col(f"{c}._b"), F.lit(False))
    on_cut = at("_cut1") | at("_cut2")
    easy = placed.filter(~on_cut).withColumn(
        out, F.when(below("_cut1"), "train").when(below("_cut2"), "val").otherwise("test")
    )
    start = F.when(at("_cut1"), F.col("_cut1._start")).otherwise(F.col("_cut2._start"))
    rank = F.row_number().over(W.partitionBy(*groups, "_b").orderBy("_h", key)) - 1 + start
    hard = (
        placed.filter(on_cut)
        .withColumn("_r", rank)
        .withColumn(out, F.when(F.col("_r") < F.col("_p1"), "train").when(F.col("_r") < F.col("_p2"), "val").otherwise("test"))
        .drop("_r")
    )
    return easy.unionByName(hard).select(*df.columns, out)


def hash_row_number(df: DataFrame, by: Sequence[str], key: str, seed: int | str, digits: int = DIGITS, out: str = "rn") -> DataFrame:
    """0-based rank inside ``by`` in hash order. One task ranks one bucket of one group;
    callers raise ``digits`` for large groups (see ``digits_for``)."""
    by = list(by)
    rows = df.withColumn("_h", seeded_hash(seed, F.col(key))).withColumn("_b", _prefix(digits))
    offsets = (
        rows.groupBy(*by, "_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_off", F.sum("_c").over(W.partitionBy(*by).orderBy("_b")) - F.col("_c"))
        .drop("_c")
    )
    local = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_h", key)) - 1
    return rows.withColumn("_l", local).join(offsets, [*by, "_b"]).select(*df.columns, (F.col("_l") + F.col("_off")).alias(out))


def digits_for(rows: int) -> int:
    """Hex digits that keep a bucket of a group of ``rows`` rows below the rank limit, one at least."""
    digits = 1
    while rows > MAX_RANK_ROWS * 16**digits:
        digits += 1
    return digits


def top_k_first_seen(df: DataFrame, label: str, ordinal: str, k: int) -> DataFrame:
    """k most frequent labels, ties by first appearance."""
    return (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first_seen"))
        .orderBy(F.desc("n"), F.asc("first_seen"))
        .limit(k)
    )


def nearest_rank(
    df: DataFrame, value: str, index: Callable[[Column], Column], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """``by``, n, value_at: the value at sorted position ``index(n)``, exact.

    ``weight`` names a count column when rows already stand for several values. Counts per value are range-sorted into a table;
    its parts, then blocks of ``BLOCK_ROWS`` rows, then rows are summed in that order, each time only in the piece that the
    position falls into. Range bounds come from the data, so no value range is too dense and no task sorts a whole group.
    """
    by = list(by)
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("c"))
    )
    rows = stored(hist.orderBy(*by, "v").withColumn("place", F.monotonically_increasing_id()), "quantile")
    asked = rows.groupBy(*by).agg(F.sum("c").alias("n")).withColumn("k", index(F.col("n")).cast("bigint"))
    if by:
        asked = asked.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "n", "k")
        same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
        rows = rows.join(asked, same).drop(*[f"_by{i}" for i in range(len(by))])
    else:
        n, k = asked.first()
        rows = rows.withColumn("n", F.lit(n).cast("bigint")).withColumn("k", F.lit(k).cast("bigint"))
    inside = W.partitionBy(*(by or [F.lit(1)]))
    reached = (F.col("cum") > F.col("k")) & (F.col("cum") - F.col("s") <= F.col("k"))
    for shift in (33, BLOCK_ROWS, 0):
        piece = F.shiftright("place", shift).alias("piece")
        sums = rows.groupBy(*by, piece, "n", "k").agg(F.sum("c").alias("s"), F.max("v").alias("v"))
        hit = sums.withColumn("cum", F.sum("s").over(inside.orderBy("piece"))).filter(reached)
        if shift == 0:
            return hit.select(*by, "n", F.col("v").alias("value_at"))
        hit = hit.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("piece").alias("_piece"), (F.col("k") - F.col("cum") + F.col("s")).alias("_k"))
        same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
        rows = rows.join(hit, [*same, F.shiftright("place", shift) == F.col("_piece")]).select(*by, "v", "c", "place", "n", F.col("_k").alias("k"))


def readiness_index(n: Column) -> Column:
    """round(0.95 * (n - 1)), half to even."""
    return F.greatest(F.lit(0), F.rint(F.lit(0.95) * (n - 1)).cast("bigint"))


def telemetry_index(n: Column) -> Column:
    """max(0, int(0.95 * n) - 1)."""
    return F.greatest(F.lit(0), F.floor(F.lit(0.95) * n) - 1)


def spread_sequence(df: DataFrame, n: Column, out: str, chunk: int = 4096) -> DataFrame:
    """One row per 0..n-1, spread over tasks even when a single row asks for billions."""
    blocks = df.withColumn("_n", n.cast("bigint")).filter(F.col("_n") > 0)
    blocks = blocks.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / chunk))))
    blocks = blocks.repartition("_blk", *df.columns[:1])
    lo = F.col("_blk") * chunk
    hi = F.least(F.col("_n") - 1, lo + chunk - 1)
    return blocks.withColumn(out, F.explode(F.sequence(lo, hi))).drop("_n", "_blk")
