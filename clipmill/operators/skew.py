"""Joins of many rows to one row per key when a few keys hold most rows.

A frequent-items sketch (one pass over the key column, merged like any aggregate, of fixed size) names the keys that hold more than a
partition's fair share. Only their rows are dealt out over several tasks, by a hash of their own columns, and only their one row on the
other side is repeated as often. All other rows join as they would. The result does not depend on what the sketch says; a key that
it misses or names wrongly costs time alone. Adaptive execution is not needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys looked at, and items that the sketch tracks: a key with a thousandth of all rows is not missed.
TOP, TRACKED = 256, 8192
#: Pieces of a heavy key for each fair share of rows: small ones even out over the tasks they are hashed to.
PIECES = 16


def heavy_keys(df: DataFrame, key: str, parts: int) -> list[tuple[object, int]]:
    """(key, pieces its rows are dealt out in) of keys with more than half of a partition's fair share; at most ``TOP`` of them."""
    row = df.filter(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {TOP}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    fair = max(row.n / max(parts, 1), 1)
    return [(x["item"], math.ceil(PIECES * x["count"] / fair)) for x in row.top or [] if 2 * x["count"] > fair and parts > 1]


def spread_join(df: DataFrame, facts: DataFrame, key: str, by: list[str] | None = None, how: str = "inner") -> DataFrame:
    """``df.join(facts, key)`` for ``facts`` with one row per key; ``by`` names the columns whose hash deals out a heavy key's rows."""
    spark = df.sparkSession
    heavy = heavy_keys(df, key, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not heavy:
        return df.join(facts, key, how)
    kind = df.schema[key].dataType.simpleString()
    table = F.broadcast(spark.createDataFrame(heavy, f"__key {kind}, __n int"))  # at most TOP rows
    own: Column = F.xxhash64(*(by or [c for c, t in df.dtypes if not t.startswith("map")]))
    many = df.join(table, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.coalesce(F.pmod(own, F.col("__n")), F.lit(0)).cast("int")).drop("__key", "__n")
    few = facts.join(table, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__n"), F.lit(1)) - 1))).drop("__key", "__n")
    return many.join(few, [key, "__salt"], how).drop("__salt")
