"""Joins with a hot key: same rows as a plain join, and no task far above the others with adaptive execution off."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipmill.operators import pose as P
from clipmill.operators import splits as S
from clipmill.operators.skew import heavy_keys, spread_join


@pytest.fixture
def plain_plans(spark):
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def frames(spark, n=60_000, width=2):
    """One clip holds a third of all frames, two more a tenth each, a thousand share the rest; some have no clip."""
    k = F.col("id")
    clip = F.when(k % 30 < 10, "hot").when(k % 30 < 13, "warm").when(k % 30 < 16, "luke").when(k % 30 == 16, None).otherwise(F.concat(F.lit("c"), (k % 997).cast("string")))
    return spark.range(n).select(clip.alias("clip_id"), F.col("id").alias("frame_idx"), F.array(*[(k % (7 + j)).cast("double") for j in range(width)]).alias("f")).repartition(6)


def loads(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_heavy_keys(spark):
    found = dict(heavy_keys(frames(spark), "clip_id", 16))
    assert set(found) == {"hot", "warm", "luke"} and found["hot"] > found["warm"] > 1
    assert heavy_keys(frames(spark).limit(0), "clip_id", 16) == [] and heavy_keys(frames(spark), "clip_id", 1) == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, plain_plans, how):
    df = frames(spark)
    facts = df.filter("clip_id is not null and clip_id <> 'c5'").groupBy("clip_id").agg(F.count(F.lit(1)).alias("size"))
    got, want = spread_join(df, facts, "clip_id", ["frame_idx"], how), df.join(facts, "clip_id", how)
    assert got.columns == want.columns
    assert Counter((r.clip_id, r.frame_idx, r.size) for r in got.collect()) == Counter((r.clip_id, r.frame_idx, r.size) for r in want.collect())
    if how == "inner":
        assert max(loads(got)) <= 2 * np.median(loads(got)) < max(loads(want))


def test_zscore_and_split_with_a_hot_clip(spark, plain_plans):
    df = frames(spark).filter("clip_id is not null")
    z = P.zscore_clip(df)
    assert max(loads(z)) <= 2 * np.median(loads(z))
    one = {r.frame_idx: r.f for r in z.filter("clip_id = 'hot'").collect()}
    src = {r.frame_idx: r.f for r in df.filter("clip_id = 'hot'").collect()}
    values = np.array([src[i] for i in sorted(src)])
    assert np.allclose([one[i] for i in sorted(src)], (values - values.mean(0)) / values.std(0))
    rows, bad = S.group_independent_split(frames(spark), "clip_id", 7)
    assert rows.count() == df.count() and bad.count() == 2000
    assert rows.groupBy("clip_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
