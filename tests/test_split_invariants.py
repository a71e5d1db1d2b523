import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clipmill.operators import sampling as Y
from clipmill.operators import splits as S
from clipmill.operators.ranking import assign_splits, hash_row_number, spread_sequence


def half_even(x):
    return round(x)


def expected_sizes(n):
    t = max(1, half_even(0.7 * n)) if n >= 3 else max(1, n - 1)
    left = n - t
    v = half_even(0.15 * n) if left > 1 else min(1, left)
    return (t, left, 0) if left - v < 0 else (t, v, left - v)


def hot_rows(spark):
    """One label holds most rows; many small ones."""
    return spark.range(4000).select(
        F.col("id").cast("string").alias("sample_id"), F.col("id").alias("ordinal"),
        F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("l"), (F.col("id") % 130).cast("string"))).alias("gloss"),
        (F.col("id") % 37).alias("signer_id"))


def plain(rows, sizes, key=lambda r: r.sample_id):
    groups = defaultdict(list)
    for r in rows:
        groups[r.gloss].append(r)
    out = {}
    for g, rs in groups.items():
        rs.sort(key=lambda r: (hashlib.md5(f"42|{key(r)}".encode()).hexdigest(), key(r)))
        t, v, _ = sizes(len(rs))
        for i, r in enumerate(rs):
            out[key(r)] = "train" if i < t else "val" if i < t + v else "test"
    return out


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_stratified_matches_plain_rank_even_when_buckets_are_refined(spark, limit):
    df = hot_rows(spark)
    got = assign_splits(df, ["gloss"], "sample_id", 42, S.stratified_sizes, max_rank_rows=limit).collect()
    assert len(got) == 4000
    assert {r.sample_id: r.split for r in got} == plain(got, expected_sizes)


def test_sizes(spark):
    df = spark.range(1, 400).select(F.col("id").alias("n"))
    rows = df.select("n", *[c.alias(x) for c, x in zip(S.stratified_sizes(F.col("n")), ("t", "v"))]).collect()
    assert all((r.t, r.v) == expected_sizes(r.n)[:2] for r in rows)
    m = df.filter("n >= 3").select("n", *[c.alias(x) for c, x in zip(S.stratified_min1_sizes(F.col("n")), ("t", "v"))]).collect()
    for r in m:
        t, v = max(1, half_even(0.7 * r.n)), max(1, half_even(0.15 * r.n))
        t, v = (max(1, r.n - 2), 1) if t + v > r.n - 1 else (t, v)
        assert (r.t, r.v) == (t, v) and r.n - r.t - r.v >= 1


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partition_independence(spark, parts):
    df = hot_rows(spark).repartition(parts)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        split = S.stratified_split(df, "gloss", "sample_id", 42)
        rows = {r.sample_id: r.split for r in split.collect()}
        overlaps = S.overlap_counts(S.group_independent_split(df, "signer_id", 42)[0], "signer_id").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert rows == plain(hot_rows(spark).collect(), expected_sizes)
    assert overlaps.has_leakage is False


def test_group_split_keeps_groups_together(spark):
    df = hot_rows(spark).withColumn("signer_id", F.when(F.col("ordinal") % 500 == 0, None).otherwise(F.col("signer_id")))
    rows, bad = S.group_independent_split(df, "signer_id", 42)
    per = defaultdict(set)
    for r in rows.collect():
        per[r.signer_id].add(r.split)
    assert all(len(s) == 1 for s in per.values()) and Counter(next(iter(s)) for s in per.values()) == {"train": 26, "val": 6, "test": 5}
    assert bad.count() == 8
    assert S.minimum_groups(df.filter("signer_id < 2"), "signer_id").count() == 1 and S.minimum_groups(df, "signer_id").count() == 0


def test_min1_reports_small_labels(spark):
    df = spark.createDataFrame([(str(i), i, "a" if i < 9 else "b") for i in range(11)], "sample_id string, ordinal bigint, gloss string")
    rows, small = S.stratified_split_min1(df, "gloss", "sample_id", "ordinal", 1, 2)
    assert [(r.rule, r.key) for r in small.collect()] == [("fewer_than_3_rows", "b")]


def test_ratio_check():
    with pytest.raises(ValueError):
        S.check_ratios(0.7, 0.2, 0.2)


def test_hash_row_number(spark):
    rows = hash_row_number(hot_rows(spark), ["gloss"], "sample_id", 7, digits=1).collect()
    per = defaultdict(list)
    for r in rows:
        per[r.gloss].append((hashlib.md5(f"7|{r.sample_id}".encode()).hexdigest(), r.rn))
    assert all([rn for _, rn in sorted(v)] == list(range(len(v))) for v in per.values())


def test_spread_sequence(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", 4097)], "k string, n bigint")
    got = spread_sequence(df, F.col("n"), "i").groupBy("k").agg(F.count("*").alias("c"), F.max("i").alias("m"), F.count_distinct("i").alias("d")).collect()
    assert {r.k: (r.c, r.m, r.d) for r in got} == {"a": (10, 9, 10), "c": (4097, 4096, 4097)}


def test_manifest_missing_clip(spark):
    clips = spark.createDataFrame([(i, f"s{i}", f"v{i}", "hello", ("train", "val", "test", "train")[i], i, None, "web") for i in range(4)], "ordinal bigint, sample_id string, video_id string, gloss string, split string, instance_id bigint, signer_id bigint, source string")
    media = spark.createDataFrame([(f"v{i}", f"/m/v{i}.mp4") for i in range(3)], "video_id string, path string")
    rows = S.official_split_manifest(clips, media, 2)
    ok, bad = rows.filter("reason is null"), rows.filter("reason is not null")
    assert Counter(r.split for r in ok.collect()) == {"train": 1, "val": 1, "test": 1}
    assert [r.reason for r in bad.collect()] == ["missing_preprocessed_clip"]
    assert sorted(ok.collect(), key=lambda r: r.ordinal)[0].frame_paths == ["frames/hello/v0/frame_000.jpg", "frames/hello/v0/frame_001.jpg"]
    assert S.official_split_manifest(clips, media, 2, glosses=clips.limit(0)).count() == 0


@pytest.mark.parametrize("p", [0.0, 1.0])
def test_phrases(spark, p):
    clips = spark.createDataFrame([(f"c{i}", "abc"[i % 3], i % 5 + 1) for i in range(60)], "sample_id string, gloss string, n_frames bigint")
    words = Y.compose_phrases(Y.phrase_ids(spark, 200), clips, ["a", "b", "c", "unused"], min_words=2, max_words=4, repeat_probability=p, gap_min=1, gap_max=3)
    hist, facts = Y.phrase_distribution(words)
    f = facts.first()
    assert f.adjacent_repeat_rate == p and f.gap_min >= 1 and f.gap_max <= 3
    assert sum(r.phrases for r in hist.collect()) == 200 and all(2 <= r.word_count <= 4 for r in hist.collect())
    frames = clips.select("sample_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - 1)).alias("frame_idx"), F.array(F.lit(1.0)).alias("f"))
    out = Y.phrase_frames(words, frames).groupBy("phrase").agg(F.count("*").alias("n"), F.count_distinct("frame_idx").alias("d"), F.max("frame_idx").alias("m"))
    assert out.filter("n <> d or n <> m + 1").count() == 0 and out.count() == 200
    assert Y.phrase_manifest(words).count() == 200
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, Y.compose_phrases(Y.phrase_ids(spark, 200).repartition(5), clips, ["a", "b", "c"], min_words=2, max_words=4, repeat_probability=p, gap_min=1, gap_max=3).collect()))


def test_phrase_frames_go_to_no_driver(spark):
    """Frames that come out of an array look small to the planner, and are still not broadcast; neither are words or clips."""
    clips = spark.range(40).selectExpr("cast(id as string) as sample_id", "if(id % 3 = 0, 'a', 'b') as gloss", "id % 5 + 1 as n_frames")
    frames = clips.selectExpr("sample_id", "explode(sequence(0L, n_frames - 1)) as frame_idx", "array(1.0D, 2.0D) as f")
    words = Y.compose_phrases(Y.phrase_ids(spark, 30), clips, ["a", "b"])
    out = Y.phrase_frames(words, frames)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 3
    total = words.agg(F.sum(F.col("n_frames") + F.col("gap_after"))).first()[0]
    assert out.count() == total
