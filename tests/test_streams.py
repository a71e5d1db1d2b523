import random

import pytest
from pyspark.sql import functions as F

from clipmill.operators.metrics import telemetry_slo
from clipmill.operators.rate_audit import mark_requests, positive_or_default, sliding_rate_audit
from clipmill.streaming.rate import sliding_rate_stream
from clipmill.streaming.telemetry import read_events, telemetry_slo_stream
from clipmill.streaming.windows import feature_windows, feature_windows_stream


def brute(rows, limit, window):
    hits, out = {}, []
    for key, ts, rid in sorted(rows, key=lambda r: (r[1], r[2])):
        live = [h for h in hits.get(key, []) if h >= ts - window]
        if len(live) >= limit:
            out.append((key, ts, rid, False, max(1, int(window - (ts - min(live))))))
        else:
            live.append(ts)
            out.append((key, ts, rid, True, None))
        hits[key] = live
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 3, 8])
def test_rate_audit_brute_force(spark, slices):
    rnd = random.Random(slices)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}", rnd.randint(0, 900), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "key string, ts bigint, rid bigint")
    audit = sliding_rate_audit(df.select("key", "ts"), 5, 20, slice_windows=slices)
    got = [(r.key, r.ts, r.rid, r.ok, r.retry_after_seconds) for r in mark_requests(df, audit, "rid", 5).collect()]
    assert sorted(got) == brute(rows, 5, 20)


def test_rate_settings():
    assert [positive_or_default(x, 60) for x in ("5", " 7 ", "0", "-1", "x", None)] == [5, 7, 60, 60, 60, 60]


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_rate_stream_in_arrival_order(spark, tmp_path):
    rnd = random.Random(5)
    rows = sorted([(f"k{rnd.randint(0, 2)}", rnd.randint(0, 300), i) for i in range(300)], key=lambda r: r[1])
    for n in range(3):
        part = [r for r in rows if n * 100 <= r[1] < n * 100 + 100 or (n == 2 and r[1] == 300)]
        spark.createDataFrame(part, "key string, ts bigint, rid bigint").select("key", "ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("key string, ts bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, sliding_rate_stream(src, 4, 15), "rate_out").agg(F.sum("requests"), F.sum("admitted")).first()
    want = brute(rows, 4, 15)
    assert tuple(got) == (300, sum(r[3] for r in want))


FRAMES = "source string, frame_idx bigint, ok boolean, f array<double>"


def test_windows_first_frame_missing(spark):
    df = spark.createDataFrame([("a", 0, False, None), ("a", 1, True, [1.0] * 236), ("a", 2, True, [1.0] * 236)], FRAMES)
    r = feature_windows(df, 2, 236).collect()
    assert len(r) == 1 and r[0].missing_frame_count == 1 and r[0].features == [[0.0] * 236, [1.0] * 236]


def test_windows_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(s, i, rnd.random() < 0.8, [1.0, float(i)] if rnd.random() < 0.9 else [1.0]) for s in "ab" for i in range(23) if rnd.random() < 0.8 or i == 22]
    for lo in (0, 9, 15):
        part = [r for r in rows if lo <= r[1] < {0: 9, 9: 15, 15: 99}[lo]]
        spark.createDataFrame(part, FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = lambda df: sorted((r.source, r.window, r.missing_frame_count, str(r.features)) for r in df.collect())
    assert key(run(spark, feature_windows_stream(src, 4, 2), "win_out")) == key(feature_windows(spark.createDataFrame(rows, FRAMES), 4, 2))
    with pytest.raises(ValueError):
        feature_windows(src, 0, 2)


def test_telemetry_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"r{i}", rnd.randint(1, 900), rnd.choice(["success", "timeout"]), 0.5, "m") for i in range(200)]
    schema = "request_id string, latency_ms bigint, outcome string, confidence double, model_tag string"
    df = spark.createDataFrame(rows, schema)
    df.repartition(4).write.json(str(tmp_path / "in"))
    q = telemetry_slo_stream(read_events(spark, str(tmp_path / "in")), str(tmp_path / "report"), str(tmp_path / "state"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.json(str(tmp_path / "report")).first()
    want = telemetry_slo(df).first()
    assert all(got[c] == want[c] for c in want.asDict())


def test_rate_audit_of_a_saturated_key(spark):
    """A key at its limit over 520 windows: one pass, whatever the number of windows."""
    from collections import deque

    def jobs(windows):
        df = spark.range(60 * windows).select(F.lit("k").alias("key"), F.col("id").alias("ts"))
        group = f"audit-{windows}"
        spark.sparkContext.setJobGroup(group, group)
        rows = sliding_rate_audit(df, 20, 60).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, (rows, many) = jobs(40)[1], jobs(520)
    hits, want = deque(), {}
    for t in range(60 * 520):
        while hits and hits[0] < t - 60:
            hits.popleft()
        want[t] = int(len(hits) < 20)
        hits.extend([t] * want[t])
    assert {r.ts: r.admitted for r in rows} == want and many <= few + 3


def test_late_frames_go_out_as_rows(spark, tmp_path):
    for part in ([("a", 0, True, [1.0]), ("a", 5, True, [1.0])], [("a", 2, True, [9.0]), ("a", 6, True, [1.0]), ("a", 7, True, [1.0])]):
        spark.createDataFrame(part, FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = run(spark, feature_windows_stream(src, 4, 1), "late_out").collect()
    assert [(r.window, r.late_frame) for r in rows if r.late_frame is not None] == [(0, 2)]
    assert sorted((r.window, r.missing_frame_count) for r in rows if r.late_frame is None) == [(0, 3), (1, 1)]


def test_shuffled_frames_within_the_delay_equal_the_batch(spark, tmp_path):
    rnd = random.Random(12)
    frames = [("a", i, i % 7 != 3, [float(i)] * 2) for i in range(120) if i % 11 != 5]
    frames += [("b", i, True, [float(-i)] * 2) for i in range(40)]
    order = sorted(range(len(frames)), key=lambda k: frames[k][1] + rnd.random() * 6)  # up to six places late
    shuffled = [frames[k] for k in order]
    late = ("a", 2, True, [9.0, 9.0])
    for n in range(8):
        part = shuffled[n * 20:n * 20 + 20] + ([late] if n == 7 else [])
        spark.createDataFrame(part, FRAMES).coalesce(1).write.json(str(tmp_path / f"in/{n}"))
    src = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    rows = run(spark, feature_windows_stream(src, 4, 2, reorder=10), "reorder_out").collect()
    key = lambda r: (r.source, r.window, r.missing_frame_count, tuple(map(tuple, r.features)))
    got = sorted(key(r) for r in rows if r.late_frame is None)
    want = sorted(key(r) for r in feature_windows(spark.createDataFrame(frames, FRAMES), 4, 2).collect())
    assert [(r.source, r.late_frame) for r in rows if r.late_frame is not None] == [("a", 2)]
    assert set(got) <= set(want) and len(got) >= len(want) - 2 * 3  # the last ten places of each source are still held
    with pytest.raises(ValueError):
        feature_windows_stream(src, 4, 2, reorder=-1)


def test_rate_stream_deals_keys_into_buckets(spark, tmp_path):
    """Many keys share a bucket, null is a key, whole numbers above 2^53 stay whole, and state goes from batch to batch."""
    rnd = random.Random(6)
    big = 2**60
    rows = sorted([(rnd.choice([None, big + rnd.randint(0, 60)]), rnd.randint(0, 90), i) for i in range(900)], key=lambda r: r[1])
    for n in range(3):
        part = [r for r in rows if n * 30 <= r[1] < n * 30 + 30 or (n == 2 and r[1] == 90)]
        spark.createDataFrame(part, "key long, ts bigint, rid bigint").select("key", "ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {}
    for key in {r[0] for r in rows}:
        hits = []
        for _, t, _ in (r for r in rows if r[0] == key):
            hits = [x for x in hits if x >= t - 15]
            if len(hits) < 4:
                hits.append(t)
            total, let_in = want.get((key, t), (0, 0))
            want[key, t] = total + 1, let_in + (len(hits) <= 4 and hits[-1:] == [t] and sum(x == t for x in hits) > let_in)
    for k, idle in enumerate((None, 3600)):
        src = spark.readStream.schema("key long, ts bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = run(spark, sliding_rate_stream(src, 4, 15, idle_seconds=idle, buckets=3), f"bucket_out_{k}").collect()
        assert len(got) == len(want) and {(r.key, r.ts): (r.requests, r.admitted) for r in got} == want
