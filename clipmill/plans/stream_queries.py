"""Queries of family G: streaming jobs and their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmill.operators.metrics import latency_counts, slo_from_counts
from clipmill.operators.rate_audit import mark_requests, sliding_rate_audit
from clipmill.plans.metric_queries import _SLO
from clipmill.plans.registry import query
from clipmill.session import new_path
from clipmill.sources.sinks import append_log
from clipmill.streaming.rate import sliding_rate_stream
from clipmill.streaming.telemetry import EVENT
from clipmill.streaming.windows import STREAM_OUTPUT, feature_windows, feature_windows_stream


def drain(stream, d, schema, slices, mode="append"):
    """Append one slice of the input after the other and run the stream over each, so state goes from run to run.

    ``slices`` are calls that write; ``stream`` makes the query's table. Every micro-batch has a folder of its own, which a repeated batch
    overwrites; of a complete mode the last one counts.
    """
    out, state, last = new_path(d.spark, "stream-out"), new_path(d.spark, "stream-state"), []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last.append(number)

    for append in slices:
        append()
        q = stream().writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    return d.spark.read.schema(schema).parquet(f"{out}/batch={max(last)}" if mode == "complete" else out).drop("batch")


def in_order(df, column, path, parts=4):
    """Calls that append ``df`` to ``path`` in ``parts`` ranges of ``column``, lowest first."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    step = max(1, -(-(high - low + 1) // parts))
    cut = lambda k: df.filter((F.col(column) >= low + k * step) & (F.col(column) < low + (k + 1) * step))
    return [lambda k=k: cut(k).write.mode("append").parquet(path) for k in range(parts)]


@query("G01_telemetry_slo_stream", _SLO)
def g01(d):
    path = new_path(d.spark, "telemetry")
    tele = d.view("v_tele").withColumn("part", F.crc32("request_id") % 3)
    slices = [lambda k=k: append_log(tele.filter(F.col("part") == k).drop("part"), path) for k in range(3)]
    events = lambda: latency_counts(d.spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 8).json(path))
    return slo_from_counts(drain(events, d, "latency_ms bigint, outcome string, n bigint", slices, "complete"))


def _frames(d, n_missing=7):
    ok = (F.col("frame_idx") * 3 + F.col("clip_id")) % n_missing != 0
    f = F.array(F.col("size"), F.col("frame_idx").cast("double"))
    return d.view("v_turns").select(F.concat(F.lit("c"), F.col("clip_id").cast("string")).alias("source"), "frame_idx", ok.alias("ok"), f.alias("f"))


_WINDOWS = """with w as (select clip_id, (max(frame_idx) + 1) // 2 as n from v_turns group by clip_id), s as (select clip_id, unnest(range(n)) as win from w),
  x as (select s.clip_id, win, win * 2 + i as frame_idx from s, range(2) t(i)), j as (select x.clip_id, win, x.frame_idx, v.size, v.size is not null and (x.frame_idx * 3 + x.clip_id) % 7 <> 0 as ok from x left join v_turns v on v.clip_id = x.clip_id and v.frame_idx = x.frame_idx)
  select 'c' || cast(clip_id as string) as source, win as window, count(*) filter (where not ok) as missing_frame_count, sum(case when ok then size else 0 end) as size_sum, cast(count(*) as bigint) as frames from j group by 1, 2"""


def _summary(w):
    return w.select(
        "source", "window", "missing_frame_count", F.aggregate("features", F.lit(0.0), lambda a, x: a + x[0]).alias("size_sum"),
        F.size("features").cast("bigint").alias("frames"))


@query("G02_feature_windows", _WINDOWS)
def g02(d):
    return _summary(feature_windows(_frames(d), 2, 2))


@query("G02_feature_windows_stream", _WINDOWS)
def g02s(d):
    path = new_path(d.spark, "frames")
    frames = lambda: d.spark.readStream.schema("source string, frame_idx bigint, ok boolean, f array<double>").parquet(path)
    rows = drain(lambda: feature_windows_stream(frames(), 2, 2), d, STREAM_OUTPUT, in_order(_frames(d), "frame_idx", path))
    return _summary(rows.filter("late_frame is null"))


def _requests(d):
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")  # free of the session's time zone
    return d.table("events").select(F.col("user_id").alias("key"), seconds.alias("ts"), "event_id")


_AUDIT = """with recursive e as (select user_id as key, cast(floor(epoch(ts)) as bigint) as ts, event_id, row_number() over (partition by user_id order by cast(floor(epoch(ts)) as bigint), event_id) as rn from {events}),
  w(key, rn, event_id, ts, hits, ok, retry) as (select key, rn, event_id, ts, [ts], true, cast(null as bigint) from e where rn = 1 union all
    select key, rn, event_id, ts, case when len(h) < 3 then list_append(h, ts) else h end, len(h) < 3, case when len(h) >= 3 then greatest(1, 86400 - (ts - list_min(h))) end
    from (select e.key, e.rn, e.event_id, e.ts, list_filter(w.hits, lambda x: x >= e.ts - 86400) as h from w join e on e.key = w.key and e.rn = w.rn + 1))
  """


@query("G03_sliding_rate_audit", _AUDIT + "select key, event_id, ts, ok, retry as retry_after_seconds from w")
def g03(d):
    req = _requests(d)
    audit = sliding_rate_audit(req.select("key", "ts"), 3, 86400)
    return mark_requests(req, audit, "event_id", 3).select("key", "event_id", "ts", "ok", "retry_after_seconds")


@query("G03_sliding_rate_stream", _AUDIT + "select key, ts, count(*) as requests, count(*) filter (where ok) as admitted, max(retry) as retry_after_seconds from w group by key, ts")
def g03s(d):
    path = new_path(d.spark, "requests")
    requests = lambda: d.spark.readStream.schema("key bigint, ts bigint").parquet(path)
    out = "key bigint, ts bigint, requests bigint, admitted bigint, retry_after_seconds bigint"
    return drain(lambda: sliding_rate_stream(requests(), 3, 86400), d, out, in_order(_requests(d).select("key", "ts"), "ts", path))
