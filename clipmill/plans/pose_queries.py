"""Queries of family D: pose and feature sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmill.constants import Q64_ALPHABET, Q64_INSTRUCTION
from clipmill.functions import arrays as A
from clipmill.operators import pose as D
from clipmill.plans.registry import query

SEED = 7
_LONG = "g as (select clip_id, frame_idx, k - 1 as k, cast(f[k] as double) as v from v_feat, range(1, 65) t(k))"
_CHAR = "substr('" + Q64_ALPHABET + "', cast(round_even((least(4.0::double, greatest(-4.0::double, {v})) + 4) / 8 * 63, 0) as int) + 1, 1)"
CHAR = lambda v: _CHAR.replace("{v}", v)


def _long(df, f="f", digits=None):
    v = F.col("v").cast("double")
    rows = df.select("clip_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), F.posexplode(f).alias("k", "v"))
    return rows.select("clip_id", "frame_idx", F.col("k").cast("bigint").alias("k"), (F.round(v, digits) + F.lit(0.0) if digits else v).alias("v"))


def feats(d, scale=None):
    v = d.view("v_feat")
    return v if scale is None else v.withColumn("f", F.transform("f", lambda x: x.cast("double") * F.lit(float(scale))))


def targets(d):
    return feats(d).select("clip_id").distinct().select("clip_id", (F.col("clip_id") * 17 % 120 + 1).alias("n_target"))


@query("D01_normalize_landmarks", """with b as (select clip_id, frame_idx, f, j from v_feat, range(8) t(j)),
  r as (select *, [(cast(f[5 + c] as double) + cast(f[9 + c] as double)) / 2.0 for c in range(3)] as mid, sqrt(pow(cast(f[5] as double) - cast(f[9] as double), 2) + pow(cast(f[6] as double) - cast(f[10] as double), 2) + pow(cast(f[7] as double) - cast(f[11] as double), 2)) as dist from b)
  select clip_id, frame_idx, j * 4 + c as k, round(case when c = 3 then cast(f[j * 4 + 4] as double) else (cast(f[j * 4 + c + 1] as double) - mid[c + 1]) / case when dist > 1e-6 then dist else 1 end end, 6) + 0.0::double as v from r, range(4) u(c)""")
def d01(d):
    c = d.components().withColumn("f", F.flatten(A.normalize_landmarks(F.col("body"), 1, 2)))
    return _long(c, digits=6)


@query("D02_flatten_components", "select clip_id, frame_idx, j * 3 + c as k, cast(f[j * 4 + c + 1] as double) as v from v_feat, range(16) t(j), range(3) u(c)")
def d02(d):
    c = d.components()
    flat = A.flatten_joints(*[A.cut_channels(F.col(x)) for x in ("body", "left_hand", "right_hand")])
    return _long(c.withColumn("f", flat))


@query("D03_zscore_clip", f"with {_LONG} select clip_id, frame_idx, k, round((v - avg(v) over w) / greatest(stddev_pop(v) over w, 1e-6), 6) + 0.0::double as v from g window w as (partition by clip_id, k)")
def d03(d):
    return _long(D.zscore_clip(feats(d)), digits=6)


@query("D04_zscore_frame", f"with {_LONG} select clip_id, frame_idx, k, round((v - avg(v) over w) / greatest(stddev_pop(v) over w, 1e-6), 6) + 0.0::double as v from g window w as (partition by clip_id, frame_idx)")
def d04(d):
    return _long(feats(d).withColumn("f", A.zscore_frame(F.transform("f", lambda x: x.cast("double")))), digits=6)


_RS = """n as (select clip_id, max(frame_idx) + 1 as s, clip_id * 17 % 120 + 1 as t from v_feat group by clip_id),
  fr as materialized (select clip_id, frame_idx, f from v_feat), o as (select clip_id, s, t, unnest(range(t)) as pos from n),
  p as materialized (select clip_id, pos, case when t = 1 or s = 1 then 0 when t = s then pos else (pos * (s - 1)) // (t - 1) end as lo, case when t = 1 or s = 1 or t = s then 0.0::double else ((pos * (s - 1)) % (t - 1)) / (t - 1) end as w from o),
  j as materialized (select p.clip_id, pos, w, a.f as a, b.f as b from p join fr a on a.clip_id = p.clip_id and a.frame_idx = lo left join fr b on b.clip_id = p.clip_id and b.frame_idx = lo + 1),
  u as (select *, unnest(range(1, 65)) as k from j)"""


@query("D05_resample_linear", f"with {_RS} select clip_id, pos as frame_idx, k - 1 as k, round(case when w > 0 then cast(a[k] as double) * (1 - w) + cast(b[k] as double) * w else cast(a[k] as double) end, 6) + 0.0::double as v from u")
def d05(d):
    return _long(D.resample_linear(feats(d).select("clip_id", "frame_idx", "f"), targets(d)), digits=6)


@query("D06_q64_encode", f"with {_LONG}, r as (select clip_id, frame_idx, string_agg({CHAR('v * 10')}, '' order by k) as chars from g group by 1, 2) select clip_id, string_agg(chars, '|' order by frame_idx) as payload from r group by clip_id")
def d06(d):
    return D.q64_payload(D.q64_rows(feats(d, 10)))


@query("D06_q64_encode_stride2", f"with {_LONG} select clip_id, frame_idx, string_agg({CHAR('v * 10')}, '' order by k) as chars from g where frame_idx % 2 = 0 group by 1, 2")
def d06s(d):
    return D.q64_rows(feats(d, 10), 2)


_SUMMARY = f"""{_LONG}, s as (select clip_id, k, avg(v * 10) as m, max_by(v * 10, frame_idx) - min_by(v * 10, frame_idx) as d from g group by 1, 2),
  sm as (select clip_id, 'm=' || string_agg({CHAR('m')}, '' order by k) || chr(10) || 'd=' || string_agg({CHAR('d')}, '' order by k) as summary from s group by clip_id)"""


@query("D07_q64_summary", f"with {_SUMMARY} select * from sm")
def d07(d):
    return D.q64_summary(feats(d, 10))


def clips(d):
    g = feats(d).groupBy("clip_id").agg(F.min("gloss").alias("output"))
    return g.select("clip_id", F.concat(F.lit("clip_"), F.col("clip_id").cast("string")).alias("sample_id"), "output")


def records(d, mode="q64_full"):
    return D.export_q64_records(feats(d, 10), clips(d), mode)


@query("D08_export_q64_records", f"""with {_SUMMARY}, r as (select clip_id, frame_idx, string_agg({CHAR('v * 10')}, '' order by k) as chars from g group by 1, 2),
  f as (select clip_id, string_agg(chars, '|' order by frame_idx) as full_text, string_agg(chars, '|' order by frame_idx) filter (where frame_idx % 2 = 0) as half, count(*) as n from r group by clip_id),
  o as (select clip_id, min(gloss) as output from v_feat group by clip_id), h as (select *, 'sample_id=clip_' || cast(clip_id as string) || chr(10) || 'encoding=' as head, ' clip=4 alphabet={Q64_ALPHABET}' || chr(10) as alpha from f join o using (clip_id) join sm using (clip_id))
  select clip_id, 'q64_full' as mode, output, head || 'q64_full' || alpha || 'frames=' || n || ' features_per_frame=64' || chr(10) || 'pose_q64=' || full_text as input from h union all
  select clip_id, 'q64_stride2', output, head || 'q64_stride2' || alpha || 'frames_used=' || ((n + 1) // 2) || ' original_frames=' || n || ' features_per_frame=64' || chr(10) || 'pose_q64=' || half from h union all
  select clip_id, 'q64_summary', output, head || 'q64_summary' || alpha || 'original_frames=' || n || ' features_per_frame=64' || chr(10) || summary from h""")
def d08(d):
    parts = [records(d, m).select("clip_id", F.lit(m).alias("mode"), "output", "input") for m in ("q64_full", "q64_stride2", "q64_summary")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("D08_export_manifest", f"""with c as (select clip_id, min(gloss) as output, count(*) as n from v_feat group by clip_id),
  l as (select length('{Q64_INSTRUCTION}') + length(output) + length('sample_id=clip_' || cast(clip_id as string) || chr(10) || 'encoding=q64_full clip=4 alphabet={Q64_ALPHABET}' || chr(10) || 'frames=' || n || ' features_per_frame=64' || chr(10) || 'pose_q64=') + n * 65 - 1 as chars from c)
  select count(*) as samples, cast(round_even(avg(chars), 0) as bigint) as avg_chars from l""")
def d08m(d):
    return D.export_manifest(records(d))


@query("D09_validate_q64_record", """with c as (select distinct clip_id, 'clip_' || cast(clip_id as string) as key from v_feat) select 'encoding_line' as rule, key from c where clip_id % 5 = 1 union all select 'malformed_shape', key from c where clip_id % 5 = 2
  union all select 'payload_shape', key from c where clip_id % 5 = 3 union all select 'label_mismatch', key from c where clip_id % 5 = 4""")
def d09(d):
    i = F.col("clip_id") % 5
    bad = F.when(i == 1, F.replace("input", F.lit("clip=4"), F.lit("clip=5"))).when(i == 2, F.replace("input", F.lit("features_per"), F.lit("per"))).when(
        i == 3, F.concat("input", F.lit("|x"))).otherwise(F.col("input"))
    r = records(d).withColumn("input", bad).withColumn("output", F.when(i == 4, "wrong").otherwise(F.col("output")))
    facts = feats(d).groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"))
    exp = clips(d).join(facts, "clip_id").select("sample_id", F.col("output").alias("expected_gloss"), "frames", F.lit(64).cast("bigint").alias("features"))
    return D.validate_q64_records(r, exp).select("rule", "key")


@query("D10_verify_pose_vs_records", """with c as (select clip_id, min(gloss) as g, count(*) as n from v_feat group by clip_id),
  p as (select *, case when clip_id % 7 = 1 then 'archive_sample_id_mismatch' when clip_id % 7 = 2 then 'sample_id_not_found' when clip_id % 7 = 3 then 'expected_gloss_mismatch' when clip_id % 7 = 4 then 'feature_mismatch' end as problem from c)
  select 'clip_' || cast(clip_id as string) as sample_id, g as expected_gloss, n as source_frames, case when problem is null then cast(12 as bigint) end as frames, cast(64 as bigint) as features, case when problem is null then cast(12 * 64 as bigint) end as payload_chars, problem, problem is null as verified from p""")
def d10(d):
    i = F.col("clip_id") % 7
    meta = clips(d).select("clip_id", "sample_id", F.when(i == 1, "other").otherwise(F.col("sample_id")).alias("archive_id"), F.col("output").alias("expected_gloss"))
    shape = F.when(i == 4, "frames=12 features_per_frame=63").otherwise("frames=12 features_per_frame=64")
    rec = clips(d).filter(i != 2).select(
        F.lit("x").alias("instruction"), F.concat(F.lit("sample_id="), "sample_id", F.lit("\n"), shape).alias("input"),
        F.when(i == 3, "wrong").otherwise(F.col("output")).alias("output"))
    return D.verify_pose_vs_records(feats(d).select("clip_id", "frame_idx", "f"), meta, rec)


@query("D11_component_coverage", """with c as (select clip_id, frame_idx % 4 = 0 as gone from v_feat) select clip_id, 'body' as component, count(*) as frames, cast(8 as bigint) as joints, cast(4 as bigint) as coordinates, count(*) as covered_frames from c group by clip_id union all
  select clip_id, 'left_hand', count(*), 4, 4, count(*) filter (where not gone) from c group by clip_id union all select clip_id, 'right_hand', count(*), 4, 4, count(*) from c group by clip_id""")
def d11(d):
    c = d.components()
    zero = F.transform("left_hand", lambda j: F.transform(j, lambda v: v * 0))
    c = c.withColumn("left_hand", F.when(F.col("frame_idx") % 4 == 0, zero).otherwise(F.col("left_hand")))
    return D.component_coverage(c, ("body", "left_hand", "right_hand"))


_UNIT = lambda what: f"(cast('0x' || left(md5('{SEED}|{what}|' || cast(clip_id as string)), 15) as bigint) % 1000000 / 999999.0::double * 2 - 1)"


@query("D12_augment_pose_rotation", f"""with a as (select *, radians({_UNIT('angle')} * 15) as t from v_feat), x as (select clip_id, frame_idx, j, cast(f[j * 4 + 1] as double) as x, cast(f[j * 4 + 2] as double) as y, cast(f[j * 4 + 3] as double) as z, cast(f[j * 4 + 4] as double) as c, t from a, range(16) u(j))
  select clip_id, frame_idx, j * 4 + m as k, round(case m when 0 then x * cos(t) - y * sin(t) when 1 then x * sin(t) + y * cos(t) when 2 then z else c end, 6) + 0.0::double as v from x, range(4) w(m)""")
def d12(d):
    return _long(D.augment_pose(d.components(), ("body", "left_hand", "right_hand"), 15.0, 0.0, SEED), digits=6)


@query("D12_augment_pose_speed", f"with n as (select clip_id, max(frame_idx) + 1 as n from v_feat group by clip_id) select clip_id, greatest(1, cast(round_even(n / greatest(1 + {_UNIT('speed')} * 0.2::double, 1e-3), 0) as bigint)) as frames from n")
def d12s(d):
    out = D.augment_pose(d.components(), ("body", "left_hand", "right_hand"), 15.0, 0.2, SEED)
    return out.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"))


def turns(d):
    return d.view("v_turns").withColumn("f", F.array(F.col("size"), F.col("frame_idx").cast("double")))


@query("D13_pad_and_mask", """with l as (select clip_id, max(frame_idx) + 1 as length, clip_id % 9 as batch_id from v_turns group by clip_id), b as (select batch_id, max(length) as padded from l group by batch_id),
  s as (select l.*, unnest(range(padded)) as t from l join b using (batch_id)) select s.batch_id, s.clip_id, s.t, s.length, v.clip_id is not null as mask, coalesce(v.size, 0) as first_feature, cast(2 as bigint) as width from s left join v_turns v on v.clip_id = s.clip_id and v.frame_idx = s.t""")
def d13(d):
    t = turns(d)
    batches = t.select("clip_id", (F.col("clip_id") % 9).alias("batch_id")).distinct()
    rows, _ = D.pad_and_mask(t.select("clip_id", "frame_idx", "f"), batches)
    return rows.select("batch_id", "clip_id", "t", "length", "mask", F.col("f")[0].alias("first_feature"), F.size("f").cast("bigint").alias("width"))


@query("D14_pose_summary", "select clip_id as request_id, count(*) as frame_count, min(ts_ms) as first_ts_ms, max(ts_ms) as last_ts_ms from v_turns group by clip_id")
def d14(d):
    return D.pose_summary(d.view("v_turns").withColumnRenamed("clip_id", "request_id"))
