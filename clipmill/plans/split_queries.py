"""Queries of family C: splits, top-k, manifests, merges and composed phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmill.operators import labels as L
from clipmill.operators import sampling as Y
from clipmill.operators import splits as S
from clipmill.operators import transcripts as X
from clipmill.operators.pose import even_sample, fixed_fps_plan
from clipmill.operators.ranking import top_k_first_seen
from clipmill.plans.registry import query
from clipmill.plans.views import NORM
from clipmill.plans.views import WORDS_SQL

SEED = 42
_RANKED = "x as (select *, row_number() over (partition by gloss order by md5(concat('42|', sample_id)), sample_id) - 1 as r, count(*) over (partition by gloss) as n from {src})"


def _stratified(src: str) -> str:
    return _RANKED.replace("{src}", src) + """,
  z as (select *, case when n >= 3 then greatest(1, cast(round_even(n * cast(0.7 as double), 0) as bigint)) else greatest(1, n - 1) end as t from x),
  y as (select *, case when n - t > 1 then cast(round_even(n * cast(0.15 as double), 0) as bigint) else least(1, n - t) end as v0 from z),
  sp as (select *, case when r < t then 'train' when r < t + case when n - t - v0 < 0 then n - t else v0 end then 'val' else 'test' end as split from y)"""


@query("C01_top_k_first_seen", "select p_type as label, count(*) as n, min(p_partkey) as first_seen from {part} group by p_type order by n desc, first_seen limit 4")
def c01(d):
    return top_k_first_seen(d.table("part").withColumnRenamed("p_type", "label"), "label", "p_partkey", 4)


@query("C02_top_k_anchors", f"select {NORM('expected_gloss')} as gloss, count(*) as count from v_pred group by 1 order by 2 desc, 1 limit 3")
def c02(d):
    top, _ = L.top_k_anchors(d.view("v_pred"), "expected_gloss", d.labels, 3)
    return top


@query("C03_anchor_contract", f"""with a as (select {NORM('expected_gloss')} as gloss, count(*) as n from v_pred group by 1 order by 2 desc, 1 limit 3)
  select 'colab_top50_anchor_contract_v1' as contract_version, cast(3 as bigint) as top_k, (select count(*) from v_pred) as record_count, (select string_agg(label, ',' order by ord) from v_labels) as allowlist,
  (select string_agg(gloss || '=' || cast(n as string), ',' order by n desc, gloss) from a) as anchors, (select string_agg(alias || '>' || canonical, ',' order by canonical, alias) from v_alias_table) as aliases""")
def c03(d):
    c = L.anchor_contract(d.view("v_pred"), "expected_gloss", d.labels, d.view("v_alias"), 3)
    join = lambda col, f: F.array_join(F.transform(col, f), ",")
    return c.select(
        "contract_version", F.col("top_k").cast("bigint").alias("top_k"), "record_count", F.array_join("allowlist", ",").alias("allowlist"),
        join("anchors", lambda x: F.concat(x["gloss"], F.lit("="), x["count"].cast("string"))).alias("anchors"),
        join("alias_map", lambda x: F.concat(x["alias"], F.lit(">"), x["canonical"])).alias("aliases"))


@query("C04_stratified_split", f"with {_stratified('v_meta')} select sample_id, gloss, split from sp")
def c04(d):
    return S.stratified_split(d.view("v_meta"), "gloss", "sample_id", SEED).select("sample_id", "gloss", "split")


_CUST = "select cast(c_custkey as string) as sample_id, c_custkey as ordinal, concat('n', cast(c_nationkey as string)) as gloss from {customer}"


@query("C04_stratified_split_many_labels", f"with m as (select cast(o_orderkey as string) as sample_id, cast(o_custkey as string) as gloss from {{orders}}), {_stratified('m')} select sample_id, gloss, split from sp")
def c04m(d):
    m = d.sql("select cast(o_orderkey as string) as sample_id, cast(o_custkey as string) as gloss from {orders}")
    return S.stratified_split(m, "gloss", "sample_id", SEED)


@query("C05_stratified_split_min1", f"""with k as (select gloss from ({_CUST}) group by gloss order by count(*) desc, min(ordinal) limit 10), c as (select * from ({_CUST}) where gloss in (select gloss from k)), {_RANKED.replace('{src}', 'c')},
  z as (select *, greatest(1, cast(round_even(n * cast(0.7 as double), 0) as bigint)) as t0, greatest(1, cast(round_even(n * cast(0.15 as double), 0) as bigint)) as v0 from x),
  y as (select *, case when t0 + v0 > n - 1 then greatest(1, n - 2) else t0 end as t, case when t0 + v0 > n - 1 then 1 else v0 end as v from z)
  select sample_id, gloss, case when r < t then 'train' when r < t + v then 'val' else 'test' end as split from y""")
def c05(d):
    rows, _ = S.stratified_split_min1(d.sql(_CUST), "gloss", "sample_id", "ordinal", SEED, 10)
    return rows.select("sample_id", "gloss", "split")


_GROUPS = """g as (select signer_id, row_number() over (order by md5(concat('42|', cast(signer_id as string))), signer_id) - 1 as r, count(*) over () as n from (select distinct signer_id from v_meta)),
  y as (select *, greatest(1, cast(round_even(n * cast(0.7 as double), 0) as bigint)) as t, greatest(1, cast(round_even(n * cast(0.15 as double), 0) as bigint)) as v from g),
  gs as (select signer_id, case when r < t then 'train' when r < t + v then 'val' else 'test' end as split from y)"""


@query("C06_group_independent_split", f"with {_GROUPS} select sample_id, signer_id, split from v_meta join gs using (signer_id)")
def c06(d):
    rows, _ = S.group_independent_split(d.view("v_meta"), "signer_id", SEED)
    return rows.select("sample_id", "signer_id", "split")


@query("C07_split_counts", f"with {_stratified('v_meta')} select gloss as label, count(*) as total, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as val, count(*) filter (where split = 'test') as test from sp group by gloss")
def c07(d):
    return S.split_counts(S.stratified_split(d.view("v_meta"), "gloss", "sample_id", SEED), "gloss")


@query("C07_split_manifest", f"with {_stratified('v_meta')} select count(*) as num_samples, count(distinct gloss) as num_glosses, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as val, count(*) filter (where split = 'test') as test, 'stratified' as strategy, 'v1' as version from sp")
def c07m(d):
    return S.split_manifest(S.stratified_split(d.view("v_meta"), "gloss", "sample_id", SEED), "gloss", "stratified", "v1")


_LEAKY = "select sample_id, signer_id, case when ordinal % 10 < 7 then 'train' when ordinal % 10 = 7 then 'val' else 'test' end as split from v_meta union all select sample_id, signer_id, 'val' as split from v_meta where ordinal % 100 = 3 union all select sample_id, signer_id, 'test' as split from v_meta where ordinal % 150 = 3"


def _overlap_sql(value: str) -> str:
    return f"""with s as ({_LEAKY}), f as (select {value} as v, bool_or(split = 'train') as tr, bool_or(split = 'val') as va, bool_or(split = 'test') as te from s group by 1),
      c as (select count(*) filter (where tr and va) as train_val, count(*) filter (where tr and te) as train_test, count(*) filter (where va and te) as val_test from f) select *, train_val + train_test + val_test > 0 as has_leakage from c"""


@query("C08_split_overlap", f"with s as ({_LEAKY}), f as (select sample_id as value, bool_or(split = 'train') as tr, bool_or(split = 'val') as va, bool_or(split = 'test') as te from s group by 1) select 'train_val' as pair, value from f where tr and va union all select 'train_test', value from f where tr and te union all select 'val_test', value from f where va and te")
def c08(d):
    return S.overlap_rows(d.sql(_LEAKY), "sample_id")


@query("C09_signer_leakage", _overlap_sql("signer_id"))
def c09(d):
    return S.overlap_counts(d.sql(_LEAKY), "signer_id")


_CLIPS = "select ordinal, concat(gloss, '_', sample_id) as sample_id, sample_id as video_id, gloss, signer_id, ordinal % 11 as instance_id, status as source, case ordinal % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split from v_meta"
_MEDIA = "select sample_id as video_id, concat('/media/', sample_id, '.mp4') as path from v_meta where ordinal % 7 <> 0"
_WANTED = "select gloss from v_meta where gloss <> '5-LOW'"


def _c10_sql(keep: str) -> str:
    at = lambda c: f"case when path is not null then {c} end"
    return f"""with c as (select c.*, m.path from ({_CLIPS}) c left join ({_MEDIA}) m using (video_id) where gloss in ({_WANTED})), e as (select max(ordinal) as last from (select ordinal from c where path is not null order by ordinal limit 5000)), k as (select c.* from c, e where {keep})
  select ordinal, 'full' as dataset, sample_id, gloss, video_id, split, {at("'official'")} as split_source, {at("array_to_string([concat('frames/', gloss, '/', video_id, '/frame_', lpad(cast(i as varchar), 3, '0'), '.jpg') for i in range(30)], ',')")} as frame_paths,
    {at("cast(30 as bigint)")} as num_frames, {at("'224x224'")} as image_size, path as source_video_path, {at("instance_id")} as instance_id, {at("signer_id")} as signer_id, {at("source")} as source, case when path is null then 'missing_preprocessed_clip' end as reason from k"""


def _c10(d, max_samples):
    return S.official_split_manifest(d.sql(_CLIPS), d.sql(_MEDIA), 30, glosses=d.sql(_WANTED), max_samples=max_samples)


def _flat(m):
    return m.withColumn("frame_paths", F.when(F.col("frame_paths").isNotNull(), F.array_join("frame_paths", ","))).withColumn(
        "image_size", F.when(F.col("image_size").isNotNull(), F.array_join(F.col("image_size").cast("array<string>"), "x"))).withColumn("num_frames", F.col("num_frames").cast("bigint"))


@query("C10_official_split_manifest", _c10_sql("true"))
def c10(d):
    return _flat(_c10(d, None))


@query("C10_official_split_manifest_max_samples", _c10_sql("ordinal <= last"))
def c10m(d):
    return _flat(_c10(d, 5000))


@query("C10_manifest_summary", f"select split, count(*) as considered, count(*) filter (where reason is null) as written, count(*) filter (where reason is not null) as failed from ({_c10_sql('true')}) group by split")
def c10s(d):
    return S.manifest_summary(_c10(d, None))


def _manifest(k: int) -> str:
    return f"select ordinal, case when ordinal % 97 = 0 then ' ' else concat('m', cast(ordinal % (1000 + {k}) as string)) end as sample_id, case when ordinal % 5 = 0 then '' else 'part{k}' end as split, case when ordinal % 89 = 1 then null else concat('v/', cast(ordinal as string), '.mp4') end as video_relpath from v_meta where ordinal % 3 = {k}"


@query("C11_manifest_dedupe", f"""with u as (select 0 as source, * from ({_manifest(0)}) union all select 1, * from ({_manifest(1)}) union all select 2, * from ({_manifest(2)})),
  g as (select *, row_number() over (partition by sample_id order by source, ordinal) as rn from u where trim(sample_id) <> '' and coalesce(trim(video_relpath), '') <> '')
  select sample_id, cast(source as bigint) as source, ordinal, coalesce(nullif(split, ''), 'unknown') as split, video_relpath, 'ok' as outcome from g where rn = 1 union all
  select trim(sample_id), source, ordinal, null, null, case when trim(sample_id) = '' then 'missing_sample_id' else 'missing_video_relpath' end from u where trim(sample_id) = '' or coalesce(trim(video_relpath), '') = ''""")
def c11(d):
    ok, bad = S.manifest_dedupe(*[d.sql(_manifest(k)) for k in range(3)])
    a = ok.withColumn("outcome", F.lit("ok"))
    b = bad.select("sample_id", "source", "ordinal", F.lit(None).cast("string").alias("split"), F.lit(None).cast("string").alias("video_relpath"), F.col("reason").alias("outcome"))
    return a.unionByName(b).withColumn("source", F.col("source").cast("bigint"))


@query("C12_even_sample", "with n as (select clip_id, max(frame_idx) + 1 as n from v_feat group by clip_id), p as (select clip_id, i as slot, cast(round_even(i * (n - 1) / 6, 0) as bigint) as frame_idx from n, range(7) t(i)) select p.clip_id, cast(slot as bigint) as slot, frame_idx, v.gloss from p join v_feat v using (clip_id, frame_idx)")
def c12(d):
    return even_sample(d.view("v_feat").select("clip_id", "frame_idx", "gloss"), 7).select("clip_id", F.col("slot").cast("bigint").alias("slot"), "frame_idx", "gloss")


_DUR = "select event_id as clip_id, value / 20 - 0.1 as duration_seconds, case event_id % 3 when 0 then 0.0 when 1 then 25.0 else 29.97 end as src_fps, cast(floor(value) + 1 as bigint) as n_frames from {events}"


@query("C13_fixed_fps_plan", f"""with c as (select *, case when duration_seconds <= 0 then 0 else cast(ceil(duration_seconds * 30 - cast(1e-9 as double)) as bigint) end as e from (select clip_id, duration_seconds, cast(src_fps as double) as src_fps, n_frames from ({_DUR}))),
  f as (select c.clip_id, unnest(range(e)) as frame, src_fps, n_frames from c where e between 1 and 300),
  s as (select clip_id, least(cast(round_even(frame / 30 * case when src_fps > 0 then src_fps else 30 end, 0) as bigint), n_frames - 1) as source_frame, cast(round_even(frame / 30 * 1000, 0) as bigint) as ts_ms from f)
  select clip_id, count(*) as frames, cast(sum(source_frame) as bigint) as source_sum, cast(sum(ts_ms) as bigint) as ts_sum, 'ok' as outcome from s group by clip_id union all select clip_id, e, null, null, 'FRAME_COUNT_EXCEEDED' from c where e > 300""")
def c13(d):
    clips = d.sql(_DUR).withColumn("duration_seconds", F.col("duration_seconds").cast("double")).withColumn("src_fps", F.col("src_fps").cast("double"))
    plan, over = fixed_fps_plan(clips)
    a = plan.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("source_frame").alias("source_sum"), F.sum("ts_ms").alias("ts_sum"), F.lit("ok").alias("outcome"))
    null = F.lit(None).cast("bigint")
    b = over.select(F.col("key").cast("bigint").alias("clip_id"), F.col("detail").cast("bigint").alias("frames"), null.alias("source_sum"), null.alias("ts_sum"), F.col("rule").alias("outcome"))
    return a.unionByName(b)


def _c14(d, cap):
    p = d.view("v_pred").select("sample_id", "index", "expected_gloss")
    u = Y.union_datasets({"a": p.filter("expected_gloss = 'click'"), "b": p.filter("expected_gloss <> 'click'")}, cap)
    return u.select("sample_id", "dataset", "index", "expected_gloss")


@query("C14_union_datasets", "select case when expected_gloss = 'click' then 'a:' else 'b:' end || sample_id as sample_id, case when expected_gloss = 'click' then 'a' else 'b' end as dataset, index, expected_gloss from v_pred")
def c14(d):
    return _c14(d, None)


@query("C14_union_datasets_cap", "select * from (select 'a:' || sample_id as sample_id, 'a' as dataset, index, expected_gloss from v_pred where expected_gloss = 'click' union all select 'b:' || sample_id, 'b', index, expected_gloss from v_pred where expected_gloss <> 'click') order by dataset, index limit 3000")
def c14c(d):
    return _c14(d, 3000)


@query("C15_merge_expected_predicted", f"""with {WORDS_SQL} select concat(cast(index // 1000 as string), '-', cast(index % 1000 as string)) as sample_id, len(w) as expected_words, case when index % 5 = 0 then 1 else len(p) end as predicted_words,
  case when index % 5 = 0 then '__missing__' else p[1] end as first_word, 'ok' as outcome from v_words1 where index % 5 = 0 or len(p) > 0 union all
  select concat(cast(index // 1000 as string), '-', cast(index % 1000 as string)), null, null, null, 'predicted_words_empty' from v_words1 where index % 5 <> 0 and len(p) = 0""")
def c15(d):
    w = d.words()
    here = w.filter("index % 5 <> 0").select(
        "sample_id", F.when(F.col("index") % 2 == 0, F.col("predicted_words")).alias("predicted_words"), F.col("predicted_words").alias("words"))
    extra = here.select(F.concat(F.lit("x"), F.col("sample_id")).alias("sample_id"), "predicted_words", "words")
    ok, bad = X.merge_expected_predicted(w.select("sample_id", "expected_words"), here.unionByName(extra), allow_missing=True)
    big = lambda c: F.size(c).cast("bigint").alias(c)
    a = ok.select("sample_id", big("expected_words"), big("predicted_words"), F.get("predicted_words", F.lit(0))["word"].alias("first_word"), F.lit("ok").alias("outcome"))
    null = F.lit(None).cast("bigint")
    return a.unionByName(bad.select(
        F.col("key").alias("sample_id"), null.alias("expected_words"), null.alias("predicted_words"), F.lit(None).cast("string").alias("first_word"), F.col("rule").alias("outcome")))


_PCLIPS = "select cast(o_orderkey as string) as sample_id, o_orderpriority as gloss, cast(o_orderkey % 23 + 5 as bigint) as n_frames from {orders}"
_GL = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _num(parts: str) -> str:
    return f"cast('0x' || left(md5({parts}), 15) as bigint)"


_PHRASE_SQL = f"""with recursive g as (select gloss, row_number() over (order by gloss) - 1 as gi, count(*) as n from ({_PCLIPS}) group by gloss),
  ph as (select c_custkey as phrase, 2 + {_num("concat_ws('|', '42', 'count', c_custkey, 0)")} % 4 as wc from {{customer}}),
  w(phrase, wc, slot, gi) as (select phrase, wc, 0, {_num("concat_ws('|', '42', 'word', phrase, 0)")} % 5 from ph union all
    select phrase, wc, slot + 1, case when {_num("concat_ws('|', '42', 'repeat', phrase, slot + 1)")} % 1000000 < 200000 then gi
      else {_num("concat_ws('|', '42', 'word', phrase, slot + 1)")} % 4 + case when {_num("concat_ws('|', '42', 'word', phrase, slot + 1)")} % 4 >= gi then 1 else 0 end end from w where slot + 1 < wc),
  k as (select *, row_number() over (partition by gloss order by md5(concat('42|', sample_id)), sample_id) - 1 as rn from ({_PCLIPS})),
  c as (select w.phrase, w.slot, g.gloss as word, k.sample_id, k.n_frames, case when w.slot = w.wc - 1 then 0 else 2 + {_num("concat_ws('|', '42', 'gap', w.phrase, w.slot)")} % 7 end as gap_after
    from w join g on g.gi = w.gi join k on k.gloss = g.gloss and k.rn = {_num("concat_ws('|', '42', 'clip', w.phrase, w.slot)")} % g.n),
  b as (select *, sum(n_frames + gap_after) over (partition by phrase order by slot) - gap_after - 1 as end_frame from c),
  words as (select phrase, cast(slot as bigint) as slot, word, sample_id, n_frames, cast(gap_after as bigint) as gap_after, cast(end_frame - n_frames + 1 as bigint) as start_frame, cast(end_frame as bigint) as end_frame,
    cast(round_even((end_frame - n_frames + 1) / 30 * 1000, 0) as bigint) as start_ms, cast(round_even((end_frame + 1) / 30 * 1000, 0) as bigint) as end_ms from b)"""


def phrases(d):
    ids = d.table("customer").select(F.col("c_custkey").alias("phrase"))
    return Y.compose_phrases(ids, d.sql(_PCLIPS), _GL, seed=SEED).withColumn("slot", F.col("slot").cast("bigint"))


@query("C18_compose_phrases", _PHRASE_SQL + " select * from words")
def c18(d):
    return phrases(d)


@query("C18_phrase_manifest", _PHRASE_SQL + " select printf('synthetic_phrase_%06d', phrase) as sample_id, string_agg(word, ' ' order by slot) as gloss, count(*) as word_count, max(end_frame) + 1 as total_frames from words group by phrase")
def c18m(d):
    return Y.phrase_manifest(phrases(d)).select("sample_id", "gloss", F.col("word_count").cast("bigint").alias("word_count"), "total_frames")


@query("C18_phrase_frames", _PHRASE_SQL + " select phrase, cast(sum(n_frames + gap_after) as bigint) as frames, cast(sum(gap_after) as bigint) as gap_frames, cast(max(end_frame) as bigint) as last_frame from words group by phrase")
def c18f(d):
    seq = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - 1))
    frames = d.sql(_PCLIPS).select("sample_id", seq.alias("frame_idx"), F.array(F.lit(1.0), F.lit(2.0)).alias("f"))
    out = Y.phrase_frames(phrases(d), frames)
    return out.groupBy("phrase").agg(F.count_distinct("frame_idx").alias("frames"), F.count_if("is_gap").alias("gap_frames"), F.max("frame_idx").alias("last_frame"))


@query("C19_phrase_distribution", _PHRASE_SQL + """, p as (select *, lag(word) over (partition by phrase order by slot) as prev, lead(slot) over (partition by phrase order by slot) is null as last from words), h as (select wc, count(*) as n from (select count(*) as wc from words group by phrase) group by wc)
  select (select string_agg(cast(wc as string) || '=' || cast(n as string), ',' order by wc) from h) as histogram, min(gap_after) filter (where not last) as gap_min, max(gap_after) filter (where not last) as gap_max, count(distinct gap_after) filter (where not last) as gap_distinct, count(prev) as adjacent_pairs, count(*) filter (where prev = word) as adjacent_repeats, count(*) filter (where prev = word) / count(prev) as adjacent_repeat_rate from p""")
def c19(d):
    hist, facts = Y.phrase_distribution(phrases(d))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_count", "phrases"))), lambda x: F.concat_ws("=", x["word_count"].cast("string"), x["phrases"].cast("string"))), ",")
    return L.beside(h=hist.agg(text.alias("histogram")), f=facts).select("h.histogram", "f.*")


@query("B17_build_chat_samples", """with n as (select sample_id, gloss, cast(ordinal % 12 + 1 as bigint) as n from v_meta), i as (select sample_id, gloss, n, unnest(case when n <= 6 then range(n) else [cast(round_even(i * (n - 1) / 5, 0) as bigint) for i in range(6)] end) as k from n)
  select 'ds:' || sample_id as sample_id, gloss as label, count(*) as images, string_agg('f' || cast(k as string) || '.jpg', ',' order by k) as paths, gloss as answer from i group by sample_id, gloss""")
def b17(d):
    m = d.view("v_meta").select(
        "sample_id", F.col("gloss").alias("label"),
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("ordinal") % 12), lambda i: F.concat(F.lit("f"), i.cast("string"), F.lit(".jpg"))).alias("frame_paths"))
    c = Y.chat_samples(m, "ds")
    images = F.filter(F.col("messages")[0]["content"], lambda x: x["type"] == "image")
    return c.select(
        "sample_id", "label", F.size(images).cast("bigint").alias("images"), F.array_join(F.transform(images, lambda x: x["image"]), ",").alias("paths"),
        F.col("messages")[1]["content"][0]["text"].alias("answer"))
