"""Queries of family A: sources, sinks and schema checks, over files Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmill.constants import CONSTRAINED_COLUMNS, MULTIWORD_COLUMNS, STRICT_COLUMNS
from clipmill.operators import gates as G
from clipmill.operators import labels as L
from clipmill.operators import metrics as M
from clipmill.operators import splits as S
from clipmill.operators import transcripts as X
from clipmill.plans.metric_queries import _SCORES, _STRICT, R, pred, ranked
from clipmill.plans.registry import query
from clipmill.plans.split_queries import SEED, _stratified
from clipmill.plans.views import NORM, WORDS_SQL
from clipmill.session import new_path
from clipmill.sources import media as E
from clipmill.sources import poses as Z
from clipmill.sources import records as Q
from clipmill.sources import sinks as K

_INST = """select o_orderpriority as gloss, cast(o_orderkey as string) as video_id, case o_orderkey % 5 when 0 then null when 1 then 'train' when 2 then 'val' when 3 then 'test' else 'dev' end as split,
  case when o_orderkey % 4 = 0 then 'NaN' when o_orderkey % 4 = 1 then '' else cast(o_custkey as string) end as signer_id, cast(o_orderkey as string) as instance_id, 'src' as source,
  case when o_orderkey % 3 = 0 then 'nan' when o_orderkey % 3 = 1 then '29.97' else 'x' end as fps, '1.0' as frame_start, '-1' as frame_end, cast(floor(o_orderkey / 8) as bigint) as grp from {orders}"""


def entries(d):
    inst = F.struct("video_id", "split", "signer_id", "instance_id", "source", "fps", "frame_start", "frame_end")
    return d.sql(_INST).groupBy("gloss", "grp").agg(F.collect_list(inst).alias("instances")).select("gloss", "instances")


@query("A01_flatten_metadata", f"select gloss || '_' || video_id as sample_id, gloss, coalesce(split, 'unspecified') as split, video_id, signer_id, instance_id, source, fps, frame_start, frame_end from ({_INST})")
def a01(d):
    path = new_path(d.spark, "metadata")
    entries(d).write.json(path)
    return Q.read_metadata(d.spark, path, lines=True)


@query("A01_flatten_metadata_array", f"select gloss || '_' || video_id as sample_id, gloss, coalesce(split, 'unspecified') as split, video_id, signer_id, instance_id, source, fps, frame_start, frame_end from ({_INST})")
def a01a(d):
    """The nested array form: files of one JSON array each, cut into entries by many tasks."""
    path = new_path(d.spark, "metadata-array")
    K.write_metadata(entries(d), path)
    return Q.read_metadata(d.spark, path)


@query("A02_cast_metadata", f"select gloss || '_' || video_id as sample_id, gloss, coalesce(split, 'unspecified') as split, video_id, source, case when signer_id not in ('NaN', '') then cast(signer_id as bigint) end as signer_id, cast(instance_id as bigint) as instance_id, cast(1 as bigint) as frame_start, cast(-1 as bigint) as frame_end, case when fps = '29.97' then 29.97::double end as fps from ({_INST})")
def a02(d):
    return Q.cast_metadata(Q.flatten_metadata(entries(d))).drop("raw_metadata")


@query("A03_validate_official_split", f"select 'unknown_split' as rule, gloss || '_' || video_id as key, coalesce(split, 'unspecified') as detail from ({_INST}) where split is null or split not in ('train', 'val', 'test')")
def a03(d):
    return Q.validate_official_split(Q.flatten_metadata(entries(d)))


_LINES = """select case when event_id % 40 = 3 then '  ' when event_id % 40 = 4 then '{{bad' when event_id % 40 = 5 then '[1]' else concat('{{"instruction":"i","input":"sample_id=s', cast(event_id as string), '","output":"', event_type, '"}}') end as value from {events}"""


@query("A04_read_records_jsonl", f"with l as ({_LINES}) select case when value = '{{{{bad' then 'not_json' when value = '[1]' then 'not_an_object' else 'ok' end as outcome, case when value like '{{{{\"%' then json_extract_string(value, '$.input') else value end as input, json_extract_string(case when value like '{{{{\"%' then value end, '$.output') as output from l where trim(value) <> ''")
def a04(d):
    path = new_path(d.spark, "records")
    d.sql(_LINES).write.text(path)
    good, bad = Q.read_records_jsonl(d.spark, path)
    a = good.select(F.lit("ok").alias("outcome"), "input", "output")
    return a.unionByName(bad.select(F.col("rule").alias("outcome"), F.col("detail").alias("input"), F.lit(None).cast("string").alias("output")))


@query("A04_line_numbers", "select count(*) as lines, cast(sum(text_line) as bigint) as line_sum, count(*) as distinct_lines from (select event_id + 1 as text_line from {events} where event_id % 40 <> 3)")
def a04l(d):
    from clipmill.sources.lines import read_lines

    path = new_path(d.spark, "ordered")
    lines = d.sql("select event_id, case when event_id % 40 = 3 then ' ' else cast(event_id as string) end as value from {events}")
    lines.orderBy("event_id").select("value").write.text(path)
    # Files of an ordered write follow each other; a line's number in its file plus the file's start is its event.
    r = read_lines(d.spark, path).withColumn("start", F.col("value").cast("bigint") + 1 - F.col("line_no"))
    per = r.groupBy("path").agg(F.min("start").alias("start"), F.max("start").alias("top"), F.sum("line_no").alias("s"), F.count(F.lit(1)).alias("n"), F.count_distinct("line_no").alias("k"))
    ok = F.when(F.col("start") == F.col("top"), F.col("s") + F.col("start") * F.col("n"))
    return per.agg(F.sum("n").alias("lines"), F.sum(ok).alias("line_sum"), F.sum("k").alias("distinct_lines"))


@query("A05_read_label_contract", "select cast(row_number() over (order by p_brand) - 1 as bigint) as ord, p_brand as label, 'v1' as version, (select count(distinct p_brand) from {part}) <> 50 as size_violation from (select distinct p_brand from {part})")
def a05(d):
    path = new_path(d.spark, "contract") + ".txt"
    d.table("part").select("p_brand").distinct().orderBy("p_brand").coalesce(1).write.text(path)
    c = Q.read_label_contract(d.spark, path).withColumn("version", F.lit("v1"))
    wrong = L.contract_checks(c).filter("rule = 'size'").count() > 0
    return c.withColumn("size_violation", F.lit(wrong))


@query("A05_contract_checks", "with l as (select distinct p_brand as label from {part}) select 'size' as rule, cast(count(*) as string) as detail from l having count(*) <> 50 union all select 'version', 'v2'")
def a05c(d):
    path = new_path(d.spark, "contract")
    brands = d.table("part").agg(F.sort_array(F.collect_set("p_brand")).alias("glosses"))  # a contract is one document
    brands.select(F.to_json(F.struct(F.lit("v2").alias("version"), "glosses")).alias("value")).write.text(path)
    return L.contract_checks(Q.read_label_contract(d.spark, path), version="v1").select("rule", "detail")


_NAMES = "select case p_partkey % 3 when 0 then upper(p_name) when 1 then concat(p_name, '!') else p_name end as original from {part}"


@query("A06_label_collision_check", f"with p as (select distinct original, {NORM('original')} as label from ({_NAMES})) select label, original from p where label in (select label from p group by label having count(*) > 1)")
def a06(d):
    return L.label_collisions(d.sql(_NAMES), "original")


@query("A07_read_predictions_csv", f"with {R} select index, sample_id, expected_gloss, nullif(coalesce(label, ''), '') as predicted_gloss, nullif(raw_model_output, '') as raw_model_output, valid as valid_label, coalesce(correct, false) as correct, 'real' as mode from r")
def a07(d):
    path = new_path(d.spark, "predictions")
    K.write_predictions(pred(d), STRICT_COLUMNS, path)
    rows, _ = Q.read_predictions_csv(d.spark, path)
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return rows.select("index", "sample_id", "expected_gloss", blank("predicted_gloss"), blank("raw_model_output"), "valid_label", "correct", "mode")


_QUOTED = "select doc_id as index, concat('s', cast(doc_id as string)) as sample_id, lang as expected_gloss, source as predicted_gloss, concat(text, chr(10), '\"', lang, '\",', chr(10)) as raw_model_output, doc_id % 2 = 0 as valid_label, doc_id % 3 = 0 as correct, 'real' as mode from {documents}"


@query("A07_read_predictions_quoted", f"select index, sample_id, nullif(expected_gloss, '') as expected_gloss, nullif(predicted_gloss, '') as predicted_gloss, md5(replace(raw_model_output, chr(13), '')) as raw_md5, valid_label, correct, mode from ({_QUOTED})")
def a07q(d):
    """Whole texts with line breaks, quotes and commas as quoted values: files are split inside them."""
    path = new_path(d.spark, "predictions-quoted")
    K.write_predictions(d.sql(_QUOTED), STRICT_COLUMNS, path)
    rows, _ = Q.read_predictions_csv(d.spark, path)
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return rows.select("index", "sample_id", blank("expected_gloss"), blank("predicted_gloss"), F.md5(F.replace("raw_model_output", F.lit("\r"), F.lit(""))).alias("raw_md5"), "valid_label", "correct", "mode")


_IDS = "select event_id as index, case when event_id % 500 = 0 then concat(' ', chr(9)) when event_id % 500 = 1 then concat('s1', chr(9)) when event_id % 500 = 2 then concat(chr(160), 's1') else concat('s', cast(event_id as string)) end as sample_id, upper(event_type) as expected_gloss from {events}"


@query("A08_identity_rows_check", f"select case when key = '' then 'empty_sample_id' else 'duplicate_sample_id' end as rule, key, cast(n as string) as detail from (select trim(sample_id, concat(' ', chr(9), chr(160))) as key, count(*) as n from ({_IDS}) group by 1) where key = '' or n > 1")
def a08(d):
    return G.identity_violations(Q.identity_rows(d.sql(_IDS)))


_EXP = "select event_id as ordinal, concat('dir/', cast(event_id % 3000 as string), '.mp4') as filename, case when event_id % 6 = 0 then ' !' else upper(event_type) end as expected_label from {events}"


@query("A10_read_expected_labels", f"with e as (select ordinal, split_part(filename, '/', 2) as filename, {NORM('expected_label')} as l from ({_EXP})) select filename, max_by(l, ordinal) as expected_label from e where l <> '' group by filename")
def a10(d):
    path = new_path(d.spark, "expected")
    d.sql(_EXP).orderBy("ordinal").select("filename", "expected_label").write.option("header", True).csv(path)
    return Q.read_expected_labels(d.spark, path)


_CLIPTEXT = "select cast(o_orderkey % 50 as bigint) as k, concat(o_orderpriority, ' ', cast(o_orderkey as string)) as value from {orders}"


@query("A11_list_media", f"select k, cast(sum(octet_length(encode(value)) + 1) as bigint) as length from ({_CLIPTEXT}) group by k")
def a11(d):
    root = new_path(d.spark, "media")
    d.sql(_CLIPTEXT).repartition("k").write.partitionBy("k").text(f"{root}/clips")
    d.sql(_CLIPTEXT).write.json(f"{root}/notes")  # another suffix: not listed
    found = E.list_media(d.spark, root, (".txt",))
    return found.groupBy(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("bigint").alias("k")).agg(F.sum("length").alias("length"))


_CAND = "select o_orderkey as clip_id, concat('v/', cast(o_orderkey as string)) as stem from {orders}"
_LIST = "select concat('v/', cast(o_orderkey as string), case o_orderkey % 4 when 0 then '.mp4' when 1 then '.mov' else '.swf' end) as path from {orders} where o_orderkey % 4 <> 2 union all select concat('v/', cast(o_orderkey as string), '.mov') as path from {orders} where o_orderkey % 8 = 0"


@query("A12_resolve_media_path", "select o_orderkey as clip_id, case o_orderkey % 4 when 0 then concat('v/', cast(o_orderkey as string), '.mp4') when 1 then concat('v/', cast(o_orderkey as string), '.mov') when 3 then concat('v/', cast(o_orderkey as string), '.swf') end as path from {orders}")
def a12(d):
    c = d.sql(_CAND).withColumn("candidates", F.array(*[F.concat("stem", F.lit(x)) for x in (".mp4", ".mov", ".swf")])).drop("stem")
    return E.resolve_media_path(c, d.sql(_LIST))


@query("A13_ingest_pose_archives", "select cast(clip_id as string) as clip_id, cast(clip_id as string) as archive_id, frame_idx, cast(f[1] as double) as body_x, cast(f[61] as double) as hand_x, 'ok' as outcome from v_feat where clip_id % 5 <> 1 union all select cast(clip_id as string), null, null, null, null, 'not_finite' from v_feat where clip_id % 5 = 1 group by clip_id")
def a13(d):
    nan = F.when((F.col("clip_id") % 5 == 1) & (F.col("frame_idx") == 0), F.lit(float("nan"))).otherwise(F.lit(1.0)).cast("float")
    broken = F.transform("right_hand", lambda j: F.transform(j, lambda v: v * nan))
    c = d.components().withColumn("right_hand", broken).withColumn("clip_id", F.col("clip_id").cast("string"))
    good, bad = Z.decode_pose_archives(Z.encode_pose_archives(c.select("clip_id", "frame_idx", "body", "left_hand", "right_hand")))
    a = good.select(
        "clip_id", "archive_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), F.col("body")[0][0].cast("double").alias("body_x"),
        F.col("right_hand")[3][0].cast("double").alias("hand_x"), F.lit("ok").alias("outcome"))
    null = F.lit(None)
    return a.unionByName(bad.select(
        F.col("key").alias("clip_id"), null.cast("string").alias("archive_id"), null.cast("bigint").alias("frame_idx"),
        null.cast("double").alias("body_x"), null.cast("double").alias("hand_x"), F.col("rule").alias("outcome")))


_PATHS = "select event_id as index, case event_id % 8 when 0 then null when 1 then ' ' when 2 then '/abs/x.npz' when 3 then '../x.npz' when 4 then 'a/../b.npz' when 5 then 'a/../../b.npz' when 6 then './a//b.npz' else 'p.npz' end as pose_path, case when event_id % 16 = 8 then '' else concat('s', cast(event_id as string)) end as sample_id from {events}"


@query("A14_safe_relative_path", f"""select index, case index % 8 when 0 then case when index % 16 = 0 then sample_id || '.npz' end when 1 then sample_id || '.npz' when 4 then 'a/../b.npz' when 6 then './a//b.npz' when 7 then 'p.npz' end as path,
  case when index % 16 = 8 then 'no_path' when index % 8 = 2 then 'absolute_path' when index % 8 in (3, 5) then 'escapes_root' end as error from ({_PATHS})""")
def a14(d):
    return d.sql(_PATHS).select("index", E.safe_relative_path(F.col("pose_path"), F.col("sample_id")).alias("p")).select("index", "p.path", "p.error")


_ARCH = "select concat('poses/', sample_id, '.npz') as path from v_meta where ordinal % 3 = 0 union all select 'poses/other.npz' as path from {region}"


@query("A15_training_pairs", "select sample_id, gloss, signer_id, 'poses/' || sample_id || '.npz' as pose_path from v_meta where ordinal % 3 = 0")
def a15(d):
    return E.training_pairs(d.view("v_meta"), d.sql(_ARCH))


_WORK = "select sample_id, case when ordinal % 10 = 1 then ' ' else concat('v/', sample_id) end as video_path from v_meta"


@query("A16_incremental_pending", "select case when ordinal % 4 = 0 then 'skipped' when ordinal % 10 = 1 then 'missing_video_path' else 'pending' end as state, count(*) as n, min(sample_id) as first_id from v_meta group by 1")
def a16(d):
    todo, skipped, bad = E.incremental_pending(d.sql(_WORK), d.sql("select sample_id from v_meta where ordinal % 4 = 0"))
    rows = todo.select(F.lit("pending").alias("state"), "sample_id").unionByName(skipped.select(F.lit("skipped").alias("state"), "sample_id")).unionByName(
        bad.select(F.col("rule").alias("state"), F.col("key").alias("sample_id")))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_id"))


@query("A17_write_metrics", f"with {R} {_STRICT} from r")
def a17(d):
    path = new_path(d.spark, "metrics")
    K.write_metrics(M.strict_metrics(pred(d), len(d.labels)), path)
    return d.spark.read.schema("sample_count bigint, correct bigint, invalid bigint, accuracy double, invalid_rate double").json(path)


@query("A17_write_multiword", f"with {WORDS_SQL} select cast(index as bigint) as index, len(w) as expected_word_count, len(p) as predicted_word_count, array_to_string(w, ' ') as expected_text, nullif(array_to_string(p, ' '), '') as predicted_text, w = p as exact_match, {len(MULTIWORD_COLUMNS)} as columns from v_words1")
def a17m(d):
    path = new_path(d.spark, "multiword")
    K.write_predictions(X.wer_rows(d.words()), MULTIWORD_COLUMNS, path)
    rows = Q.read_csv(d.spark, path, MULTIWORD_COLUMNS)
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return rows.select(
        big("index"), big("expected_word_count"), big("predicted_word_count"), "expected_text", F.nullif("predicted_text", F.lit("")).alias("predicted_text"),
        F.col("exact_match").cast("boolean").alias("exact_match"), F.lit(len(rows.columns)).alias("columns"))


@query("A17_write_constrained", f"with {R}, {_SCORES}, rk as (select *, row_number() over (partition by sample_id order by score desc, ord) as rk from sc) select r.index, r.sample_id, r.expected_gloss, nullif(coalesce(r.label, ''), '') as free_generation_prediction, b.label as constrained_prediction, b.label = r.expected_gloss as constrained_correct, (select string_agg(label || '=' || cast(cast(score as bigint) as string), ',' order by rk) from rk where rk.sample_id = r.sample_id and rk <= 3) as top_scores, 'constrained' as mode from r join best b on r.sample_id = b.sample_id")
def a17c(d):
    """The constrained layout written, read back, and its scores parsed from their JSON text."""
    path = new_path(d.spark, "constrained")
    K.write_predictions(M.constrained_layout(M.constrained_rows(ranked(d), pred(d))), CONSTRAINED_COLUMNS, path)
    rows, _ = Q.read_predictions_csv(d.spark, path, CONSTRAINED_COLUMNS)
    scores = F.from_json("top_scores", "array<struct<label string, score double>>")
    text = F.array_join(F.transform(scores, lambda x: F.concat_ws("=", x["label"], x["score"].cast("bigint").cast("string"))), ",")
    return rows.withColumn("top_scores", text).withColumn("free_generation_prediction", F.nullif("free_generation_prediction", F.lit("")))


@query("A18_write_splits", f"with {_stratified('v_meta')} select split, count(*) as rows, count(*) as ids, (select count(*) from v_meta) as num_samples from sp group by split")
def a18(d):
    path = new_path(d.spark, "splits")
    rows = S.stratified_split(d.view("v_meta"), "gloss", "sample_id", SEED)
    K.write_splits(rows, "gloss", "stratified", "v1", path)
    n = d.spark.read.parquet(f"{path}/rows").groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    ids = d.spark.read.text(f"{path}/ids").groupBy("split").agg(F.count_distinct("value").alias("ids"))
    total = d.spark.read.schema("num_samples bigint").json(f"{path}/manifest").first()[0]
    return n.join(ids, "split").withColumn("num_samples", F.lit(total).cast("bigint"))


@query("A19_append_log", "select outcome, count(*) * 2 as n, cast(sum(latency_ms) * 2 as bigint) as total_ms from v_tele group by outcome")
def a19(d):
    path = new_path(d.spark, "log")
    for _ in range(2):
        K.append_log(d.view("v_tele"), path)
    log = d.spark.read.schema("request_id string, latency_ms bigint, outcome string").json(path)
    return log.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("total_ms"))
