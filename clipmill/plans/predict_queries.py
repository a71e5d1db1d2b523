"""Queries of family E: prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmill.functions.provider import failure_evidence, normalize_provider_response, validate_proof_fields
from clipmill.operators import predict as P
from clipmill.plans.metric_queries import _GATE_SQL, _SCORES, pred
from clipmill.plans.registry import query
from clipmill.plans.views import NORM


@query("E01_score_hook", "select event_id as index, upper(event_type) || ':' || cast(cast(floor(value) as bigint) as string) as raw from {events}")
def e01(d):
    def load():
        return lambda b: b.assign(raw=b["event_type"].str.upper() + ":" + b["v"].astype(str))[["index", "raw"]]

    e = d.table("events").select(F.col("event_id").alias("index"), "event_type", F.floor("value").alias("v"))
    return P.score_with(e, load, "index bigint, raw string")


@query("E02_hash_baseline", "select p.index, l.label as prediction from v_pred p join v_labels l on l.ord = cast('0x' || left(sha256(p.sample_id), 8) as bigint) % 5")
def e02(d):
    return d.view("v_pred").select("index", P.hash_baseline(F.col("sample_id"), d.labels).alias("prediction"))


_TRAIN = "select index, expected_gloss from v_pred where index % 3 <> 0"
_EVAL = "select index, case when index % 50 = 0 then 'unseen' else expected_gloss end as expected_gloss from v_pred where index % 3 = 0"


@query("E03_label_prior", f"select index, (select expected_gloss from ({_TRAIN}) group by 1 order by count(*) desc, 1 limit 1) as prediction from ({_EVAL})")
def e03(d):
    return P.label_prior(d.sql(_TRAIN), d.sql(_EVAL), "expected_gloss").select("index", "prediction")


@query("E04_label_prior_loss", f"with t as ({_TRAIN}), e as ({_EVAL}), c as (select expected_gloss, count(*) as n from t group by 1) select count(*) as n, round(avg(-ln((coalesce(c.n, 0) + 1) / ((select count(*) from t) + (select count(*) from (select expected_gloss from t union select expected_gloss from e))))), 6) as loss from e left join c using (expected_gloss)")
def e04(d):
    return P.label_prior_loss(d.sql(_TRAIN), d.sql(_EVAL), "expected_gloss").withColumn("loss", F.round("loss", 6))


@query("E05_retry_resolution", f"""with {_GATE_SQL} select q.sample_id, q.expected as expected_gloss, v.first_raw as first_pass_raw, "first" is not null as first_pass_valid, "first" is null as retry_used, case when "first" is null then v.retry_raw else '' end as retry_raw,
  "first" is null and final is not null as retry_valid, coalesce(final, '') as final_gloss, final is not null as final_valid, coalesce(final = q.expected, false) as correct from q join v_retry v using (index)""")
def e05(d):
    return P.retry_resolution(d.view("v_retry"), d.view("v_alias"), d.labels)


@query("E06_rank_candidates", f"with {_SCORES}, rk as (select *, row_number() over (partition by sample_id order by score desc, ord) as rk from sc) select sample_id, max(case when rk = 1 then label end) as best_label, max(score) as best_score, string_agg(label || '=' || cast(cast(score as bigint) as string), ',' order by rk) filter (where rk <= 3) as top_scores from rk group by sample_id")
def e06(d):
    top, _ = P.rank_candidates(d.scores(), d.labels, 3)
    text = F.array_join(F.transform("top_scores", lambda x: F.concat_ws("=", x["label"], x["score"].cast("bigint").cast("string"))), ",")
    return top.withColumn("top_scores", text)


@query("E06_candidate_violations", """with s as (select event_id as i, concat('s', cast(event_id as string)) as key, label from {events}, v_labels)
  select key, 'missing_label' as rule from s where i % 20 = 0 group by key union all select distinct key, 'unexpected_label' from s where i % 30 = 0 union all select distinct key, 'duplicate_label' from s where i % 70 = 0""")
def e06v(d):
    i = F.substring("sample_id", 2, 20).cast("bigint")
    s = d.scores()
    first = d.labels[0]
    some = s.filter(~((i % 20 == 0) & (F.col("label") == first)))
    extra = s.filter((i % 30 == 0) & (F.col("label") == first)).withColumn("label", F.lit("other"))
    twice = s.filter((i % 70 == 0) & (F.col("label") != first)).withColumn("score", F.col("score") + 1)
    _, bad = P.rank_candidates(some.unionByName(extra).unionByName(twice), d.labels, 3)
    return bad.select("key", "rule")


@query("E07_normalize_provider_response", """with p as (select index, event_type, index % 8 as k from v_provider join {events} on event_id = index)
  select index, case when k >= 5 then 'INFERENCE_INVALID_RESPONSE' end as error_code, case k when 5 then 'empty_prediction' when 6 then 'missing_confidence' when 7 then 'invalid_transcript_words' end as error,
  case when k in (0, 1, 2) then event_type when k = 3 then 'aa bb' when k = 4 then 'cc' end as prediction, case k when 0 then 0.9::double when 1 then 0.77::double when 2 then 0.5::double when 3 then 0.0::double when 4 then 0.3::double end as confidence,
  case when k in (0, 1, 2) then event_type || '@0-0' when k = 3 then 'aa@1-5 bb@6-9' when k = 4 then 'cc@0-0' end as words,
  case k when 0 then 0.9::double when 1 then 0.77::double when 2 then 0.25::double when 3 then 0.0::double when 4 then 0.3::double end as sequence_confidence, case when k < 5 then k in (1, 4) end as low_confidence, case when k = 0 then '["x",2]' when k = 2 then '["y"]' when k < 5 then '[]' end as alternatives from p""")
def e07(d):
    p = d.view("v_provider").withColumn("v", F.try_parse_json("payload"))
    a = normalize_provider_response(p, "v")
    words = F.array_join(F.transform("answer.words", lambda w: F.concat(w["word"], F.lit("@"), w["start_ms"].cast("string"), F.lit("-"), w["end_ms"].cast("string"))), " ")
    ok = lambda c, n: F.when(F.col("answer.error").isNull(), c).alias(n)
    return a.select(
        "index", "answer.error_code", "answer.error", *[ok(F.col(f"answer.{c}"), c) for c in ("prediction", "confidence", "sequence_confidence", "low_confidence", "alternatives")], ok(words, "words"))


@query("E08_validate_proof_fields", """with p as (select index, case when index % 11 = 0 and index % 13 = 0 then 'runtime_mode, model_id' when index % 11 = 0 then 'runtime_mode' when index % 13 = 0 then 'model_id' end as gone,
  case when index % 11 = 1 then 'runtime_mode' when index % 5 = 0 then 'cloud_handoff' when index % 7 = 1 then 'request_id mismatch' end as bad from v_provider)
  select index, case when gone is not null then 'INFERENCE_PROOF_MISSING' when bad is not null then 'INFERENCE_PROOF_INVALID' end as error_code, coalesce(gone, bad) as detail from p""")
def e08(d):
    v = F.try_parse_json("payload")
    return d.view("v_provider").withColumn("v", v).select("index", validate_proof_fields(F.col("v"), F.col("request_id")).alias("p")).select("index", "p.error_code", "p.detail")


_FAIL = "select event_id as index, case when event_id % 7 <> 0 then 400 + event_id % 200 end as status, case event_id % 4 when 0 then null when 1 then '  ' when 2 then ' TIMEOUT ' else 'X' end as code, case event_id % 3 when 0 then '' when 1 then ' m ' end as message, case event_id % 5 when 0 then ' ' else concat(' r', cast(event_id as string)) end as rid from {events}"


@query("E09_failure_evidence", f"with f as ({_FAIL}) select index, cast(status as bigint) as upstream_status, coalesce(nullif(trim(code), ''), 'CLOUD_HANDOFF_FAILED') as upstream_code, coalesce(nullif(trim(message), ''), 'Cloud handoff request failed') as upstream_message, nullif(trim(rid), '') as upstream_request_id from f")
def e09(d):
    return d.sql(_FAIL).select("index", failure_evidence(F.col("status"), F.col("code"), F.col("message"), F.col("rid")).alias("e")).select("index", "e.*")


@query("E10_confidence_output", "with c as (select event_id as index, event_type, event_id % 9 <> 0 as ok, value / 100 - 0.1 as c from {events}) select index, case when not ok then 'error' when least(greatest(c, 0), 1) < 0.7 then 'uncertain' else 'ok' end as status, case when not ok or c < 0.7 then 'uncertain' else event_type end as display_text, least(greatest(c, 0.0::double), 1.0::double) as confidence, not ok or c < 0.7 as is_uncertain from c")
def e10(d):
    e = d.table("events")
    o = P.confidence_output(F.col("event_id") % 9 != 0, F.col("event_type"), F.col("value") / 100 - F.lit(0.1))
    return e.select(F.col("event_id").alias("index"), o.alias("o")).select("index", "o.*")


@query("E11_replay_check", """with s as (select conv_id, turn, row_number() over (partition by conv_id, turn // 50 order by turn) - 1 as pos, case when turn % 5 = 4 then 0 else turn * 100 end as at_ms, length(text) % 10 / 10 as c, role from {conversations}),
  x as (select *, coalesce(lag(at_ms) over (partition by conv_id, turn // 50 order by turn), 0) as previous_at_ms from s)
  select concat_ws('.', 'c', cast(conv_id as string), cast(turn // 50 as string)) as scenario, pos, at_ms, previous_at_ms, case when c < 0.7 then 'uncertain' else 'ok' end as status, case when c < 0.7 then 'uncertain' else role end as display_text, c as confidence, at_ms < previous_at_ms as backwards from x""")
def e11(d):
    zero = F.lit(0).cast("bigint")
    step = F.struct(
        F.col("turn"), F.when(F.col("turn") % 5 == 4, zero).otherwise(F.col("turn") * 100).alias("at_ms"), F.col("role").alias("prediction"),
        (F.length("text") % 10 / 10).alias("confidence"), F.lit(None).cast("boolean").alias("ok"))
    scripts = d.table("conversations").groupBy(
        F.concat_ws(".", F.lit("c"), F.col("conv_id").cast("string"), F.floor(F.col("turn") / 50).cast("string")).alias("scenario")).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    rows, _ = P.replay_check(scripts)
    return rows.withColumn("pos", F.col("pos").cast("bigint")).withColumn("backwards", F.col("at_ms") < F.col("previous_at_ms"))


_LABELLED = "select concat('clip', cast(event_id as string), '.mp4') as filename, case event_id % 4 when 0 then event_type when 1 then upper(event_type) else '' end as expected_label from {events} where event_id % 5 <> 0"
_OUT = "select concat('clip', cast(event_id as string), '.mp4') as filename, case event_id % 6 when 0 then 'error' when 1 then 'uncertain' else 'ok' end as status, case when event_id % 6 > 1 then case when event_id % 3 = 0 then 'click' else event_type end end as prediction from {events}"


@query("E12_result_rows", f"""with l as ({_LABELLED}), o as ({_OUT}), j as (select o.*, nullif({NORM('l.expected_label')}, '') as expected from o left join l using (filename))
  select filename as video_filename, expected as expected_label, status, prediction as predicted_gloss, upper(left(prediction, 1)) || substr(prediction, 2) || '.' as translation,
  case when expected is not null and status <> 'error' then coalesce(prediction = expected, false) end as correct, 'm1' as model from j""")
def e12(d):
    return P.result_rows(d.sql(_OUT), d.sql(_LABELLED), {"model": "m1"})


@query("C16_reference_selection", f"""with r as (select index, sample_id, expected_gloss, case when label = expected_gloss then label end as predicted_gloss from (select index, concat('g', cast(index % 40 as string)) as sample_id, expected_gloss, list_filter(list_transform(regexp_split_to_array(raw_model_output, '[\\n,;:]+'), lambda x: {NORM('x')}), lambda x: x <> '')[1] as label from v_pred)),
  f as (select *, row_number() over (partition by sample_id order by index) as rn from r where predicted_gloss is not null)
  select index, sample_id, predicted_gloss, case when row_number() over (order by index) = 1 then 'smoke' else 'demo' end as selection_role from f where rn = 1 order by index limit 6""")
def c16(d):
    rows = pred(d).withColumn("sample_id", F.concat(F.lit("g"), (F.col("index") % 40).cast("string")))
    return P.reference_selection(rows, 5).select("index", "sample_id", "predicted_gloss", "selection_role")


_REQ = "select concat('s', cast(event_id * 2 as string)) as sample_id, case when event_id % 100 = 7 then 'other' else upper(event_type) end as expected_gloss from {events}"
_REC = "select concat('s', cast(event_id as string)) as sample_id, event_type as output, concat('input ', cast(event_id as string)) as input from {events}"


@query("C17_lookup_record", f"""with q as (select sample_id, {NORM('expected_gloss')} as g from ({_REQ})), r as ({_REC}), j as (select q.sample_id, g, r.sample_id as hit, output, input from q left join r using (sample_id))
  select sample_id, g as expected_gloss, case when hit is null then 'sample_id_not_found' when output <> g then 'expected_gloss_mismatch' else 'ok' end as outcome from j""")
def c17(d):
    good, bad = P.lookup_records(d.sql(_REQ), d.sql(_REC))
    return good.select("sample_id", "expected_gloss", F.lit("ok").alias("outcome")).unionByName(
        bad.select(F.col("key").alias("sample_id"), F.col("detail").alias("expected_gloss"), F.col("rule").alias("outcome")))
