"""Queries of family F: scores, gates and run comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmill.operators import gates as G
from clipmill.operators import metrics as M
from clipmill.operators import predict as P
from clipmill.operators import transcripts as X
from clipmill.operators.ranking import nearest_rank, readiness_index, telemetry_index
from clipmill.plans.registry import query
from clipmill.plans.views import NORM
from clipmill.plans.views import WORDS_SQL


def _rows_sql(view: str, name: str) -> str:
    """Resolved predictions in SQL, as CTE ``name``."""
    return f"""{name} as (select *, valid and label = expected_gloss as correct, case when valid then label else '__invalid__' end as pm from
      (select index, sample_id, {NORM('expected_gloss')} as expected_gloss, raw_model_output, label, coalesce(label in (select label from v_labels), false) as valid from
        (select *, list_filter(list_transform(regexp_split_to_array(raw_model_output, '[\\n,;:]+'), lambda x: {NORM('x')}), lambda x: x <> '')[1] as label from {view})))"""


R = _rows_sql("v_pred", "r")
RB = _rows_sql("v_pred_b", "rb")
_STRICT = """select count(*) as sample_count, count(*) filter (where correct) as correct, count(*) filter (where not valid) as invalid,
  count(*) filter (where correct) / count(*) as accuracy, count(*) filter (where not valid) / count(*) as invalid_rate"""


def pred(d, view="v_pred"):
    return M.prediction_rows(d.view(view), d.labels)


@query("F01_prediction_rows", f"with {R} select index, sample_id, expected_gloss, coalesce(label, '') as predicted_gloss, raw_model_output, valid as valid_label, coalesce(correct, false) as correct, pm as prediction_for_metrics, 'real' as mode from r")
def f01(d):
    return pred(d)


@query("F02_strict_metrics", f"with {R} {_STRICT}, (select count(*) from v_labels) as class_count from r")
def f02(d):
    return M.strict_metrics(pred(d), len(d.labels))


@query("F03_per_class_accuracy", f"with {R}, l as (select label from v_labels union all select 'absent') select l.label, count(r.index) as support, count(*) filter (where correct) as correct, case when count(r.index) = 0 then 0.0::double else count(*) filter (where correct) / count(r.index) end as accuracy from l left join r on l.label = r.expected_gloss group by l.label")
def f03(d):
    extra = d.sql("select cast(99 as bigint) as ord, 'absent' as label")
    return M.per_class_accuracy(pred(d), d.label_df.unionByName(extra))


@query("F04_confusion_counts", f"with {R} select coalesce(nullif(expected_gloss, ''), 'unknown') as expected, pm as predicted, count(*) as n from r group by 1, 2")
def f04(d):
    return M.confusion_counts(pred(d))


_SCORES = """sc as (select concat('s', cast(event_id as string)) as sample_id, event_type as expected, l.label, l.ord,
  cast(cast('0x' || left(md5(cast(event_id as string) || '|' || l.label), 4) as bigint) % 7 as double) as score from {events}, v_labels l),
  best as (select *, label = expected as ok from (select *, row_number() over (partition by sample_id order by score desc, ord) as rk from sc) where rk = 1)"""


def ranked(d, k=3):
    top, _ = P.rank_candidates(d.scores(), d.labels, k)
    exp = d.view("v_pred").select("sample_id", "index", "expected_gloss")
    j = top.join(exp, "sample_id")
    return j.withColumn("correct", F.col("best_label") == F.col("expected_gloss"))


@query("F05_constrained_metrics", f"with {R}, {_SCORES} select count(*) as sample_count, count(*) filter (where ok) as correct, count(*) filter (where ok) / count(*) as constrained_top1_accuracy, (select count(*) from v_labels) as class_count, count(*) filter (where coalesce(r.label, '') = best.label) as agrees from best left join r using (sample_id)")
def f05(d):
    rows = M.constrained_rows(ranked(d), pred(d))
    agrees = F.count_if(F.col("free_generation_prediction") == F.col("best_label")).alias("agrees")
    from clipmill.operators.labels import beside

    return beside(a=M.constrained_metrics(rows, len(d.labels)), b=rows.agg(agrees)).select("a.*", "b.agrees")


@query("F06_word_accuracy", "select count(*) as n, count(*) filter (where trim(regexp_replace(lower(expected_gloss), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(raw_model_output), '\\s+', ' ', 'g'))) as correct, count(*) filter (where trim(regexp_replace(lower(expected_gloss), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(raw_model_output), '\\s+', ' ', 'g'))) / count(*) as word_accuracy from v_pred_b")
def f06(d):
    return M.word_accuracy(d.view("v_pred_b"), "expected_gloss", "raw_model_output")


@query("F07_top_k_accuracy", f"with {_SCORES}, t as (select sample_id, max(case when label = expected then rk end) as rk from (select *, row_number() over (partition by sample_id order by score desc, ord) as rk from sc) group by sample_id) select count(*) as n, count(*) filter (where rk <= 2) as hits, count(*) filter (where rk <= 2) / count(*) as top_k_accuracy from t")
def f07(d):
    r = ranked(d, 5).withColumn("cands", F.transform("top_scores", lambda x: x["label"]))
    return M.top_k_accuracy(r, "expected_gloss", "cands", 2)


_PRF = f"""with {R}, o as (select label, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from (
  select expected_gloss as label, cast(expected_gloss = pm as int) as tp, 0 as fp, cast(expected_gloss <> pm as int) as fn from r union all
  select pm, 0, 1, 0 from r where expected_gloss <> pm) group by label),
  f as (select label, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tp + fn as bigint) as support,
  case when tp + fp = 0 then 0.0::double else tp / (tp + fp) end as "precision", case when tp + fn = 0 then 0.0::double else tp / (tp + fn) end as recall,
  case when 2 * tp + fp + fn = 0 then 0.0::double else 2 * tp / (2 * tp + fp + fn) end as f1 from o)"""


@query("F08_precision_recall_f1", _PRF + " select * from f")
def f08(d):
    return M.precision_recall_f1(pred(d), "expected_gloss", "prediction_for_metrics")


@query("F09_macro_f1", _PRF + " select count(*) as class_count, round(avg(f1), 9) as macro_f1 from f")
def f09(d):
    return M.macro_f1(pred(d), "expected_gloss", "prediction_for_metrics").withColumn("macro_f1", F.round("macro_f1", 9))


_SIGNER = """select sample_id, gloss, signer_id, case ordinal % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split from v_meta"""


@query("F10_phase_gate", _PRF + f""", w as (select count(*) as class_count, cast(sum(support) as bigint) as sample_count, round(sum(tp) / sum(support), 3) as accuracy, round(avg(f1), 3) as macro_f1,
    coalesce(string_agg(label, ',' order by label) filter (where round(f1, 3) < 0.65), '') as weak_classes, count(*) filter (where round(f1, 3) < 0.65) as nw, coalesce(string_agg(label, ', ' order by label) filter (where round(f1, 3) < 0.65), '') as weak_text from f),
  k as (select count(*) > 0 as has_signer_leakage from (select signer_id from ({_SIGNER}) group by signer_id having count(distinct split) > 1)),
  b as (select *, array_to_string(list_filter([case when macro_f1 < 0.75 then printf('macro_f1 %.3f is below Phase 2B threshold 0.750', macro_f1) end,
    case when nw > 0 then printf('%d weak classes below F1 0.65: %s', nw, weak_text) end, case when has_signer_leakage then 'signer leakage detected across train/val/test splits' end], lambda x: x is not null), ' | ') as blockers from w, k)
  select sample_count, class_count, accuracy, macro_f1, weak_classes, has_signer_leakage, blockers, case when blockers <> '' then 'adjust_strategy' else 'proceed_to_phase2b' end as decision from b""")
def f10(d):
    return G.phase_gate(pred(d), "expected_gloss", "prediction_for_metrics", d.sql(_SIGNER), "signer_id")


@query("F11_readiness_gate", f"""with {R}, {RB}, x as (select 'o' as run, expected_gloss as t, pm as p from rb union all select 'i', expected_gloss, pm from r),
  o as (select run, label, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from (select run, t as label, cast(t = p as int) as tp, 0 as fp, cast(t <> p as int) as fn from x union all select run, p, 0, 1, 0 from x where t <> p) group by run, label),
  m as (select run, round(avg(2 * tp / (2 * tp + fp + fn)), 3) as macro, cast(sum(tp + fn) as bigint) as n from o group by run),
  l as (select latency, row_number() over (order by latency) - 1 as i, count(*) over () as n from (select value * 3 as latency from {{events}})),
  p as (select round(max(latency), 3) as p95_ms from l where i = cast(round_even(0.95 * (n - 1), 0) as bigint)),
  b as (select mo.macro as official_macro_f1, mo.n as official_samples, mi.macro as iteration_macro_f1, mi.n as iteration_samples, p95_ms, cast(0.9 as double) as stability,
    array_to_string(list_filter([case when mo.macro < 0.7 then printf('official signer-independent macro_f1 %.3f is below required 0.700', mo.macro) end,
    case when p95_ms > 200 then printf('p95 latency %.1fms exceeds allowed 200.0ms', p95_ms) end, 'stability 0.900 is below required 0.950'], lambda x: x is not null), ' | ') as blockers
    from m mo, m mi, p where mo.run = 'o' and mi.run = 'i')
  select *, 'no_go' as decision from b""")
def f11(d):
    lat = d.table("events").select((F.col("value") * 3).alias("latency"))
    return G.readiness_gate(pred(d, "v_pred_b"), pred(d), "expected_gloss", "prediction_for_metrics", lat, "latency", 9, 10, max_p95=200.0)


@query("F12_nearest_rank_p95", """with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from {events})
  select event_type, n, max(value) filter (where i = greatest(0, cast(round_even(cast(0.95 as double) * (n - 1), 0) as bigint))) as readiness_p95, max(value) filter (where i = greatest(0, cast(floor(cast(0.95 as double) * n) as bigint) - 1)) as telemetry_p95 from s group by event_type, n""")
def f12(d):
    e = d.table("events").select("event_type", "value")
    a = nearest_rank(e, "value", readiness_index, ["event_type"]).withColumnRenamed("value_at", "readiness_p95")
    b = nearest_rank(e, "value", telemetry_index, ["event_type"]).select("event_type", F.col("value_at").alias("telemetry_p95"))
    return a.join(b, "event_type")


_SLO = """with s as (select latency_ms, outcome, row_number() over (order by latency_ms) - 1 as i, count(*) over () as n from (select outcome, coalesce(latency_ms, 0) as latency_ms from v_tele) t)
  select max(n) as count, count(*) filter (where outcome = 'success') as success_count, count(*) filter (where outcome = 'success') / count(*) as success_rate,
  max(latency_ms) filter (where i = greatest(0, cast(floor(cast(0.95 as double) * n) as bigint) - 1)) as latency_p95_ms from s"""


@query("F13_telemetry_slo", _SLO)
def f13(d):
    return M.telemetry_slo(d.view("v_tele"))


# The whole alignment: a row of cells (cost, substitutions, boundary error, boundaries) per expected word, each cell from
# the one above, the one before and the one between, in that order of preference.
_CELLS = f"""with recursive {WORDS_SQL}, st as (select index, w, p, [k - 1 for k in range(1, len(w) + 1) if k % 7 <> 0] as pos from v_words1),
  full_dp(index, i, w, p, pos, r) as (select index, cast(0 as bigint), w, p, pos, [[cast(j as bigint), 0, 0, 0] for j in range(len(p) + 1)] from st union all
    select index, i + 1, w, p, pos, list_reduce(range(1, len(p) + 1), lambda acc, j: acc || [
      case when r[j][1] + (case when w[i + 1] = p[j] then 0 else 1 end) < least(r[j + 1][1], acc[j][1]) + 1 then
        case when w[i + 1] = p[j] then [r[j][1], r[j][2], r[j][3] + case when (pos[j] + 1) % 13 = 0 then 0 else abs(i * 400 - (pos[j] * 400 + (pos[j] + 1) % 5 * 10)) + abs(i * 400 + 360 - (pos[j] * 400 + 360 + (pos[j] + 1) % 3 * 7)) end,
          r[j][4] + case when (pos[j] + 1) % 13 = 0 then 0 else 2 end] else [r[j][1] + 1, r[j][2] + 1, r[j][3], r[j][4]] end
      when r[j + 1][1] <= acc[j][1] then [r[j + 1][1] + 1, r[j + 1][2], r[j + 1][3], r[j + 1][4]] else [acc[j][1] + 1, acc[j][2], acc[j][3], acc[j][4]] end], [[i + 1, 0, 0, 0]])
    from full_dp where i < len(w)),
  c as (select index, len(w) as m, len(p) as n, w = p as exact, r[-1] as z from full_dp where i = len(w)),
  al as (select index, m, exact, z[2] as substitutions, (z[1] - z[2] - (m - n)) // 2 as insertions, (z[1] - z[2] - (m - n)) // 2 + m - n as deletions, z[3] as boundary_error_ms, z[4] as boundary_count from c)"""


@query("F14_word_alignment", _CELLS + " select index, substitutions, insertions, deletions, m - substitutions - deletions as matched, boundary_error_ms, boundary_count from al")
def f14(d):
    from clipmill.functions.align import word_alignment

    return d.words().select("index", word_alignment(F.col("expected_words"), F.col("predicted_words")).alias("a")).select("index", "a.*")


# Word-by-word edit table, one row of it per step: new[j] = j + min over k <= j of (candidate[k] - k).
_EDITS = f"""with recursive {WORDS_SQL}, dp(index, i, w, p, row) as (select index, 0, w, p, range(len(p) + 1) from v_words1 union all
    select index, i + 1, w, p, [j + list_min(list_slice(u, 1, j + 1)) for j in range(len(u))] from
      (select index, i, w, p, [case when k = 0 then i + 1 else least(row[k + 1] + 1, row[k] + case when w[i + 1] = p[k] then 0 else 1 end) - k end for k in range(len(row))] as u from dp where i < len(w))),
  edits as (select index, len(w) as m, len(p) as n, w = p as exact, row[-1] as edits from dp where i = len(w))"""


def scored(d):
    return X.wer_rows(d.words()).withColumn("edits", F.col("substitutions") + F.col("insertions") + F.col("deletions"))


@query("F14_edit_total", _EDITS + " select index, cast(edits as bigint) as edits, m as matched_side, n as heard_side from edits")
def f14e(d):
    s, ok = F.col("substitutions"), F.col("matched_word_count")
    return scored(d).select("index", "edits", (ok + s + F.col("deletions")).alias("matched_side"), (ok + s + F.col("insertions")).alias("heard_side"))


@query("F16_word_error_rate", _EDITS + " select count(*) as sample_count, cast(sum(m) as bigint) as total_expected_words, sum(edits) / sum(m) as word_error_rate, count(*) filter (where exact) / count(*) as exact_sequence_accuracy from edits")
def f16e(d):
    return X.wer_metrics(X.wer_rows(d.words())).select("sample_count", "total_expected_words", "word_error_rate", "exact_sequence_accuracy")


@query("F15_wer_rows", f"with {WORDS_SQL} select index, len(w) as expected_word_count, len(p) as predicted_word_count, array_to_string(w, ' ') as expected_text, array_to_string(p, ' ') as predicted_text, w = p as exact_match, true as edits_consistent from v_words1")
def f15(d):
    r = X.wer_rows(d.words())
    m, n = F.col("expected_word_count"), F.col("predicted_word_count")
    s, i, de, ok = (F.col(c) for c in ("substitutions", "insertions", "deletions", "matched_word_count"))
    consistent = (ok + s + de == m) & (ok + s + i == n) & ((s + i + de == 0) == F.col("exact_match"))
    return r.select("index", "expected_word_count", "predicted_word_count", "expected_text", "predicted_text", "exact_match", consistent.alias("edits_consistent"))


_LISTS = '''select event_id as index, concat('s', cast(event_id as string)) as sample_id, case event_id % 9 when 0 then '[]' when 1 then '["a","!!"]' when 2 then '[{{"word":"a","start_ms":"1"}}]' when 3 then '"a"' when 4 then '[{{"word":7}}]' else concat('["', event_type, '",{{"word":"Hi!","start_ms":1,"end_ms":5}}]') end as expected,
  case when event_id % 9 = 8 then '[{{"word":"x","end_ms":1.5}}]' else concat('[{{"word":"', event_type, '"}},"hi"]') end as predicted from {events}'''


@query("F15_transcript_checks", f"with l as ({_LISTS}) select case index % 9 when 0 then 'expected_words_empty_list' when 1 then 'expected_words_empty_word' when 2 then 'expected_words_invalid_timestamp' when 3 then 'expected_words_empty_list' when 4 then 'expected_words_empty_word' when 8 then 'predicted_words_invalid_timestamp' else 'ok' end as outcome, sample_id as key, case when index % 9 in (5, 6, 7) then true end as exact from l")
def f15c(d):
    lists = d.sql(_LISTS).withColumn("e", F.try_parse_json("expected")).withColumn("p", F.try_parse_json("predicted"))
    rows, bad = X.scored_transcripts(lists, "e", "p")
    return rows.select(F.lit("ok").alias("outcome"), F.col("sample_id").alias("key"), F.col("exact_match").alias("exact")).unionByName(
        bad.select(F.col("rule").alias("outcome"), "key", F.lit(None).cast("boolean").alias("exact")))


@query("F16_wer_metrics", _CELLS + """ select count(*) as sample_count, count(*) filter (where exact) / count(*) as exact_sequence_accuracy, sum(substitutions + insertions + deletions) / sum(m) as word_error_rate, cast(sum(substitutions) as bigint) as substitutions,
  cast(sum(insertions) as bigint) as insertions, cast(sum(deletions) as bigint) as deletions, cast(sum(m) as bigint) as total_expected_words, sum(m - substitutions - deletions) / sum(m) as matched_word_recall,
  sum(boundary_error_ms) / sum(boundary_count) as timestamp_boundary_mae_ms, cast(sum(boundary_count) as bigint) as timestamp_boundary_count from al""")
def f16(d):
    return X.wer_metrics(X.wer_rows(d.words()))


_GATE_SQL = f"""n as (select index, sample_id, expected_gloss, {NORM('first_raw')} as f, {NORM('retry_raw')} as g from v_retry),
  a as (select index, sample_id, expected_gloss, case when coalesce(x.canonical, f) in (select label from v_labels) then coalesce(x.canonical, f) end as fl, case when coalesce(y.canonical, g) in (select label from v_labels) then coalesce(y.canonical, g) end as rl
    from n left join v_alias_table x on f = x.alias left join v_alias_table y on g = y.alias),
  q as (select index, sample_id, expected_gloss as expected, fl as "first", coalesce(fl, rl) as final from a)"""


def _gate_rows(d):
    log = P.retry_resolution(d.view("v_retry"), d.view("v_alias"), d.labels)
    return G.anchor_outcomes(G.anchor_rows(log, d.view("v_alias"), d.labels))


def _anchors(d):
    return d.label_df.select("ord", F.col("label").alias("gloss"))


@query("F17_anchor_table", f"""with {_GATE_SQL}, t as (select l.ord, l.label as gloss, count(q.index) as support, count(*) filter (where "first" = expected) / count(q.index) as first_accuracy, count(*) filter (where final = expected) / count(q.index) as final_accuracy
  from v_labels l left join q on q.expected = l.label group by 1, 2) select *, first_accuracy >= 0.7 as first_pass, final_accuracy >= 0.7 as final_pass from t""")
def f17t(d):
    return G.anchor_table(_gate_rows(d), _anchors(d))


@query("F17_anchor_violations", "select 'anchor_count' as rule, 'anchors' as key, cast(count(*) as string) as detail from v_labels having count(*) <> 10 union all select 'expected_not_in_allowlist', sample_id, expected_gloss from v_retry where expected_gloss not in (select label from v_labels where ord < 3)")
def f17v(d):
    few = d.labels[:3]
    log = P.retry_resolution(d.view("v_retry"), d.view("v_alias"), few)
    return G.anchor_violations(_anchors(d), G.anchor_rows(log, d.view("v_alias"), few))


@query("F17_anchor_gate", f"""with {_GATE_SQL}, t as (select l.ord, l.label as gloss, count(q.index) as support, count(*) filter (where "first" = expected) / count(q.index) as fa, count(*) filter (where final = expected) / count(q.index) as la from v_labels l left join q on q.expected = l.label group by 1, 2),
  m as (select p, label, n, row_number() over (partition by p order by n desc, label desc) as rk from (select 'f' as p, "first" as label, count(*) as n from q where "first" is not null group by 2 union all select 'l', final, count(*) from q where final is not null group by 2)),
  s as (select (select label from m where p = 'f' and rk = 1) as first_mode_gloss, (select n from m where p = 'f' and rk = 1) / count(*) as first_mode_ratio, (select label from m where p = 'l' and rk = 1) as final_mode_gloss, (select n from m where p = 'l' and rk = 1) / count(*) as final_mode_ratio,
    count(*) filter (where "first" is null and final = expected) as retry_helped_rows from q),
  c as (select count(*) as anchor_count, string_agg(gloss, ', ' order by ord) filter (where support < 3 or support > 5) as rng, string_agg(gloss, ', ' order by ord) filter (where not fa >= 0.7) as flow, string_agg(gloss, ', ' order by ord) filter (where not la >= 0.7) as llow from t),
  z as (select *, array_to_string(list_filter(['anchor_support_out_of_range: ' || rng, 'per_anchor_below_threshold: ' || flow, case when first_mode_ratio > 0.2 then 'collapse' end], lambda x: x is not null), ' | ') as fr,
    array_to_string(list_filter(['anchor_support_out_of_range: ' || rng, 'per_anchor_below_threshold: ' || llow, case when final_mode_ratio > 0.2 then 'collapse' end], lambda x: x is not null), ' | ') as lr from s, c)
  select anchor_count, fr = '' as first_pass, fr as first_reasons, first_mode_gloss, first_mode_ratio, lr = '' as final_pass, lr as final_reasons, final_mode_gloss, final_mode_ratio, retry_helped_rows, (fr = '') <> (lr = '') as decision_changed from z""")
def f17(d):
    g = G.anchor_gate(_gate_rows(d), _anchors(d), max_share=0.2)
    short = lambda c: F.regexp_replace(c, "collapse_detected: .*$", "collapse")
    return g.withColumn("first_reasons", short("first_reasons")).withColumn("final_reasons", short("final_reasons"))


_B = "select * from (select event_id as index, concat('s', cast(case when event_id % 1000 = 777 then event_id + 1 else event_id end as string)) as sample_id, case when event_id % 500 = 499 then 'other' else event_type end as expected_gloss from {events}) t where index % 2500 <> 2400"


@query("F18_run_identity", f"""with b as ({_B}), j as (select coalesce(a.index, b.index) as index, a.sample_id as ai, a.expected_gloss as ae, b.sample_id as bi, b.expected_gloss as be from v_pred a full outer join b on a.index = b.index),
  m as (select * from j where ai is distinct from bi or ae is distinct from be order by index limit 1)
  select not exists (select 1 from m) as matches_baseline, (select bool_and(ai is not distinct from bi) from j) as sample_id_order_matches, (select bool_and(ae is not distinct from be) from j) as expected_order_matches,
  (select count(ai) from j) as baseline_sample_count, (select count(bi) from j) as candidate_sample_count, m.index as mismatch_index, m.ai as mismatch_baseline_id, m.ae as mismatch_baseline_expected, m.bi as mismatch_candidate_id, m.be as mismatch_candidate_expected from m""")
def f18(d):
    return G.run_identity(d.view("v_pred"), d.sql(_B))


_F = f"f as (select count(*) as n, count(*) filter (where correct) / count(*) as acc, count(*) filter (where not valid) / count(*) as inv from r)"
_C = "k as (select count(*) filter (where ok) / count(*) as acc from best)"


def _free_constrained(d):
    n = len(d.labels)
    return M.strict_metrics(pred(d), n), M.constrained_metrics(ranked(d), n)


@query("F19_constrained_comparison", f"with {R}, {_SCORES}, {_F}, {_C} select f.acc as free_accuracy, f.inv as free_invalid_rate, k.acc as constrained_accuracy, k.acc - f.acc as accuracy_delta, 0.0::double - f.inv as invalid_rate_delta from f, k")
def f19(d):
    return G.constrained_comparison(*_free_constrained(d))


@query("F20_activation", f"with {R}, {_SCORES}, {_F}, {_C} select f.inv > 0 and k.acc > f.acc as active, case when f.inv > 0 and k.acc > f.acc then 'invalid_outputs_with_constrained_gain' else 'no_invalid_outputs_with_constrained_gain' end as reason, f.acc as free_accuracy, f.inv as free_invalid_rate, k.acc as constrained_accuracy from f, k")
def f20(d):
    return G.activation(G.constrained_comparison(*_free_constrained(d)))


@query("F21_run_comparison", f"""with {R}, {RB}, {_SCORES}, {_F}, {_C}, g as (select count(*) as n, count(*) filter (where correct) / count(*) as acc, count(*) filter (where not valid) / count(*) as inv from rb),
  i as (select count(*) = 0 as same from r full outer join rb using (index) where r.sample_id is distinct from rb.sample_id or r.expected_gloss is distinct from rb.expected_gloss)
  select g.acc - f.acc as accuracy_delta, g.inv - f.inv as invalid_rate_delta, g.acc - k.acc as constrained_accuracy_delta, g.n = f.n as sample_count_matches, i.same as sample_identity_matches,
  g.n = f.n and i.same and g.inv < f.inv and g.acc >= f.acc as enough_before_retraining,
  case when g.n <> f.n then 'needs_full_run' when not i.same then 'not_comparable' when g.inv < f.inv and g.acc >= f.acc then 'enough' else 'not_enough' end as recommendation from f, g, k, i""")
def f21(d):
    n = len(d.labels)
    free, con = _free_constrained(d)
    same = G.run_identity(d.view("v_pred"), d.view("v_pred_b"))
    return G.run_comparison(free, M.strict_metrics(pred(d, "v_pred_b"), n), same, con)


_MS_SQL = """x as (select model, split, label, pm, row_number() over (partition by model, split order by index) as rn from (select 'base' as model, index, expected_gloss as label, pm, concat('part', cast(index % 4 as string)) as split from r union all select 'cand', index, expected_gloss, pm, concat('part', cast(index % 4 as string)) from rb)),
  ms as (select model, split, count(*) as samples, count(*) filter (where pm = label) as correct, count(*) filter (where pm = '__invalid__') as invalid, count(*) filter (where pm = label) / count(*) as accuracy, count(*) filter (where pm = '__invalid__') / count(*) as invalid_rate from x where {cap} group by 1, 2)"""
_MS_ALL, _MS_CAP = _MS_SQL.replace("{cap}", "true"), _MS_SQL.replace("{cap}", "rn <= 200")
_MD_SQL = "select b.split, b.accuracy as baseline_accuracy, c.accuracy as candidate_accuracy, c.accuracy - b.accuracy as accuracy_delta, c.correct - b.correct as correct_delta, c.invalid_rate - b.invalid_rate as invalid_rate_delta from ms b join ms c on b.split = c.split where b.model = 'base' and c.model = 'cand'"


def _matrix(d, cap=None):
    side = lambda v, m: pred(d, v).select(
        F.lit(m).alias("model"), F.concat(F.lit("part"), (F.col("index") % 4).cast("string")).alias("split"),
        F.col("index").alias("ordinal"), F.col("expected_gloss").alias("label"), F.col("prediction_for_metrics").alias("prediction"))
    return G.model_split_matrix(side("v_pred", "base").unionByName(side("v_pred_b", "cand")), cap)


@query("F22_model_split_matrix", f"with {R}, {RB}, {_MS_ALL} select * from ms")
def f22(d):
    return _matrix(d)


@query("F22_matrix_delta", f"with {R}, {RB}, {_MS_ALL} {_MD_SQL}")
def f22d(d):
    return G.matrix_delta(_matrix(d), "base", "cand")


@query("F22_model_split_matrix_cap", f"with {R}, {RB}, {_MS_CAP} select * from ms")
def f22c(d):
    return _matrix(d, 200)


_BATCH = "select event_id as index, case when event_id % 5 = 0 then null when event_id % 5 = 1 then '' else event_type end as expected_label, case event_id % 6 when 0 then 'error' when 1 then 'uncertain' else 'ok' end as status, case when event_id % 5 > 1 and event_id % 6 > 0 then event_id % 3 = 0 end as correct from {events}"


@query("F23_batch_summary", f"with b as ({_BATCH}) select count(*) as total, count(*) filter (where expected_label <> '') as labeled, count(*) filter (where status = 'ok') as ok, count(*) filter (where correct) as correct, count(*) filter (where expected_label <> '' and not correct) as incorrect, count(*) filter (where status = 'uncertain') as uncertain, count(*) filter (where status = 'error') as failed, count(*) filter (where correct) / count(*) filter (where expected_label <> '') as accuracy_on_labeled from b")
def f23(d):
    return G.batch_summary(d.sql(_BATCH))


@query("F24_rescue_regression", f"with {R}, {_SCORES} select case when r.correct and ok then 'both_right' when r.correct then 'regressed' when ok then 'rescued' else 'both_wrong' end as outcome, count(*) as n from (select sample_id, coalesce(correct, false) as correct from r) r join best using (sample_id) group by 1")
def f24(d):
    return G.rescue_regression(pred(d), ranked(d))


@query("F25_decision_band", "select user_id, n, ok, case when ok / n >= 0.8 then 'strong_go' when ok / n >= 0.7 then 'go' when ok / n >= 0.4 then 'yellow' else 'no_go' end as band from (select user_id, count(*) as n, count(*) filter (where value < 60) as ok from {events} group by user_id)")
def f25(d):
    a = d.table("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 60).alias("ok"))
    return a.withColumn("band", G.decision_band(F.col("ok") / F.col("n")))


_LOG = "select user_id % 20 as run, event_id as step, case when event_type <> 'view' then value end as loss, case when event_type in ('view', 'click') then value / 2 end as eval_loss from {events}"


@query("F26_log_series", f"with l as ({_LOG}) select run, case when loss is not null then 'train' else 'eval' end as kind, step, coalesce(loss, eval_loss) as value from l where loss is not null or eval_loss is not null")
def f26s(d):
    return G.log_series(d.sql(_LOG))


@query("F26_latest_checkpoint", "select user_id % 20 as run, max(event_id) as checkpoint, concat('out/checkpoint-', cast(max(event_id) as string), '/state.json') as path from {events} where event_type <> 'error' group by 1")
def f26c(d):
    c = d.sql("select user_id % 20 as run, case when event_type = 'error' then 'out/other.json' else concat('out/checkpoint-', cast(event_id as string), '/state.json') end as path from {events}")
    return G.latest_checkpoint(c)


_EPOCH = "select user_id % 20 as run, cast(dayofmonth(ts) as bigint) as epoch, max(value) as loss from {events} where event_type {cond} group by 1, 2"


@query("F26_loss_curve", f"""with t as ({_EPOCH.replace('{cond}', "in ('view', 'click')")}), v as ({_EPOCH.replace('{cond}', "= 'error'")})
  select coalesce(t.run, v.run) as run, coalesce(t.epoch, v.epoch) as epoch, t.loss as train_loss, v.loss as val_loss from t full outer join v on t.run = v.run and t.epoch = v.epoch""")
def f26l(d):
    part = lambda cond: d.sql(_EPOCH.replace("{cond}", cond))
    return G.loss_curve(part("in ('view', 'click')"), part("= 'error'"))


_METRIC = "select user_id as run, cast(dayofmonth(ts) as bigint) as epoch, max(value) as value from {events} group by 1, 2"


@query("F26_best_epoch", f"""with recursive m as ({_METRIC}), o as (select *, row_number() over (partition by run order by epoch) as rn from m),
  w(run, rn, epoch, best, best_epoch, bad) as (select run, rn, epoch, value, epoch, 0 from o where rn = 1 union all
    select o.run, o.rn, o.epoch, case when o.value > w.best + 5 then o.value else w.best end, case when o.value > w.best + 5 then o.epoch else w.best_epoch end, case when o.value > w.best + 5 then 0 else w.bad + 1 end
    from w join o on o.run = w.run and o.rn = w.rn + 1 where w.bad < 3)
  select run, best as best_metric, best_epoch, epoch as last_epoch, bad >= 3 as stopped_early from (select *, row_number() over (partition by run order by rn desc) as k from w) where k = 1""")
def f26b(d):
    return G.best_epoch(d.sql(_METRIC), 5.0, 3)
