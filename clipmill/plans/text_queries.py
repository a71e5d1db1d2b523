"""Queries of family B: text rules of the label contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmill.functions import text as T
from clipmill.functions.provider import probe_flatten, profile_conformity
from clipmill.operators import labels as L
from clipmill.plans.registry import query
from clipmill.plans.views import NORM


@query("B01_normalize_gloss", f"select index, {NORM('raw_model_output')} as gloss from v_pred union all select page_id as index, {NORM('url')} as gloss from {{pages}}")
def b01(d):
    a = d.view("v_pred").select("index", T.normalize_gloss(F.col("raw_model_output")).alias("gloss"))
    return a.unionByName(d.table("pages").select(F.col("page_id").alias("index"), T.normalize_gloss(F.col("url")).alias("gloss")))


@query("B02_normalize_gloss_keep_apostrophe", "select conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_ ''-]+', '', 'g'), ' +', ' ', 'g')) as gloss from {conversations}")
def b02(d):
    return d.table("conversations").select("conv_id", "turn", T.normalize_gloss_keep_apostrophe(F.col("text")).alias("gloss"))


@query("B03_normalize_word", "select doc_id, regexp_replace(lower(text), '[^a-z0-9'']+', '', 'g') as word from {documents}")
def b03(d):
    return d.table("documents").select("doc_id", T.normalize_word(F.col("text")).alias("word"))


@query("B04_canonicalize_text", "select doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as canonical from {documents}")
def b04(d):
    return d.table("documents").select("doc_id", T.canonicalize_text(F.col("text")).alias("canonical"))


@query("B05_resolve_output_split", f"""with p as (select index, list_filter(list_transform(regexp_split_to_array(raw_model_output, '[\\n,;:]+'), lambda x: {NORM('x')}), lambda x: x <> '')[1] as label from v_pred)
  select index, label, coalesce(label in (select label from v_labels), false) as valid from p""")
def b05(d):
    return T.resolve_output_split(d.view("v_pred"), "raw_model_output", d.labels).select("index", "label", "valid")


@query("B06_resolve_output_first_line", f"""with p as (select index, {NORM("split_part(raw_model_output, chr(10), 1)")} as label from v_pred)
  select index, case when ok then 'ok' else 'uncertain' end as status, case when ok then label end as prediction
  from (select *, label in (select label from v_labels) as ok from p)""")
def b06(d):
    r = d.view("v_pred").select("index", T.resolve_output_first_line(F.col("raw_model_output"), d.labels).alias("r"))
    return r.select("index", "r.status", "r.prediction")


@query("B07_resolve_output_alias", """with p as (select index, coalesce(list_filter(regexp_split_to_array(first_raw || chr(10) || retry_raw, '\\n'), lambda x: trim(x) <> '')[1], '') as line from v_retry),
  n as (select index, trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9_ ''-]+', '', 'g'), ' +', ' ', 'g')) as g from p),
  c as (select n.index, coalesce(a.canonical, g) as label from n left join v_alias_table a on n.g = a.alias)
  select index, case when ok then 'ok' else 'out_of_allowlist' end as status, case when ok then label end as prediction, nullif(label, '') as candidate,
  case when ok then 'in_allowlist' else 'not_in_allowlist' end as reason from (select *, label in (select label from v_labels) as ok from c)""")
def b07(d):
    raw = F.concat("first_raw", F.lit("\n"), "retry_raw")
    line = T.normalize_gloss_keep_apostrophe(T.first_full_line(raw))
    return L.resolve_output_alias(d.view("v_retry"), line, d.view("v_alias"), d.labels).select("index", "status", "prediction", "candidate", "reason")


_REASON = """case when event_id % 6 = 0 then concat('{{"label": "', upper(event_type), '"}}')
  when event_id % 6 = 1 then concat('I think it is ', event_type, '.') when event_id % 6 = 2 then concat(event_type, ' or click')
  when event_id % 6 = 3 then concat('"', event_type, '!"', chr(10), 'because') when event_id % 6 = 4 then 'clicks viewer' else concat('**', event_type, '**') end"""


@query("B08_resolve_output_reason", f"""with r as (select event_id as index, {_REASON} as raw from {{events}}),
  c as (select index, raw, list_transform(list_filter([raw, split_part(raw, chr(10), 1), case when json_valid(raw) and json_type(raw) = 'OBJECT' then json_extract_string(raw, '$.label') when json_valid(raw) and json_type(raw) = 'VARCHAR' then json_extract_string(raw, '$') end], lambda x: x is not null and trim(x) <> ''),
    lambda x: trim(regexp_replace(lower(regexp_replace(x, '^[ .,:;!?"''`()\\[\\]{{}}]+|[ .,:;!?"''`()\\[\\]{{}}]+$', '', 'g')), '\\s+', ' ', 'g'))) as cands from r),
  n as (select list(label) as names from v_labels),
  x as (select index, names, list_filter(cands, lambda x: list_contains(names, x))[1] as exact, array_to_string(cands, ' || ') as joined from c, n),
  h as (select index, exact, list_filter(names, lambda l: regexp_matches(joined, '(^|[^a-z])' || l || '([^a-z]|$)')) as hits from x)
  select index, case when exact is not null then exact when len(hits) = 1 then hits[1] else '__invalid__' end as label,
  case when exact is not null then 'exact_or_wrapper' when len(hits) = 1 then 'single_mention' when len(hits) > 1 then 'ambiguous' else 'no_match' end as reason from h""")
def b08(d):
    raw = d.sql(f"select event_id as index, {_REASON} as raw from {{events}}")
    return T.resolve_output_reason(raw, "raw", d.labels).select("index", "label", "reason")


@query("B09_alias_canonicalize", f"""with n as (select index, {NORM('first_raw')} as g from v_retry),
  c as (select n.index, g, coalesce(a.canonical, g) as label from n left join v_alias_table a on n.g = a.alias)
  select index, case when g <> '' and label in (select label from v_labels) then label end as label from c""")
def b09(d):
    return L.alias_canonicalize(d.view("v_retry"), F.col("first_raw"), d.view("v_alias"), d.labels, "label").select("index", "label")


@query("B10_flatten_aliases", f"""with m as (select distinct o_orderpriority as canonical, {NORM("concat(o_orderpriority, ' ', o_orderstatus)")} as alias from {{orders}}
  union select distinct o_orderpriority, {NORM('o_orderstatus')} from {{orders}} union select distinct o_orderpriority, {NORM('o_orderpriority')} from {{orders}}),
  p as (select distinct alias, {NORM('canonical')} as canonical from m)
  select alias, canonical, alias in (select alias from p group by alias having count(*) > 1) as collision from p""")
def b10(d):
    o = d.table("orders").groupBy(F.col("o_orderpriority").alias("canonical")).agg(F.collect_set("o_orderstatus").alias("s"))
    both = F.concat("s", F.transform("s", lambda x: F.concat("canonical", F.lit(" "), x)))
    src = o.select("canonical", both.alias("aliases"))
    names = [r[0] for r in o.select(T.normalize_gloss(F.col("canonical"))).collect()]
    pairs, bad = L.flatten_aliases(src, names)
    clash = bad.filter("rule = 'alias_collision'").select(F.col("key").alias("alias"), F.lit(True).alias("collision")).distinct()
    return pairs.join(clash, "alias", "left").select("alias", "canonical", F.coalesce("collision", F.lit(False)).alias("collision"))


@query("B11_filter_to_contract", "select p.index, p.expected_gloss as label, l.ord from v_pred p join v_labels l on p.expected_gloss = l.label where l.ord < 3")
def b11(d):
    return L.filter_to_contract(d.view("v_pred").withColumnRenamed("expected_gloss", "label"), "label", d.label_df.filter("ord < 3")).select("index", "label", "ord")


@query("B12_map_source_labels", """with s as (select index, trim(regexp_replace(lower(concat(' ', upper(first_raw))), '\\s+', ' ', 'g')) as g from v_retry),
  m as (select index, case g when 'buy' then 'purchase' else g end as m from s)
  select index, case m when 'view' then 'look' else m end as mapped from m where m in (select label from v_labels)""")
def b12(d):
    over = d.sql("select * from (values (1, 'buy', 'view'), (2, ' BUY', 'purchase')) as t(ord, source, canonical)")  # the last repeat counts
    subst = d.sql("select 'view' as canonical, 'look' as preferred")
    src = d.view("v_retry").withColumn("src", F.concat(F.lit(" "), F.upper("first_raw")))
    return L.map_source_labels(src, "src", over, subst, d.labels).select("index", "mapped")


@query("B13_split_row_check", """with r as (select *, case status when 'P' then 'Train ' when 'O' then 'val' end as split from v_meta)
  select gloss, count(*) as rows, count(*) filter (where coalesce(trim(lower(split)), 'train') = 'train' and gloss <> '5-LOW') as kept,
  count(*) filter (where coalesce(trim(lower(split)), 'train') <> 'train') as wrong_split from r group by gloss""")
def b13(d):
    m = d.view("v_meta").withColumn("split", F.when(F.col("status") == "P", "Train ").when(F.col("status") == "O", "val")).withColumn("file_split", F.lit("train"))
    names = ["1-urgent", "2-high", "3-medium", "4-not specified"]
    return L.split_row_check(m, "gloss", "split", "file_split", names).groupBy("gloss").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("kept"), F.count_if(~F.col("split_ok")).alias("wrong_split"))


_BLOCK = """concat('note=1', chr(10), case when event_id % 4 = 0 then '' when event_id % 4 = 1 then concat('sample_id=', chr(10)) else concat('sample_id= s', cast(event_id as string), chr(10)) end,
  'encoding=q64_full clip=4 alphabet=x=y', chr(10), case when event_id % 3 = 0 then 'frames=12 features_per_frame=177' when event_id % 3 = 1 then 'frames=12 features=9' else 'frames=' end, chr(10), 'pose_q64=ab|cd')"""


@query("B14_sample_key", f"""with b as (select event_id as index, {_BLOCK} as input from {{events}})
  select index, case when event_id4 = 0 then left(sha256(input), 12) when event_id4 = 1 then '' else concat('s', cast(index as string)) end as sample_key from (select *, index % 4 as event_id4 from b)""")
def b14(d):
    b = d.sql(f"select event_id as index, {_BLOCK} as input from {{events}}")
    return b.select("index", T.sample_key(F.col("input")).alias("sample_key"))


@query("B15_parse_input_block", f"""with b as (select event_id as index, {_BLOCK} as input from {{events}})
  select index, case when index % 4 = 0 then null when index % 4 = 1 then '' else concat('s', cast(index as string)) end as sample_id, 'q64_full clip=4 alphabet=x=y' as encoding,
  index % 3 = 0 as shape_ok, case when index % 3 = 0 then cast(12 as bigint) end as frames, case when index % 3 = 0 then cast(177 as bigint) end as features, 'ab|cd' as pose_q64 from b""")
def b15(d):
    b = d.sql(f"select event_id as index, {_BLOCK} as input from {{events}}")
    return T.parse_input_block(b, "input").select("index", "p.sample_id", "p.encoding", "p.shape_ok", "p.frames", "p.features", "p.pose_q64")


@query("B16_build_prompts", """with l as (select string_agg(label, ', ' order by ord) as comma, string_agg('- ' || label, chr(10) order by ord) as dash from v_labels)
  select index, md5('Identify the ASL sign shown across these frames. Return exactly one gloss label from the approved list.' || chr(10) || 'Approved labels: ' || comma) as frames_prompt,
  md5('instruction' || chr(10) || chr(10) || trim(raw_model_output, ' ')) as record_prompt,
  md5('Classify this compact ASL pose encoding into one WLASL gloss.' || chr(10) || 'You must choose exactly one label from the canonical Top-50 label list below.' || chr(10) || 'Reply with only the chosen label. Do not include punctuation, explanation, formatting, or any label outside this list.' || chr(10) || chr(10) || 'Canonical Top-50 labels:' || chr(10) || dash || chr(10) || chr(10) || sample_id) as list_prompt,
  md5('You are evaluating an ASL pose/frame-derived sample.' || chr(10) || 'Return exactly one canonical gloss from the allowlist below.' || chr(10) || 'Output must be only the gloss token (no explanation/punctuation).' || chr(10) || chr(10) || 'Allowlist:' || chr(10) || dash || chr(10) || chr(10) || 'Sample:' || chr(10) || sample_id) as first_prompt,
  md5('STRICT RETRY (deterministic): your previous output was out-of-vocabulary.' || chr(10) || 'Choose EXACTLY one token from this allowlist and output only that token.' || chr(10) || 'Allowlist tokens: ' || comma || chr(10) || 'Previous output: ''' || replace(raw_model_output, chr(10), '\\n') || '''' || chr(10) || 'Sample: ' || sample_id) as retry_prompt
  from v_pred, l""")
def b16(d):
    names, raw, sid = d.labels, F.col("raw_model_output"), F.col("sample_id")
    p = d.view("v_pred").withColumn("record", F.when(F.col("raw_model_output") == "", F.lit("")).otherwise(raw))
    return p.select(
        "index", F.md5(T.frames_prompt(names)).alias("frames_prompt"),
        F.md5(F.concat(F.lit("instruction\n\n"), F.trim("record"))).alias("record_prompt"),
        F.md5(T.label_list_prompt(sid, names)).alias("list_prompt"), F.md5(T.first_pass_prompt(sid, names)).alias("first_prompt"),
        F.md5(T.retry_prompt(sid, names, raw)).alias("retry_prompt"))


@query("B18_display_translation", f"""select index, case when g <> '' then upper(left(g, 1)) || substr(g, 2) || '.' end as translation from (select index, {NORM('raw_model_output')} as g from v_pred)""")
def b18(d):
    return d.view("v_pred").select("index", T.display_translation(F.col("raw_model_output")).alias("translation"))


@query("B19_redact_filename", """with f as (select event_id as index, concat(event_type, cast(event_id as string), case when event_id % 3 = 0 then '.MP4' when event_id % 3 = 1 then '.tar.Mov' else '' end) as name from {events})
  select index, 'file_' || left(sha256(name), 10) || case index % 3 when 0 then '.mp4' when 1 then '.mov' else '.bin' end as hint from f""")
def b19(d):
    f = d.sql("select event_id as index, concat(event_type, cast(event_id as string), case when event_id % 3 = 0 then '.MP4' when event_id % 3 = 1 then '.tar.Mov' else '' end) as name from {events}")
    return f.select("index", T.redact_filename(F.col("name")).alias("hint"))


_PROBE_SQL = """with s as (select index, payload, list_filter(from_json(json_extract(payload, '$.streams'), '["json"]'), lambda x: json_extract_string(x, '$.codec_type') = 'video')[1] as v,
    list_contains(list_transform(from_json(json_extract(payload, '$.streams'), '["json"]'), lambda x: json_extract_string(x, '$.codec_type')), 'audio') as has_audio from v_probe),
  f as (select index, has_audio, v is null as no_video, cast(coalesce(json_extract_string(payload, '$.format.duration'), json_extract_string(v, '$.duration')) as double) as duration_seconds,
    json_extract_string(v, '$.avg_frame_rate') as rate, cast(json_extract_string(v, '$.width') as bigint) as width, cast(json_extract_string(v, '$.height') as bigint) as height,
    json_extract_string(v, '$.codec_name') as codec from s),
  p as (select *, case when rate not like '%/%' then cast(rate as double) when cast(split_part(rate, '/', 2) as double) = 0 then 0.0
    else cast(split_part(rate, '/', 1) as double) / cast(split_part(rate, '/', 2) as double) end as fps,
    case when no_video then 'video_stream_not_found' when duration_seconds is null then 'video_duration_missing' when width <= 0 then 'video_resolution_invalid' end as error from f)"""


@query("B20_probe_flatten", _PROBE_SQL + " select index, error, case when error is null then duration_seconds end as duration_seconds, case when error is null then fps end as fps, case when error is null then width end as width, case when error is null then height end as height, case when error is null then codec end as codec, has_audio from p")
def b20(d):
    p = probe_flatten(d.view("v_probe"), "payload")
    ok = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return p.select("index", "error", *[ok(c) for c in ("duration_seconds", "fps", "width", "height", "codec")], "has_audio")


@query("B21_profile_conformity", _PROBE_SQL + """ select p.index, p.error, q.* exclude (index) from p left join (select index, width <> 1280 or height <> 720 as size_differs, abs(fps - 30) > 0.01 as fps_differs, lower(codec) not in ('h264', 'avc1') as codec_differs,
  false as pix_fmt_differs, has_audio as audio_present, (width <> 1280 or height <> 720 or abs(fps - 30) > 0.01 or lower(codec) not in ('h264', 'avc1') or has_audio) as needs_normalizing, duration_seconds > 10 as too_long from p where error is null) q on p.index = q.index""")
def b21(d):
    p = probe_flatten(d.view("v_probe"), "payload")
    flags = ("size_differs", "fps_differs", "codec_differs", "pix_fmt_differs", "audio_present", "needs_normalizing", "too_long")
    return profile_conformity(p).select("index", "error", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in flags])


@query("A09_coerce_bool", """with r as (select event_id as index, case event_id % 7 when 0 then ' TRUE ' when 1 then 'false' when 2 then '1' when 3 then 'Yes' when 4 then 'y' when 5 then '' else 'no' end as raw from {events})
  select index, case lower(trim(raw)) when 'true' then true when 'false' then false end as strict, lower(trim(raw)) in ('1', 'true', 'yes') as lenient, lower(trim(raw)) in ('1', 'true', 'yes', 'y') as provider from r""")
def a09(d):
    r = d.sql("select event_id as index, case event_id % 7 when 0 then ' TRUE ' when 1 then 'false' when 2 then '1' when 3 then 'Yes' when 4 then 'y' when 5 then '' else 'no' end as raw from {events}")
    v = F.parse_json(F.concat(F.lit('"'), F.col("raw"), F.lit('"')))
    return r.select("index", T.bool_strict(F.col("raw")).alias("strict"), T.bool_lenient(F.col("raw")).alias("lenient"), T.bool_provider(v).alias("provider"))
