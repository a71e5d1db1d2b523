"""Views that give the driver tables the shapes of the toolkit.

``VIEWS`` texts run in Spark and in the SQL oracle alike, so both sides start from the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmill.functions.text import normalize_word
from clipmill.operators.labels import label_list

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


_N = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9_ -]+', '', 'g'), ' +', ' ', 'g'))"
NORM = lambda c: _N.replace("{c}", c)


def _pred(cases: str) -> str:
    return f"""select event_id as index, concat('s', cast(event_id as string)) as sample_id,
      event_type as expected_gloss, case {cases} else event_type end as raw_model_output from {{events}}"""


VIEWS = {
    "v_labels": """select cast(row_number() over (order by first_id) - 1 as bigint) as ord, label from
      (select event_type as label, min(event_id) as first_id from {events} group by event_type) t""",
    "v_pred": _pred("""when event_id % 10 = 0 then concat(upper(event_type), '!')
      when event_id % 10 = 1 then 'thank' when event_id % 10 = 2 then concat(event_type, ', extra')
      when event_id % 10 = 3 then '' when event_id % 10 = 4 then 'click'
      when event_id % 10 = 5 then concat('`', event_type, '`', chr(10), 'extra text')"""),
    "v_pred_b": _pred("""when event_id % 9 = 0 then 'view' when event_id % 9 = 1 then ' : '
      when event_id % 9 = 2 then concat('  ', upper(event_type), ' ')"""),
    # repeats, unnormalised and blank rows on purpose
    "v_alias": """select * from (values (1, 'thank', 'view'), (2, 'Buy!', 'Purchase'), (3, 'look', 'view'), (4, 'see', 'look'), (5, 'sign-up', 'signup'),
      (6, 'view', 'view'), (7, ' THANK', 'purchase'), (8, 'buy', 'purchase '), (9, '!', 'view'), (10, 'see', '')) as t(ord, alias, canonical)""",
    "v_alias_table": """select alias, max_by(canonical, ord) as canonical from (select ord, """ + NORM("alias") + """ as alias, """ + NORM("canonical") + """ as canonical
      from v_alias) n where alias <> '' and canonical <> '' group by alias""",
    "v_retry": """select event_id as index, concat('s', cast(event_id as string)) as sample_id, event_type as expected_gloss,
      case when event_id % 6 = 0 then 'buy' when event_id % 6 = 1 then 'see' when event_id % 6 = 2 then ''
        when event_id % 6 = 3 then 'Sign-Up' else event_type end as first_raw,
      case when event_id % 4 = 0 then 'nothing' when event_id % 4 = 1 then 'Look!' else concat('`', upper(event_type), '`') end as retry_raw
      from {events}""",
    "v_meta": """select cast(o_orderkey as string) as sample_id, o_orderkey as ordinal, o_orderpriority as gloss,
      o_custkey as signer_id, o_orderstatus as status from {orders}""",
    "v_docs": """select d.doc_id, cast(l.quality as string) as truth, cast(l.toxic as string) as pred, d.source as source, d.lang as label
      from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    "v_feat": """select cast(floor(vec_id / 50) as bigint) as clip_id, cast(vec_id % 50 as bigint) as frame_idx,
      cast(label as string) as gloss, embedding as f from {embeddings}""",
    "v_turns": """select conv_id as clip_id, turn as frame_idx, cast(length(text) as double) as size, cast(turn * 33 as bigint) as ts_ms from {conversations}""",
    "v_tele": """select concat('r', cast(event_id as string)) as request_id, case when event_id % 15 = 0 then null else cast(floor(value) as bigint) end as latency_ms,
      case when event_type = 'error' then 'timeout' else 'success' end as outcome,
      cast(value / 500 as double) as confidence, 'm1' as model_tag from {events}""",
    "v_provider": """select event_id as index, concat('r', cast(event_id as string)) as request_id, concat('{{',
      case when event_id % 7 = 0 then '' when event_id % 7 = 1 then '"request_id":"other",' else concat('"request_id":"r', cast(event_id as string), '",') end,
      case when event_id % 11 = 0 then '' when event_id % 11 = 1 then '"runtime_mode":" ",' else '"runtime_mode":"cloud",' end,
      case when event_id % 5 = 0 then '"cloud_handoff":"true",' else '"cloud_handoff":true,' end,
      case when event_id % 13 = 0 then '' else '"model_id":"m",' end, '"model_version":"1"',
      case when event_id % 8 = 0 then concat(',"prediction":"', event_type, '","confidence":0.9,"alternatives":["x",2]')
        when event_id % 8 = 1 then concat(',"translation":"', event_type, '","confidence":0.77,"low_confidence":"Yes"')
        when event_id % 8 = 2 then concat(',"output":{{"translation":"', event_type, '","confidence":0.5,"alternatives":["y"],"sequence_confidence":0.25}}')
        when event_id % 8 = 3 then ',"transcript_words":[{{"word":"aa","start_ms":1,"end_ms":5,"confidence":0.4}},{{"word":"bb","start":6,"end":9}}],"confidence":0'
        when event_id % 8 = 4 then ',"prediction":"","words":[{{"word":"cc"}},{{"nope":1}},7],"confidence":0.3,"low_confidence":1'
        when event_id % 8 = 5 then ',"confidence":0.3,"prediction":null,"transcript_words":[]'
        when event_id % 8 = 6 then ',"prediction":"p","confidence":null'
        else ',"prediction":"p","confidence":0.2,"transcript_words":[{{"word":"q","start_ms":"bad"}}]' end, '}}') as payload from {events}""",
    "v_probe": """select event_id as index, concat('{{"format":{{', case when event_id % 3 = 0 then '' else concat('"duration":"', cast(event_id % 14 as string), '.5"') end,
      '}},"streams":[', case when event_id % 4 = 0 then '{{"codec_type":"audio"}},' else '' end,
      case when event_id % 17 = 0 then '{{"codec_type":"data"}}' else concat('{{"codec_type":"video","avg_frame_rate":"',
        case when event_id % 5 = 0 then '30000/1001' when event_id % 5 = 1 then '30/1' when event_id % 5 = 2 then '0/0' else '25' end, '","width":',
        case when event_id % 6 = 0 then '640' when event_id % 19 = 0 then '0' else '1280' end, ',"height":720,"codec_name":"',
        case when event_id % 7 = 0 then 'HEVC' else 'H264' end, '","pix_fmt":"yuv420p"',
        case when event_id % 2 = 0 then ',"duration":"3.25"' else '' end, '}}') end, ']}}') as payload from {events}""",
}
_NAME = re.compile(r"\bv_[a-z_]+\b")


def _needed(text: str, found: dict[str, str]) -> None:
    for name in _NAME.findall(text):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found[name] = VIEWS[name]


def with_views(text: str) -> str:
    """Prefix ``text`` with the views it names (as CTEs)."""
    found: dict[str, str] = {}
    _needed(text, found)
    if not found:
        return text
    ctes = ",\n".join(f"{n} as ({v})" for n, v in found.items())
    if re.match(r"\s*with\s+recursive\s", text, re.I):
        return re.sub(r"^\s*with\s+recursive\s", lambda m: f"with recursive {ctes},\n", text, flags=re.I)
    if re.match(r"\s*with\s", text, re.I):
        return re.sub(r"^\s*with\s", lambda m: f"with {ctes},\n", text, flags=re.I)
    return f"with {ctes}\n{text}"


def sql_text(oracle: str) -> str:
    """Oracle text: views as CTEs, table marks as plain table names."""
    return _fill(with_views(oracle), {t: t for t in TABLES})


def _fill(text: str, names: dict[str, str]) -> str:
    for t, name in names.items():
        text = text.replace("{" + t + "}", name)
    return text.replace("{{", "{").replace("}}", "}")


class Data:
    """Tables and views of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        names = {t: f"parquet.`{self.sf_dir}/{t}.parquet`" for t in TABLES}
        return self.spark.sql(_fill(with_views(text), names))

    def view(self, name: str) -> DataFrame:
        return self.sql(f"select * from {name}")

    @cached_property
    def label_df(self) -> DataFrame:
        return self.view("v_labels")

    @cached_property
    def labels(self) -> list[str]:
        """The contract: distinct event types in order of first appearance (size-checked)."""
        return label_list(self.label_df)

    def scores(self) -> DataFrame:
        """(sample_id, label, score): every event with every label, scores with ties."""
        names = F.array(*[F.lit(x) for x in self.labels])
        e = self.table("events").select("event_id").select("event_id", F.explode(names).alias("label"))
        h = F.conv(F.left(F.md5(F.concat_ws("|", F.col("event_id").cast("string"), "label")), F.lit(4)), 16, 10).cast("bigint")
        return e.select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("sample_id"), "label", (h % 7).cast("double").alias("score"))

    def components(self) -> DataFrame:
        """64 features as 8 body, 4 left-hand and 4 right-hand joints of 4 channels."""
        v = self.view("v_feat")
        part = lambda lo, n: F.transform(F.sequence(F.lit(lo), F.lit(lo + n - 1)), lambda j: F.slice("f", j * 4 + 1, 4))
        return v.select("clip_id", "frame_idx", "gloss", part(0, 8).alias("body"), part(8, 4).alias("left_hand"), part(12, 4).alias("right_hand"))

    def words(self) -> DataFrame:
        """Transcripts: all words of a turn against a copy with every 7th dropped, every 11th replaced."""
        c = self.table("conversations")
        w = F.filter(F.transform(F.split("text", r"\s+"), normalize_word), lambda x: x != "")
        c = c.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("index"),
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sample_id"), w.alias("w"))
        big = lambda x: x.cast("bigint")
        expected = F.transform("w", lambda x, i: F.struct(x.alias("word"), big(i * 400).alias("start_ms"), big(i * 400 + 360).alias("end_ms")))
        heard = F.transform(
            "w", lambda x, i: F.struct(
                F.when((i + 1) % 7 == 0, F.lit("")).when((i + 1) % 11 == 0, F.lit("zz")).otherwise(x).alias("word"),
                big(i * 400 + (i + 1) % 5 * 10).alias("start_ms"),
                F.when((i + 1) % 13 == 0, F.lit(None)).otherwise(big(i * 400 + 360 + (i + 1) % 3 * 7)).alias("end_ms")))
        return c.filter(F.size("w") > 0).select(
            "index", "sample_id", expected.alias("expected_words"), F.filter(heard, lambda x: x["word"] != "").alias("predicted_words"))


# The same transcripts for the SQL oracle: word lists only.
WORDS_SQL = """v_words0 as (select conv_id * 1000 + turn as index, concat(cast(conv_id as string), '-', cast(turn as string)) as sample_id,
  list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: regexp_replace(lower(x), '[^a-z0-9'']+', '', 'g')), lambda x: x <> '') as w from {conversations}),
v_words1 as (select index, sample_id, w,
  [case when i % 11 = 0 then 'zz' else w[i] end for i in range(1, len(w) + 1) if i % 7 <> 0] as p from v_words0 where len(w) > 0)"""
