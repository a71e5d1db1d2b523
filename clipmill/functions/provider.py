"""Rules for model-provider JSON and media-probe JSON, on VARIANT and struct columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.constants import MAX_DURATION_SECONDS, PROFILE
from clipmill.functions.text import bool_provider, strip

# Error codes and default texts (fixed values).
BAD_RESPONSE = "INFERENCE_INVALID_RESPONSE"
PROOF_MISSING = "INFERENCE_PROOF_MISSING"
PROOF_INVALID = "INFERENCE_PROOF_INVALID"
FAILURE_CODE, FAILURE_MESSAGE = "CLOUD_HANDOFF_FAILED", "Cloud handoff request failed"
PROOF_FIELDS = ("runtime_mode", "cloud_handoff", "model_id", "model_version")
_PROOF_TEXT_ORDER = ("runtime_mode", "model_id", "model_version")


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _present(v: Column) -> Column:
    """There, and not a JSON null."""
    return F.coalesce(v.isNotNull() & ~F.is_variant_null(v), F.lit(False))


# First letters of the type names a VARIANT value can have.
OBJECT, ARRAY, STRING, BOOLEAN = "OBJ", "ARR", "STR", "BOO"


def _kind(v: Column) -> Column:
    return F.coalesce(F.left(F.schema_of_variant(v), F.lit(3)), F.lit(""))


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _truthy(v: Column) -> Column:
    """False for absent, null, '', 0, false, [] and {}."""
    kind = _kind(v)
    return _present(v) & F.coalesce(
        F.when(kind == STRING, _string(v) != "")
        .when(kind == BOOLEAN, F.try_variant_get(v, "$", "boolean"))
        .when(kind == ARRAY, F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
        .when(kind == OBJECT, F.size(F.try_variant_get(v, "$", "map<string,variant>")) > 0)
        .otherwise(F.try_variant_get(v, "$", "double") != 0),
        F.lit(False),
    )


def _first(test, *values: Column) -> Column:
    return F.coalesce(*[F.when(test(v), v) for v in values])


def _as_int(v: Column) -> Column:
    """Whole number or null when it cannot be one; text must hold digits only."""
    kind = _kind(v)
    text = strip(_string(v))
    return (
        F.when(kind == BOOLEAN, F.try_variant_get(v, "$", "boolean").cast("bigint"))
        .when(kind == STRING, F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")))
        .when(~kind.isin(ARRAY, OBJECT), F.try_variant_get(v, "$", "double").try_cast("bigint"))
    )


def _as_float(v: Column) -> Column:
    kind = _kind(v)
    return F.when(kind == BOOLEAN, F.try_variant_get(v, "$", "boolean").cast("double")).when(
        ~kind.isin(ARRAY, OBJECT), F.when(kind == STRING, strip(_string(v)).try_cast("double")).otherwise(
            F.try_variant_get(v, "$", "double"))
    )


_TOP = ("prediction", "translation", "transcript_words", "words", "confidence", "sequence_confidence", "low_confidence", "alternatives", "output")
_NESTED = ("translation", "transcript_words", "confidence", "sequence_confidence", "low_confidence", "alternatives")
_WORD = "array<struct<word:string,start_ms:bigint,end_ms:bigint,confidence:double>>"


def _word(i: Column) -> Column:
    start = _first(_present, _at(i, "$.start_ms"), _at(i, "$.start"))
    end = _first(_present, _at(i, "$.end_ms"), _at(i, "$.end"))
    conf, zero = _at(i, "$.confidence"), F.lit(0).cast("bigint")
    return F.struct(
        _string(_at(i, "$.word")).alias("word"),
        F.when(start.isNull(), zero).otherwise(_as_int(start)).alias("start_ms"),
        F.when(end.isNull(), zero).otherwise(_as_int(end)).alias("end_ms"),
        F.when(_present(conf), _as_float(conf)).otherwise(F.lit(0.0)).alias("confidence"),
    )


def normalize_provider_response(df: DataFrame, response: str) -> DataFrame:
    """Add ``answer``: struct(error_code, error, prediction, confidence, words, sequence_confidence, low_confidence, alternatives).

    ``error`` is null for a usable response; ``words`` falls back to the prediction at 0-0 ms.
    ``response`` names a VARIANT column. Each field is taken out of it once and each later stage is a
    column, so nothing is looked up twice.
    """
    c = F.col
    d = df.select("*", _kind(c(response)).alias("_kind"), *[_at(c(response), f"$.{f}").alias(f"_{f}") for f in _TOP])
    d = d.select("*", *[F.when(_kind(c("_output")) == OBJECT, _at(c("_output"), f"$.{f}")).alias(f"_o_{f}") for f in _NESTED])
    d = d.withColumn("_raw", _first(_truthy, c("_transcript_words"), c("_o_transcript_words"), c("_words")))
    d = d.withColumn("_items", F.when(_kind(c("_raw")) == ARRAY, F.try_variant_get("_raw", "$", "array<variant>")))
    d = d.withColumn("_said", _first(_truthy, c("_prediction"), c("_translation"), c("_o_translation")))
    d = d.withColumn("_items", F.filter("_items", lambda i: (_kind(i) == OBJECT) & _truthy(_at(i, "$.word"))))
    d = d.withColumn("_list", F.coalesce(F.transform("_items", _word), F.array().cast(_WORD)))
    d = d.withColumn("_conf", _first(_present, c("_confidence"), c("_o_confidence")))
    d = d.withColumn("_seq", _first(_present, c("_sequence_confidence"), c("_o_sequence_confidence"), c("_conf")))
    d = d.withColumn("_low", _first(_present, c("_low_confidence"), c("_o_low_confidence")))
    joined = F.nullif(F.array_join(F.transform("_list", lambda w: w["word"]), " "), F.lit(""))
    d = d.withColumn("_text", F.coalesce(_string(c("_said")), F.to_json("_said"), joined))
    d = d.withColumn("_c", _as_float(c("_conf"))).withColumn("_s", _as_float(c("_seq")))
    broken = F.exists("_list", lambda w: w["start_ms"].isNull() | w["end_ms"].isNull() | w["confidence"].isNull())
    d = d.withColumn(
        "_error",
        F.when(c("_kind") != OBJECT, "not_an_object").when(broken, "invalid_transcript_words")
        .when(c("_text").isNull(), "empty_prediction").when(c("_conf").isNull(), "missing_confidence")
        .when(c("_c").isNull(), "invalid_confidence").when(c("_s").isNull(), "invalid_sequence_confidence"),
    )
    zero = F.lit(0).cast("bigint")
    single = F.array(F.struct(c("_text").alias("word"), zero.alias("start_ms"), zero.alias("end_ms"), c("_c").alias("confidence")))
    answer = F.struct(
        F.when(c("_error").isNotNull(), BAD_RESPONSE).alias("error_code"), c("_error").alias("error"),
        c("_text").alias("prediction"), c("_c").alias("confidence"),
        F.when(F.size("_list") > 0, c("_list")).otherwise(single).alias("words"),
        c("_s").alias("sequence_confidence"), bool_provider(c("_low")).alias("low_confidence"),
        F.coalesce(F.to_json(_first(_truthy, c("_alternatives"), c("_o_alternatives"))), F.lit("[]")).alias("alternatives"),
    )
    return d.select(*df.columns, answer.alias("answer"))


def validate_proof_fields(v: Column, request_id: Column) -> Column:
    """struct(error_code, detail): all four fields there, then well formed, then the request id."""
    absent = F.array_compact(F.array(*[F.when(_at(v, f"$.{f}").isNull(), F.lit(f)) for f in PROOF_FIELDS]))
    checks = F.lit(None).cast("string")
    given = _at(v, "$.request_id")
    given_text = F.when(_truthy(given), strip(_string(given))).otherwise("")
    steps = [
        (~((_kind(_at(v, f"$.{f}")) == STRING) & F.coalesce(strip(_string(_at(v, f"$.{f}"))) != "", F.lit(False))), f)
        for f in _PROOF_TEXT_ORDER
    ]
    steps += [
        (_kind(_at(v, "$.cloud_handoff")) != BOOLEAN, "cloud_handoff"),
        ((given_text != "") & (given_text != request_id), "request_id mismatch"),
    ]
    for bad, name in reversed(steps):
        checks = F.when(bad, F.lit(name)).otherwise(checks)
    return F.when(
        F.size(absent) > 0, F.struct(F.lit(PROOF_MISSING).alias("error_code"), F.array_join(absent, ", ").alias("detail"))
    ).otherwise(F.struct(F.when(checks.isNotNull(), PROOF_INVALID).alias("error_code"), checks.alias("detail")))


def failure_evidence(status: Column, code: Column, message: Column, request_id: Column) -> Column:
    """The upstream status as it is, trimmed texts with defaults; a blank request id becomes null."""
    clean = lambda c: F.nullif(strip(c), F.lit(""))
    return F.struct(
        status.try_cast("bigint").alias("upstream_status"),
        F.coalesce(clean(code), F.lit(FAILURE_CODE)).alias("upstream_code"),
        F.coalesce(clean(message), F.lit(FAILURE_MESSAGE)).alias("upstream_message"),
        clean(request_id).alias("upstream_request_id"),
    )


PROBE_SCHEMA = (
    "format struct<duration string>, streams array<struct<codec_type string, avg_frame_rate string, "
    "width bigint, height bigint, codec_name string, pix_fmt string, duration string>>"
)


def probe_flatten(df: DataFrame, payload: str) -> DataFrame:
    """Add the first video stream's facts: error, duration_seconds, fps, width, height, codec, pixel_format, has_audio."""
    clean = lambda c: F.nullif(c, F.lit(""))
    s, rate, duration = F.col("_s"), F.col("_rate"), F.col("_duration")
    kinds = F.coalesce(F.col("_p.streams.codec_type"), F.array().cast("array<string>"))
    d = df.withColumn("_p", F.from_json(payload, PROBE_SCHEMA))
    d = d.withColumn("_s", F.get(F.filter(F.col("_p.streams"), lambda x: x["codec_type"] == "video"), F.lit(0)))
    d = d.withColumn("_rate", F.split(F.coalesce(clean(s["avg_frame_rate"]), F.lit("0/1")), "/", 2))
    d = d.withColumn("_duration", F.coalesce(clean(F.col("_p.format.duration")), clean(s["duration"])))
    d = d.withColumn("duration_seconds", duration.try_cast("double"))
    num, den = rate[0].try_cast("double"), F.get(rate, F.lit(1)).try_cast("double")
    d = d.withColumn("fps", F.when(F.size(rate) == 1, num).when(den == 0, 0.0).otherwise(num / den))
    size_ok = (F.coalesce(s["width"], F.lit(0)) > 0) & (F.coalesce(s["height"], F.lit(0)) > 0)
    return d.select(
        *df.columns,
        F.when(s.isNull(), "video_stream_not_found").when(duration.isNull(), "video_duration_missing")
        .when(F.col("duration_seconds").isNull(), "video_duration_invalid")
        .when(F.col("fps").isNull(), "frame_rate_invalid").when(~size_ok, "video_resolution_invalid").alias("error"),
        "duration_seconds", "fps", s["width"].alias("width"), s["height"].alias("height"),
        F.coalesce(clean(s["codec_name"]), F.lit("unknown")).alias("codec"),
        F.coalesce(clean(s["pix_fmt"]), F.lit("unknown")).alias("pixel_format"),
        F.array_contains(kinds, "audio").alias("has_audio"),
    )


def profile_conformity(probes: DataFrame, max_seconds: float = MAX_DURATION_SECONDS) -> DataFrame:
    """Add one flag per rule, the overall flag and whether the clip is too long."""
    rules = {
        "size_differs": (F.col("width") != PROFILE["width"]) | (F.col("height") != PROFILE["height"]),
        "fps_differs": F.abs(F.col("fps") - F.lit(PROFILE["fps"])) > F.lit(0.01),
        "codec_differs": ~F.lower("codec").isin(*PROFILE["codecs"]),
        "pix_fmt_differs": F.lower("pixel_format") != PROFILE["pix_fmt"],
        "audio_present": F.col("has_audio"),
    }
    d = probes.select("*", *[c.alias(n) for n, c in rules.items()])
    return d.withColumn("needs_normalizing", reduce(or_, [F.col(n) for n in rules])).withColumn(
        "too_long", F.col("duration_seconds") > F.lit(float(max_seconds)))
