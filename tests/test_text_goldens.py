from pyspark.sql import functions as F

from clipmill.functions import text as T
from clipmill.functions.provider import normalize_provider_response, probe_flatten, profile_conformity, validate_proof_fields
from clipmill.operators import labels as L

LABELS = ["hello", "thank-you", "thank you", "no"]


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


def test_normalizers(spark):
    assert one(spark, "  `HELLO`\t! ", T.normalize_gloss) == "hello"
    assert one(spark, "don't  like", T.normalize_gloss) == "dont like"
    assert one(spark, "a\tb", T.normalize_gloss) == "ab"
    assert one(spark, "Don't  LIKE", T.normalize_gloss_keep_apostrophe) == "don't like"
    assert one(spark, "  HELLO! ", T.normalize_word) == "hello"
    assert one(spark, "Thank-you", T.normalize_word) == "thankyou"
    assert one(spark, " A  b\n", T.canonicalize_text) == "a b"


def test_resolve_split(spark):
    df = spark.createDataFrame([("HELLO\nextra text",), ("; : `what` : hello",), ("",), (None,)], "x string")
    rows = T.resolve_output_split(df, "x", LABELS).collect()
    assert [(r.label, r.valid) for r in rows] == [("hello", True), ("what", False), (None, False), (None, False)]


def test_first_line_even_if_empty(spark):
    f = lambda c: T.resolve_output_first_line(c, LABELS)
    assert tuple(one(spark, "\nhello", f)) == ("uncertain", None)
    assert tuple(one(spark, "Hello.\nx", f)) == ("ok", "hello")


def test_resolve_reason(spark):
    cases = [
        ('{"translation": "Hello!"}', "hello", "exact_or_wrapper"), ('"thank-you"', "thank-you", "exact_or_wrapper"),
        ("**hello** is it", "hello", "single_mention"), ("hello or no", "__invalid__", "ambiguous"),
        ("nothing", "__invalid__", "no_match"), ('{"label": 3}', "__invalid__", "no_match"), ("I say thank you", "thank you", "single_mention"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "x string")
    got = {r.x: (r.label, r.reason) for r in T.resolve_output_reason(df, "x", LABELS).collect()}
    assert got == {c[0]: c[1:] for c in cases}


def test_alias_output(spark):
    df = spark.createDataFrame([("\n  Dont Like\nx",), ("weird",), ("",)], "x string")
    aliases = spark.createDataFrame([("dont like", "hello")], "alias string, canonical string")
    out = L.resolve_output_alias(df, T.normalize_gloss_keep_apostrophe(T.first_full_line(F.col("x"))), aliases, LABELS).collect()
    assert [(r.status, r.prediction, r.candidate) for r in out] == [
        ("ok", "hello", "hello"), ("out_of_allowlist", None, "weird"), ("out_of_allowlist", None, None)]


def test_sample_key_and_block(spark):
    assert one(spark, "a=1\nsample_id= s7 \nsample_id=x", T.sample_key) == "s7"
    assert one(spark, "sample_id=\nb", T.sample_key) == ""
    import hashlib

    assert one(spark, "xsample_id=1", T.sample_key) == hashlib.sha256(b"xsample_id=1").hexdigest()[:12]
    df = spark.createDataFrame([("frames=12 features_per_frame=177\npose_q64=a|b",), ("frames=12",), ("x",)], "t string")
    p = [r.p for r in T.parse_input_block(df, "t").collect()]
    assert (p[0].frames, p[0].features, p[0].shape_ok, p[0].pose_q64) == (12, 177, True, "a|b")
    assert p[1].shape_ok is False and p[2].shape_ok is None


def test_pose_text(spark):
    assert one(spark, "1,2.5; ;3,,4", T.parse_pose_text) == [[1.0, 2.5], [3.0, 4.0]]


def test_display_redact_quote(spark):
    assert one(spark, "thank-you", T.display_translation) == "Thank-you."
    assert one(spark, " ! ", T.display_translation) is None
    assert one(spark, "a.tar.GZ", T.redact_filename).endswith(".gz")
    assert one(spark, ".hidden", T.redact_filename).endswith(".bin")
    for text in ("it's", 'say "x"', "a\\b\nc", "it's \"x\""):
        assert one(spark, text, T.python_quoted) == repr(text)


def test_bools(spark):
    df = spark.createDataFrame([(x,) for x in (' True', 'false', '1', 'Yes', 'maybe')], "x string")
    assert [r[0] for r in df.select(T.bool_strict(F.col("x"))).collect()] == [True, False, None, None, None]
    assert [r[0] for r in df.select(T.bool_lenient(F.col("x"))).collect()] == [True, False, True, True, False]
    v = spark.createDataFrame([(x,) for x in ('true', '0', '2', '"y"', '"n"', '[1]', 'null')], "x string")
    assert [r[0] for r in v.select(T.bool_provider(F.parse_json("x"))).collect()] == [True, False, True, True, False, False, False]


def test_aliases(spark):
    src = spark.createDataFrame([("Hello", ["hi", "Hey!", ""]), ("no", ["hi"]), ("other", ["o"])], "canonical string, aliases array<string>")
    pairs, bad = L.flatten_aliases(src, LABELS)
    assert {(r.alias, r.canonical) for r in pairs.collect()} == {("hello", "hello"), ("hi", "hello"), ("hey", "hello"), ("no", "no"), ("hi", "no")}
    assert {(r.rule, r.key) for r in bad.collect()} == {("canonical_not_in_allowlist", "other"), ("alias_collision", "hi")}


def test_anchor_ties(spark):
    df = spark.createDataFrame([(x,) for x in ("yes", "hello", "yes", "hello", "thanks", "thanks", None)], "output string")
    top, bad = L.top_k_anchors(df, "output", ["hello", "thanks", "yes"], 3)
    assert [tuple(r) for r in top.collect()] == [("hello", 2), ("thanks", 2), ("yes", 2)]
    assert bad.count() == 0


def provider(spark, text):
    df = spark.createDataFrame([(text,)], "x string").withColumn("v", F.try_parse_json("x"))
    return normalize_provider_response(df, "v").first().answer


def test_provider_branches(spark):
    a = provider(spark, '{"translation":"hello","confidence":0.77}')
    assert [tuple(w) for w in a.words] == [("hello", 0, 0, 0.77)] and a.sequence_confidence == 0.77 and a.low_confidence is False
    a = provider(spark, '{"prediction":"x","confidence":0.5,"transcript_words":[{"word":"x","start_ms":"bad"}]}')
    assert a.error_code == "INFERENCE_INVALID_RESPONSE"
    assert provider(spark, '{"prediction":"x","confidence":0}').confidence == 0.0
    a = provider(spark, '{"prediction":"","output":{"translation":"t","confidence":"0.4","low_confidence":"y"}}')
    assert (a.prediction, a.confidence, a.low_confidence) == ("t", 0.4, True)
    a = provider(spark, '{"words":[{"word":"a","start":"3"},{"word":""},{"word":"b","end_ms":2.9}],"confidence":1}')
    assert (a.prediction, [tuple(w)[:3] for w in a.words]) == ("a b", [("a", 3, 0), ("b", 0, 2)])
    assert provider(spark, '{"prediction":"x"}').error == "missing_confidence"
    assert provider(spark, '{"confidence":1,"transcript_words":"abc"}').error == "empty_prediction"
    assert provider(spark, "[1]").error == "not_an_object"


def test_proof_fields(spark):
    good = '"runtime_mode":"cloud","cloud_handoff":true,"model_id":"m","model_version":"1"'
    cases = {
        "{" + good + "}": (None, None),
        '{"runtime_mode":"cloud"}': ("INFERENCE_PROOF_MISSING", "cloud_handoff, model_id, model_version"),
        "{" + good.replace("true", '"true"') + "}": ("INFERENCE_PROOF_INVALID", "cloud_handoff"),
        "{" + good.replace('"m"', "null") + "}": ("INFERENCE_PROOF_INVALID", "model_id"),
        "{" + good + ',"request_id":"other"}': ("INFERENCE_PROOF_INVALID", "request_id mismatch"),
        "{" + good + ',"request_id":" r "}': (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string").withColumn("v", F.try_parse_json("x"))
    got = {r.x: (r.p.error_code, r.p.detail) for r in df.select("x", validate_proof_fields(F.col("v"), F.lit("r")).alias("p")).collect()}
    assert got == cases


def test_probe(spark):
    text = '{"format":{"duration":"2.5"},"streams":[{"codec_type":"audio"},{"codec_type":"video","avg_frame_rate":"30000/1001","width":1280,"height":720,"codec_name":"h264","pix_fmt":"yuv420p"}]}'
    df = spark.createDataFrame([(text,), ('{"streams":[]}',), ('{"streams":[{"codec_type":"video","width":1,"height":1,"avg_frame_rate":"0/0"}]}',)], "x string")
    p = profile_conformity(probe_flatten(df, "x")).collect()
    assert p[0].error is None and p[0].has_audio and p[0].needs_normalizing and not p[0].too_long and abs(p[0].fps - 29.97) < 0.01
    assert p[1].error == "video_stream_not_found" and p[2].error == "video_duration_missing" and p[2].fps == 0.0
