import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipmill.constants import Q64_ALPHABET, Q64_ENCODING
from clipmill.functions import arrays as A
from clipmill.operators import pose as D
from clipmill.sources.poses import decode_pose_archives, encode_pose_archives

SCHEMA = "clip_id string, frame_idx bigint, f array<double>"


def clip(spark, data):
    return spark.createDataFrame([(c, t, [float(x) for x in f]) for c, fs in data.items() for t, f in enumerate(fs)], SCHEMA)


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.frame_idx):
        out.setdefault(r.clip_id, []).append(list(r.f))
    return {k: np.array(v) for k, v in out.items()}


def test_even_indices(spark):
    df = spark.createDataFrame([(10,), (3,), (0,), (5,)], "n int")
    get = lambda few, k=5: [r[0] for r in df.select(A.even_indices(F.col("n"), k, few)).collect()]
    assert get("all") == [[0, 2, 4, 7, 9], [0, 1, 2], None, [0, 1, 2, 3, 4]]
    assert get("error")[1] is None and get("repeat")[1] == [0, 0, 1, 2, 2] or get("repeat")[1] == [round(i * 2 / 4) for i in range(5)]
    assert get("all", 1)[0] == [0]


def test_zscore_and_constant_feature(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9, 4))
    x[:, 2] = 5
    got = collect(D.zscore_clip(clip(spark, {"a": x})))["a"]
    want = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6)
    assert np.allclose(got, want, atol=1e-6)


@pytest.mark.parametrize("target", [1, 2, 5, 12, 13, 40])
def test_resample_matches_interpolation(spark, target):
    rng = np.random.default_rng(target)
    data = {f"c{n}": rng.normal(size=(n, 3)) for n in (1, 2, 7, 12, 25)}
    df = clip(spark, data)
    t = df.select("clip_id").distinct().withColumn("n_target", F.lit(target).cast("bigint"))
    got = collect(D.resample_linear(df, t))
    for k, x in data.items():
        n = len(x)
        if n == target:
            want = x
        elif n == 1 or target == 1:
            want = np.repeat(x[:1], target, axis=0)
        else:
            pos = np.linspace(0, n - 1, target)
            want = np.stack([np.interp(pos, np.arange(n), x[:, j]) for j in range(3)], axis=1)
        assert got[k].shape == (target, 3) and np.allclose(got[k], want, atol=1e-6)


def test_resample_zero_target(spark):
    df = clip(spark, {"a": np.ones((3, 2))})
    t = spark.createDataFrame([("a", 0)], "clip_id string, n_target bigint")
    assert D.resample_linear(df, t).count() == 0 and D.resample_linear(df, t, "one").count() == 1


def test_q64(spark):
    values = [-9.0, -4.0, 0.0, 4.0, 9.0, 0.05, -1.3]
    want = "".join(Q64_ALPHABET[round((max(-4.0, min(4.0, v)) + 4) / 8 * 63)] for v in values)
    df = clip(spark, {"a": [values, values, values]})
    assert D.q64_payload(D.q64_rows(df)).first().payload == "|".join([want] * 3)
    assert D.q64_payload(D.q64_rows(df, 2)).first().payload == "|".join([want] * 2)


def test_q64_record_of_a_long_clip(spark):
    df = spark.range(5000).select(F.lit("a").alias("clip_id"), F.col("id").alias("frame_idx"), F.array(F.lit(0.5), F.lit(-0.5)).alias("f"))
    clips = spark.createDataFrame([("a", "a", "g")], "clip_id string, sample_id string, output string")
    records = D.export_q64_records(df, clips, "q64_full")
    assert records.count() == 1 and D.export_manifest(records).first().samples == 1
    expected = spark.createDataFrame([("a", "g", 5000, 2)], "sample_id string, expected_gloss string, frames bigint, features bigint")
    assert D.validate_q64_records(records, expected).count() == 0


def test_q64_summary(spark):
    df = clip(spark, {"a": [[0, 1, 9], [2, 3], [4, -1]], "b": [[1, 2]]})
    q = lambda v: Q64_ALPHABET[round((max(-4.0, min(4.0, v)) + 4) / 8 * 63)]
    got = {r.clip_id: r.summary for r in D.q64_summary(df).collect()}
    assert got["a"] == f"m={q(2)}{q(1)}\nd={q(4)}{q(-2)}" and got["b"] == f"m={q(1)}{q(2)}\nd={q(0)}{q(0)}"


def test_landmarks(spark):
    rng = np.random.default_rng(1)
    j = rng.normal(size=(5, 4))
    df = spark.createDataFrame([(j.tolist(),), (np.zeros((5, 4)).tolist(),)], "j array<array<double>>")
    got = [np.array(r[0]) for r in df.select(A.normalize_landmarks(F.col("j"), 1, 2)).collect()]
    want = (j[:, :3] - (j[1, :3] + j[2, :3]) / 2) / np.linalg.norm(j[1, :3] - j[2, :3])
    assert np.allclose(got[0][:, :3], want) and np.allclose(got[0][:, 3], j[:, 3]) and not got[1].any()


def test_true_rotation(spark):
    df = spark.createDataFrame([([[1.0, 0.0, 5.0]],)], "j array<array<double>>")
    x, y, z = df.select(A.rotate_xy(F.col("j"), F.radians(F.lit(90.0)))).first()[0][0]
    # Reading x back after it was replaced would give y = 0 here.
    assert (round(x, 9), round(y, 9), z) == (0.0, 1.0, 5.0)


def test_frame_zscore(spark):
    df = spark.createDataFrame([([1.0, 2.0, 6.0],), ([3.0, 3.0],)], "f array<double>")
    got = [r[0] for r in df.select(A.zscore_frame(F.col("f"))).collect()]
    x = np.array([1.0, 2.0, 6.0])
    assert np.allclose(got[0], (x - x.mean()) / x.std()) and got[1] == [0.0, 0.0]


def record(sid, gloss, rows, feats, enc=f"{Q64_ENCODING} clip=4 alphabet={Q64_ALPHABET}"):
    body = "|".join(["0" * feats] * rows)
    return ("i", f"sample_id={sid}\nencoding={enc}\nframes={rows} features_per_frame={feats}\npose_q64={body}", gloss)


def test_verify_against_record(spark):
    frames = clip(spark, {"a": np.ones((60, 177))})
    meta = spark.createDataFrame([("a", "s1", None, "hello")], "clip_id string, sample_id string, archive_id string, expected_gloss string")
    rec = spark.createDataFrame([record("s1", "Hello", 12, 177)], "instruction string, input string, output string")
    r = D.verify_pose_vs_records(frames, meta, rec).first()
    assert (r.source_frames, r.frames, r.payload_chars, r.verified) == (60, 12, 12 * 177, True)
    r = D.verify_pose_vs_records(frames, meta, rec.withColumn("output", F.lit("no"))).first()
    assert r.problem == "expected_gloss_mismatch" and r.verified is False


def test_validate_records(spark):
    rows = [record("s1", "a", 2, 3), record("s2", "a", 2, 4), record("s3", "b", 2, 3, "q64"), (" ", "sample_id=s4", "a")]
    rec = spark.createDataFrame(rows, "instruction string, input string, output string")
    exp = spark.createDataFrame([(f"s{i}", "a", 2, 3) for i in range(1, 5)], "sample_id string, expected_gloss string, frames bigint, features bigint")
    got = {(r.key, r.rule) for r in D.validate_q64_records(rec, exp).collect()}
    assert got == {
        ("s2", "shape_mismatch"), ("s2", "payload_shape"), ("s3", "encoding_line"), ("s3", "label_mismatch"),
        ("s4", "missing_instruction"), ("s4", "encoding_line"), ("s4", "malformed_shape"), ("s4", "missing_payload")}


def test_pad(spark):
    df = clip(spark, {"a": np.ones((3, 2)), "b": np.ones((1, 2)), "c": np.ones((2, 5))})
    b = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "clip_id string, batch_id int")
    rows, bad = D.pad_and_mask(df, b)
    got = {}
    for r in sorted(rows.collect(), key=lambda r: r.t):
        got.setdefault(r.clip_id, []).append((r.mask, sum(r.f)))
    assert got == {"a": [(True, 2.0)] * 3, "b": [(True, 2.0), (False, 0.0), (False, 0.0)], "c": [(True, 5.0)] * 2} and bad.count() == 0
    assert D.pad_and_mask(df, b.withColumn("batch_id", F.lit(0)))[1].count() == 1


def npz(**parts):
    buffer = io.BytesIO()
    np.savez(buffer, **parts)
    return bytearray(buffer.getvalue())


def test_archives(spark):
    one = lambda j, t=2, c=3: np.ones((t, j, c), dtype=np.float32)
    good = {"body": one(17), "left_hand": one(21), "right_hand": one(21)}
    nan = one(21)
    nan[0, 0, 0] = np.nan
    files = {
        "ok": npz(**good, sample_id=np.array("s1")), "gone": npz(body=one(17)), "flat": npz(**{**good, "body": np.ones((2, 17))}),
        "short": npz(**{**good, "left_hand": one(21, 1)}), "none": npz(**{k: v[:0] for k, v in good.items()}),
        "nan": npz(**{**good, "right_hand": nan}), "junk": bytearray(b"zip?"),
    }
    df = spark.createDataFrame([(f"x/{k}.npz", v) for k, v in files.items()], "path string, content binary")
    frames, bad = decode_pose_archives(df)
    assert [(r.clip_id, r.frame_idx, r.archive_id, len(r.body), r.face) for r in frames.collect()] == [("ok", 0, "s1", 17, None), ("ok", 1, "s1", 17, None)]
    assert {r.key: r.rule for r in bad.collect()} == {
        "gone": "missing_component", "flat": "not_three_dimensional", "short": "frame_count_mismatch", "none": "empty_axis", "nan": "not_finite", "junk": "unreadable"}
    again, _ = decode_pose_archives(encode_pose_archives(frames.drop("archive_id", "face")))
    assert sorted((r.clip_id, r.frame_idx) for r in again.collect()) == [("ok", 0), ("ok", 1)]


def test_fps_plan(spark):
    c = spark.createDataFrame([("a", 0.1, 0.0, 3), ("b", 10.1, 30.0, 303), ("c", 0.0, 30.0, 1), ("d", 1.0, 15.0, 10)], "clip_id string, duration_seconds double, src_fps double, n_frames bigint")
    plan, over = D.fixed_fps_plan(c)
    got = {}
    for r in sorted(plan.collect(), key=lambda r: r.frame):
        got.setdefault(r.clip_id, []).append((r.source_frame, r.ts_ms))
    assert got["a"] == [(0, 0), (1, 33), (2, 67)] and "c" not in got and len(got["d"]) == 30
    assert got["d"] == [(min(round(i / 30 * 15), 9), round(i / 30 * 1000)) for i in range(30)]
    assert [(r.rule, r.key, r.detail) for r in over.collect()] == [("FRAME_COUNT_EXCEEDED", "b", "303")]
