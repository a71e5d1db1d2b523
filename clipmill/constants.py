"""Schemas, sentinels and thresholds. All values here are fixed by the data contract."""

from pyspark.sql import types as T

# Sentinels (fixed values).
INVALID = "__invalid__"
UNKNOWN = "unknown"
NONE_LABEL = "__none__"
MISSING_WORD = "__missing__"

# Splits and ratios (fixed values).
SPLITS = ("train", "val", "test")
TRAIN_RATIO, VAL_RATIO, TEST_RATIO = 0.70, 0.15, 0.15
CONTRACT_SIZE = 50

# Quantisation alphabet (fixed value): position = 6-bit code.
Q64_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"
Q64_CLIP = 4.0
Q64_ENCODING = "q64_full"
Q64_INSTRUCTION = "Classify this compact ASL pose encoding into its WLASL gloss. Reply with only the gloss word."

# Frame plan (fixed values).
TARGET_FPS = 30.0
MAX_FRAMES = 300

# Canonical video profile (fixed values).
PROFILE = {"width": 1280, "height": 720, "fps": 30.0, "pix_fmt": "yuv420p", "codecs": ("h264", "avc1")}
MAX_DURATION_SECONDS = 10.0

# Gate thresholds (fixed values).
CONFIDENCE_THRESHOLD = 0.70
PHASE_MIN_MACRO_F1, PHASE_WEAK_F1 = 0.75, 0.65
READY_MIN_MACRO_F1, READY_MAX_P95_MS, READY_MIN_STABILITY = 0.70, 800.0, 0.95
ANCHOR_COUNT, ANCHOR_MIN_SUPPORT, ANCHOR_MAX_SUPPORT = 10, 3, 5
ANCHOR_MIN_ACCURACY, COLLAPSE_MAX_SHARE = 0.70, 0.40
RATE_LIMIT, RATE_WINDOW_SECONDS = 60, 60

# Pose layout (fixed values).
BODY_JOINTS, HAND_JOINTS, FACE_JOINTS = 17, 21, 468
BODY_REFERENCE, HAND_REFERENCE = (1, 2), (0, 9)
EPS = 1e-6

MEDIA_SUFFIXES = (".mp4", ".mov", ".m4v")

INSTANCE = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("signer_id", T.StringType()),
        T.StructField("instance_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("fps", T.StringType()),
        T.StructField("frame_start", T.StringType()),
        T.StructField("frame_end", T.StringType()),
    ]
)
METADATA = T.StructType(
    [T.StructField("gloss", T.StringType()), T.StructField("instances", T.ArrayType(INSTANCE))]
)
JOINTS = T.ArrayType(T.ArrayType(T.FloatType()))
POSE_FRAMES = T.StructType(
    [
        T.StructField("clip_id", T.StringType()),
        T.StructField("frame_idx", T.IntegerType()),
        T.StructField("body", JOINTS),
        T.StructField("left_hand", JOINTS),
        T.StructField("right_hand", JOINTS),
        T.StructField("face", JOINTS),
    ]
)
STRICT_COLUMNS = (
    "index", "sample_id", "expected_gloss", "predicted_gloss",
    "raw_model_output", "valid_label", "correct", "mode",
)
CONSTRAINED_COLUMNS = (
    "index", "sample_id", "expected_gloss", "free_generation_prediction",
    "constrained_prediction", "constrained_correct", "top_scores", "mode",
)
MULTIWORD_COLUMNS = (
    "index", "sample_id", "expected_text", "predicted_text", "expected_word_count",
    "predicted_word_count", "substitutions", "insertions", "deletions", "exact_match",
    "matched_word_count", "timestamp_boundary_mae_ms",
)
