"""Pose archives (NPZ) -> one row per frame. The file codec is the only Python; frames are Arrow lists over the decoded arrays."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmill.constants import POSE_FRAMES
from clipmill.session import stored

PARTS = ("body", "left_hand", "right_hand", "face")
REQUIRED = PARTS[:3]
FRAMES_PER_BATCH = 512
_JOINTS = pa.list_(pa.list_(pa.float32()))
_ARROW = pa.schema([("path", pa.string()), ("clip_id", pa.string()), ("archive_id", pa.string()), ("frame_idx", pa.int32()), *((n, _JOINTS) for n in PARTS), ("rule", pa.string())])
_SCHEMA = "path string, clip_id string, archive_id string, frame_idx int, body array<array<float>>, left_hand array<array<float>>, right_hand array<array<float>>, face array<array<float>>, rule string"


def _problem(parts: dict[str, np.ndarray]) -> str | None:
    if any(n not in parts for n in REQUIRED):
        return "missing_component"
    if any(a.ndim != 3 for a in parts.values()):
        return "not_three_dimensional"
    if any(0 in a.shape for a in parts.values()):
        return "empty_axis"
    if len({a.shape[0] for a in parts.values()}) != 1:
        return "frame_count_mismatch"
    return None if all(np.isfinite(a).all() for a in parts.values()) else "not_finite"


def _nested(a: np.ndarray) -> pa.Array:
    """frames x joints x coordinates as lists of lists over the array's own buffer."""
    frames, joints, channels = a.shape
    rows = pa.ListArray.from_arrays(pa.array(np.arange(frames * joints + 1, dtype=np.int32) * channels), pa.array(a.reshape(-1)))
    return pa.ListArray.from_arrays(pa.array(np.arange(frames + 1, dtype=np.int32) * joints), rows)


def _archive(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
    clip, archive_id, parts = path.rsplit("/", 1)[-1].removesuffix(".npz"), None, {}
    try:
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            parts = {n: np.ascontiguousarray(z[n], dtype=np.float32) for n in PARTS if n in z}
            archive_id = str(z["sample_id"]) if "sample_id" in z else None
        rule = _problem(parts)
    except Exception:
        rule = "unreadable"
    if rule:
        yield pa.RecordBatch.from_pylist([{"path": path, "clip_id": clip, "archive_id": archive_id, "rule": rule}], schema=_ARROW)
        return
    total = len(parts["body"])
    for at in range(0, total, FRAMES_PER_BATCH):
        n = min(FRAMES_PER_BATCH, total - at)
        same = lambda value: pa.array([value] * n, pa.string())
        yield pa.RecordBatch.from_arrays([
            same(path), same(clip), same(archive_id), pa.array(np.arange(at, at + n, dtype=np.int32)),
            *(_nested(parts[x][at:at + n]) if x in parts else pa.nulls(n, _JOINTS) for x in PARTS), same(None)], schema=_ARROW)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield from _archive(path, content.as_buffer())


def decode_pose_archives(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(path, content)`` -> (pose frames + archive_id, violations).

    Archives are decoded once, into a table that both results read.
    """
    rows = stored(files.select("path", "content").mapInArrow(_decode, _SCHEMA), "pose-frames")
    bad = rows.filter("rule is not null").select("rule", F.col("clip_id").alias("key"), F.col("path").alias("detail"))
    return rows.filter("rule is null").select(*POSE_FRAMES.names, "archive_id"), bad


def ingest_pose_archives(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """As above for the ``*.npz`` files under ``root``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz")
    return decode_pose_archives(reader.load(root))


def encode_pose_archives(frames: DataFrame) -> DataFrame:
    """Pose frames -> ``(path, content)``: one archive ``<clip>.npz`` per clip, whatever its length."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_idx").combine_chunks()
        parts = {}
        for n in PARTS:
            if n in table.column_names and table.column(n).null_count == 0:
                lists = table.column(n).combine_chunks()
                rows = lists.flatten()
                parts[n] = rows.flatten().to_numpy().astype(np.float32).reshape(len(lists), len(rows) // len(lists), -1)
        clip, buffer = table.column("clip_id")[0].as_py(), io.BytesIO()
        np.savez_compressed(buffer, sample_id=np.array(str(clip)), **parts)
        return pa.table({"path": pa.array([f"{clip}.npz"]), "content": pa.array([buffer.getvalue()], pa.binary())})

    return frames.groupBy("clip_id").applyInArrow(pack, "path string, content binary")
