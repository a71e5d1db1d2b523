"""Count-based feature windows: N frames each, missing frames are zeros and are counted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.operators.ranking import spread_sequence

OUTPUT = "source string, window bigint, missing_frame_count bigint, features array<array<double>>"
STREAM_OUTPUT = OUTPUT + ", late_frame bigint"


def _usable(ok: Column, f: Column, width: int) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)) & (F.size(f) == width), f.cast("array<double>"))


def feature_windows(frames: DataFrame, n: int, width: int) -> DataFrame:
    """Batch form over ``(source, frame_idx, ok, f[])``: one row per whole window.

    A window holds n frames, so a group is small however long a source runs. Windows without any
    frame row come from lengths alone. A last part window is left out.
    """
    if n <= 0:
        raise ValueError("frame count must be positive")
    zeros = F.array_repeat(F.lit(0.0), width)
    pos = (F.col("frame_idx") % n).cast("int")
    there = frames.select(
        "source", F.floor(F.col("frame_idx") / n).alias("window"), pos.alias("pos"), _usable(F.col("ok"), F.col("f"), width).alias("f"),
        F.coalesce("ok", F.lit(False)).alias("ok"),
    )
    got = there.groupBy("source", "window").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("pos", "f")))).alias("m"),
        F.count_if("ok").alias("ok"),
    )
    whole = frames.groupBy("source").agg(F.floor((F.max("frame_idx") + 1) / n).alias("w"))
    spine = spread_sequence(whole, F.col("w"), "window").drop("w")
    j = spine.join(got, ["source", "window"], "left")
    filled = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), zeros))
    return j.select("source", "window", (F.lit(n) - F.coalesce("ok", F.lit(0))).alias("missing_frame_count"), filled.alias("features"))


def feature_windows_stream(frames: DataFrame, n: int, width: int, idle_seconds: int | None = None, reorder: int = 0) -> DataFrame:
    """Streaming form: a window goes out once its N frames have passed; gaps in frame_idx are missing frames.

    A frame's place passes when the source has shown a frame ``reorder`` places further on, so frames that come up to that much late are
    put in order first. One that comes after its place has passed goes out as a row of its own, with its number in
    ``late_frame`` and no features. State per source: next frame number, the open window, and at most the frames of the last
    ``reorder`` places; with ``idle_seconds`` a timer passes the held frames on and ends the state when a source is silent for so long.
    """
    if n <= 0:
        raise ValueError("frame count must be positive")
    if reorder < 0:
        raise ValueError("reorder must not be negative")
    zero = [0.0] * width

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        nxt, missing, held, seen, places, flags, values = state.get if state.exists else (0, 0, [], -1, [], [], [])
        held, silent = [list(x) for x in held], state.hasTimedOut
        waiting = [(i, bool(ok), None if f is None else list(f)) for i, ok, f in zip(places, flags, values)]
        out = []

        def push(f):
            nonlocal nxt, missing, held
            held.append(zero if f is None else f)
            nxt += 1
            if len(held) == n:
                out.append((key[0], nxt // n - 1, missing, held, None))
                held, missing = [], 0

        def put(idx: int, good: bool, f) -> None:
            nonlocal missing
            if idx < nxt:
                out.append((key[0], idx // n, None, None, idx))
                return
            while nxt < idx:
                missing += 1
                push(None)
            missing += 0 if good else 1
            push(f)

        for pdf in [] if silent else batches:
            for idx, ok, f in pdf[["frame_idx", "ok", "f"]].itertuples(index=False):
                good = ok is not None and bool(ok)
                waiting.append((int(idx), good, [float(x) for x in f] if good and f is not None and len(f) == width else None))
                seen = max(seen, int(idx))
        waiting.sort(key=lambda w: w[0])
        passed = len(waiting) if silent else sum(w[0] <= seen - reorder for w in waiting)
        for w in waiting[:passed]:
            put(*w)
        waiting = waiting[passed:]
        if silent:
            state.remove()
        else:
            state.update((nxt, missing, held, seen, [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting]))
            if idle_seconds:
                state.setTimeoutDuration(idle_seconds * 1000)
        table = pd.DataFrame(out, columns=["source", "window", "missing_frame_count", "features", "late_frame"])
        yield table.astype({"missing_frame_count": "Int64", "late_frame": "Int64"})

    held = "nxt bigint, missing bigint, held array<array<double>>, seen bigint, places array<bigint>, flags array<boolean>, waiting array<array<double>>"
    return frames.groupBy("source").applyInPandasWithState(
        step, STREAM_OUTPUT, held, "append", "ProcessingTimeTimeout" if idle_seconds else "NoTimeout")
