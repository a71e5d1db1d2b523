"""Sliding-window admission over a request stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmill.constants import RATE_LIMIT, RATE_WINDOW_SECONDS
from clipmill.operators.rate_audit import admit

#: Keys are dealt into so many groups; a group's state and requests go to Python at once, not each key's.
BUCKETS = 1024


def sliding_rate_stream(
    requests: DataFrame, limit: int = RATE_LIMIT, window_seconds: int = RATE_WINDOW_SECONDS, unit: int = 1, idle_seconds: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(key, ts) stream -> (key, ts, requests, admitted, retry_after_seconds) per micro-batch.

    State per key is at most ``limit`` stamps; the keys of a bucket share a row of it. Requests count in arrival order of micro-batches.
    With ``idle_seconds`` the state of a key that sent nothing for so long (by the clock of the cluster, so not less than the window in
    a live stream) ends. ``buckets`` stays as it is for the life of a checkpoint.
    """
    window = window_seconds * unit
    key_type = requests.schema["key"].dataType.simpleString()
    same = lambda key: None if key != key else key  # not-a-number is a key like others

    def step(bucket: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = {}  # key: (key, hits, when it last sent)
        if state.exists:
            names, sizes, hits, seen = (list(x) for x in state.get)
            at = 0
            for key, n, when in zip(names, sizes, seen):
                known[same(key)] = key, deque(int(t) for t in hits[at:at + n]), int(when)
                at += n
        now = state.getCurrentProcessingTimeMs() if idle_seconds else 0
        touched, out = set(), []
        if not state.hasTimedOut:
            by = ["ts"] if bucket[1] else ["key", "ts"]
            rows = pd.concat([b[b["ts"].notna()].groupby(by, dropna=False).size() for b in batches])
            rows = rows.groupby(level=by, dropna=False).sum().sort_index().reset_index(name="requests")
            names = [None] * len(rows) if bucket[1] else list(rows["key"])
            for key, t, n in zip(names, rows["ts"].tolist(), rows["requests"].tolist()):
                name = same(key)
                if name not in touched:
                    touched.add(name)
                    known[name] = key, known[name][1] if name in known else deque(), now
                out.append((key, int(t), n, *admit(known[name][1], int(t), n, limit, window, unit)))
        if idle_seconds:
            known = {k: x for k, x in known.items() if k in touched or x[2] + idle_seconds * 1000 > now}
        if known:
            state.update((
                [x[0] for x in known.values()], [len(x[1]) for x in known.values()],
                [t for x in known.values() for t in x[1]], [x[2] for x in known.values()]))
            if idle_seconds:
                state.setTimeoutDuration(max(1, min(x[2] for x in known.values()) + idle_seconds * 1000 - now))
        elif state.exists:
            state.remove()
        if out:
            key, ts, n, taken, waits = zip(*out)
            yield pd.DataFrame({
                "key": pd.Series(key, dtype=object), "ts": ts, "requests": n, "admitted": taken,
                "retry_after_seconds": pd.array(waits, dtype="Int64")})

    schema = f"key {key_type}, ts bigint, requests bigint, admitted bigint, retry_after_seconds bigint"
    state = f"keys array<{key_type}>, sizes array<int>, hits array<bigint>, seen array<bigint>"
    # null keys have a bucket of their own, so that whole-number keys stay whole in pandas
    dealt = requests.select("key", "ts", F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket"), F.col("key").isNull().alias("none"))
    return dealt.groupBy("bucket", "none").applyInPandasWithState(step, schema, state, "append", "ProcessingTimeTimeout" if idle_seconds else "NoTimeout")
