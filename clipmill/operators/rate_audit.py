"""Per-key sliding-window admission, replayed over a request log.

A request is admitted when fewer than ``limit`` admitted requests lie in the last ``window`` (ends
included); rejected ones do not count. Whether one is admitted depends on earlier admissions, yet
most of a log needs no replay:

* a stamp with at most ``limit`` requests in its window (its own included) is let in whole, whatever came before;
* after a whole window of such stamps the state is known: the requests of that window.

So only stretches are replayed that begin at a stamp beyond the limit and end when such a window has passed.
Counts are range windows over slices of a key's time line, each with three windows of lead-in, so a key with a third of all
requests spreads over tasks. A stretch runs once, in order, over sorted batches, with at most ``limit`` stamps in memory;
stretches run side by side. The number of Spark jobs does not depend on the log. A key that stays at its limit is one stretch:
its order is inherent, its cost is one step for each distinct stamp.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipmill.constants import RATE_LIMIT, RATE_WINDOW_SECONDS
from clipmill.session import stored

SLICE_WINDOWS = 8


def positive_or_default(value: str | None, default: int) -> int:
    """Setting as a positive whole number, else the default."""
    try:
        number = int(str(value).strip())
    except ValueError:
        return default
    return number if number > 0 else default


def admit(hits: deque, t: int, n: int, limit: int, window: int, unit: int) -> tuple[int, int | None]:
    """Let in ``n`` requests at stamp ``t``: (admitted, seconds to wait or None). ``hits`` moves on."""
    while hits and hits[0] < t - window:
        hits.popleft()
    take = min(n, limit - len(hits))
    hits.extend([t] * take)
    return take, None if take == n else max(1, int((window - (t - hits[0])) / unit))


def _flagged(log: DataFrame, limit: int, window: int, width: int) -> DataFrame:
    """``log`` (key, ts, requests) with ``slice``, ``open`` (the state before it decides) and ``start`` (first of its stretch)."""
    ahead = F.floor((F.col("ts") + 3 * window) / F.lit(width)).cast("bigint")
    own = F.floor(F.col("ts") / F.lit(width)).cast("bigint")
    rows = log.withColumn("own", own).withColumn("slice", F.explode(F.sequence(own, ahead)))
    line = W.partitionBy("key", "slice").orderBy("ts")
    before = line.rangeBetween(-window, 0)
    rows = rows.withColumn("over", F.sum("requests").over(before) > limit)
    rows = rows.withColumn("open", F.max("over").over(before))
    closed = ~F.coalesce(F.lag("open").over(line), F.lit(False)) | (F.lag("ts").over(line) < F.col("ts") - window)
    rows = rows.withColumn("start", F.col("open") & closed)
    # the first windows of the lead-in lack their own past: only rows of the slice itself are kept
    return rows.filter("own = slice").select("key", "ts", "requests", "slice", "open", "start")


def _stretches(flagged: DataFrame) -> DataFrame:
    """Open rows with ``stretch``, the stamp at which theirs began."""
    begun = flagged.filter("start").groupBy("key", "slice").agg(F.max("ts").alias("last"))
    seen = flagged.filter("open").select("key", "slice").distinct().join(begun, ["key", "slice"], "left")
    earlier = W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    seen = seen.select("key", "slice", F.last("last", True).over(earlier).alias("inherited"))  # one row per slice
    here = W.partitionBy("key", "slice").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    rows = flagged.filter("open").withColumn("own", F.max(F.when(F.col("start"), F.col("ts"))).over(here))
    return rows.join(seen, ["key", "slice"]).select("key", "ts", "requests", "slice", F.coalesce("own", "inherited").alias("stretch"))


def sliding_rate_audit(
    requests: DataFrame, limit: int = RATE_LIMIT, window_seconds: int = RATE_WINDOW_SECONDS,
    unit: int = 1, slice_windows: int = SLICE_WINDOWS,
) -> DataFrame:
    """(key, ts) -> (key, ts, requests, admitted, retry_after_seconds).

    ``ts`` is a whole number with ``unit`` ticks per second. Equal stamps of a key form one row.
    """
    if limit <= 0 or window_seconds <= 0 or slice_windows < 1:
        raise ValueError("limit, window and slice length must be positive")
    window = window_seconds * unit
    width = window * slice_windows
    key_type = requests.schema["key"].dataType.simpleString()

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (key, stretch, ts); the rows before a stretch only fill its first window."""
        at, hits = None, deque()
        for pdf in batches:
            taken, waits = [], []
            for key, stretch, ts, n in zip(*(pdf[c].tolist() for c in ("key", "stretch", "ts", "requests"))):
                if (key, stretch) != at:
                    at, hits = (key, stretch), deque()
                take, wait = admit(hits, ts, n, limit, window, unit)
                taken.append(take)
                waits.append(wait)
            out = pdf[["key", "ts", "requests"]].assign(admitted=pd.array(taken, dtype="Int64"), retry_after_seconds=pd.array(waits, dtype="Int64"))
            yield out[(pdf["ts"] >= pdf["stretch"]).to_numpy()]

    log = requests.groupBy("key", "ts").agg(F.count(F.lit(1)).alias("requests"))
    flagged = stored(_flagged(log, limit, window, width), "rate-log")
    inside = stored(_stretches(flagged), "rate-stretches")
    starts = inside.filter("ts = stretch").select("key", "stretch", F.explode(F.array(F.col("slice") - 1, F.col("slice"))).alias("slice"))
    lead_in = (
        flagged.join(starts, ["key", "slice"])  # all of these were let in whole: the stamp before a start is not open
        .filter((F.col("ts") < F.col("stretch")) & (F.col("ts") >= F.col("stretch") - window))
    )
    columns = ["key", "stretch", "ts", "requests"]
    rows = inside.select(*columns).unionByName(lead_in.select(*columns))
    schema = f"key {key_type}, ts bigint, requests bigint, admitted bigint, retry_after_seconds bigint"
    replayed = rows.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "ts").mapInPandas(replay, schema)
    free = flagged.filter("not open").select(
        "key", "ts", "requests", F.col("requests").alias("admitted"), F.lit(None).cast("bigint").alias("retry_after_seconds"))
    return free.unionByName(replayed)


def mark_requests(requests: DataFrame, audit: DataFrame, order: str, limit: int = RATE_LIMIT) -> DataFrame:
    """Per request: admitted or not, ``order`` being a unique tie-break.

    Only stamps admitted in part need a rank. At most ``limit`` rows of a stamp are let in, so each
    task sends on no more than that many (window group limit); the rest are the ones rejected.
    """
    j = requests.join(audit, ["key", "ts"])
    part = (F.col("admitted") > 0) & (F.col("admitted") < F.col("requests"))
    whole = j.filter(~part).withColumn("ok", F.col("admitted") > 0)
    some = j.filter(part)
    rank = F.row_number().over(W.partitionBy("key", "ts").orderBy(order))
    let_in = some.withColumn("_r", rank).filter(F.col("_r") <= limit).filter(F.col("_r") <= F.col("admitted")).drop("_r")
    refused = some.join(let_in.select("key", "ts", order), ["key", "ts", order], "left_anti")
    marked = whole.unionByName(let_in.withColumn("ok", F.lit(True))).unionByName(refused.withColumn("ok", F.lit(False)))
    return marked.select(*requests.columns, "ok", F.when(~F.col("ok"), F.col("retry_after_seconds")).alias("retry_after_seconds"))
