"""Centroid clustering with ns-bounds: stored bounds are loosened by the norm of a centroid's total displacement.

Lloyd's rounds over integer vectors, the same assignments as plain rounds, with fewer distances. Every vector keeps an upper bound of the
distance to its own centroid, a lower bound for every other one, and the round in which each was measured. The centroids of all rounds
are retained (rounds x centroids x components), so a bound measured in round s is loosened in round t by |c(t) - c(s)|: the norm of the
displacement as a whole, which is never more than the sum of the rounds' drifts and much less when centroids swing.

1. Own upper bound below all loosened lower bounds: nothing is measured.
2. Otherwise the own distance is measured; if all lower bounds are now greater, the vector stays.
3. Otherwise the centroids whose bounds fail are measured, in whole numbers, and the nearest is taken (ties: smaller number).

Bounds are whole sixteenths, rounded to the safe side; comparisons are of integers. One pass a round gives new states and the
task's sums (centroids x components rows); sums meet in a grouped aggregate. A state is a table in the shared folder, the one before is
removed when the next is written. Centroids and history travel with the task.

Vectors without exactly ``dim`` components, or with null or non-finite ones, are dropped. Starting centroids are the vectors whose ids
have the smallest digests; rows with a null id come last, equal ids are ordered by vector. With fewer vectors than centroids there are as
many centroids as vectors. Repeated rows count each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmill.llm.vectors import STEP2, blocks, ceil_root, finite, floor_root, kept_from, whole, wide
from clipmill.session import stored

TOP = (1 << 32) - 1


def squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid, or of each row to its own."""
    apart = x - centre
    return (apart * apart).sum(1)


def all_squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([squares(x, c) for c in centres], 1)


def first_round(x: np.ndarray, centres: np.ndarray):
    """(own, its distance, upper bound, lower bounds) with every distance measured."""
    d = all_squares(x, centres)
    own = d.argmin(1)
    best = d[np.arange(len(x)), own]
    root = floor_root(d)
    return own, best, np.minimum(root[np.arange(len(x)), own] + 1, TOP), np.minimum(root, TOP)


def next_round(x: np.ndarray, centres: np.ndarray, drift: np.ndarray, t: int, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, when: np.ndarray):
    """The state after round ``t``: (own, upper bound, lower bounds, their rounds, how many distances were measured).

    ``drift[s, j]`` is the displacement of centroid j from round s to t, ``when[:, j]`` the round in which the bound for j was
    measured; for the own centroid the upper bound counts.
    """
    n, k = lower.shape
    rows, each = np.arange(n), np.arange(k)
    now_low = np.maximum(lower - drift[when, each], 0)
    now_low[rows, own] = 1 << 40
    now_up = upper + drift[when[rows, own], own]
    unsure = np.flatnonzero(~(now_low.min(1) > now_up))
    measured = len(unsure)
    if not len(unsure):
        return own, upper, lower, when, 0
    own, upper, lower, when = own.copy(), upper.copy(), lower.copy(), when.copy()
    before = own[unsure]
    best, at = squares(x[unsure], centres[before]), before.copy()
    root = np.minimum(floor_root(best), TOP)
    lower[unsure, before], when[unsure, before] = root, t
    fails = ~(now_low[unsure] ** 2 > STEP2 * best[:, None])
    fails[np.arange(len(unsure)), before] = False
    for j in np.flatnonzero(fails.any(0)):
        some = np.flatnonzero(fails[:, j])
        d = squares(x[unsure[some]], centres[j])
        measured += len(some)
        lower[unsure[some], j], when[unsure[some], j] = np.minimum(floor_root(d), TOP), t
        nearer = (d < best[some]) | ((d == best[some]) & (j < at[some]))
        best[some[nearer]], at[some[nearer]] = d[nearer], j
    own[unsure] = at
    upper[unsure] = np.minimum(floor_root(best) + 1, TOP)
    return own, upper, lower, when, measured


def _state(row: pa.RecordBatch, n: int, k: int):
    read = lambda c, kind: np.frombuffer(row.column(c)[0].as_py(), kind)
    return (read(2, "<u2").astype(np.int64), read(3, "<u4").astype(np.int64), read(4, "<u4").astype(np.int64).reshape(n, k), read(5, "<u2").astype(np.int64).reshape(n, k))


def _block(row: pa.RecordBatch, centres: np.ndarray, drift: np.ndarray | None, t: int):
    """(data, own, upper, lower, when, measured) of a block after round ``t``."""
    k, dim = centres.shape
    n = len(row.column(0)[0])
    x = wide(row.column(1)[0].as_py(), n, dim)
    if drift is None:
        own, _, upper, lower = first_round(x, centres)
        return x, own, upper, lower, np.full((n, k), t), n * k
    return (x, *next_round(x, centres, drift, t, *_state(row, n, k)))


def _pass(rows: DataFrame, centres: np.ndarray, drift: np.ndarray | None, t: int) -> DataFrame:
    """Blocks with their new state, and rows (cluster, pos, total) with the task's sums; pos -1 counts vectors, cluster -1 distances."""
    id_type = dict(rows.dtypes)["ids"]
    k, dim = centres.shape

    def run(batches):
        sums, counts, work, schema = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0, None
        for batch in batches:
            schema = batch.schema
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x, own, upper, lower, when, measured = _block(row, centres, drift, t)
                work += measured
                for c in range(dim):  # exact: a block's sums stay far below 2^53
                    sums[:, c] += np.bincount(own, x[:, c], k).astype(np.int64)
                counts += np.bincount(own, minlength=k)
                held = [a.astype(kind).tobytes() for a, kind in ((own, "<u2"), (upper, "<u4"), (lower, "<u4"), (when, "<u2"))]
                yield pa.RecordBatch.from_arrays(
                    [row.column(0), row.column(1), *(pa.array([h], pa.binary()) for h in held), *(pa.nulls(1, c) for c in (pa.int32(), pa.int32(), pa.int64()))], names=fields)
        if schema is not None:
            every = np.concatenate([counts[:, None], sums], 1)
            cluster, pos = (a.ravel() for a in np.indices(every.shape))
            total = np.append(every.ravel(), work)
            m = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, schema.field(0).type), *(pa.nulls(m, pa.binary()) for _ in range(5)),
                 pa.array(np.append(cluster, -1).astype(np.int32)), pa.array(np.append(pos - 1, -1).astype(np.int32)), pa.array(total)], names=fields)

    fields = ["ids", "v", "own", "upper", "lower", "seen", "cluster", "pos", "total"]
    return rows.mapInArrow(run, f"ids {id_type}, v binary, own binary, upper binary, lower binary, seen binary, cluster int, pos int, total long")


def _start(df: DataFrame, id_col: str, vec_col: str, clusters: int, dim: int, scale: int, seed: str) -> tuple[DataFrame, np.ndarray | None]:
    rows = df.select(F.col(id_col).alias("id"), F.lit(None).cast("int").alias("label"), F.col(vec_col).alias("vec"))
    rows = rows.filter(finite(F.col("vec")) & (F.size("vec") == dim))
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    chosen = rows.orderBy(digest.asc_nulls_last(), F.col("id"), F.col("vec")).limit(clusters).select("vec").toArrow().column(0).combine_chunks()
    return rows, whole(chosen, scale) if len(chosen) else None


def _moved(sums: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, int]:
    """Centroids replaced by the floor of their vectors' mean, empty ones as they were; and the distances measured in the round."""
    found = sums.groupBy("cluster", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = {(r.cluster, r.pos): int(r.total) for r in found}
    out = centres.copy()
    for (cluster, pos), n in total.items():
        if pos >= 0 and total[cluster, -1]:
            out[cluster, pos] = n // total[cluster, -1]
    return out, total.get((-1, -1), 0)


def centroids(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = 8, rounds: int = 10,
              dim: int = 64, scale: int = 1024, seed: str = "3:", work: list | None = None) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``work`` gets the number of distances measured in each round but the last.
    """
    if not 0 < clusters < 1 << 16 or not 0 <= rounds < 1 << 16:
        raise ValueError("clusters and rounds must be positive numbers of 16 bits")
    rows, start = _start(df, id_col, vec_col, clusters, dim, scale, seed)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"vec_id {id_type}, cluster int, distance long"
    if start is None:
        empty = rows.limit(0).select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")])
        return empty.withColumn("centroid_sha256", F.lit(""))
    state, path, history = blocks(rows, scale).select("ids", "v"), None, [start]
    for t in range(rounds):
        both, path = kept_from(_pass(state, history[t], _drift(history, t), t), "centroids", path)
        new, measured = _moved(both.filter("cluster is not null").select("cluster", "pos", "total"), history[t])
        if work is not None:
            work.append(measured)
        history.append(new)
        state = both.filter("cluster is null").select("ids", "v", "own", "upper", "lower", "seen")
    last, drift = history[rounds], _drift(history, rounds)

    def finish(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x, own, *_ = _block(row, last, drift, rounds)
                yield pa.RecordBatch.from_arrays([row.column(0).flatten(), pa.array(own.astype(np.int32)), pa.array(squares(x, last[own]))], names=["vec_id", "cluster", "distance"])

    placed = stored(state.mapInArrow(finish, schema), "centroids")
    inertia = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a centroid
    facts = [(j, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(last) if j in inertia]
    table = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _drift(history: list[np.ndarray], t: int) -> np.ndarray | None:
    """Displacement of every centroid from each earlier round to ``t``, rounded up; None before the first round."""
    if t == 0:
        return None
    return np.stack([ceil_root(((history[t] - old) ** 2).sum(1)) for old in history[:t]])
