"""Product codes of vectors, trained with Drake and Hamerly's adaptive bounds.

A vector's integer components are cut into equal parts; each part position has a codebook of entries, improved by a few rounds of
assignment and replacement by the floor of the mean. Between rounds every part keeps, beside its entry, the next ``b`` entries in order
with a lower bound of the distance to each, and one outer bound for all others:

1. when entries have moved, each bound is lowered by its entry's move, the outer one by the largest move, and bounds are put in order
   (each at most the next). If the first is greater than the exact distance to the own entry, nothing else can be as near;
2. otherwise the listed entries are measured in whole numbers, the nearest taken (ties: lower index), and only if the outer bound does
   not exclude the rest, all entries are;
3. ``b`` follows use, block by block: it grows where many parts had to measure all entries, and shrinks to what the lists were read for.

Bounds are whole sixteenths rounded down, moves rounded up, comparisons are of squares: no decision rests on rounding. One pass over
the blocks gives states and sums; sums have parts x entries x length rows a task and meet in a grouped aggregate. A state is a table
in the shared folder; the one before is removed when the next is written. Codebooks (bounded by parameters) travel with the task.

Vectors that are null, empty, or hold null or non-finite components are dropped, as are those whose length is not that of the smallest
kept id among lengths that can be cut into equal parts. Rows with a null id come last in order; equal ids are ordered by vector. With
fewer vectors than entries, codebooks have as many entries as there are vectors. Repeated rows count each. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmill.llm.vectors import beyond, blocks, ceil_root, finite, floor_root, kept_from, whole, wide
from clipmill.session import stored

FAR = 1 << 62
#: Stored bounds have 16 bits; larger ones are cut to this, which only loosens them.
TOP = (1 << 16) - 1


@dataclass(frozen=True)
class Shape:
    """Parts of a vector, entries of a codebook, rounds, factor of components, and the first, least and greatest length of a list."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    b: int = 4
    b_least: int = 2
    b_most: int = 12


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``x`` to every entry."""
    out = np.zeros((len(x), len(book)), np.int64)
    for c in range(x.shape[1]):
        apart = x[:, c, None] - book[None, :, c]
        out += apart * apart
    return out


def to_entries(x: np.ndarray, book: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to its own list of entries."""
    out = np.zeros(which.shape, np.int64)
    for c in range(x.shape[1]):
        apart = x[:, c, None] - book[:, c][which]
        out += apart * apart
    return out


def scan(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From all entries: (the nearest and the b next, b + 1 ordered bounds with the outer one last, distance to the nearest)."""
    d = distances(x, book)
    k = len(book)
    order = np.argsort(d, axis=1, kind="stable")[:, :b + 2]  # equal distances stay in order of index
    near = np.take_along_axis(d, order, 1)
    ids = np.zeros((len(x), b + 1), np.int64)
    low = np.full((len(x), b + 1), TOP, np.int64)
    have = min(k, b + 1)
    ids[:, :have] = order[:, :have]
    ids[:, have:] = order[:, :1]
    have = min(k - 1, b + 1)
    low[:, :have] = np.minimum(floor_root(near[:, 1:1 + have]), TOP)
    return ids, low, near[:, 0]


def update(x: np.ndarray, book: np.ndarray, moved: np.ndarray, ids: np.ndarray, low: np.ndarray):
    """(ids, bounds, distance, entries read from each list, which rows had to measure all entries) after entries have moved."""
    b = ids.shape[1] - 1
    low = low.copy()
    low[:, :b] -= moved[ids[:, 1:]]
    low[:, b] -= moved.max()
    low = np.minimum.accumulate(np.maximum(low, 0)[:, ::-1], axis=1)[:, ::-1]
    d = to_entries(x, book, ids[:, :1])[:, 0]
    read = (~beyond(low[:, :b], d[:, None])).sum(1)
    full = np.zeros(len(x), bool)
    unsure = np.flatnonzero(~beyond(low[:, 0], d))
    if len(unsure):
        own = ids[unsure]
        each = to_entries(x[unsure], book, own)
        each[:, 1:][own[:, 1:] == own[:, :1]] = FAR  # an unused place of the list
        order = np.lexsort((own, each), axis=1)
        own, each = np.take_along_axis(own, order, 1), np.take_along_axis(each, order, 1)
        ids = ids.copy()
        ids[unsure], d[unsure] = own, each[:, 0]
        low[unsure, :b] = np.minimum(np.minimum(floor_root(each[:, 1:]), TOP), low[unsure, b:])
        rest = unsure[~beyond(low[unsure, b], d[unsure])]
        full[rest] = True
        if len(rest):
            ids[rest], low[rest], d[rest] = scan(x[rest], book, b)
    return ids, low, d, read, full


def resized(ids: np.ndarray, low: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of another length: what is cut off passes into the outer bound, new places are unused."""
    now = ids.shape[1] - 1
    if b < now:
        return ids[:, :b + 1], low[:, :b + 1]
    more = b - now
    return np.concatenate([ids, np.repeat(ids[:, :1], more, 1)], 1), np.concatenate([low, np.repeat(low[:, -1:], more, 1)], 1)


def adapted(b: int, read: np.ndarray, full: np.ndarray, shape: Shape) -> int:
    """The list length for the next round."""
    if len(full) and full.mean() > 1 / 8:
        return min(2 * b, shape.b_most)
    wanted = int(np.quantile(read, 0.95)) + 1 if len(read) else b
    return min(max(wanted, shape.b_least), b)


def _assigned(data, n: int, shape: Shape, books: np.ndarray, moved, b: int, state):
    """(codes, distances, new list length, state bytes) of one block."""
    p = data.shape[1] // shape.parts
    cut = lambda j: data[:, j * p:(j + 1) * p]
    if state is None:
        found = [scan(cut(j), books[j], b) for j in range(shape.parts)]
        after = b
    else:
        ids, low = np.frombuffer(state[0], np.uint8).reshape(shape.parts, n, b + 1), np.frombuffer(state[1], "<u2").reshape(shape.parts, n, b + 1)
        seen = [update(cut(j), books[j], moved[j], ids[j].astype(np.int64), low[j].astype(np.int64)) for j in range(shape.parts)]
        after = adapted(b, np.concatenate([s[3] for s in seen]), np.concatenate([s[4] for s in seen]), shape)
        found = [(*resized(s[0], s[1], after), s[2]) for s in seen]
    codes = np.stack([f[0][:, 0] for f in found], 1)
    held = b"".join(f[0].astype(np.uint8).tobytes() for f in found), b"".join(f[1].astype("<u2").tobytes() for f in found)
    return codes, np.stack([f[2] for f in found], 1), after, held


def _pass(rows: DataFrame, shape: Shape, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """One round: blocks with their new state, and rows (part, entry, pos, total) with the task's sums (pos -1: counts)."""
    names = rows.columns[:3]
    types = dict(rows.dtypes)
    parts, k, p = books.shape

    def run(batches):
        sums, counts = np.zeros((parts, k, p), np.int64), np.zeros((parts, k), np.int64)
        schema = None
        for batch in batches:
            schema = batch.schema
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n = len(row.column(0)[0])
                data = wide(row.column(2)[0].as_py(), n, parts * p)
                state = None if moved is None else (row.column(4)[0].as_py(), row.column(5)[0].as_py())
                b = shape.b if moved is None else row.column(3)[0].as_py()
                codes, _, after, held = _assigned(data, n, shape, books, moved, b, state)
                for j in range(parts):
                    counts[j] += np.bincount(codes[:, j], minlength=k)
                    for c in range(p):  # exact: a block's sums stay far below 2^53
                        sums[j, :, c] += np.bincount(codes[:, j], data[:, j * p + c], k).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:3], pa.array([after], pa.int32()), pa.array([held[0]], pa.binary()), pa.array([held[1]], pa.binary()), *[pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]], names=fields)
        if schema is not None:
            every = np.concatenate([counts[:, :, None], sums], 2)
            part, entry, pos = (a.ravel() for a in np.indices(every.shape))
            some = np.repeat((counts > 0).ravel(), p + 1)
            m = int(some.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, schema.field(c).type) for c in range(3)] + [pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())]
                + [pa.array(a[some].astype(np.int32)) for a in (part, entry, pos - 1)] + [pa.array(every.ravel()[some])], names=fields)

    fields = [*names, "b", "near", "low", "part", "entry", "pos", "total"]
    schema = ", ".join(f"{c} {types[c]}" for c in names) + ", b int, near binary, low binary, part int, entry int, pos int, total long"
    return rows.mapInArrow(run, schema)


def _improved(sums: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with used entries replaced by the floor of their parts' mean; parts x entries x (length + 1) rows."""
    found = sums.groupBy("part", "entry", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = {(r.part, r.entry, r.pos): int(r.total) for r in found}
    out = books.copy()
    for (part, entry, pos), n in total.items():
        if pos >= 0:
            out[part, entry, pos] = n // total[part, entry, -1]
    return out


def _start(df: DataFrame, id_col: str, vec_col: str, label_col: str, shape: Shape) -> tuple[DataFrame, np.ndarray | None]:
    """Usable rows (id, label, vec) and the first codebooks."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    rows = rows.filter(finite(F.col("vec")) & (F.size("vec") % shape.parts == 0))
    order = [F.col("id").asc_nulls_last(), F.col("vec")]
    first = rows.orderBy(*order).select(F.size("vec").alias("dim")).first()
    if first is None:
        return rows, None
    rows = rows.filter(F.size("vec") == first.dim)
    chosen = rows.orderBy(*order).limit(shape.entries).select("vec").toArrow().column(0).combine_chunks()
    start = whole(chosen, shape.scale)
    return rows, start.reshape(len(start), shape.parts, -1).transpose(1, 0, 2).copy()


def train(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shape: Shape = Shape()):
    """(last state of all blocks, final codebooks, moves of the last round); codebooks are None without usable vectors."""
    if not 0 < shape.entries <= 256:
        raise ValueError("a codebook holds 1 to 256 entries")
    rows, books = _start(df, id_col, vec_col, label_col, shape)
    if books is None:
        return rows, None, None
    state, path, moved = blocks(rows, shape.scale), None, None
    for _ in range(shape.rounds):
        both, path = kept_from(_pass(state, shape, books, moved), "vector-codes", path)
        new = _improved(both.filter("part is not null").select("part", "entry", "pos", "total"), books)
        moved = ceil_root(((new - books) ** 2).sum(2))
        books, state = new, both.filter("part is null").select("ids", "labels", "v", "b", "near", "low")
    return state, books, moved


def vector_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shape: Shape = Shape()) -> DataFrame:
    """One row per kept vector: vec_id, code (two hex digits a part), error, label, label_error, codebooks_sha256."""
    state, books, moved = train(df, id_col, vec_col, label_col, shape)
    id_type, label_type = (df.schema[c].dataType.simpleString() for c in (id_col, label_col))
    if books is None:
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        return state.limit(0).select(F.col("id").alias("vec_id"), none("string", "code"), none("bigint", "error"), "label", none("bigint", "label_error"), none("string", "codebooks_sha256"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, labels = row.column(0).flatten(), row.column(1).flatten()
                data = wide(row.column(2)[0].as_py(), len(ids), books.shape[0] * books.shape[2])
                b = shape.b if moved is None else row.column(3)[0].as_py()
                held = None if moved is None else (row.column(4)[0].as_py(), row.column(5)[0].as_py())
                codes, d, _, _ = _assigned(data, len(ids), shape, books, moved, b, held)
                text = codes.astype(np.uint8).tobytes().hex()
                size = 2 * shape.parts
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([text[at:at + size] for at in range(0, len(text), size)], pa.string()), pa.array(d.sum(1))], names=["vec_id", "label", "code", "error"])

    coded = stored(state.mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error long"), "vector-codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label", "label_error", F.lit(digest).alias("codebooks_sha256"))
