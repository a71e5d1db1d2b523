"""Vector codes and centroid clustering against plain numpy: edges, ties, adaptive lists and bounds."""

import hashlib
import math

import numpy as np
import pytest

from clipmill.llm import centroids, vector_codes, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id int, code string, cluster int"


def plain_codes(rows, shape):
    """(vec_id, code, error, label) of the kept rows and the final codebooks, by whole distance tables."""
    kept = sorted((r for r in rows if good(r[1]) and len(r[1]) % shape.parts == 0), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.array([[math.floor(shape.scale * v) for v in r[1]] for r in kept]).reshape(len(kept), shape.parts, -1)
    books = x[:shape.entries].transpose(1, 0, 2).copy()
    for t in range(shape.rounds + 1):
        d = np.stack([((x[:, j, None] - books[j][None]) ** 2).sum(2) for j in range(shape.parts)], 1)
        code, error = d.argmin(2), d.min(2).sum(1)
        if t < shape.rounds:
            for j in range(shape.parts):
                for e in range(books.shape[1]):
                    own = x[code[:, j] == e, j]
                    if len(own):
                        books[j, e] = own.sum(0) // len(own)
    return [(r[0], bytes(c.astype(np.uint8)).hex(), int(e), r[2]) for r, c, e in zip(kept, code, error)], books


def plain_clusters(rows, k, rounds, dim, scale, seed="3:"):
    kept = [r for r in rows if good(r[1]) and len(r[1]) == dim]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"{seed}{i}".encode()).hexdigest()
    kept.sort(key=lambda r: (digest(r[0]), r[0] or 0, r[1]))
    x = np.array([[math.floor(scale * v) for v in r[1]] for r in kept])
    c = x[:k].copy()
    for t in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        if t < rounds:
            c = np.stack([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    return [(r[0], int(j), int(m)) for r, j, m in zip(kept, own, d.min(1))], c


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def f32(v):
    return [float(np.float32(x)) for x in v]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 1, (5, 64))
    out = [(int(i), f32(centre[i % 5] + rng.normal(0, 0.3, 64)), [None, 1, 2][i % 3], 0, "x", 9) for i in rng.permutation(600)]
    out += [(1000 + i, [float(i % 2)] * 64, 3, 0, "x", 9) for i in range(20)]  # many equal vectors: ties everywhere
    out += [out[0], out[0], (5, f32(rng.normal(0, 1, 64)), 1, 0, "x", 9), (None, f32(rng.normal(0, 1, 64)), None, 0, "x", 9)]
    out += [(2000, None, 1, 0, "x", 9), (2001, [], 1, 0, "x", 9), (2002, [None] * 64, 1, 0, "x", 9), (2003, [float("nan")] * 64, 1, 0, "x", 9)]
    out += [(2004, [float("inf")] + [0.0] * 63, 1, 0, "x", 9), (2005, [0.5] * 32, 1, 0, "x", 9), (2006, [0.5] * 63, 1, 0, "x", 9), (-1, [0.5] * 7, 1, 0, "x", 9)]
    return out


@pytest.mark.parametrize("shape", [vector_codes.Shape(), vector_codes.Shape(parts=8, entries=20, rounds=5, b=2, b_most=6), vector_codes.Shape(parts=4, entries=3, rounds=4), vector_codes.Shape(rounds=0)])
def test_vector_codes(spark, rows, shape):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = vector_codes.vector_codes(df, shape=shape).collect()
    want, books = plain_codes(rows, shape)
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in got), key=repr) == sorted(want, key=repr)
    total = {label: sum(w[2] for w in want if w[3] == label) for label in (None, 1, 2, 3)}
    assert all(r.label_error == total[r.label] for r in got)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()}


def test_few_and_no_vectors(spark, rows):
    few = spark.createDataFrame(rows[:5], SCHEMA)
    got = vector_codes.vector_codes(few).collect()
    assert [r.error for r in got] == [0] * 5 and len({r.code for r in got}) == 5
    assert {r.cluster for r in centroids.centroids(few).collect()} == {0, 1, 2, 3, 4}
    for df in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)):
        assert vector_codes.vector_codes(df).collect() == [] and centroids.centroids(df).collect() == []


def test_lists_shrink_grow_and_stay_exact():
    rng = np.random.default_rng(4)
    shape = vector_codes.Shape(b=4, b_least=2, b_most=12)
    x, book = rng.integers(-60, 60, (500, 4)), rng.integers(-60, 60, (64, 4))
    ids, low, _ = vector_codes.scan(x, book, 4)
    lengths = set()
    for t, reach in enumerate([1, 1, 40, 40, 1, 1, 1, 15, 60, 1, 1]):
        new = book + rng.integers(-reach, reach + 1, book.shape)
        moved = vectors.ceil_root(((new - book) ** 2).sum(1))
        book = new
        ids, low, d, read, full = vector_codes.update(x, book, moved, ids, low)
        table = vector_codes.distances(x, book)
        assert (ids[:, 0] == table.argmin(1)).all() and (d == table.min(1)).all()
        b = vector_codes.adapted(ids.shape[1] - 1, read, full, shape)
        ids, low = vector_codes.resized(ids, low, b)
        lengths.add(b)
        exact = vectors.floor_root(np.take_along_axis(table, ids[:, 1:], 1))
        own = ids[:, 1:] == ids[:, :1]
        assert (low[:, :-1] <= np.where(own, 1 << 40, exact)).all()
        others = table.copy()
        np.put_along_axis(others, ids, 1 << 40, 1)
        assert (low[:, -1] <= vectors.floor_root(others.min(1))).all()
    assert len(lengths) > 2 and max(lengths) > 4


@pytest.mark.parametrize("k, rounds, scale", [(8, 10, 1024), (3, 1, 1024), (25, 7, 4), (8, 0, 1024)])
def test_centroids(spark, rows, k, rounds, scale):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    work = []
    got = centroids.centroids(df, clusters=k, rounds=rounds, scale=scale, work=work).collect()
    want, c = plain_clusters(rows, k, rounds, 64, scale)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == sorted(want, key=repr)
    total = {j: sum(w[2] for w in want if w[1] == j) for j in range(k)}
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (total[r.cluster], sum(total.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster].tolist())).encode()).hexdigest()
    if rounds > 5:
        assert work[-1] < work[0] / 2  # bounds spare distances


def test_displacement_is_less_than_summed_drifts():
    swing = [np.array([[0, 0]]), np.array([[300, 0]]), np.array([[10, 0]])]
    assert centroids._drift(swing, 2)[:, 0].tolist() == [160, 16 * 290]


def test_bounds_are_exact():
    d = np.array([0, 1, 2, 3, 15, 16, 17, 10**6, 10**6 + 1, 2**40 + 1])
    assert vectors.floor_root(d).tolist() == [math.isqrt(256 * int(v)) for v in d]
    up = vectors.ceil_root(d)
    assert all((int(u) - 1) ** 2 < 256 * int(v) <= int(u) ** 2 for u, v in zip(up[1:], d[1:]))
    with pytest.raises(ValueError):
        vectors.whole(__import__("pyarrow").array([[1e30]]), 256)
