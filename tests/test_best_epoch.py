"""Best epoch and early stop from parts of a run equal the plain fold, however rows are dealt out."""

import math
import random

import numpy as np
import pytest

from clipmill.operators import gates as G


def fold(rows, delta, patience, sign):
    best = best_epoch = None
    bad = 0
    for epoch, value in rows:
        last = epoch
        high = lambda v: math.inf if math.isnan(v) else sign * v
        if best is None or (value is not None and high(value) > high(best) + delta):
            best, best_epoch, bad = value, epoch, 0
        else:
            bad += 1
            if bad >= patience:
                return best, best_epoch, last, True
    return best, best_epoch, last, False


@pytest.mark.parametrize("maximize", [True, False])
@pytest.mark.parametrize("patience, delta", [(1, 0.0), (3, 0.5), (7, 2.0), (40, 1.0)])
def test_parts_equal_the_fold(spark, maximize, patience, delta):
    rnd = random.Random(patience)
    rows = []
    for run in range(12):
        level = 0.0
        for epoch in range(rnd.choice([1, 2, 30, 300])):
            level += rnd.choice([0, 0, 0.4, 1.0, -0.3]) * (1 if maximize else -1)
            value = rnd.choice([level, level, level + rnd.random(), None if run % 3 == 0 and epoch < 3 else level])
            rows.append((run, 3 * epoch + 1, value))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "run long, epoch long, value double")
    want = {}
    for run in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == run), key=lambda r: r[0])
        want[run] = fold(own, delta, patience, 1 if maximize else -1)
    for n in (1, 5, 64):
        old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            got = {r.run: (r.best_metric, r.best_epoch, r.last_epoch, r.stopped_early) for r in G.best_epoch(df, delta, patience, maximize).collect()}
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
        assert got == want
    assert G.best_epoch(df.limit(0), delta, patience).count() == 0
    with pytest.raises(ValueError):
        G.best_epoch(df, delta, 0)


def test_chain_by_hand():
    last, bad = G.accepted_chain(np.array([1.0, 1.0, 3.0, 2.0, 2.5, 9.0]), np.ones(6, bool), 0.5, 2)
    assert last.tolist() == [2, 2, 2, 5, 5, 5] and bad.tolist() == [2, 2, 2, 0, 0, 0]


def test_runs_inside_a_part_are_folded_there(spark, monkeypatch):
    """Of many runs only those at the ends of parts reach the fold of a run; all equal the plain fold, the run without a name too."""
    rnd = random.Random(8)
    rows = [(run if run else None, epoch, rnd.choice([None, 1.0, rnd.random() * 9])) for run in range(400) for epoch in range(rnd.choice([1, 4, 9]))]
    df = spark.createDataFrame(rows, "run long, epoch long, value double")
    want = {run: fold([r[1:] for r in rows if r[0] == run], 0.5, 3, 1) for run in {r[0] for r in rows}}
    tables, write = [], G.stored
    monkeypatch.setattr(G, "stored", lambda *a: tables.append(write(*a)) or tables[-1])
    got = {r.run: (r.best_metric, r.best_epoch, r.last_epoch, r.stopped_early) for r in G.best_epoch(df, 0.5, 3).collect()}
    assert got == want
    parts = tables[0].select("part").distinct().count()
    assert tables[0].filter("not whole").select("run").distinct().count() <= 2 * parts < len(want) / 4
