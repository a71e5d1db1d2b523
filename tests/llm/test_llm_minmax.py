"""Min-max near-dedup against all pairs in plain Python, with short and long lists, edges and the bands' probabilities."""

from collections import Counter

import numpy as np
import pytest

from clipmill.llm import minmax
from clipmill.llm.words import mix
from test_llm_edges import SCHEMA, WORD, _texts


def sets_of(text, size=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def by_all_pairs(rows, num=85):
    """Counter of (doc_id, set size, component)."""
    sets = [sets_of(t) for _, t in rows]
    comp = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if comp[x] != comp[y] and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                low, high = sorted((comp[x], comp[y]))
                comp = [low if c == high else c for c in comp]
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[comp[k]] = min(i, least.get(comp[k], i))
    return Counter((i, len(s), least.get(comp[k]) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def found(df, rule=minmax.Rule()):
    got = minmax.near_groups(df, rule=rule).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)


def test_edges(spark):
    rows = [(1000 - 7 * k, text) for k, text in enumerate(_texts())]
    rows += [rows[0], rows[20], (None, "one two three four"), (None, None)]
    full = [(i, t, "en", "s1", 1, k, True, "x", "y", "z", None, "t", 5, "v") for k, (i, t) in enumerate(rows)]
    assert found(spark.createDataFrame(full, SCHEMA).repartition(3)) == by_all_pairs(rows)
    assert minmax.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("long_list", [100_000, 256, 0])
def test_many_near_copies_and_shared_passages(spark, long_list):
    rng = np.random.default_rng(8)
    base = [f"b{k}" for k in range(200)]
    texts = []
    for k in range(150):  # copies of one text: the base links with most, the copies with few of each other
        w = list(base)
        for at in rng.choice(200, rng.integers(0, 5), replace=False):
            w[at] = f"r{k}_{at}"
        texts.append(" ".join(w))
    passage = [f"p{k}" for k in range(160)]
    for k in range(120):  # a long shared passage, yet below the threshold; a few pairs above it
        own = [f"o{k - k % 6 if k % 6 == 5 else k}_{j}" for j in range(rng.integers(20, 60))]
        texts.append(" ".join(passage + own))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, minmax.Rule(long_list=long_list)) == by_all_pairs(rows)


def test_values_agree_as_often_as_sets():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.85):
        size = 1000
        both = int(round(2 * share * size / (1 + share)))
        union = 2 * size - both
        pool = mix(rng.integers(1, 1 << 60, union).astype(np.uint64))
        a, b = pool[:size], pool[size - both:]
        low, high = minmax.min_max(np.concatenate([a, b]), np.array([0, size]), 600)
        for side in (low, high):
            assert abs((side[0] == side[1]).mean() - both / union) < 0.07
        together = ((low[0] == low[1]).mean() + (high[0] == high[1]).mean()) / 2
        assert abs(together - both / union) < 0.05


def test_bands_find_what_they_promise():
    rng = np.random.default_rng(6)
    rule, size, both = minmax.Rule(), 1000, 919  # 919 / 1081 = 0.85
    values = mix(rng.integers(1, 1 << 60, (300, 2 * size - both)).astype(np.uint64))
    parts = np.concatenate([np.concatenate([v[:size], v[size - both:]]) for v in values])
    keys = minmax.band_keys(parts, np.arange(600) * size, rule.bands, rule.values).reshape(300, 2, -1)
    same = (keys[:, 0] == keys[:, 1])
    assert same.any(1).all() and abs(same.mean() - (both / (2 * size - both)) ** rule.values) < 0.03
    assert (1 - 0.85 ** rule.values) ** rule.bands < 1e-9
