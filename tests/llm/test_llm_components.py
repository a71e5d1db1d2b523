"""Components of a link table against union-find, and how often a round deals the links out."""

import numpy as np

from clipmill.llm import components as c


def smallest(links):
    """{node: smallest node of its component} in plain Python."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((root(a), root(b)))
            up[high] = low
    return {x: root(x) for x in list(up)}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(8)
    chain = [int(x) for x in rng.permutation(np.arange(1000, 1200))]
    links = [*zip(chain, chain[1:]), *((5000 + k, 7000) for k in range(150)), (7000, 7001), (-3, 9), (9, -3), (9, -3), (4, 4)]
    links += [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))]
    got = c.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len({r.node for r in got}) == len(got)
    assert {r.node: r.comp for r in got} == smallest(links)
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_round_shuffles_the_links_four_times(spark, monkeypatch):
    """Joins of the larger neighbours of all nodes, minima over both directions and two work tables made it six."""
    shuffles, store = [], c.stored

    def counting(df, name):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return store(df, name)

    monkeypatch.setattr(c, "stored", counting)
    c.components(spark.createDataFrame([(k, 0) for k in range(1, 50)], "a long, b long"))
    first, *rounds = shuffles  # links of a star: one round, and one that changes nothing
    assert first == 1 and sum(rounds) <= 2 * 4
