"""The character model against plain Python, and what a folded alphabet could not see."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clipmill.llm import characters as c
from clipmill.llm import quality
from clipmill.llm.words import buffers

TEXTS = ["abab", "", None, "Abc äbc", "日本語 日本", "x", "aab abab\nab", "🙂🙂a", "ab\0 12", "abab"]


def plain_model(texts):
    """(p, p with one occurrence taken off) of every n-gram of four characters."""
    levels = {4: Counter(("   " + t)[k:k + 4] for t in texts for k in range(len(t)))}
    for k in (3, 2, 1):
        levels[k] = Counter(g[-k:] for g in levels[k + 1])
    p, less = {"": 1 / (len(levels[1]) + 1)}, {"": 1 / (len(levels[1]) + 1)}
    for k in (1, 2, 3, 4):
        n = [sum(v == x for v in levels[k].values()) for x in (1, 2, 3, 4)]
        d = [0, 0.5, 1.0, 1.5]
        if min(n):
            y = n[0] / (n[0] + 2 * n[1])
            d = [0] + [min(max(x - (x + 1) * y * n[x] / n[x - 1], 0.05), x - 0.05) for x in (1, 2, 3)]
        of = lambda v: d[min(v, 3)]
        context = defaultdict(dict)
        for g, v in levels[k].items():
            context[g[:-1]][g] = v
        for g, v in levels[k].items():
            def prob(counts, below):
                total = sum(counts.values())
                if not total:
                    return below
                return (counts.get(g, 0) - of(counts.get(g, 0))) / total + sum(map(of, counts.values())) / total * below

            p[g] = prob(context[g[:-1]], p[g[1:]])
            without = {**context[g[:-1]], g: v - 1}
            without = {h: w for h, w in without.items() if w}
            less[g] = prob(without, p[g[1:]] if v > 1 else less[g[1:]])
    return p, less


def spelled(a, b):
    return "".join(map(chr, (a >> 21, a & c.LOW, b >> 21, b & c.LOW)))


def test_code_points_and_pairs():
    data, off = buffers(pa.array(TEXTS))
    points, at = c.code_points(data, off)
    assert "".join(map(chr, points)) == "".join(t or "" for t in TEXTS)
    assert np.diff(at).tolist() == [len(t or "") for t in TEXTS]
    a, b = c.pairs(points, at)
    want = [("   " + t)[k:k + 4] for t in TEXTS if t for k in range(len(t))]
    assert [spelled(int(x), int(y)) for x, y in zip(a, b)] == want
    a, b, place, n = c.distinct(points, at)
    assert [spelled(int(a[k]), int(b[k])) for k in place] == want and n.tolist() == np.bincount(place).tolist()


def test_more_letters_than_fit_a_key():
    rng = np.random.default_rng(3)
    points = rng.permutation(np.arange(0x10000, 0x10000 + 70_000)).astype(np.uint32)
    off = np.array([0, 30_000, 70_000])
    a, b, place, n = c.distinct(points, off)
    x, y = c.pairs(points, off)
    assert (a[place] == x).all() and (b[place] == y).all() and (n == 1).all()


@pytest.mark.parametrize("repeat", [1, 40])
def test_model_equals_plain_kneser_ney(spark, repeat):
    rng = np.random.default_rng(repeat)
    texts = TEXTS + ["".join(rng.choice(list("abcd Aä語"), 30, p=[.3, .2, .1, .1, .1, .1, .05, .05])) for _ in range(repeat)]
    rows = spark.createDataFrame([(k % 3, t) for k, t in enumerate(texts)], "block long, text string").repartition(2, "block").sortWithinPartitions("block")
    grams = c.block_grams(rows, "block", "text", 64)
    p, less = plain_model([t or "" for t in texts])
    counts = grams.groupBy("a", "b").agg(F.sum("n").alias("n"))
    model = {spelled(r.a, r.b): r for r in c.kneser_ney(counts).collect()}
    assert set(model) == {g for g in p if len(g) == 4}
    for g, r in model.items():
        assert math.isclose(r.p, p[g], rel_tol=1e-9) and math.isclose(r.logp, math.log(less[g]), rel_tol=1e-9), g
    got = c.score(rows, "block", "text", c.block_values(grams, c.kneser_ney(counts)), 64).collect()
    for r in got:
        t = r.text or ""
        want = -sum(math.log(less[("   " + t)[k:k + 4]]) for k in range(len(t))) / max(len(t), 1)
        assert math.isclose(r.log_ppl, want, rel_tol=1e-9, abs_tol=1e-12)


def capitals():
    """Documents in capitals and digits; every 25th has its letters mixed, with the same word lengths."""
    rng = np.random.default_rng(5)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    odds = rng.dirichlet(np.full(26, 0.5))
    vocabulary = ["".join(rng.choice(letters, rng.integers(3, 9), p=odds)) for _ in range(200)] + ["2024", "1999", "300"]
    rows = []
    for k in range(200):
        words = list(rng.choice(vocabulary, 120))
        junk = k % 25 == 0
        if junk:
            mixed = rng.permutation(list("".join(words)))
            ends = np.cumsum([len(w) for w in words])
            words = ["".join(mixed[e - len(w):e]) for w, e in zip(words, ends)]
        rows.append((k, " ".join(words), "en", junk))
    return rows


def check_capitals(rows, kept):
    assert [r[0] for r in rows if r[3] and r[0] in kept] == []
    assert np.mean([r[0] in kept for r in rows if not r[3]]) > 0.98


def test_letters_that_a_fold_hides_are_judged(spark):
    rows = capitals()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, junk boolean").repartition(3)
    check_capitals(rows, {r.doc_id for r in quality.quality(docs).filter("kept").collect()})


def test_rows_that_are_kept_are_judged_by_every_letter(spark, monkeypatch):
    """The pipeline's form, with many blocks in a task."""
    monkeypatch.setattr(quality, "BLOCK", 5000)
    rows = capitals()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, junk boolean").repartition(3)
    check_capitals(rows, {r.doc_id for r in quality.keep_good(docs).collect()})


def plain_kept(rows):
    """Ids that word rules, plain model and bands keep, without Spark."""
    texts = [r[1] or "" for r in rows]
    _, less = plain_model(texts)
    usable, failed = [], []
    for (_, _, lang), t in zip(rows, texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
        failed.append(len(words) < 50 or 100 * len(covered) > 50 * len(words))
        if len(words) >= 50:
            usable.append((lang, -sum(math.log(less[("   " + t)[k:k + 4]]) for k in range(len(t))) / len(t)))
        else:
            usable.append(None)
    grid = quality.GRID
    median = lambda xs: sorted(round(x * grid) for x in xs)[(len(xs) - 1) // 2] / grid
    of = defaultdict(list)
    for lang, x in filter(None, usable):
        of[lang].append(x)
    mid = {lang: median(xs) for lang, xs in of.items()}
    every = median([abs(x - mid[lang]) for lang, x in filter(None, usable)])
    limits = {}
    for lang, xs in of.items():
        n, mad = len(xs), median([abs(x - mid[lang]) for x in xs])
        dev = max(1.4826 * max(mad, (n * mad + 50 * every) / (n + 50)), 0.01) * math.sqrt(1 + math.pi / 2 / n)
        limits[lang] = mid[lang] - 5 * dev, mid[lang] + 5 * dev
    return [r[0] for r, bad, got in zip(rows, failed, usable) if not bad and limits[got[0]][0] <= got[1] <= limits[got[0]][1]]


def test_rows_that_are_kept_equal_plain_rules_model_and_bands(spark, monkeypatch):
    """Every step of the pipeline's form at once: rules, whole model, perplexity of each document, bands of its language."""
    monkeypatch.setattr(quality, "BLOCK", 5000)
    rng = np.random.default_rng(6)
    cyrillic = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщ")
    rows = [(k, t, "en") for k, t, _, _ in capitals()]
    rows += [(500 + k, t.translate(cyrillic), [None, "ru"][k % 10 > 0]) for k, t, _, _ in capitals()[:80]]
    rows += [(700, None, "en"), (701, "", None), (702, "ONE TWO", "ru"), (703, "SAME THREE WORDS " * 40, "en")]
    rows += [(710 + k, " ".join("".join(rng.choice(list("#$%xyzQ"), 6)) for _ in range(60)), ["en", "ru", None, "xx"][k]) for k in range(4)]
    rows += [(900, rows[3][1], "en"), (900, rows[3][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = [r.doc_id for r in quality.keep_good(docs).collect()]
    want = plain_kept(rows)
    assert 200 < len(want) < len(rows) - 8 and sorted(kept) == sorted(want)
