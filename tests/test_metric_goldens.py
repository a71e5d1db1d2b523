import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipmill.functions.align import _batch
from clipmill.operators import gates as G
from clipmill.operators import metrics as M
from clipmill.operators import predict as P
from clipmill.operators import transcripts as X
from clipmill.operators.ranking import nearest_rank, readiness_index, telemetry_index

WORDS = "array<struct<word:string,start_ms:bigint,end_ms:bigint>>"


def test_wer_golden(spark):
    df = spark.createDataFrame(
        [
            (0, "a", [("hello", 0, 100), ("you", 100, 200)], [("hello", 10, 110), ("me", 110, 210)]),
            (1, "b", [("thank", 0, 100), ("you", 100, 200)], [("thank", 10, 110), ("you", 110, 210), ("now", 210, 300)]),
        ],
        f"index bigint, sample_id string, expected_words {WORDS}, predicted_words {WORDS}")
    m = X.wer_metrics(X.wer_rows(df)).first()
    assert (m.word_error_rate, m.substitutions, m.insertions, m.deletions) == (0.5, 1, 1, 0)
    assert (m.exact_sequence_accuracy, m.timestamp_boundary_count, m.timestamp_boundary_mae_ms) == (0.0, 6, 10.0)


def trace(e, p):
    """Plain reference: full table, then back from the end; deletion, insertion, diagonal in that order."""
    m, n = len(e), len(p)
    c = [[max(i, j) if not i or not j else 0 for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            c[i][j] = min(c[i - 1][j] + 1, c[i][j - 1] + 1, c[i - 1][j - 1] + (e[i - 1] != p[j - 1]))
    s = ins = d = ok = 0
    i, j = m, n
    while i or j:
        if i and (not j or c[i][j] == c[i - 1][j] + 1):
            d, i = d + 1, i - 1
        elif j and (not i or c[i][j] == c[i][j - 1] + 1):
            ins, j = ins + 1, j - 1
        else:
            same = e[i - 1] == p[j - 1]
            s, ok, i, j = s + (not same), ok + same, i - 1, j - 1
    return s, ins, d, ok


def test_alignment_brute_force():
    rnd = random.Random(3)
    es = [[rnd.choice("abcd") for _ in range(rnd.randint(0, 14))] for _ in range(600)]
    ps = [[rnd.choice("abcd") for _ in range(rnd.randint(0, 14))] for _ in range(600)]
    z = lambda rows: [np.zeros(len(r), dtype=np.int64) for r in rows]
    out = _batch(es, ps, z(es), z(es), z(ps), z(ps))
    assert [tuple(r)[:4] for r in out.itertuples(index=False)] == [trace(e, p) for e, p in zip(es, ps)]
    assert (out.boundary_count == 2 * out.matched).all()
    assert tuple(_batch([["a", "b"]], [["b", "a", "c"]], z([["a", "b"]]), z([["a", "b"]]), z([[1, 1, 1]]), z([[1, 1, 1]])).iloc[0])[:4] == (1, 1, 0, 1)


def test_transcript_words(spark):
    v = F.parse_json("x")
    df = spark.createDataFrame([(x,) for x in ('["Hi!",{"word":"You","start_ms":1,"end_ms":null}]', "[]", '["!"]', '[{"word":"a","start_ms":true}]', '[{"word":"a","end_ms":"3"}]')], "x string")
    got = [r[0] for r in df.select(X.words_from_variant(v)).collect()]
    assert [tuple(w) for w in got[0].words] == [("hi", None, None), ("you", 1, None)] and got[0].error is None
    assert [g.error for g in got[1:]] == ["empty_list", "empty_word", "invalid_timestamp", "invalid_timestamp"]


def test_merge(spark):
    e = spark.createDataFrame([("a", [("x", None, None)]), ("b", [("y", None, None)])], f"sample_id string, expected_words {WORDS}")
    p = spark.createDataFrame([("a", [], [("x", 1, 2)]), ("z", [], [("q", 1, 2)])], f"sample_id string, predicted_words {WORDS}, words {WORDS}")
    ok, bad = X.merge_expected_predicted(e, p)
    assert [r.sample_id for r in ok.collect()] == ["a"]
    assert [(r.rule, r.key) for r in bad.collect()] == [("missing_prediction", "b")]
    ok, bad = X.merge_expected_predicted(e, p, allow_missing=True)
    assert {r.sample_id: r.predicted_words[0].word for r in ok.collect()} == {"a": "x", "b": "__missing__"} and bad.count() == 0


PAIRS = [("hello", "hello"), ("hello", "hello"), ("thanks", "hello"), ("thanks", "hello")]


def test_f1_and_phase_gate(spark):
    df = spark.createDataFrame(PAIRS, "t string, p string")
    f1 = {r.label: round(r.f1, 3) for r in M.precision_recall_f1(df, "t", "p").collect()}
    assert f1 == {"hello": 0.667, "thanks": 0.0}
    splits = spark.createDataFrame([("a", "hello", "s1", "train"), ("b", "hello", "s2", "train"), ("c", "hello", "s2", "val"), ("d", "hello", None, "test")], "sample_id string, gloss string, signer_id string, split string")
    g = G.phase_gate(df, "t", "p", splits, "signer_id").first()
    assert (g.macro_f1, g.accuracy, g.weak_classes, g.has_signer_leakage, g.decision) == (0.333, 0.5, "thanks", True, "adjust_strategy")
    assert g.blockers.startswith("macro_f1 0.333 is below Phase 2B threshold 0.750 | ") and g.blockers.endswith("signer leakage detected across train/val/test splits")


def test_readiness(spark):
    off = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "b"), ("b", "a")], "t string, p string")
    lat = spark.createDataFrame([(210.0,), (350.0,), (410.0,)], "v double")
    r = G.readiness_gate(off, off, "t", "p", lat, "v", 19, 20).first()
    assert (r.official_macro_f1, r.p95_ms, r.decision) == (0.733, 410.0, "go")
    bad = spark.createDataFrame([("a", "b"), ("b", "a")], "t string, p string")
    r = G.readiness_gate(bad, off, "t", "p", spark.createDataFrame([(900.0,)], "v double"), "v", 1, 2).first()
    assert r.decision == "no_go" and [b.split()[0] for b in r.blockers.split(" | ")] == ["official", "p95", "stability"]


def test_telemetry(spark):
    df = spark.createDataFrame([(120, "success"), (900, "timeout"), (300, "success")], "latency_ms bigint, outcome string")
    r = M.telemetry_slo(df).first()
    assert (r["count"], r.success_count, round(r.success_rate, 4), r.latency_p95_ms) == (3, 2, 0.6667, 300)
    assert tuple(M.telemetry_slo(df.limit(0)).first()) == (0, 0, 0.0, 0)


@pytest.mark.parametrize("n", [1, 2, 7, 20, 133])
def test_nearest_rank(spark, n):
    rnd = random.Random(n)
    values = [round(rnd.uniform(0, 3000), rnd.choice([0, 1, 7])) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    s = sorted(values)
    assert nearest_rank(df, "v", readiness_index).first().value_at == s[max(0, round(0.95 * (n - 1)))]
    assert nearest_rank(df, "v", telemetry_index).first().value_at == s[max(0, int(0.95 * n) - 1)]


def gate(spark, rows, anchors=None):
    labels = [f"g{i}" for i in range(10)]
    schema = "sample_id string, expected_gloss string, first_pass_raw string, first_pass_valid boolean, retry_used boolean, final_gloss string, final_valid boolean, correct boolean"
    df = spark.createDataFrame(rows, schema)
    al = spark.createDataFrame([("x", "g0")], "alias string, canonical string")
    an = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "ord bigint, gloss string")
    return G.anchor_gate(G.anchor_outcomes(G.anchor_rows(df, al, labels)), an).first()


def rows10(change=None):
    out = []
    for i in range(10):
        for k in range(3):
            g = f"g{i}"
            r = [f"s{i}_{k}", g, g, True, False, g, True, True]
            out.append(change(i, k, r) if change else r)
    return out


def test_anchor_gate(spark):
    g = gate(spark, rows10())
    assert g.first_pass and g.final_pass and g.first_reasons == "" and not g.decision_changed
    g = gate(spark, rows10(lambda i, k, r: r[:5] + ["g9", True, False] if i < 4 or (i == 4 and k == 0) else r))
    assert not g.final_pass and "collapse_detected: gloss=g9" in g.final_reasons and g.first_pass
    g = gate(spark, rows10(lambda i, k, r: r[:5] + ["g1", True, False] if i == 0 and k < 2 else r))
    assert g.final_reasons == "per_anchor_below_threshold: g0"
    g = gate(spark, rows10() + [[f"x{k}", "g3", "g3", True, False, "g3", True, True] for k in range(3)])
    assert g.final_reasons == "anchor_support_out_of_range: g3"
    g = gate(spark, rows10(lambda i, k, r: [r[0], r[1], "??", False, True, r[1], True, True] if i == 0 else r))
    assert (g.first_pass, g.final_pass, g.decision_changed, g.retry_helped_rows) == (False, True, True, 3)
    g = gate(spark, rows10(lambda i, k, r: [r[0], r[1], "??", False, True, "", False, False]))
    assert (g.final_mode_gloss, g.final_mode_ratio) == ("__none__", 0.0) and "collapse" not in g.final_reasons


def test_rank_ties(spark):
    s = spark.createDataFrame([("a", "thanks", 1.0), ("a", "hello", 1.0), ("a", "yes", 0.5), ("b", "hello", 1.0), ("c", "hello", 1.0), ("c", "hello", 2.0), ("c", "x", 0.0)], "sample_id string, label string, score double")
    top, bad = P.rank_candidates(s, ["hello", "thanks", "yes"], 2)
    assert [(r.sample_id, r.best_label, [x.label for x in r.top_scores]) for r in top.collect()] == [("a", "hello", ["hello", "thanks"])]
    assert {(r.key, r.rule) for r in bad.collect()} == {("b", "missing_label"), ("c", "missing_label"), ("c", "unexpected_label"), ("c", "duplicate_label")}


def test_batch_summary(spark):
    rows = [("ok", "a", True), ("ok", "b", False), ("ok", None, None), ("uncertain", "c", False), ("error", "d", None)]
    r = G.batch_summary(spark.createDataFrame(rows, "status string, expected_label string, correct boolean")).first()
    assert tuple(r) == (5, 4, 3, 1, 2, 1, 1, 0.25)


def test_best_epoch(spark):
    df = spark.createDataFrame([(1, e, v) for e, v in enumerate([0.5, 0.505, 0.6, 0.6, 0.605, 0.9])], "run int, epoch bigint, value double")
    assert tuple(G.best_epoch(df, 0.01, 2).first()) == (1, 0.6, 2, 4, True)


def test_run_comparison_precedence(spark):
    m = lambda n, a, i: spark.createDataFrame([(n, a, i)], "sample_count bigint, accuracy double, invalid_rate double")
    same = lambda x: spark.createDataFrame([(x,)], "matches_baseline boolean")
    rec = lambda *a, **k: G.run_comparison(*a, **k).first().recommendation
    assert rec(m(5, 0.4, 0.6), m(4, 0.8, 0.0)) == "needs_full_run"
    assert rec(m(5, 0.4, 0.6), m(5, 0.8, 0.0), same(False)) == "not_comparable"
    assert rec(m(5, 0.4, 0.6), m(5, 0.8, 0.0), same(True)) == "enough"
    assert rec(m(5, 0.4, 0.6), m(5, 0.8, 0.0)) == "enough"
    assert rec(m(5, 0.4, 0.0), m(5, 0.8, 0.0)) == "not_enough"


def test_ranking_takes_more_tasks_for_more_scores(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_SCORES", 20)
    s = spark.range(600).selectExpr("concat('s', id div 3) as sample_id", "element_at(array('hello', 'thanks', 'yes'), cast(id % 3 + 1 as int)) as label", "cast(id % 7 as double) as score")
    top, bad = P.rank_candidates(s, ["hello", "thanks", "yes"], 2)
    assert "hashpartitioning(sample_id" in top._jdf.queryExecution().executedPlan().toString()
    assert bad.count() == 0 and top.count() == 200
    assert top.rdd.getNumPartitions() == 30
