"""Go/no-go decisions: each gate is a one-row table with its reasons in fixed order."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipmill import constants as K
from clipmill.operators.labels import alias_table, beside, lookup_alias
from clipmill.operators.metrics import precision_recall_f1, ratio
from clipmill.operators.ranking import nearest_rank, readiness_index
from clipmill.operators.splits import overlap_counts
from clipmill.functions.text import normalize_gloss, strip
from clipmill.session import stored


def _reasons(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in pairs]))


def phase_gate(
    pred: DataFrame, truth: str, predicted: str, splits: DataFrame, signer: str,
    min_macro: float = K.PHASE_MIN_MACRO_F1, weak_below: float = K.PHASE_WEAK_F1,
) -> DataFrame:
    """macro F1, weak labels and signer leakage -> adjust_strategy or proceed_to_phase2b.

    Thresholds see scores rounded to 3 digits, as reports show them.
    """
    per = precision_recall_f1(pred, truth, predicted).withColumn("f1_r", F.round("f1", 3))
    weak = F.sort_array(F.collect_list(F.when(F.col("f1_r") < F.lit(weak_below), F.col("label"))))
    scores = per.agg(
        F.count(F.lit(1)).alias("class_count"), F.sum("support").alias("sample_count"),
        F.round(ratio(F.sum("tp"), F.sum("support")), 3).alias("accuracy"),
        F.round(F.avg("f1"), 3).alias("macro_f1"), weak.alias("weak"),
    )
    all_ = beside(s=scores, l=overlap_counts(splits, signer))
    s, leak = F.col("s"), F.col("l.has_leakage")
    n_weak = F.size("s.weak")
    blockers = _reasons(
        (s["macro_f1"] < F.lit(min_macro), F.format_string(f"macro_f1 %.3f is below Phase 2B threshold {min_macro:.3f}", s["macro_f1"])),
        (n_weak > 0, F.format_string(f"%d weak classes below F1 {weak_below:.2f}: %s", n_weak, F.array_join(F.slice("s.weak", 1, 10), ", "))),
        (leak, F.lit("signer leakage detected across train/val/test splits")),
    )
    return all_.select(
        s["sample_count"].alias("sample_count"), s["class_count"].alias("class_count"),
        s["accuracy"].alias("accuracy"), s["macro_f1"].alias("macro_f1"),
        F.array_join("s.weak", ",").alias("weak_classes"), leak.alias("has_signer_leakage"),
        F.array_join(blockers, " | ").alias("blockers"),
        F.when(F.size(blockers) > 0, "adjust_strategy").otherwise("proceed_to_phase2b").alias("decision"),
    )


def readiness_gate(
    official: DataFrame, iteration: DataFrame, truth: str, predicted: str,
    latencies: DataFrame, latency: str, stable_runs: int, total_runs: int,
    min_macro: float = K.READY_MIN_MACRO_F1, max_p95: float = K.READY_MAX_P95_MS,
    min_stability: float = K.READY_MIN_STABILITY,
) -> DataFrame:
    """Quality on the group-independent split, p95 latency and run stability -> go or no_go."""
    if total_runs <= 0 or not 0 <= stable_runs <= total_runs:
        raise ValueError("run counts out of range")
    quality = lambda df: precision_recall_f1(df, truth, predicted).agg(
        F.round(F.avg("f1"), 3).alias("macro_f1"), F.sum("support").alias("n")
    )
    all_ = beside(o=quality(official), i=quality(iteration), p=nearest_rank(latencies, latency, readiness_index))
    macro, p95 = F.col("o.macro_f1"), F.round(F.col("p.value_at"), 3)
    stability = F.round(F.lit(stable_runs / total_runs), 3)
    blockers = _reasons(
        (macro < F.lit(min_macro), F.format_string(f"official signer-independent macro_f1 %.3f is below required {min_macro:.3f}", macro)),
        (p95 > F.lit(float(max_p95)), F.format_string(f"p95 latency %.1fms exceeds allowed {max_p95:.1f}ms", p95)),
        (stability < F.lit(min_stability), F.format_string(f"stability %.3f is below required {min_stability:.3f}", stability)),
    )
    return all_.select(
        macro.alias("official_macro_f1"), F.col("o.n").alias("official_samples"),
        F.col("i.macro_f1").alias("iteration_macro_f1"), F.col("i.n").alias("iteration_samples"),
        p95.alias("p95_ms"), stability.alias("stability"),
        F.array_join(blockers, " | ").alias("blockers"),
        F.when(F.size(blockers) > 0, "no_go").otherwise("go").alias("decision"),
    )


def anchor_rows(rows: DataFrame, aliases: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Add expected, first, final labels (null when invalid) to retry-log rows."""
    lookup = alias_table(aliases)
    df = rows
    for src, out in (("expected_gloss", "expected"), ("first_pass_raw", "first"), ("final_gloss", "final")):
        df = lookup_alias(df.withColumn("_n", normalize_gloss(F.col(src))), "_n", lookup, labels, out).drop("_n")
    return df.withColumn("first", F.when(F.col("first_pass_valid"), F.col("first"))).withColumn(
        "final", F.when(F.col("final_valid"), F.col("final"))
    )


def unresolved_expected(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("expected").isNull()).select(
        F.lit("expected_not_in_allowlist").alias("rule"), F.col("sample_id").alias("key"), F.col("expected_gloss").alias("detail")
    )


def anchor_violations(anchors: DataFrame, resolved: DataFrame, count: int = K.ANCHOR_COUNT) -> DataFrame:
    """(rule, key, detail): another number of anchors than ``count``, and rows whose expected label does not resolve."""
    n = anchors.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != count)
    return n.select(F.lit("anchor_count").alias("rule"), F.lit("anchors").alias("key"), F.col("n").cast("string").alias("detail")).unionByName(unresolved_expected(resolved))


def anchor_outcomes(resolved: DataFrame) -> DataFrame:
    """Rows per (expected, first, final) and rows the retry helped: at most one row per label triple.

    One pass over the log; every figure of the gate comes from this small table.
    """
    helped = F.col("retry_used") & ~F.col("first_pass_valid") & F.col("correct")
    return resolved.groupBy("expected", "first", "final").agg(F.count(F.lit(1)).alias("n"), F.count_if(helped).alias("helped"))


def anchor_table(outcomes: DataFrame, anchors: DataFrame, min_accuracy: float = K.ANCHOR_MIN_ACCURACY) -> DataFrame:
    """(ord, gloss, support, first/final accuracy and pass) for every anchor, also those without rows."""
    n_if = lambda c: F.sum(F.when(F.col(c) == F.col("expected"), F.col("n")).otherwise(0))
    per = outcomes.groupBy(F.col("expected").alias("gloss")).agg(
        F.sum("n").alias("support"), n_if("first").alias("first_ok"), n_if("final").alias("final_ok"))
    out = anchors.select("ord", "gloss").join(per, "gloss", "left").na.fill(0, ["support", "first_ok", "final_ok"])
    for p in ("first", "final"):
        out = out.withColumn(f"{p}_accuracy", ratio(F.col(f"{p}_ok"), F.col("support")))
        out = out.withColumn(f"{p}_pass", F.col(f"{p}_accuracy") >= F.lit(min_accuracy))
    return out.select("ord", "gloss", "support", "first_accuracy", "first_pass", "final_accuracy", "final_pass")


def anchor_gate(
    outcomes: DataFrame, anchors: DataFrame,
    min_accuracy: float = K.ANCHOR_MIN_ACCURACY, max_share: float = K.COLLAPSE_MAX_SHARE,
    min_support: int = K.ANCHOR_MIN_SUPPORT, max_support: int = K.ANCHOR_MAX_SUPPORT,
) -> DataFrame:
    """First-pass and final decision over the anchors, with the effect of the retry."""
    outcomes = stored(outcomes, "anchor-outcomes")  # small, read three times
    table = anchor_table(outcomes, anchors, min_accuracy)
    ordered = lambda cond: F.transform(
        F.sort_array(F.collect_list(F.when(cond, F.struct("ord", "gloss")))), lambda x: x["gloss"]
    )
    facts = table.agg(
        F.count(F.lit(1)).alias("anchor_count"), F.sum("support").alias("rows"),
        ordered((F.col("support") < min_support) | (F.col("support") > max_support)).alias("range"),
        ordered(~F.col("first_pass")).alias("first_low"), ordered(~F.col("final_pass")).alias("final_low"),
    )
    on_anchor = outcomes.join(anchors.select(F.col("gloss").alias("expected")), "expected", "left_semi")
    said = on_anchor.select("n", F.explode(F.array(
        F.struct(F.lit("first").alias("p"), F.col("first").alias("label")),
        F.struct(F.lit("final").alias("p"), F.col("final").alias("label")),
    )).alias("s")).select("s.p", "s.label", "n").filter("label is not null")
    counts = said.groupBy("p", "label").agg(F.sum("n").alias("n"))
    mode = lambda p: F.max(F.when(F.col("p") == p, F.struct("n", "label")))
    modes = counts.agg(mode("first").alias("first"), mode("final").alias("final"))
    retry = outcomes.agg(F.coalesce(F.sum("helped"), F.lit(0)).alias("helped"))
    one = beside(f=facts, m=modes, r=retry)

    def decide(p: str) -> tuple[Column, Column, Column]:
        label = F.coalesce(F.col(f"m.{p}.label"), F.lit(K.NONE_LABEL))
        share = ratio(F.coalesce(F.col(f"m.{p}.n"), F.lit(0)), F.col("f.rows"))
        low = F.col(f"f.{p}_low")
        reasons = _reasons(
            (F.size("f.range") > 0, F.concat(F.lit("anchor_support_out_of_range: "), F.array_join("f.range", ", "))),
            (F.size(low) > 0, F.concat(F.lit("per_anchor_below_threshold: "), F.array_join(low, ", "))),
            (share > F.lit(max_share), F.concat(
                F.lit("collapse_detected: gloss="), label, F.lit(" ratio="), F.round(share, 6).cast("string"), F.lit(f" threshold={max_share}"))),
        )
        return label, share, reasons

    cols = []
    for p in ("first", "final"):
        label, share, reasons = decide(p)
        cols += [
            (F.size(reasons) == 0).alias(f"{p}_pass"), F.array_join(reasons, " | ").alias(f"{p}_reasons"),
            label.alias(f"{p}_mode_gloss"), share.alias(f"{p}_mode_ratio"),
        ]
    out = one.select(F.col("f.anchor_count").alias("anchor_count"), *cols, F.col("r.helped").alias("retry_helped_rows"))
    return out.withColumn("decision_changed", F.col("first_pass") != F.col("final_pass"))


def run_identity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do two runs list the same samples and expected labels in the same order?"""
    side = lambda df, p: df.select(
        "index", F.lit(True).alias(f"{p}_there"), strip(F.col("sample_id")).alias(f"{p}_id"),
        normalize_gloss(F.col("expected_gloss")).alias(f"{p}_expected"),
    )
    j = side(a, "a").join(side(b, "b"), "index", "full_outer")
    id_ok, exp_ok = F.col("a_id").eqNullSafe(F.col("b_id")), F.col("a_expected").eqNullSafe(F.col("b_expected"))
    bad = F.when(~(id_ok & exp_ok), F.struct("index", "a_id", "a_expected", "b_id", "b_expected"))
    out = j.agg(
        F.count("a_there").alias("baseline_sample_count"), F.count("b_there").alias("candidate_sample_count"),
        F.coalesce(F.bool_and(id_ok), F.lit(True)).alias("sample_id_order_matches"),
        F.coalesce(F.bool_and(exp_ok), F.lit(True)).alias("expected_order_matches"),
        F.min(bad).alias("m"),
    )
    return out.select(
        (F.col("sample_id_order_matches") & F.col("expected_order_matches")).alias("matches_baseline"),
        "sample_id_order_matches", "expected_order_matches", "baseline_sample_count", "candidate_sample_count",
        F.col("m.index").alias("mismatch_index"),
        F.col("m.a_id").alias("mismatch_baseline_id"), F.col("m.a_expected").alias("mismatch_baseline_expected"),
        F.col("m.b_id").alias("mismatch_candidate_id"), F.col("m.b_expected").alias("mismatch_candidate_expected"),
    )


def identity_violations(df: DataFrame) -> DataFrame:
    """Blank or repeated sample ids: (rule, key, detail)."""
    sid = strip(F.coalesce(F.col("sample_id"), F.lit("")))
    n = df.groupBy(sid.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.when(F.col("key") == "", "empty_sample_id").when(F.col("n") > 1, "duplicate_sample_id")
    return n.withColumn("rule", rule).filter("rule is not null").select("rule", "key", F.col("n").cast("string").alias("detail"))


def missing_metrics(metrics: DataFrame, required: Sequence[str]) -> list[str]:
    """Required metric columns that a metrics table lacks."""
    return sorted(set(required) - set(metrics.columns))


def constrained_comparison(free: DataFrame, constrained: DataFrame) -> DataFrame:
    """Accuracy and invalid-rate deltas of the constrained run against free generation."""
    lacking = missing_metrics(free, ("accuracy", "invalid_rate")) + missing_metrics(constrained, ("constrained_top1_accuracy",))
    if lacking:
        raise ValueError("metrics missing: " + ", ".join(lacking))
    return beside(f=free, c=constrained).select(
        F.col("f.accuracy").alias("free_accuracy"), F.col("f.invalid_rate").alias("free_invalid_rate"),
        F.col("c.constrained_top1_accuracy").alias("constrained_accuracy"),
        (F.col("c.constrained_top1_accuracy") - F.col("f.accuracy")).alias("accuracy_delta"),
        (F.lit(0.0) - F.col("f.invalid_rate")).alias("invalid_rate_delta"),
    )


def activation(comparison: DataFrame) -> DataFrame:
    """Active when outputs are invalid at times and the constrained run does better."""
    active = (F.col("free_invalid_rate") > 0) & F.col("constrained_accuracy").isNotNull() & (
        F.col("constrained_accuracy") > F.col("free_accuracy")
    )
    active = F.coalesce(active, F.lit(False))
    return comparison.select(
        active.alias("active"),
        F.when(active, "invalid_outputs_with_constrained_gain").otherwise("no_invalid_outputs_with_constrained_gain").alias("reason"),
        "free_accuracy", "free_invalid_rate", "constrained_accuracy",
    )


def run_comparison(
    baseline: DataFrame, candidate: DataFrame, identity: DataFrame | None = None, constrained: DataFrame | None = None
) -> DataFrame:
    """Deltas, scope and recommendation: count, then identity, then enough, then not enough."""
    parts = {"b": baseline, "c": candidate}
    if identity is not None:
        parts["i"] = identity
    if constrained is not None:
        parts["k"] = constrained
    one = beside(**parts)
    b, c = F.col("b"), F.col("c")
    same_n = F.coalesce(b["sample_count"] == c["sample_count"], F.lit(False))
    same_id = F.col("i.matches_baseline") if identity is not None else F.lit(None).cast("boolean")
    fewer_invalid, kept = c["invalid_rate"] < b["invalid_rate"], c["accuracy"] >= b["accuracy"]
    not_same = F.coalesce(~same_id, F.lit(False))
    enough = same_n & ~not_same & fewer_invalid & kept
    vs_k = c["accuracy"] - F.col("k.constrained_top1_accuracy") if constrained is not None else F.lit(None).cast("double")
    return one.select(
        (c["accuracy"] - b["accuracy"]).alias("accuracy_delta"),
        (c["invalid_rate"] - b["invalid_rate"]).alias("invalid_rate_delta"),
        vs_k.alias("constrained_accuracy_delta"),
        same_n.alias("sample_count_matches"), same_id.alias("sample_identity_matches"),
        enough.alias("enough_before_retraining"),
        F.when(~same_n, "needs_full_run").when(not_same, "not_comparable")
        .when(enough, "enough").otherwise("not_enough").alias("recommendation"),
    )


def model_split_matrix(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """(model, split) scores over all rows, or over the first ``cap`` of each group by ``ordinal``.

    With a cap Spark keeps at most that many rows per group and task before the shuffle (window group limit).
    """
    top = rows
    if cap is not None:
        rn = F.row_number().over(W.partitionBy("model", "split").orderBy("ordinal"))
        top = rows.withColumn("_rn", rn).filter(F.col("_rn") <= cap)
    n, ok, bad = F.count(F.lit(1)), F.count_if(F.col("prediction") == F.col("label")), F.count_if(F.col("prediction") == K.INVALID)
    one = F.greatest(n, F.lit(1))
    return top.groupBy("model", "split").agg(
        n.alias("samples"), ok.alias("correct"), bad.alias("invalid"),
        (ok / one).alias("accuracy"), (bad / one).alias("invalid_rate"),
    )


def matrix_delta(matrix: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Per split: candidate minus baseline, from one pass over the matrix."""
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    d = lambda c: (pick(candidate, c) - pick(baseline, c)).alias(f"{c}_delta")
    return matrix.groupBy("split").agg(
        pick(baseline, "accuracy").alias("baseline_accuracy"), pick(candidate, "accuracy").alias("candidate_accuracy"),
        d("accuracy"), d("correct"), d("invalid_rate"),
    )


def batch_summary(rows: DataFrame) -> DataFrame:
    labeled = F.coalesce(F.col("expected_label") != "", F.lit(False))
    status = lambda s: F.count_if(F.col("status") == s)
    out = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(labeled).alias("labeled"), status("ok").alias("ok"),
        F.count_if(F.coalesce("correct", F.lit(False))).alias("correct"),
        F.count_if(labeled & F.coalesce(~F.col("correct"), F.lit(False))).alias("incorrect"),
        status("uncertain").alias("uncertain"), status("error").alias("failed"),
    )
    return out.withColumn("accuracy_on_labeled", F.when(F.col("labeled") > 0, F.col("correct") / F.col("labeled")))


def rescue_regression(free: DataFrame, constrained: DataFrame) -> DataFrame:
    """Counts of the 2x2 table free/constrained correct over shared samples."""
    j = free.select("sample_id", F.col("correct").alias("a")).join(
        constrained.select("sample_id", F.col("correct").alias("b")), "sample_id"
    )
    a, b = F.col("a"), F.col("b")
    name = F.when(a & b, "both_right").when(a, "regressed").when(b, "rescued").otherwise("both_wrong")
    return j.groupBy(name.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# Accuracy bands (fixed values).
def decision_band(accuracy: Column) -> Column:
    return (
        F.when(accuracy >= F.lit(0.80), "strong_go").when(accuracy >= F.lit(0.70), "go")
        .when(accuracy >= F.lit(0.40), "yellow").otherwise("no_go")
    )


def log_series(log: DataFrame) -> DataFrame:
    """Trainer log (run, step, loss, eval_loss) -> (run, kind, step, value); a row with ``loss`` is train."""
    kind = F.when(F.col("loss").isNotNull(), "train").when(F.col("eval_loss").isNotNull(), "eval")
    return log.filter(F.col("step").isNotNull()).withColumn("kind", kind).filter("kind is not null").select(
        "run", "kind", "step", F.coalesce("loss", "eval_loss").alias("value")
    )


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """Path with the highest number in ``checkpoint-N`` per run."""
    n = F.regexp_extract("path", r"checkpoint-(\d+)", 1).try_cast("bigint")
    return checkpoints.withColumn("n", n).filter("n is not null").groupBy("run").agg(
        F.max_by("path", "n").alias("path"), F.max("n").alias("checkpoint")
    )


def loss_curve(train: DataFrame, val: DataFrame) -> DataFrame:
    """(run, epoch, train_loss, val_loss), padded with nulls where one series is longer."""
    return train.select("run", "epoch", F.col("loss").alias("train_loss")).join(
        val.select("run", "epoch", F.col("loss").alias("val_loss")), ["run", "epoch"], "full_outer"
    )


def accepted_chain(value: np.ndarray, known: np.ndarray, delta: float, patience: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row as the accepted best: the last row accepted after it, and how many rows follow that one before it ends or stops.

    A row's follower is the first of the next ``patience`` rows that beats it by more than ``delta``; followers are
    then followed in jumps that double. ``known`` is false for null values, which every row beats.
    """
    n = len(value)
    follower = np.arange(n)
    for k in range(patience, 0, -1):
        if k < n:
            beats = ~known[:-k] | (known[k:] & (value[k:] > value[:-k] + delta))
            follower[:-k][beats] = np.arange(k, n)[beats]
    while True:
        further = follower[follower]
        if (further == follower).all():
            break
        follower = further
    return follower, np.minimum(n - 1 - follower, patience)


_SEGMENT = "offset long, rows long, epoch long, value double, best double, best_epoch long, bad long, last long, stopped boolean, whole boolean"


def best_epoch(metric: DataFrame, delta: float, patience: int, maximize: bool = True) -> DataFrame:
    """Per run: best metric, its epoch, the epoch training stops at, whether it stopped early.

    ``metric`` has one value per (run, epoch). The bar moves with the last accepted best, so epochs are folded in order, yet no run is
    gathered: rows are range-sorted, and each part of a run says what follows if any of its first ``patience`` rows is the
    next one accepted (later rows cannot be: the run would have stopped). These few rows per part are then folded from part to part.
    Only the first and the last run of a part can go on in another; the runs between them are folded where they are.
    """
    if patience < 1:
        raise ValueError("patience must be positive")
    kind = metric.schema["run"].dataType.simpleString()
    sign = 1.0 if maximize else -1.0

    def summary(run, part: int, epoch: np.ndarray, raw: np.ndarray, known: np.ndarray) -> pd.DataFrame:
        value = np.where(np.isnan(raw), np.inf, sign * raw)  # as in Spark, not-a-number beats every number
        last, bad = accepted_chain(value, known, delta, patience)
        first = np.arange(min(patience, len(raw)))
        end = last[first] + bad[first]
        shown = lambda numbers, at: pd.Series([float(numbers[i]) if known[i] else None for i in at], dtype=object)
        return pd.DataFrame({
            "run": pd.Series([run] * len(first), dtype=object), "part": part, "offset": first, "rows": len(raw), "epoch": epoch[first],
            "value": shown(value, first), "best": shown(raw, last[first]), "best_epoch": epoch[last[first]],
            "bad": bad[first], "last": epoch[end], "stopped": bad[first] >= patience, "whole": False,
        })

    def walked(epoch: list, raw: list, known: list) -> tuple:
        """(value, best epoch, bad, last epoch, stopped) of a whole run, ``value`` being the best."""
        bar, best, best_at, bad = None, None, None, 0
        for at, v, has in zip(epoch, raw, known):
            high = math.inf if math.isnan(v) else sign * v
            if bar is None or (has and high > bar + delta):
                best, best_at, bad, bar = v if has else None, at, 0, high if has else None
            else:
                bad += 1
                if bad >= patience:
                    return best, best_at, bad, at, True
        return best, best_at, bad, epoch[-1], False

    def wholes(part: int, rows: list[tuple]) -> pd.DataFrame:
        run, best, best_at, bad, last, stopped = zip(*rows)
        shown = pd.Series(best, dtype=object)
        return pd.DataFrame({
            "run": pd.Series(run, dtype=object), "part": part, "offset": 0, "rows": 0, "epoch": last, "value": shown, "best": shown,
            "best_epoch": best_at, "bad": bad, "last": last, "stopped": stopped, "whole": True,
        })

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, edge, part = None, [], True, None
        for pdf in batches:
            if not len(pdf):
                continue
            part, done = int(pdf["part"].iloc[0]), []
            runs, before = pdf["run"], pdf["run"].shift()
            starts = np.flatnonzero(~((runs == before) | (runs.isna() & before.isna())).to_numpy())
            starts = np.unique(np.append(0, starts)).tolist()
            columns = pdf["epoch"].to_numpy(np.int64), pdf["value"].to_numpy(np.float64), pdf["known"].to_numpy(bool)
            lists = [x.tolist() for x in columns]
            names = [None if pd.isna(x) else x for x in runs.iloc[starts].tolist()]
            for run, lo, hi in zip(names, starts, [*starts[1:], len(pdf)]):
                if held and run != at:
                    if edge:
                        yield summary(at, part, *(np.concatenate(x) for x in zip(*held)))
                    else:
                        done.append((at, *walked(*(np.concatenate(x).tolist() for x in zip(*held)))))
                    held, edge = [], False
                at = run
                if held or edge or hi == len(pdf):  # begun before, or it may go on
                    held.append(tuple(x[lo:hi] for x in columns))
                else:
                    done.append((run, *walked(*(x[lo:hi] for x in lists))))
            if done:
                yield wholes(part, done)
        if held:
            yield summary(at, part, *(np.concatenate(x) for x in zip(*held)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        bar, state = None, None  # bar: signed value to beat, None when anything does; state: (best, its epoch, bad, last epoch, stopped)
        for _, seg in pdf.sort_values(["part", "offset"]).groupby("part", sort=True):
            seg = seg.astype(object).where(seg.notna(), None).to_dict("records")
            left = patience - (state[2] if state else 0)
            beats = lambda r: bar is None or (r["value"] is not None and r["value"] > bar + delta)
            found = next((r for r in seg[:left] if beats(r)), None)
            if found is not None:
                state = (found["best"], found["best_epoch"], found["bad"], found["last"], found["stopped"])
                bar = None if found["best"] is None else math.inf if math.isnan(found["best"]) else sign * found["best"]
            elif seg[0]["rows"] >= left:
                state = (*state[:2], patience, seg[left - 1]["epoch"], True)
            else:
                state = (*state[:2], state[2] + seg[0]["rows"], seg[-1]["epoch"], False)
            if state[4]:
                break
        return pd.DataFrame([(pdf["run"].iloc[0], state[0], state[1], state[3], state[4])], columns=["run", "best_metric", "best_epoch", "last_epoch", "stopped_early"])

    value = F.col("value").cast("double")
    ordered = metric.select("run", F.col("epoch").cast("bigint").alias("epoch"), F.coalesce(value, F.lit(0.0)).alias("value"), value.isNotNull().alias("known")).orderBy("run", "epoch")
    parts = stored(ordered.withColumn("part", F.spark_partition_id()).mapInPandas(segments, f"run {kind}, part int, {_SEGMENT}"), "best-epoch")
    folded = parts.filter("not whole").groupBy("run").applyInPandas(fold, f"run {kind}, best_metric double, best_epoch long, last_epoch long, stopped_early boolean")
    inside = parts.filter("whole").select("run", F.col("best").alias("best_metric"), "best_epoch", F.col("last").alias("last_epoch"), F.col("stopped").alias("stopped_early"))
    return folded.unionByName(inside)
