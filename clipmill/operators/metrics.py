"""Scores of prediction tables: each is one or two aggregates over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.constants import INVALID, UNKNOWN
from clipmill.functions.text import canonicalize_text, in_labels, normalize_gloss, output_label
from clipmill.operators.ranking import nearest_rank, telemetry_index
from clipmill.session import stored


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double, 0.0 when the bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom.cast("double"))


def prediction_rows(df: DataFrame, labels: Sequence[str], mode: str = "real") -> DataFrame:
    """(index, sample_id, expected_gloss, raw_model_output) -> resolved prediction columns."""
    r = df.withColumn("_label", output_label(F.col("raw_model_output"))).withColumn("_expected", normalize_gloss(F.col("expected_gloss")))
    label, expected, valid = F.col("_label"), F.col("_expected"), in_labels(F.col("_label"), labels)
    return r.select(
        "index",
        "sample_id",
        expected.alias("expected_gloss"),
        F.coalesce(label, F.lit("")).alias("predicted_gloss"),
        "raw_model_output",
        valid.alias("valid_label"),
        ((expected != "") & valid & F.coalesce(label == expected, F.lit(False))).alias("correct"),
        F.when(valid, label).otherwise(INVALID).alias("prediction_for_metrics"),
        F.lit(mode).alias("mode"),
    )


def strict_metrics(rows: DataFrame, class_count: int) -> DataFrame:
    n, ok, bad = F.count(F.lit(1)), F.count_if("correct"), F.count_if(~F.col("valid_label"))
    return rows.agg(
        n.alias("sample_count"), ok.alias("correct"), bad.alias("invalid"),
        ratio(ok, n).alias("accuracy"), ratio(bad, n).alias("invalid_rate"),
        F.lit(class_count).cast("bigint").alias("class_count"),
    )


def per_class_accuracy(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Every contract label with support, correct and accuracy (0.0 without rows)."""
    seen = rows.groupBy(F.col("expected_gloss").alias("label")).agg(
        F.count(F.lit(1)).alias("support"), F.count_if("correct").alias("correct")
    )
    out = labels.select("label").join(seen, "label", "left").na.fill(0, ["support", "correct"])
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("support")))


def confusion_counts(rows: DataFrame) -> DataFrame:
    expected = F.coalesce(F.nullif(F.col("expected_gloss"), F.lit("")), F.lit(UNKNOWN))
    return rows.groupBy(expected.alias("expected"), F.col("prediction_for_metrics").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def constrained_rows(ranked: DataFrame, free: DataFrame) -> DataFrame:
    """Ranked candidates (sample_id, expected_gloss, best_label, correct, …) + free-run prediction."""
    return ranked.join(
        free.select("sample_id", F.col("predicted_gloss").alias("free_generation_prediction")), "sample_id", "left"
    ).na.fill("", ["free_generation_prediction"])


def constrained_layout(rows: DataFrame, mode: str = "constrained") -> DataFrame:
    """Rows of ``constrained_rows`` (with index) under the column names of the written table."""
    return rows.select(
        "index", "sample_id", "expected_gloss", "free_generation_prediction", F.col("best_label").alias("constrained_prediction"),
        F.col("correct").alias("constrained_correct"), "top_scores", F.lit(mode).alias("mode"))


def constrained_metrics(rows: DataFrame, class_count: int) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if(F.coalesce("correct", F.lit(False)))
    return rows.agg(
        n.alias("sample_count"), ok.alias("correct"), ratio(ok, n).alias("constrained_top1_accuracy"),
        F.lit(class_count).cast("bigint").alias("class_count"),
    )


def word_accuracy(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    same = canonicalize_text(F.col(reference)) == canonicalize_text(F.col(hypothesis))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("correct")).withColumn(
        "word_accuracy", ratio(F.col("correct"), F.col("n"))
    )


def top_k_accuracy(df: DataFrame, reference: str, candidates: str, k: int) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    first = F.transform(F.slice(F.col(candidates), 1, k), canonicalize_text)
    hit = F.array_contains(first, canonicalize_text(F.col(reference)))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits")).withColumn(
        "top_k_accuracy", ratio(F.col("hits"), F.col("n"))
    )


def label_outcomes(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, tp, fp, fn) over the union of truth and predicted labels; one shuffle."""
    t, p = F.col(truth).cast("string"), F.col(pred).cast("string")
    row = lambda label, tp, fp, fn: F.struct(
        label.alias("label"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn")
    )
    rows = F.when(t == p, F.array(row(t, 1, 0, 0))).otherwise(F.array(row(t, 0, 0, 1), row(p, 0, 1, 0)))
    return (
        df.select(*by, F.explode(rows).alias("r"))
        .groupBy(*by, F.col("r.label").alias("label"))
        .agg(*[F.sum(f"r.{c}").alias(c) for c in ("tp", "fp", "fn")])
    )


def precision_recall_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    o = label_outcomes(df, truth, pred)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return o.select(
        "label", "tp", "fp", "fn", (tp + fn).alias("support"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def macro_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return precision_recall_f1(df, truth, pred).agg(
        F.count(F.lit(1)).alias("class_count"), F.avg("f1").alias("macro_f1")
    )


def latency_counts(events: DataFrame) -> DataFrame:
    """(latency_ms, outcome, n): all the SLO needs, as small as the number of distinct latencies."""
    latency = F.coalesce(F.col("latency_ms"), F.lit(0)).alias("latency_ms")  # a missing latency counts as 0
    return events.groupBy(latency, "outcome").agg(F.count(F.lit(1)).alias("n"))


def slo_from_counts(counts: DataFrame) -> DataFrame:
    """One row: count, success_count, success_rate, p95 (telemetry index rule); zeros when empty."""
    from clipmill.operators.labels import beside

    n = F.col("n")
    totals = counts.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "success", n)), F.lit(0)).alias("success_count"),
    )
    p95 = nearest_rank(counts, "latency_ms", telemetry_index, weight="n")
    return beside(t=totals, p=p95).select(
        F.col("t.count").alias("count"), F.col("t.success_count").alias("success_count"),
        ratio(F.col("t.success_count"), F.col("t.count")).alias("success_rate"),
        F.coalesce(F.col("p.value_at"), F.lit(0.0)).cast("bigint").alias("latency_p95_ms"),
    )


def telemetry_slo(events: DataFrame) -> DataFrame:
    """The SLO row of an event log. The log is read once; the counts are a small table read twice."""
    return slo_from_counts(stored(latency_counts(events), "latency-counts"))
