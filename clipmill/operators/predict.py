"""Prediction tables: user models, baselines, retry, ranking, output contract."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipmill import constants as K
from clipmill.functions.text import display_translation, normalize_gloss
from clipmill.operators.labels import alias_table, lookup_alias


def score_with(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Run a user's model: ``load()`` once per task, then its result on every Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)


def hash_baseline(key: Column, labels: Sequence[str]) -> Column:
    """Label number sha256(key)[:8] mod the number of labels."""
    n = F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("bigint")
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (n % len(labels) + 1).cast("int"))


def majority_label(train: DataFrame, label: str) -> str:
    row = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(label)).first()
    if row is None:
        raise ValueError("train must contain at least one label")
    return row[label]


def label_prior(train: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """Predict the majority train label (ties lexical) for every row."""
    return rows.withColumn("prediction", F.lit(majority_label(train, label)))


def label_prior_loss(train: DataFrame, evaluation: DataFrame, label: str) -> DataFrame:
    """mean of -ln((count + 1) / (N + labels)), from label counts only: ln(N + V) - mean ln(count + 1)."""
    both = train.select(F.col(label).alias("l"), F.lit(1).alias("t"), F.lit(0).alias("e")).unionByName(
        evaluation.select(F.col(label).alias("l"), F.lit(0).alias("t"), F.lit(1).alias("e"))
    )
    per = both.groupBy("l").agg(F.sum("t").alias("t"), F.sum("e").alias("e"))
    loss = F.log(F.sum("t") + F.count(F.lit(1))) - F.sum(F.col("e") * F.log(F.col("t") + 1)) / F.sum("e")
    return per.agg(F.sum("e").alias("n"), F.when(F.sum("e") > 0, loss).otherwise(0.0).alias("loss"))


def retry_resolution(df: DataFrame, aliases: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(sample_id, expected_gloss, first_raw, retry_raw) -> retry-log columns.

    ``retry_raw`` counts only where the first pass is invalid.
    """
    lookup = alias_table(aliases)
    for src, out in (("first_raw", "_first"), ("retry_raw", "_retry")):
        df = lookup_alias(df.withColumn("_n", normalize_gloss(F.col(src))), "_n", lookup, labels, out).drop("_n")
    ok1 = F.col("_first").isNotNull()
    final = F.when(ok1, F.col("_first")).otherwise(F.col("_retry"))
    expected = normalize_gloss(F.col("expected_gloss"))
    return df.select(
        "sample_id", expected.alias("expected_gloss"), F.col("first_raw").alias("first_pass_raw"),
        ok1.alias("first_pass_valid"), (~ok1).alias("retry_used"),
        F.when(ok1, "").otherwise(F.col("retry_raw")).alias("retry_raw"),
        (~ok1 & F.col("_retry").isNotNull()).alias("retry_valid"),
        F.coalesce(final, F.lit("")).alias("final_gloss"), final.isNotNull().alias("final_valid"),
        F.coalesce(final == expected, F.lit(False)).alias("correct"),
    )


#: Scores that one task folds and ranks; their number sets the number of tasks.
TASK_SCORES = 250_000


def rank_candidates(scores: DataFrame, labels: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """(sample_id, best_label, best_score, top_scores; violations) from (sample_id, label, score).

    Order: score descending, then contract position. Contract positions are a table joined by label. Scores are dealt out by sample once, to as many
    tasks as keep each at about ``TASK_SCORES`` rows; checks are counts, and no list is longer than ``k``: a window group limit lets only the first ``k`` of a sample through.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    names = list(dict.fromkeys(labels))
    contract = scores.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], "label string, ord int")
    tasks = max(scores.sparkSession.sparkContext.defaultParallelism, math.ceil(scores.count() / TASK_SCORES))
    folded = (
        scores.withColumn("label", normalize_gloss(F.col("label"))).repartition(tasks, "sample_id")
        .groupBy("sample_id", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
        .join(F.broadcast(contract), "label", "left")  # its size is the caller's; a shuffle by label would give each label one task
    )
    known = F.col("ord").isNotNull()
    per = folded.groupBy("sample_id").agg(
        F.count_if(known).alias("held"), F.count_if(~known).alias("extra"), F.count_if(F.col("n") > 1).alias("repeated"))
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(-F.col("score"), "ord"))
    first = folded.filter(known).withColumn("rk", rank).filter(F.col("rk") <= k)
    top = first.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("rk", "label", "score"))).alias("s"))
    whole = (F.col("held") == len(names)) & (F.col("extra") == 0) & (F.col("repeated") == 0)
    ranked = per.filter(whole).join(top, "sample_id").select(
        "sample_id", F.col("s")[0]["label"].alias("best_label"), F.col("s")[0]["score"].alias("best_score"),
        F.transform("s", lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))).alias("top_scores"),
    )
    rules = F.array_compact(F.array(
        F.when(F.col("held") < len(names), "missing_label"), F.when(F.col("extra") > 0, "unexpected_label"),
        F.when(F.col("repeated") > 0, "duplicate_label"),
    ))
    bad = per.select(F.explode(rules).alias("rule"), F.col("sample_id").alias("key"), F.lit("").alias("detail"))
    return ranked, bad


def confidence_output(ok: Column, prediction: Column, confidence: Column, threshold: float = K.CONFIDENCE_THRESHOLD) -> Column:
    """struct(status, display_text, confidence, is_uncertain)."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence.cast("double")))
    low = c < F.lit(threshold)
    return F.struct(
        F.when(~ok, "error").when(low, "uncertain").otherwise("ok").alias("status"),
        F.when(~ok | low, "uncertain").otherwise(prediction).alias("display_text"),
        c.alias("confidence"),
        (~ok | low).alias("is_uncertain"),
    )


STEP_SCHEMA = "array<struct<at_ms bigint, prediction string, confidence double, latency_ms double, latency_target_ms double, ok boolean, error string>>"


def replay_check(scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scenario, steps[]) -> (step rows with output contract, steps whose at_ms runs backwards).

    The previous stamp is read inside the step array, so no shuffle is needed.
    """
    at = lambda s: F.coalesce(s["at_ms"], F.lit(0))
    earlier = F.transform(
        F.col("steps"), lambda s, i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(at(F.get(F.col("steps"), i - 1)))
    )
    rows = scripts.withColumn("_prev", earlier).select(
        "scenario", "_prev", F.posexplode("steps").alias("pos", "s")
    )
    ok, conf = F.coalesce("s.ok", F.lit(True)), F.coalesce("s.confidence", F.lit(1.0))
    out = rows.select(
        "scenario", "pos", at(F.col("s")).alias("at_ms"), F.get("_prev", F.col("pos")).alias("previous_at_ms"),
        confidence_output(ok, F.col("s.prediction"), conf).alias("o"),
    ).select("scenario", "pos", "at_ms", "previous_at_ms", "o.status", "o.display_text", "o.confidence")
    return out, out.filter("at_ms < previous_at_ms")


def result_rows(predictions: DataFrame, expected: DataFrame, constants: dict[str, str]) -> DataFrame:
    """(filename, status, prediction) ⟕ (filename, expected_label) -> result rows with run constants.

    ``correct`` is null without an expected label and for error rows.
    """
    j = predictions.join(expected, "filename", "left")
    exp = F.nullif(normalize_gloss(F.col("expected_label")), F.lit(""))
    correct = F.when(exp.isNotNull() & (F.col("status") != "error"), F.coalesce(F.col("prediction") == exp, F.lit(False)))
    return j.select(
        F.col("filename").alias("video_filename"), exp.alias("expected_label"), "status",
        F.col("prediction").alias("predicted_gloss"), display_translation(F.col("prediction")).alias("translation"),
        correct.alias("correct"), *[F.lit(v).alias(n) for n, v in constants.items()],
    )


def reference_selection(rows: DataFrame, demo_count: int) -> DataFrame:
    """First right row of each sample in index order; the first is ``smoke``, the rest ``demo``.

    ``(rows)`` may be fewer than ``demo_count + 1``; callers compare ``count()`` and stop the run then.
    """
    cols = [c for c in rows.columns if c not in ("index", "sample_id")]
    first = (
        rows.filter(F.col("valid_label") & F.col("correct"))
        .groupBy("sample_id")
        .agg(F.min(F.struct("index", *cols)).alias("r"))
        .select("sample_id", "r.*")
        .orderBy("index")
        .limit(demo_count + 1)
    )
    rank = F.row_number().over(W.orderBy("index"))  # over at most demo_count + 1 rows
    return first.withColumn("selection_role", F.when(rank == 1, "smoke").otherwise("demo"))


def lookup_records(requests: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sample_id, expected_gloss) requests with their record; misses and label mismatches apart."""
    rec = records.select(
        F.col("sample_id"), F.lit(True).alias("_hit"), normalize_gloss(F.col("output")).alias("record_gloss"), "input"
    )
    j = requests.join(rec, "sample_id", "left").withColumn("expected_gloss", normalize_gloss(F.col("expected_gloss")))
    rule = F.when(F.col("_hit").isNull(), "sample_id_not_found").when(
        F.col("record_gloss") != F.col("expected_gloss"), "expected_gloss_mismatch"
    )
    j = j.withColumn("rule", rule)
    good = j.filter("rule is null").drop("_hit", "rule")
    return good, j.filter("rule is not null").select("rule", F.col("sample_id").alias("key"), F.col("expected_gloss").alias("detail"))
