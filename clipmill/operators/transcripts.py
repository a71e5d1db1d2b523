"""Multi-word transcripts: merging, checks, word error rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.constants import MISSING_WORD
from clipmill.functions.align import word_alignment
from clipmill.functions.text import normalize_word
from clipmill.operators.gates import identity_violations

WORDS = "array<struct<word string, start_ms bigint, end_ms bigint>>"


def words_from_variant(v: Column) -> Column:
    """struct(words, error) from a JSON list whose items are text or {word, start_ms?, end_ms?}.

    Stamps must be JSON whole numbers (no booleans, no text, no fractions).
    """
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    kind = lambda x: F.coalesce(F.regexp_extract(F.schema_of_variant(x), "^([A-Z]+)", 1), F.lit(""))
    at = lambda x, p: F.try_variant_get(x, p, "variant")
    text = lambda x: F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string")).when(
        kind(at(x, "$.word")) == "STRING", F.try_variant_get(x, "$.word", "string")
    )
    stamp_ok = lambda s: s.isNull() | F.is_variant_null(s) | (kind(s) == "BIGINT")
    bad_stamp = lambda x: (kind(x) == "OBJECT") & ~(stamp_ok(at(x, "$.start_ms")) & stamp_ok(at(x, "$.end_ms")))
    get_stamp = lambda x, p: F.when(kind(x) == "OBJECT", F.try_variant_get(x, p, "bigint"))
    words = F.transform(
        items,
        lambda x: F.struct(
            normalize_word(text(x)).alias("word"), get_stamp(x, "$.start_ms").alias("start_ms"), get_stamp(x, "$.end_ms").alias("end_ms")
        ),
    )
    error = (
        F.when(items.isNull() | (F.size(items) == 0), "empty_list")
        .when(F.exists(items, lambda x: text(x).isNull() | (normalize_word(text(x)) == "")), "empty_word")
        .when(F.exists(items, bad_stamp), "invalid_timestamp")
    )
    return F.struct(words.alias("words"), error.alias("error"))


def first_non_empty(row: DataFrame, names: Sequence[str]) -> Column:
    """First list among ``names`` that has items."""
    return F.coalesce(*[F.when(F.size(n) > 0, F.col(n)) for n in names if n in row.columns])


def merge_expected_predicted(
    expected: DataFrame, predicted: DataFrame, allow_missing: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(merged (sample_id, expected_words, predicted_words), violations); extra predictions are ignored.

    With ``allow_missing`` a sample without a prediction gets the one word ``__missing__``.
    """
    side = predicted.select(
        "sample_id", F.lit(True).alias("_hit"),
        first_non_empty(predicted, ("predicted_words", "transcript_words", "words")).alias("predicted_words"),
    )
    j = expected.select("sample_id", first_non_empty(expected, ("expected_words",)).alias("expected_words")).join(side, "sample_id", "left")
    miss = F.col("_hit").isNull()
    if allow_missing:
        filler = F.array(F.struct(
            F.lit(MISSING_WORD).alias("word"), F.lit(None).cast("bigint").alias("start_ms"), F.lit(None).cast("bigint").alias("end_ms")
        ))
        j = j.withColumn("predicted_words", F.when(miss, filler).otherwise(F.col("predicted_words")))
    rule = F.when(F.col("expected_words").isNull(), "expected_words_empty").when(
        F.col("predicted_words").isNull(), F.when(miss, "missing_prediction").otherwise("predicted_words_empty")
    )
    j = j.withColumn("rule", rule)
    ids = identity_violations(expected).unionByName(identity_violations(predicted))
    bad = j.filter("rule is not null").select("rule", F.col("sample_id").alias("key"), F.lit("").alias("detail"))
    return j.filter("rule is null").drop("_hit", "rule"), bad.unionByName(ids)


def normalized_words(words: Column) -> Column:
    return F.transform(
        words, lambda w: F.struct(normalize_word(w["word"]).alias("word"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"))
    )


def scored_transcripts(df: DataFrame, expected: str, predicted: str) -> tuple[DataFrame, DataFrame]:
    """(scored rows, violations) from rows (index, sample_id) with two JSON word lists as VARIANT columns.

    Lists are checked before they are scored: empty or missing lists, words without a letter, stamps that are no whole numbers.
    """
    sides = {"expected_words": expected, "predicted_words": predicted}
    d = df.select("index", "sample_id", *[words_from_variant(F.col(v)).alias(c) for c, v in sides.items()])
    rules = F.array_compact(F.array(*[F.concat(F.lit(f"{c}_"), F.col(f"{c}.error")) for c in sides]))
    tagged = d.withColumn("rules", rules)
    good = tagged.filter(F.size("rules") == 0).select("index", "sample_id", *[F.col(f"{c}.words").cast(WORDS).alias(c) for c in sides])
    bad = tagged.select(F.explode("rules").alias("rule"), F.col("sample_id").alias("key"), F.lit("").alias("detail"))
    return wer_rows(good), bad


def wer_rows(df: DataFrame) -> DataFrame:
    """(index, sample_id, expected_words, predicted_words) -> one scored row each, no shuffle."""
    text = lambda c: F.transform(c, lambda w: w["word"])
    d = df.withColumn("_e", normalized_words(F.col("expected_words"))).withColumn("_p", normalized_words(F.col("predicted_words")))
    d = d.withColumn("_a", word_alignment(F.col("_e"), F.col("_p")))
    return d.select(
        "index", "sample_id",
        F.array_join(text(F.col("_e")), " ").alias("expected_text"), F.array_join(text(F.col("_p")), " ").alias("predicted_text"),
        F.size("_e").cast("bigint").alias("expected_word_count"), F.size("_p").cast("bigint").alias("predicted_word_count"),
        F.col("_a.substitutions").alias("substitutions"), F.col("_a.insertions").alias("insertions"),
        F.col("_a.deletions").alias("deletions"),
        (text(F.col("_e")) == text(F.col("_p"))).alias("exact_match"),
        F.col("_a.matched").alias("matched_word_count"),
        F.when(F.col("_a.boundary_count") > 0, F.col("_a.boundary_error_ms") / F.col("_a.boundary_count")).alias("timestamp_boundary_mae_ms"),
        F.col("_a.boundary_error_ms").alias("boundary_error_ms"), F.col("_a.boundary_count").alias("boundary_count"),
    )


def wer_metrics(rows: DataFrame) -> DataFrame:
    """Corpus scores: totals first, then ratios; boundary error weighted by boundaries."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    t = rows.agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if("exact_match").alias("exact"),
        s("substitutions").alias("substitutions"), s("insertions").alias("insertions"), s("deletions").alias("deletions"),
        s("expected_word_count").alias("total_expected_words"), s("matched_word_count").alias("matched"),
        s("boundary_error_ms").alias("err"), s("boundary_count").alias("timestamp_boundary_count"),
    )
    words = F.col("total_expected_words")
    checked = F.when(words == 0, F.raise_error(F.lit("expected words are required to compute WER"))).otherwise(words)
    return t.select(
        "sample_count", (F.col("exact") / F.col("sample_count")).alias("exact_sequence_accuracy"),
        ((F.col("substitutions") + F.col("insertions") + F.col("deletions")) / checked).alias("word_error_rate"),
        "substitutions", "insertions", "deletions", "total_expected_words",
        (F.col("matched") / words).alias("matched_word_recall"),
        F.when(F.col("timestamp_boundary_count") > 0, F.col("err") / F.col("timestamp_boundary_count")).alias("timestamp_boundary_mae_ms"),
        "timestamp_boundary_count",
    )
