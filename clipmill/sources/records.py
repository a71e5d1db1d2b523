"""Readers for metadata, records, contracts and prediction tables. Bad rows come back as violations."""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipmill import constants as K
from clipmill.functions.text import bool_lenient, bool_strict, normalize_gloss, strip
from clipmill.sources.blocks import csv_records, json_elements
from clipmill.sources.lines import head_lines, read_lines


def flatten_metadata(entries: DataFrame) -> DataFrame:
    """(gloss, instances[]) -> one row per instance with sample_id ``gloss_videoid``."""
    return entries.select("gloss", F.explode("instances").alias("i")).select(
        F.concat_ws("_", "gloss", "i.video_id").alias("sample_id"), "gloss",
        F.coalesce("i.split", F.lit("unspecified")).alias("split"),
        *[F.col(f"i.{c}").alias(c) for c in ("video_id", "signer_id", "instance_id", "source", "fps", "frame_start", "frame_end")],
    )


def read_metadata(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested metadata JSON, flattened. ``path`` may hold many files.

    Each is one JSON array, cut into its entries by many tasks (``sources/blocks.py``); with ``lines`` each line is an entry.
    """
    if lines:
        return flatten_metadata(spark.read.schema(K.METADATA).json(path))
    entry = F.from_json("value", K.METADATA)
    return flatten_metadata(json_elements(spark, path).select(entry.alias("e")).select("e.*"))


def as_whole(c: Column) -> Column:
    """Text or number -> whole number; NaN, blank and unreadable give null."""
    d = c.cast("string").try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d), d.try_cast("bigint"))


def as_real(c: Column) -> Column:
    d = c.cast("string").try_cast("double")
    return F.when(~F.isnan(d), d)


def cast_metadata(df: DataFrame) -> DataFrame:
    whole = ("signer_id", "instance_id", "frame_start", "frame_end")
    raw = F.to_json(F.struct(*df.columns)).alias("raw_metadata")
    text = lambda c: F.when(~F.lower(F.col(c)).isin("nan", ""), F.col(c)).alias(c)
    return df.select(
        "sample_id", "gloss", "split", text("video_id"), text("source"),
        *[as_whole(F.col(c)).alias(c) for c in whole], as_real(F.col("fps")).alias("fps"), raw,
    )


def validate_official_split(df: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("split").isin(*K.SPLITS), F.lit(False))
    return df.filter(~ok).select(
        F.lit("unknown_split").alias("rule"), F.col("sample_id").alias("key"), F.coalesce("split", F.lit("")).alias("detail"))


def read_records_jsonl(spark: SparkSession, path: str, fields: Sequence[str] = ("instruction", "input", "output"), max_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, line_no, fields…), violations with line number) of a JSONL file set."""
    lines = head_lines(read_lines(spark, path), max_samples).withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    rule = F.when(F.col("v").isNull(), "not_json").when(~kind.startswith("OBJECT"), "not_an_object")
    tagged = lines.withColumn("rule", rule)
    good = tagged.filter("rule is null").select(
        "path", "line_no", *[F.try_variant_get("v", f"$.{f}", "string").alias(f) for f in fields])
    name = F.element_at(F.split("path", "/"), -1)
    bad = tagged.filter("rule is not null").select("rule", F.concat_ws(":", name, "line_no").alias("key"), F.col("value").alias("detail"))
    return good, bad


def read_label_contract(spark: SparkSession, path: str) -> DataFrame:
    """(ord, label, version) from a contract JSON (``glosses``), a manifest JSON (``labels``) or a text file."""
    if path.endswith(".txt"):
        lines = read_lines(spark, path)
        return lines.select((F.col("line_no") - 1).alias("ord"), strip(F.col("value")).alias("label"), F.lit(None).cast("string").alias("version"))
    doc = spark.read.schema("version string, glosses array<string>, labels array<string>").option("multiLine", True).json(path)
    return doc.select("version", F.posexplode(F.coalesce("glosses", "labels")).alias("ord", "label")).select(
        F.col("ord").cast("bigint").alias("ord"), "label", "version")


def _header(record: str) -> list[str]:
    """Column names of a header; blank ones are numbered, names that differ in case only get their place behind them."""
    names = next(csv.reader(io.StringIO(record, newline="")))
    often = Counter(n.lower() for n in names)
    return [f"_c{i}" if not n else f"{n}{i}" if often[n.lower()] > 1 else n for i, n in enumerate(names)]


def read_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """CSV with header and quoted line breaks, files split over tasks; every required column must be there.

    The first file's header names the columns, each file's first record is taken for a header.
    """
    records = csv_records(spark, path)
    first = records.orderBy("path", "block", "part").first()
    names = _header(first.value) if first else []
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    heads = records.groupBy("path").agg(F.min(F.struct("block", "part")).alias("head"))
    rows = records.join(heads, "path").filter(F.struct("block", "part") != F.col("head"))
    parsed = F.from_csv("value", schema.toDDL(), {"multiLine": "true", "escape": '"', "maxCharsPerColumn": "-1"})
    return rows.select(parsed.alias("r")).select("r.*")


def read_predictions_csv(spark: SparkSession, path: str, required: Sequence[str] = K.STRICT_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(typed rows, violations for flags that are neither true nor false)."""
    df = read_csv(spark, path, required)
    flags = [c for c in ("valid_label", "correct", "constrained_correct") if c in df.columns]
    typed = df.select(
        *[bool_strict(F.col(c)).alias(c) if c in flags else (F.col(c).cast("bigint").alias(c) if c == "index" else F.col(c)) for c in df.columns])
    bad = df.select("sample_id", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in flags])).alias("x")).filter(
        bool_strict(F.col("x.v")).isNull()
    ).select(F.lit("not_boolean").alias("rule"), F.col("sample_id").alias("key"), F.concat_ws("=", "x.c", "x.v").alias("detail"))
    return typed, bad


def read_gate_csv(spark: SparkSession, path: str) -> DataFrame:
    """Retry log with the lenient rule for flags."""
    need = ("sample_id", "expected_gloss", "first_pass_raw", "first_pass_valid", "retry_used", "final_gloss", "final_valid", "correct")
    df = read_csv(spark, path, need)
    flags = {"first_pass_valid", "retry_used", "retry_valid", "final_valid", "correct"}
    return df.select(*[bool_lenient(F.col(c)).alias(c) if c in flags else F.coalesce(c, F.lit("")).alias(c) for c in df.columns])


def expected_labels(rows: DataFrame) -> DataFrame:
    """(ordinal, filename, expected_label) -> one row per base name; the last non-blank row wins."""
    name = F.element_at(F.split(strip(F.coalesce("filename", F.lit(""))), "/"), -1)
    return (
        rows.select("ordinal", name.alias("filename"), normalize_gloss(F.col("expected_label")).alias("expected_label"))
        .filter("filename <> '' and expected_label <> ''")
        .groupBy("filename").agg(F.max_by("expected_label", "ordinal").alias("expected_label"))
    )


def read_expected_labels(spark: SparkSession, path: str) -> DataFrame:
    """As above from CSV files with header, one record a line; later means a later file, then a later line."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    missing = [c for c in ("filename", "expected_label") if c not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    return expected_labels(df.select("filename", "expected_label", place.alias("ordinal")))


def identity_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("sample_id", strip(F.col("sample_id"))).withColumn("expected_gloss", normalize_gloss(F.col("expected_gloss")))
