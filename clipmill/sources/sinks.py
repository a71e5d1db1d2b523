"""Writers: fixed column order, one folder per table, one JSON row per summary."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmill.operators.splits import split_manifest


def write_predictions(rows: DataFrame, columns: Sequence[str], path: str) -> None:
    """CSV with exactly ``columns``; arrays become JSON text."""
    cols = [
        F.to_json(c).alias(c) if rows.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in columns
    ]
    whole = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.select(*cols).write.options(**whole).mode("overwrite").csv(path)


def write_metadata(entries: DataFrame, path: str) -> None:
    """(gloss, instances) as JSON files that each hold one array, an entry a line."""

    def run(batches: Iterator[pa.RecordBatch]):
        lead = "["
        for batch in batches:
            lines = []
            for text in batch.column(0).to_pylist():
                lines.append(lead + text)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], names=["value"])

    entries.select(F.to_json(F.struct("gloss", "instances")).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_splits(rows: DataFrame, label: str, strategy: str, version: str, path: str) -> None:
    """``<path>/rows/split=…`` (Parquet, prunable), ``<path>/csv/split=…``, ``<path>/ids/split=…``, ``<path>/manifest``.

    The split is computed once; CSV, id lists and manifest are made from the Parquet rows.
    """
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    placed = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    placed.write.mode("overwrite").option("header", True).partitionBy("split").csv(f"{path}/csv")
    placed.select("sample_id", "split").write.mode("overwrite").partitionBy("split").text(f"{path}/ids")
    write_metrics(split_manifest(placed, label, strategy, version), f"{path}/manifest")


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON object per line, added to what is there."""
    rows.write.mode("append").json(path)
