"""Latency SLO kept current over an append-only JSONL log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmill.operators.metrics import latency_counts, slo_from_counts

EVENT = "request_id string, latency_ms bigint, outcome string, confidence double, model_tag string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(folder)


def telemetry_slo_stream(events: DataFrame, report_path: str, checkpoint: str):
    """Start the query: after every micro-batch the report at ``report_path`` is replaced."""

    def write(counts: DataFrame, batch: int) -> None:
        slo_from_counts(counts).withColumn("batch", F.lit(batch)).write.mode("overwrite").json(report_path)

    return (
        latency_counts(events).writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).start()
    )
