"""Stage-log metrics (A16) and per-stage size metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_metrics(logs: DataFrame) -> DataFrame:
    """Attempts, outcome counts and duration statistics per (stage, status).

    Exact aggregates only (count / sum / min / max / avg); percentiles are
    offered by ``stage_duration_quantiles`` with an explicit accuracy.
    """
    return logs.groupBy("stage", "status").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("email_id").alias("n_emails"),
        F.max("attempt").alias("max_attempt"),
        F.sum("duration_ms").cast("bigint").alias("total_ms"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.round(F.avg("duration_ms"), 6).alias("avg_ms"),
    )


def stage_duration_quantiles(logs: DataFrame, accuracy: int = 10000) -> DataFrame:
    return logs.groupBy("stage").agg(
        F.percentile_approx("duration_ms", [0.5, 0.9, 0.99], accuracy).alias("p50_p90_p99"))


def latest_failure(logs: DataFrame) -> DataFrame:
    """The most recent failure message per message (by recorded_at, then id)."""
    return (logs.where(F.col("status") == "failed")
            .groupBy("email_id")
            .agg(F.max_by("message", F.struct("recorded_at", "id")).alias("message"),
                 F.max("recorded_at").alias("failed_at"),
                 F.count(F.lit(1)).alias("n_failures")))


def text_size_metrics(df: DataFrame, text_in: str, text_out: str) -> DataFrame:
    """Characters in and out per row."""
    return df.select("*", F.length(text_in).alias("chars_in"), F.length(text_out).alias("chars_out"))
