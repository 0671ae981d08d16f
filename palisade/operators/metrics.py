"""Run summaries: request latencies, pipeline stages, and integrity style count rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.scale import nearest_rank


def latency_summary(samples: DataFrame, scenario: str, millis: str, elapsed_seconds: str | None = None) -> DataFrame:
    """Mean, nearest-rank p50 and p95, maximum and throughput per scenario."""
    totals = samples.groupBy(scenario).agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg(millis).alias("mean_ms"),
        F.max(millis).alias("max_ms"),
        (F.max(elapsed_seconds) if elapsed_seconds else F.sum(millis) / 1000).alias("elapsed_s"),
    )
    ranks = nearest_rank(samples, [scenario], millis, {"p50_ms": 0.50, "p95_ms": 0.95})
    return totals.join(ranks, scenario).withColumn(
        "throughput", F.try_divide(F.col("requests"), F.col("elapsed_s"))
    )


def stage_summary(samples: DataFrame, stage: str, millis: str) -> DataFrame:
    """Calls, total, mean and calls per second of each stage."""
    return (
        samples.groupBy(stage)
        .agg(F.count(F.lit(1)).alias("calls"), F.sum(millis).alias("total_ms"))
        .withColumns(
            {
                "mean_ms": F.col("total_ms") / F.col("calls"),
                "per_second": F.try_divide(F.col("calls") * 1000, F.col("total_ms")),
            }
        )
    )


def observed(df: DataFrame, name: str) -> DataFrame:
    """Attach a row-count metric that a query listener can read while the job runs."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))
