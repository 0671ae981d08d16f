"""Queue state as data: metrics, due and expired batches, claim and failure outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import bounded_reason
from palisade.functions.times import retry_delay_seconds

# --- fixed values ---------------------------------------------------------------------------
LEASE_EXPIRED = "Worker lease expired; job queued for replay."
EXHAUSTED = "Retry attempts were exhausted before the job could be claimed."
DEFAULT_REASON = "Ingestion job failed."
# ------------------------------------------------------------------------------------------


def queue_metrics(jobs: DataFrame, as_of, capacity: int, by: list[str] | None = None) -> DataFrame:
    """Counts by state in one pass, with what they leave of the capacity."""
    queued = F.col("state") == "queued"
    counts = jobs.groupBy(*(by or [])).agg(
        F.count_if(queued).alias("queued"),
        F.count_if(queued & (F.col("next_attempt_at") <= F.lit(as_of))).alias("due"),
        F.count_if(F.col("state") == "processing").alias("processing"),
        F.min(F.when(queued, F.col("created_at"))).alias("oldest_queued_at"),
    )
    active = F.col("queued") + F.col("processing")
    return counts.withColumns(
        {
            "active": active,
            "capacity": F.lit(capacity).cast("bigint"),
            "available": F.greatest(F.lit(0).cast("bigint"), F.lit(capacity) - active),
        }
    )


def due_jobs(jobs: DataFrame, as_of, limit: int) -> DataFrame:
    """Oldest due queued jobs first."""
    ready = jobs.filter((F.col("state") == "queued") & (F.col("next_attempt_at") <= F.lit(as_of)))
    return ready.orderBy("next_attempt_at", "id").limit(limit).select("id", "next_attempt_at")


def expired_leases(jobs: DataFrame, as_of, limit: int) -> DataFrame:
    """Processing jobs whose lease ran out, as they look once queued again."""
    lost = jobs.filter((F.col("state") == "processing") & (F.col("lease_expires_at") <= F.lit(as_of)))
    return lost.orderBy("lease_expires_at", "id").limit(limit).select(
        "id", "lease_expires_at", F.lit("queued").alias("state"), F.lit(LEASE_EXPIRED).alias("failure_reason")
    )


def claim_outcomes(jobs: DataFrame, as_of) -> DataFrame:
    """What a claim of each job would meet at a moment."""
    outcome = (
        F.when(F.col("state") != "queued", F.lit("not_queued"))
        .when(F.col("next_attempt_at") > F.lit(as_of), F.lit("not_due"))
        .when(F.col("attempts") >= F.col("max_attempts"), F.lit("exhausted"))
        .otherwise(F.lit("claimed"))
    )
    return jobs.withColumn("outcome", outcome).withColumn(
        "attempt", F.when(F.col("outcome") == "claimed", F.col("attempts") + 1).otherwise(F.col("attempts"))
    )


def failure_outcomes(jobs: DataFrame, failures: DataFrame, base_seconds: int) -> DataFrame:
    """Disposition of reported failures: stale lease, retry with back-off, or failed.

    ``failures``: id, lease_token, attempt, reason, retryable.
    """
    rows = failures.withColumnRenamed("attempt", "_attempt").withColumnRenamed("lease_token", "_token")
    joined = jobs.join(rows, "id")
    owns = (
        (F.col("state") == "processing")
        & (F.col("lease_token") == F.col("_token"))
        & (F.col("attempts") == F.col("_attempt"))
    )
    retry = F.col("retryable") & (F.col("attempts") < F.col("max_attempts"))
    disposition = (
        F.when(~F.coalesce(owns, F.lit(False)), F.lit("stale"))
        .when(retry, F.lit("retry"))
        .otherwise(F.lit("failed"))
    )
    return joined.select(
        "id",
        disposition.alias("disposition"),
        F.when(disposition == "retry", retry_delay_seconds(F.col("attempts"), base_seconds) * 1000).alias("delay_ms"),
        F.when(disposition != "stale", bounded_reason(F.col("reason"), DEFAULT_REASON)).alias("failure_reason"),
    )
