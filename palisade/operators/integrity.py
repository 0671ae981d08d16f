"""Reconcile references with blobs: missing, mismatched, orphaned, verified."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_FINDINGS = 100


def reconcile(references: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row per reference or stray blob with its ``kind``; a single full outer join on the key.

    ``references``: raw_evidence_id, storage_key, content_sha256, content_size_bytes.
    ``blobs``: storage_key, blob_sha256, blob_size, and optionally blob_status.
    """
    held = references.filter(F.col("storage_key").isNotNull()).withColumn("_ref", F.lit(True))
    if "blob_status" not in blobs.columns:
        blobs = blobs.withColumn("blob_status", F.lit("read"))
    joined = held.join(blobs, "storage_key", "full_outer")
    same = (F.col("blob_sha256") == F.col("content_sha256")) & (
        F.col("content_size_bytes").isNull() | (F.col("blob_size") == F.col("content_size_bytes"))
    )
    kind = (
        F.when(F.col("_ref").isNull(), F.lit("orphaned"))
        .when(F.col("blob_status").isNull() | (F.col("blob_status") == "missing"), F.lit("missing"))
        .when(F.col("blob_status") == "storage_error", F.lit("storage_error"))
        .when(F.coalesce(same, F.lit(False)), F.lit("verified"))
        .otherwise(F.lit("mismatched"))
    )
    return joined.select("raw_evidence_id", "storage_key", kind.alias("kind"))


def counts(reconciled: DataFrame) -> DataFrame:
    """The report's one row."""
    one = {
        name: F.count_if(F.col("kind") == kind)
        for name, kind in (
            ("verified", "verified"), ("missing", "missing"), ("mismatched", "mismatched"),
            ("storage_errors", "storage_error"), ("orphaned", "orphaned"),
        )
    }
    totals = reconciled.agg(
        F.count_if(F.col("kind") != "orphaned").alias("referenced"),
        *[expr.alias(name) for name, expr in one.items()],
    )
    faults = F.col("missing") + F.col("mismatched") + F.col("storage_errors") + F.col("orphaned")
    return totals.withColumn("clean", faults == 0)


def findings(reconciled: DataFrame, limit: int = MAX_FINDINGS) -> DataFrame:
    """First findings in report order (references by id, then stray keys); ``truncated`` if there are more."""
    order = [F.col("raw_evidence_id").asc_nulls_last(), F.col("storage_key").asc()]
    first = reconciled.filter(F.col("kind") != "verified").orderBy(*order).limit(limit + 1)
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        first.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
        .withColumn("truncated", F.count(F.lit(1)).over(every) > limit)
        .filter(F.col("_n") <= limit).drop("_n")
    )


def write_report(spark, reconciled: DataFrame, path: str) -> None:
    """JSON counts and all findings side by side."""
    counts(reconciled).coalesce(1).write.mode("overwrite").json(f"{path}/counts")
    reconciled.filter(F.col("kind") != "verified").write.mode("overwrite").json(f"{path}/findings")
