"""Idempotent intake: raw evidence, artifacts, sources, rules and jobs, deduplicated by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import ids, text
from palisade.functions.times import utc_millis_text
from palisade.session import materialize


def first_per_key(
    batch: DataFrame, key: Sequence[str], order: str, stored: DataFrame | None = None
) -> DataFrame:
    """Marks each row ``duplicate`` unless it is the first of its key and the key is not stored.

    The first row is found with a map-side combined minimum and joined back, so a key repeated in a
    third of the rows is reduced before the shuffle; the join side has one row per key and AQE
    splits a hot key's other side. ``order`` must be unique within the key.
    """
    firsts = batch.groupBy(*key).agg(F.min(order).alias("_first"))
    if stored is not None:
        known = stored.select(*key).distinct().withColumn("_known", F.lit(True))
        firsts = firsts.join(known, list(key), "left")
    else:
        firsts = firsts.withColumn("_known", F.lit(None).cast("boolean"))
    marked = batch.join(firsts, list(key), "left")
    is_first = (F.col(order) == F.col("_first")) & F.col("_known").isNull()
    return marked.withColumn("duplicate", ~F.coalesce(is_first, F.lit(False))).drop("_first", "_known")


def raw_evidence(
    submissions: DataFrame,
    stored: DataFrame | None = None,
    order: str = "submission_id",
    max_bytes: int = 50 * 1024 * 1024,
    stage: bool = False,
) -> DataFrame:
    """Hash, key and deduplicate submissions by (source, content hash).

    The content is hashed in the scan stage and does not enter the shuffle. Oversized or empty
    content is kept in the output with ``rejection`` set and takes no part in deduplication.
    ``stage`` writes the narrow hashed rows to the shared folder first, so that the bytes of a large
    intake are read and hashed once and not again for the second side of the key join.
    """
    hashed = submissions.select(
        *[c for c in submissions.columns if c not in ("content", "mime_type")],
        text.media_type(F.col("mime_type")).alias("mime_type"),
        ids.content_sha256(F.col("content")).alias("content_sha256"),
        F.octet_length("content").cast("bigint").alias("content_size_bytes"),
    ).withColumn(
        "rejection",
        F.when(F.col("content_size_bytes") == 0, F.lit("empty_content"))
        .when(F.col("content_size_bytes") > max_bytes, F.lit("content_too_large"))
        .when(F.col("mime_type").isNull(), F.lit("bad_media_type")),
    )
    if stage:
        hashed = materialize(hashed, "hashed")
    accepted = first_per_key(
        hashed.filter(F.col("rejection").isNull()), ["source_id", "content_sha256"], order, stored
    )
    rejected = hashed.filter(F.col("rejection").isNotNull()).withColumn("duplicate", F.lit(False))
    both = accepted.unionByName(rejected)
    return both.withColumn(
        "storage_key",
        F.when(
            F.col("rejection").isNull(),
            ids.object_key(F.col("source_id"), F.col("content_sha256"), F.col("mime_type")),
        ),
    )


def new_rows(marked: DataFrame) -> DataFrame:
    """What an intake run appends to the stored table."""
    rows = marked.filter(~F.col("duplicate"))
    return rows.filter(F.col("rejection").isNull()) if "rejection" in marked.columns else rows


def register(
    batch: DataFrame, stored: DataFrame, key: str, attributes: Sequence[str], order: str
) -> DataFrame:
    """Immutable registrations: ``created``, ``duplicate`` (all attributes equal) or ``conflict``.

    A key not stored yet is settled by its first row in the batch; later rows are compared with it.
    """
    details = F.struct(*attributes)
    firsts = batch.groupBy(key).agg(F.min(F.struct(F.col(order).alias("o"), details.alias("d"))).alias("_f"))
    held = stored.select(key, details.alias("_held"))
    basis = firsts.join(held, key, "left").select(
        key,
        F.coalesce("_held", F.col("_f.d")).alias("_basis"),
        F.when(F.col("_held").isNull(), F.col("_f.o")).alias("_creator"),
    )
    outcome = (
        F.when(F.col(order) == F.col("_creator"), F.lit("created"))
        .when(details.eqNullSafe(F.col("_basis")), F.lit("duplicate"))
        .otherwise(F.lit("conflict"))
    )
    return batch.join(basis, key).withColumn("outcome", outcome).drop("_basis", "_creator")


# --- fixed values: what makes two registrations the same ------------------------------------
SOURCE_DETAILS = ("kind", "base_url", "policy_notes", "license_name", "license_url", "metadata")
RULE_DETAILS = ("alias_name", "actor_id", "reason", "confidence", "evidence_id", "created_by", "active")
ALIAS_DETAILS = ("name", "source_native_id", "metadata")
# ------------------------------------------------------------------------------------------


def register_sources(batch: DataFrame, stored: DataFrame, order: str = "submission_id") -> DataFrame:
    return register(batch, stored, "name", SOURCE_DETAILS, order)


def register_alias_rules(batch: DataFrame, stored: DataFrame, order: str = "submission_id") -> DataFrame:
    """Known-alias rules keyed by normalized alias; an inactive stored rule conflicts."""
    ready = batch.withColumns(
        {"normalized_alias": text.normalize_name(F.col("alias_name")), "active": F.lit(True)}
    )
    return register(ready, stored, "normalized_alias", RULE_DETAILS, order)


def assert_aliases(batch: DataFrame, stored: DataFrame, order: str = "submission_id") -> DataFrame:
    """Alias labels keyed by (source, normalized name)."""
    def keyed(df):
        return df.withColumn("_key", F.concat_ws("\x1f", "source_id", "normalized_name"))

    ready = keyed(batch.withColumn("normalized_name", text.normalize_name(F.col("name"))))
    return register(ready, keyed(stored), "_key", ALIAS_DETAILS, order).drop("_key")


def submit_jobs(batch: DataFrame, stored: DataFrame | None = None, order: str = "submission_id") -> DataFrame:
    """Same (job kind, idempotency key) returns the first job with ``duplicate`` set."""
    key = ["job_kind", "idempotency_key"]
    ready = batch.withColumn("idempotency_key", F.trim("idempotency_key"))
    firsts = ready.groupBy(*key).agg(F.min(order).alias("_first"))
    if stored is not None:
        known = stored.select(*key, F.col("id").alias("_stored"))
        firsts = firsts.join(known, key, "left")
    else:
        firsts = firsts.withColumn("_stored", F.lit(None).cast("string"))
    return ready.join(firsts, key).select(
        *ready.columns,
        F.coalesce("_stored", F.col("_first").cast("string")).alias("job_id"),
        (F.col("_stored").isNotNull() | (F.col(order) != F.col("_first"))).alias("duplicate"),
    )


def check_provenance(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """Imported rows need raw evidence, and named raw evidence must exist under the same source."""
    known = raw.select(F.col("id").alias("raw_evidence_id"), F.col("source_id").alias("_owner"))
    missing = (F.col("origin") == "imported") & F.col("raw_evidence_id").isNull()
    foreign = F.col("raw_evidence_id").isNotNull() & ~F.coalesce(
        F.col("_owner") == F.col("source_id"), F.lit(False)
    )
    return (
        rows.join(known, "raw_evidence_id", "left")
        .withColumn(
            "provenance_error",
            F.when(missing, F.lit("imported rows require raw evidence"))
            .when(foreign, F.lit("raw evidence must exist and belong to the same source")),
        )
        .drop("_owner")
    )


def manifest_times(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as UTC millisecond text, for writing records out."""
    return df.withColumns({c: utc_millis_text(F.col(c)) for c in columns})
