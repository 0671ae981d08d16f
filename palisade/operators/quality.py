"""Data-quality operators: row rules, unique keys, references and state transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import text
from palisade.operators.scale import running_before


def _present(name: str) -> Column:
    return F.trim(F.col(name)) != ""


def _optional(name: str) -> Column:
    return F.col(name).isNull() | _present(name)


def _percent(name: str = "confidence") -> Column:
    return F.col(name).isNull() | F.col(name).between(0, 100)


def _ordered(first: str = "first_seen", last: str = "last_seen") -> Column:
    return F.col(first).isNull() | F.col(last).isNull() | (F.col(first) <= F.col(last))


def _hex(name: str) -> Column:
    return F.col(name).rlike(text.SHA256_HEX)


def rules(table: str) -> dict[str, Column]:
    """Row rules of a model table by name. A rule that evaluates to null passes, as a CHECK does."""
    col = F.col
    span = {"confidence_range": _percent(), "time_range_order": _ordered()}
    named = {"name_not_blank": _present("name"), "normalized_name_not_blank": _present("normalized_name")}
    table_rules: dict[str, dict[str, Column]] = {
        "sources": {"name_not_blank": _present("name"), "kind_not_blank": _present("kind")},
        "raw_evidence": {
            "sha256_lower_hex": _hex("content_sha256"),
            "storage_uri_not_blank": _present("storage_uri"),
            "source_locator_not_blank": _optional("source_locator"),
            "storage_key_not_blank": _optional("storage_key"),
            "original_filename_not_blank": _optional("original_filename"),
            "content_size_positive": col("content_size_bytes").isNull() | (col("content_size_bytes") > 0),
            "processing_attempts_nonnegative": col("processing_attempts") >= 0,
        },
        "ingestion_jobs": {
            "correlation_id_not_blank": _present("correlation_id"),
            "idempotency_key_not_blank": _present("idempotency_key"),
            "attempts_nonnegative": col("attempts") >= 0,
            "max_attempts_range": col("max_attempts").between(1, 10),
            "attempts_within_limit": col("attempts") <= col("max_attempts"),
            "state_shape": job_state_shape(),
        },
        "actors": {
            "canonical_name_not_blank": _present("canonical_name"),
            "normalized_name_not_blank": _present("normalized_name"),
        },
        "aliases": {**named, "confidence_range": _percent()},
        "actor_alias_rules": {
            "alias_name_not_blank": _present("alias_name"),
            "normalized_alias_not_blank": _present("normalized_alias"),
            "reason_not_blank": _present("reason"),
            "created_by_not_blank": _present("created_by"),
            "confidence_range": col("confidence").between(0, 100),
        },
        "actor_resolution_decisions": {
            "reason_not_blank": _present("reason"),
            "decided_by_not_blank": _present("decided_by"),
            "confidence_range": _percent(),
            "actor_shape": (col("decision").isin("auto_link", "manual_link") & col("actor_id").isNotNull())
            | (col("decision").isin("unresolved", "manual_unlink") & col("actor_id").isNull()),
            "decision_hash_lower_hex": _hex("decision_hash"),
        },
        "observations": {"title_not_blank": _present("title"), "summary_not_blank": _present("summary"), **span},
        "normalization_records": {
            "source_native_id_not_blank": _present("source_native_id"),
            "object_type_not_blank": _present("object_type"),
            "object_index_nonnegative": col("object_index") >= 0,
            "payload_sha256_lower_hex": _hex("payload_sha256"),
            "attempts_positive": col("attempts") > 0,
            "failure_reason_present": ~col("status").isin("rejected", "failed")
            | (col("reason").isNotNull() & _present("reason")),
        },
        "evidence": {"citation_not_blank": _present("citation"), "confidence_range": _percent()},
        "evidence_embeddings": {
            "embedding_model_not_blank": _present("embedding_model"),
            "content_sha256_lower_hex": _hex("content_sha256"),
            "dimensions_positive": col("dimensions") > 0,
        },
        "technical_artifacts": {
            "canonical_id_not_blank": _present("canonical_id"),
            "title_not_blank": _present("title"),
            "original_content_not_blank": _present("original_content"),
            "content_sha256_lower_hex": _hex("content_sha256"),
            "imported_has_raw_evidence": (col("origin") != "imported") | col("raw_evidence_id").isNotNull(),
        },
        "behaviors": named,
        "techniques": {"external_id_not_blank": _present("external_id"), "name_not_blank": _present("name")},
        "campaigns": {**named, **span},
        "relationships": {"type_not_blank": _present("relationship_type"), **span},
        "advisories": {
            "slug_safe_format": col("slug").rlike(text.SLUG),
            "publication_shape": (
                (col("status") == "draft") & col("published_revision").isNull() & col("published_at").isNull()
            )
            | (
                (col("status") == "published")
                & col("published_revision").isNotNull()
                & col("published_at").isNotNull()
            ),
            "published_revision_positive": col("published_revision").isNull() | (col("published_revision") > 0),
        },
        "advisory_revisions": {
            "version_positive": col("version") > 0,
            "title_not_blank": _present("title"),
            "summary_not_blank": _present("summary"),
            "created_by_not_blank": _present("created_by"),
            "publication_shape": (col("published_at").isNull() & col("published_by").isNull())
            | (col("published_at").isNotNull() & col("published_by").isNotNull() & _present("published_by")),
        },
    }
    return table_rules[table]


def job_state_shape() -> Column:
    """Which of a job's time and lease columns must be set or empty in each state."""
    col = F.col
    no_lease = col("lease_expires_at").isNull() & col("lease_token").isNull()
    closed = col("finished_at").isNotNull() & col("next_attempt_at").isNull() & no_lease
    explained = col("failure_reason").isNotNull() & (F.trim("failure_reason") != "")
    shapes = {
        "queued": col("finished_at").isNull() & no_lease & col("next_attempt_at").isNotNull(),
        "processing": col("started_at").isNotNull()
        & col("finished_at").isNull()
        & col("lease_expires_at").isNotNull()
        & col("lease_token").isNotNull()
        & col("next_attempt_at").isNull(),
        "succeeded": closed & col("failure_reason").isNull(),
        "failed": closed & explained,
    }
    fits = F.lit(False)
    for state, shape in shapes.items():
        fits = fits | ((col("state") == state) & shape)
    return fits


def check_constraints(df: DataFrame, key: str, row_rules: dict[str, Column], table: str) -> DataFrame:
    """(table, key, rule) for every broken rule, in one pass and without a shuffle."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in row_rules.items()])
    )
    return df.select(
        F.lit(table).alias("table"),
        F.col(key).cast("string").alias("key"),
        F.explode(broken).alias("rule"),
    )


def split_valid(df: DataFrame, row_rules: dict[str, Column]) -> DataFrame:
    """Adds ``rejected_rules``: names of broken rules, empty for an acceptable submission."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in row_rules.items()])
    )
    return df.withColumn("rejected_rules", broken)


def unique_violations(df: DataFrame, key: Sequence[str], table: str) -> DataFrame:
    """Keys held by more than one row; a key with a null part never conflicts."""
    complete = F.lit(True)
    for name in key:
        complete = complete & F.col(name).isNotNull()
    return (
        df.filter(complete)
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .filter(F.col("row_count") > 1)
        .withColumn("table", F.lit(table))
    )


def foreign_key_orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose reference is set but names no parent row.

    Only distinct reference values meet the parent keys, so a value shared by very many rows
    crosses the shuffle once per task; orphans are then few and select the rows to report.
    """
    refs = child.select(F.col(column).alias("_ref")).filter(F.col("_ref").isNotNull()).distinct()
    missing = refs.join(parent.select(F.col(parent_key).alias("_ref")), "_ref", "left_anti")
    return child.join(missing, child[column] == missing["_ref"], "left_semi")


def missing_references(requests: DataFrame, ids: str, target: DataFrame, target_key: str) -> DataFrame:
    """Requested ids in request order with whether each exists (exploded array joined back)."""
    asked = requests.select(
        *[c for c in requests.columns if c != ids], F.posexplode(ids).alias("position", "_id")
    )
    known = target.select(F.col(target_key).alias("_id")).distinct().withColumn("_found", F.lit(True))
    return asked.join(known, "_id", "left").select(
        *[c for c in requests.columns if c != ids], "position", F.col("_id").alias(target_key),
        F.coalesce("_found", F.lit(False)).alias("found"),
    )


# --- fixed values: legal moves of a raw evidence row's processing state ---------------------
TRANSITIONS = (
    ("pending", "processing"),
    ("processing", "succeeded"),
    ("processing", "failed"),
    ("processing", "pending"),
    ("succeeded", "pending"),
    ("failed", "pending"),
)
# ------------------------------------------------------------------------------------------


def illegal_transitions(
    log: DataFrame,
    keys: Sequence[str],
    seq: str,
    state: str,
    allowed: Sequence[tuple[str, str]] = TRANSITIONS,
    initial: Sequence[str] = ("pending",),
    span: int = 1_000_000,
) -> DataFrame:
    """Log rows whose move from the previous state of the same key is not allowed.

    The previous state is the running maximum of (seq, state), which splits over a hot key.
    """
    moved = running_before(
        log, keys, seq, {"_prev": ("max", F.struct(F.col(seq).alias("s"), F.col(state).alias("state")))},
        span,
    ).withColumn("previous_state", F.col("_prev.state"))
    legal = F.col("previous_state").isNull() & F.col(state).isin(*initial)
    for before, after in allowed:
        legal = legal | ((F.col("previous_state") == before) & (F.col(state) == after))
    return moved.filter(~F.coalesce(legal, F.lit(False))).drop("_prev")


# ---- rules of submissions, applied before anything is stored -------------------------------


def submission_rules(kind: str, max_bytes: int = 50 * 1024 * 1024) -> dict[str, Column]:
    col = F.col

    def visible(name: str, limit: int | None = None) -> Column:
        stripped = text.strip(col(name))
        ok = (stripped != "") & ~text.has_control(stripped)
        return ok & (F.length(col(name)) <= limit) if limit else ok

    def optional(name: str, limit: int) -> Column:
        return col(name).isNull() | visible(name, limit)

    table: dict[str, dict[str, Column]] = {
        "source": {
            "name": (text.strip(col("name")) != "") & (F.length("name") <= 255),
            "kind": (text.strip(col("kind")) != "") & (F.length("kind") <= 50),
            "policy_notes": col("policy_notes").isNull()
            | ((text.strip(col("policy_notes")) != "") & (F.length("policy_notes") <= 4000)),
            "license_name": col("license_name").isNull()
            | ((text.strip(col("license_name")) != "") & (F.length("license_name") <= 255)),
        },
        "raw_evidence": {
            "content_present": F.octet_length("content") > 0,
            "content_size": F.octet_length("content") <= max_bytes,
            "source_locator": visible("source_locator", 2048),
            "filename_hint": optional("filename_hint", 512),
            "source_native_id": optional("source_native_id", 512),
            "mime_type": text.media_type(col("mime_type")).isNotNull(),
            "publication_order": col("published_at").isNull() | (col("published_at") <= col("fetched_at")),
        },
        "artifact": {
            "content_text": (text.strip(col("content")) != "") & ~text.has_control(col("content"), True),
            "content_size": F.octet_length("content") <= 10 * 1024 * 1024,
            "provenance": (col("origin") != "imported") | col("raw_evidence_id").isNotNull(),
        },
        "alias": {
            "name": visible("name", 255),
            "source_native_id": optional("source_native_id", 512),
        },
        "alias_rule": {
            "alias_name": visible("alias_name", 255),
            "reason": visible("reason", 2000),
            "created_by": visible("created_by", 255),
            "confidence": col("confidence").between(0, 100),
        },
        "manual_correction": {
            "reason": visible("reason", 2000),
            "decided_by": visible("decided_by", 255),
            "confidence": col("confidence").isNull() | col("confidence").between(0, 100),
        },
        "question": {
            "question": F.length("question").between(2, 1000),
            "date_order": col("date_from").isNull() | col("date_to").isNull()
            | (col("date_from") <= col("date_to")),
        },
        "revision": {
            "title": (text.strip(col("title")) != "") & (F.length(text.strip(col("title"))) <= 500),
            "summary": text.strip(col("summary")) != "",
            "sections_present": F.size("section_types") > 0,
            "sections_unique": F.size("section_types") == F.size(F.array_distinct("section_types")),
            "evidence_unique": F.size("evidence_ids") == F.size(F.array_distinct("evidence_ids")),
        },
        "update": {
            "occurred_at_offset": col("occurred_at").rlike(r"([Zz]|[+-][0-9]{2}:?[0-9]{2})$"),
            "title": (text.strip(col("title")) != "") & (F.length(text.strip(col("title"))) <= 500),
            "summary": text.strip(col("summary")) != "",
            "evidence_unique": F.size("evidence_ids") == F.size(F.array_distinct("evidence_ids")),
        },
    }
    return table[kind]
