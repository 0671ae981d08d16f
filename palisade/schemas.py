"""Tables of the intelligence model, their keys, references and value domains."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

S, B, I, L, TS = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_STAMPS = {"created_at": TS, "updated_at": TS}
_PUBLIC = {"publication_state": S}
_SPAN = {"first_seen": TS, "last_seen": TS, "confidence": I}
_KIND = {"intelligence_type": S, "origin": S}

TABLES: dict[str, T.StructType] = {
    "sources": _table(
        id=S, name=S, kind=S, base_url=S, policy_notes=S, license_name=S, license_url=S,
        metadata=S, **_PUBLIC, **_STAMPS),
    "raw_evidence": _table(
        id=S, source_id=S, storage_uri=S, storage_key=S, source_locator=S, original_filename=S,
        content_sha256=S, content_size_bytes=L, retrieved_at=TS, published_at=TS, mime_type=S,
        source_native_id=S, retrieval_status=S, processing_state=S, processing_error=S,
        processing_attempts=I, metadata=S, **_STAMPS),
    "ingestion_jobs": _table(
        id=S, job_kind=S, source_id=S, state=S, correlation_id=S, idempotency_key=S, attempts=I,
        max_attempts=I, next_attempt_at=TS, started_at=TS, finished_at=TS, lease_expires_at=TS,
        lease_token=S, failure_reason=S, **_STAMPS),
    "actors": _table(
        id=S, canonical_name=S, normalized_name=S, description=S, metadata=S, **_PUBLIC, **_STAMPS),
    "aliases": _table(
        id=S, source_id=S, actor_id=S, name=S, normalized_name=S, source_native_id=S,
        confidence=I, metadata=S, **_PUBLIC, **_STAMPS),
    "actor_alias_rules": _table(
        id=S, alias_name=S, normalized_alias=S, actor_id=S, reason=S, confidence=I,
        evidence_id=S, created_by=S, active=B),
    "actor_resolution_decisions": _table(
        sequence=L, alias_id=S, actor_id=S, previous_actor_id=S, evidence_id=S, decision=S,
        method=S, reason=S, confidence=I, decided_by=S, candidates=S, decision_hash=S),
    "observations": _table(
        id=S, source_id=S, raw_evidence_id=S, source_native_id=S, title=S, summary=S,
        observed_at=TS, **_SPAN, **_KIND, metadata=S, **_PUBLIC, **_STAMPS),
    "normalization_records": _table(
        source_id=S, raw_evidence_id=S, source_native_id=S, object_type=S, object_index=I,
        payload_sha256=S, status=S, stage=S, reason=S, attempts=I),
    "evidence": _table(
        id=S, source_id=S, raw_evidence_id=S, citation=S, excerpt=S, locator=S, captured_at=TS,
        confidence=I, origin=S, **_PUBLIC, **_STAMPS),
    "evidence_embeddings": _table(
        evidence_id=S, source_id=S, embedding_model=S, content_sha256=S, dimensions=I,
        embedding=T.ArrayType(T.FloatType())),
    "technical_artifacts": _table(
        id=S, source_id=S, raw_evidence_id=S, artifact_type=S, origin=S, canonical_id=S, title=S,
        version=S, content_sha256=S, original_content=S, validation_status=S,
        validation_errors=T.ArrayType(S), metadata=S, created_at=TS),
    "behaviors": _table(
        id=S, name=S, normalized_name=S, description=S, metadata=S, **_PUBLIC, **_STAMPS),
    "techniques": _table(
        id=S, source_id=S, external_id=S, name=S, description=S, metadata=S, **_PUBLIC, **_STAMPS),
    "campaigns": _table(
        id=S, source_id=S, name=S, normalized_name=S, source_native_id=S, description=S,
        **_SPAN, **_KIND, metadata=S, **_PUBLIC, **_STAMPS),
    "relationships": _table(
        id=S, actor_id=S, relationship_type=S, campaign_id=S, source_id=S, evidence_id=S,
        **_SPAN, **_KIND, **_STAMPS),
    "advisories": _table(
        id=S, slug=S, status=S, published_revision=I, published_at=TS, **_STAMPS),
    "advisory_revisions": _table(
        id=S, advisory_id=S, version=I, title=S, summary=S, created_by=S, published_at=TS,
        published_by=S, created_at=TS),
    "advisory_sections": _table(
        revision_id=S, section_type=S, position=I, intelligence_type=S, content=S),
    "advisory_updates": _table(
        id=S, advisory_id=S, revision_id=S, sequence=I, occurred_at=TS, title=S, summary=S,
        intelligence_type=S, created_by=S, created_at=TS),
    "actor_observations": _table(actor_id=S, observation_id=S),
    "observation_evidence": _table(observation_id=S, evidence_id=S),
    "observation_behaviors": _table(observation_id=S, behavior_id=S),
    "observation_techniques": _table(observation_id=S, technique_id=S),
    "revision_evidence": _table(revision_id=S, evidence_id=S),
    "revision_actors": _table(revision_id=S, actor_id=S),
    "revision_campaigns": _table(revision_id=S, campaign_id=S),
    "revision_techniques": _table(revision_id=S, technique_id=S),
    "update_evidence": _table(update_id=S, evidence_id=S),
}

# --- fixed values: natural keys; a key with a null part is exempt, as in SQL ----------------
UNIQUE_KEYS: dict[str, list[tuple[str, ...]]] = {
    "sources": [("name",)],
    "raw_evidence": [("source_id", "content_sha256"), ("storage_key",)],
    "ingestion_jobs": [("job_kind", "idempotency_key")],
    "actors": [("normalized_name",)],
    "aliases": [("source_id", "normalized_name")],
    "actor_alias_rules": [("normalized_alias",)],
    "actor_resolution_decisions": [("alias_id", "decision_hash")],
    "observations": [("source_id", "source_native_id")],
    "normalization_records": [("raw_evidence_id", "object_index")],
    "evidence_embeddings": [("evidence_id", "embedding_model")],
    "technical_artifacts": [("source_id", "artifact_type", "content_sha256")],
    "behaviors": [("normalized_name",)],
    "techniques": [("source_id", "external_id")],
    "campaigns": [("source_id", "normalized_name")],
    "relationships": [("actor_id", "relationship_type", "campaign_id", "source_id")],
    "advisories": [("slug",)],
    "advisory_revisions": [("advisory_id", "version")],
    "advisory_sections": [("revision_id", "section_type"), ("revision_id", "position")],
    "advisory_updates": [("advisory_id", "sequence")],
}

# --- fixed values: (child, column, parent); parent key is "id" ------------------------------
FOREIGN_KEYS: list[tuple[str, str, str]] = [
    ("raw_evidence", "source_id", "sources"),
    ("ingestion_jobs", "source_id", "sources"),
    ("aliases", "source_id", "sources"),
    ("aliases", "actor_id", "actors"),
    ("actor_alias_rules", "actor_id", "actors"),
    ("actor_alias_rules", "evidence_id", "evidence"),
    ("actor_resolution_decisions", "alias_id", "aliases"),
    ("actor_resolution_decisions", "actor_id", "actors"),
    ("observations", "source_id", "sources"),
    ("observations", "raw_evidence_id", "raw_evidence"),
    ("normalization_records", "source_id", "sources"),
    ("normalization_records", "raw_evidence_id", "raw_evidence"),
    ("evidence", "source_id", "sources"),
    ("evidence", "raw_evidence_id", "raw_evidence"),
    ("evidence_embeddings", "evidence_id", "evidence"),
    ("technical_artifacts", "source_id", "sources"),
    ("technical_artifacts", "raw_evidence_id", "raw_evidence"),
    ("techniques", "source_id", "sources"),
    ("campaigns", "source_id", "sources"),
    ("relationships", "actor_id", "actors"),
    ("relationships", "campaign_id", "campaigns"),
    ("relationships", "source_id", "sources"),
    ("relationships", "evidence_id", "evidence"),
    ("advisory_revisions", "advisory_id", "advisories"),
    ("advisory_sections", "revision_id", "advisory_revisions"),
    ("advisory_updates", "advisory_id", "advisories"),
    ("advisory_updates", "revision_id", "advisory_revisions"),
    ("actor_observations", "actor_id", "actors"),
    ("actor_observations", "observation_id", "observations"),
    ("observation_evidence", "observation_id", "observations"),
    ("observation_evidence", "evidence_id", "evidence"),
    ("observation_behaviors", "observation_id", "observations"),
    ("observation_behaviors", "behavior_id", "behaviors"),
    ("observation_techniques", "observation_id", "observations"),
    ("observation_techniques", "technique_id", "techniques"),
]

# --- fixed values: order of entity kinds among equal search scores --------------------------
ENTITY_ORDER = {
    "actor": 0,
    "alias": 1,
    "campaign": 2,
    "behavior": 3,
    "technique": 4,
    "observation": 5,
    "source": 6,
}


@dataclass
class Graph:
    """The model's tables by name, as DataFrames or as functions that make one on first use.

    Absent tables are empty DataFrames of the declared schema.
    """

    spark: object
    tables: dict = field(default_factory=dict)

    def __getattr__(self, name):
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], TABLES[name])
        elif callable(self.tables[name]):
            self.tables[name] = self.tables[name]()
        return self.tables[name]
