"""Staged normalization of bundle objects into observations with a per-record ledger.

parse -> normalize -> validate -> deduplicate -> persist. A record leaves at the first stage that
refuses it and never reaches the fold of a later stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.jsonx import Members, fields, kinds, payload_sha256, struct_sha256, variant_kind
from palisade.functions.text import bounded_reason, strip
from palisade.functions.times import offset_timestamp
from palisade.operators.scale import numbered, running_before

# --- fixed values: reasons written to the ledger --------------------------------------------
UNSUPPORTED = "unsupported object type: "
INVALID_FIELDS = "invalid ATT&CK intrusion-set fields: "
BAD_PROVENANCE = "raw evidence does not match the source provenance"
NEWER_EXISTS = "existing observation has a newer source timestamp"
SAME_EXISTS = "canonical observation already exists"
SAME_TIME_CONFLICT = "conflicting canonical content has the same source timestamp"
IDENTITY_CONFLICT = "Raw evidence object index conflicts with its recorded normalization identity"
SUPPORTED_TYPE = "intrusion-set"
SPEC_VERSION = "2.1"
LISTED_FIELDS = 8
# ------------------------------------------------------------------------------------------

#: Total arrival order: bundle by bundle, then by position in the bundle.
ARRIVAL = (("bundle_seq", True), ("raw_evidence_id", True), ("object_index", True))


def _optional_text(p: Members, name: str, limit: int | None = None) -> Column:
    ok = p.kind(name).isin("", "VOID") | (
        (p.kind(name) == "STRING")
        & (F.length(p.text(name)) <= limit if limit else F.lit(True))
    )
    return ~ok


def _bad_time(p: Members, name: str, required: bool) -> Column:
    parsed = offset_timestamp(p.text(name)).isNotNull()
    return ~parsed if required else ~(p.kind(name).isin("", "VOID") | parsed)


def _bad_flag(p: Members, name: str) -> Column:
    word = F.lower(p.read(name, "string"))
    truthy = word.isin("true", "false", "1", "0", "t", "f", "y", "n", "yes", "no", "on", "off")
    return (p.kind(name) != "") & ~F.coalesce(truthy, F.lit(False))


def _bad_percent(p: Members, name: str) -> Column:
    number = p.read(name, "double")
    whole = (number == F.floor(number)) & number.between(0, 100)
    usable = p.kind(name).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "STRING", "BOOLEAN")
    return ~(p.kind(name).isin("", "VOID") | (usable & F.coalesce(whole, F.lit(False))))


def parse_intrusion_sets(objects: DataFrame) -> DataFrame:
    """Typed fields of each supported object, or the sorted list of fields it gets wrong.

    Input: ``object_type``, ``object_id``, ``payload`` (exact JSON text) beside any envelope columns.
    """
    supported = F.col("object_type") == SUPPORTED_TYPE
    rows = objects.withColumn(
        "_m", F.when(supported, fields(F.try_parse_json("payload")))
    ).withColumn("_k", kinds(F.col("_m")))
    p = Members(F.col("_m"), F.col("_k"))
    names = {
        "id": ~F.coalesce(F.length(p.text("id")).between(1, 512), F.lit(False)),
        "spec_version": ~F.coalesce(p.text("spec_version") == SPEC_VERSION, F.lit(False)),
        "name": ~F.coalesce(
            F.length(p.text("name")).between(1, 500) & (strip(p.text("name")) != ""), F.lit(False)
        ),
        "description": _optional_text(p, "description"),
        "created": _bad_time(p, "created", True),
        "modified": _bad_time(p, "modified", True),
        "first_seen": _bad_time(p, "first_seen", False),
        "last_seen": _bad_time(p, "last_seen", False),
        "aliases": (p.kind("aliases") != "") & (p.kind("aliases") != "ARRAY"),
        "external_references": (p.kind("external_references") != "")
        & (p.kind("external_references") != "ARRAY"),
        "confidence": _bad_percent(p, "confidence"),
        "revoked": _bad_flag(p, "revoked"),
        "x_mitre_deprecated": _bad_flag(p, "x_mitre_deprecated"),
        "x_mitre_version": _optional_text(p, "x_mitre_version", 100),
    }
    flat = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in names.items()]))
    aliases = p.read("aliases", "array<variant>")
    refs = p.read("external_references", "array<variant>")
    not_text = F.transform(
        aliases,
        lambda x, i: F.when(
            F.coalesce(variant_kind(x), F.lit("VOID")) != "STRING",
            F.concat(F.lit("aliases."), i.cast("string")),
        ),
    )
    alias_faults = F.coalesce(F.array_compact(not_text), F.array().cast("array<string>"))
    alias_texts = F.transform(aliases, lambda x: strip(F.try_variant_get(x, "$", "string")))
    blank_alias = F.when(
        (F.size(alias_faults) == 0) & F.exists(alias_texts, lambda x: x == ""),
        F.array(F.lit("aliases")),
    ).otherwise(F.array().cast("array<string>"))

    def ref_faults(x, i):
        r = Members(fields(x), kinds(fields(x)))
        at = F.concat(F.lit("external_references."), i.cast("string"))
        bad_name = ~F.coalesce(F.length(r.text("source_name")).between(1, 255), F.lit(False))
        inner = F.array_compact(
            F.array(
                F.when(bad_name, F.concat(at, F.lit(".source_name"))),
                F.when(_optional_text(r, "external_id", 255), F.concat(at, F.lit(".external_id"))),
                F.when(_optional_text(r, "url", 2048), F.concat(at, F.lit(".url"))),
            )
        )
        is_object = F.coalesce(variant_kind(x), F.lit("VOID")) == "OBJECT"
        return F.when(is_object, inner).otherwise(F.array(at))

    reference_faults = F.coalesce(
        F.flatten(F.transform(refs, ref_faults)), F.array().cast("array<string>")
    )
    bad = F.array_sort(F.array_distinct(F.concat(flat, alias_faults, blank_alias, reference_faults)))
    parsed = rows.withColumns(
        {
            "bad_fields": F.when(F.col("_m").isNotNull(), bad),
            "name": strip(p.text("name")),
            "description": F.nullif(strip(p.text("description")), F.lit("")),
            "created": offset_timestamp(p.text("created")),
            "modified": offset_timestamp(p.text("modified")),
            "first_seen": offset_timestamp(p.text("first_seen")),
            "last_seen": offset_timestamp(p.text("last_seen")),
            "confidence": p.read("confidence", "int"),
            "aliases": F.coalesce(alias_texts, F.array().cast("array<string>")),
            "external_references": F.coalesce(F.to_json(p.item("external_references")), F.lit("[]")),
            "revoked": F.coalesce(p.read("revoked", "boolean"), F.lit(False)),
            "x_mitre_deprecated": F.coalesce(
                p.read("x_mitre_deprecated", "boolean"), F.lit(False)
            ),
            "x_mitre_version": F.nullif(strip(p.text("x_mitre_version")), F.lit("")),
        }
    )
    disordered = (F.col("modified") < F.col("created")) | (F.col("first_seen") > F.col("last_seen"))
    reason = (
        F.when(F.col("object_type") != SUPPORTED_TYPE,
               F.concat(F.lit(UNSUPPORTED), F.col("object_type")))
        .when(F.size("bad_fields") > 0,
              F.concat(F.lit(INVALID_FIELDS), F.array_join(F.slice("bad_fields", 1, LISTED_FIELDS), ", ")))
        .when(F.coalesce(disordered, F.lit(False)), F.lit(f"{INVALID_FIELDS}record"))
    )
    outcome = F.when(F.col("object_type") != SUPPORTED_TYPE, F.lit("unsupported")).when(
        reason.isNotNull(), F.lit("rejected")
    )
    return parsed.withColumns({"parse_outcome": outcome, "parse_reason": reason}).drop("_m", "_k")


def to_observations(parsed: DataFrame) -> DataFrame:
    """Canonical observation columns, with the content fingerprint that ignores the raw row."""
    metadata = F.to_json(
        F.struct(
            "aliases",
            F.col("created").cast("string").alias("created"),
            F.col("external_references"),
            F.col("modified").cast("string").alias("modified"),
            "revoked",
            F.lit(SPEC_VERSION).alias("spec_version"),
            F.lit(SUPPORTED_TYPE).alias("stix_type"),
            "x_mitre_deprecated",
            "x_mitre_version",
        )
    )
    shaped = parsed.withColumns(
        {
            "source_native_id": F.col("object_id"),
            "title": F.col("name"),
            "summary": F.coalesce("description", "name"),
            "observed_at": F.col("modified"),
            "metadata": metadata,
        }
    )
    parts = ["source_id", "source_native_id", "title", "summary", "observed_at", "first_seen",
             "last_seen", "confidence", "metadata"]
    return shaped.withColumn("fingerprint", struct_sha256(**{c: F.col(c) for c in parts}))


def check_raw_provenance(records: DataFrame, raw_evidence: DataFrame) -> DataFrame:
    """Adds ``provenance_reason`` where the raw row is missing or belongs to another source."""
    owner = raw_evidence.select(
        F.col("id").alias("raw_evidence_id"), F.col("source_id").alias("_owner")
    )
    fits = F.coalesce(F.col("_owner") == F.col("source_id"), F.lit(False))
    return (
        records.join(owner, "raw_evidence_id", "left")
        .withColumn("provenance_reason", F.when(~fits, F.lit(BAD_PROVENANCE)))
        .drop("_owner")
    )


def version_fold(
    records: DataFrame,
    keys: list[str],
    seq: str,
    observed_at: str,
    fingerprint: str,
    stored: DataFrame | None = None,
    span: int = 1_000_000,
    levels: int = 2,
) -> DataFrame:
    """What each record does to the row its key holds at that moment, in arrival order.

    The held row is always the earliest arrival at the greatest time seen so far: a tie is either a
    repeat (kept) or a conflict (rejected) and never replaces it. So the held row is a running
    maximum of (time, stored, -seq), which is computed over bounded chunks; a stored row came before
    all others and is joined once per key.
    """
    def held(is_stored: bool, nseq: Column) -> Column:
        return F.struct(F.col(observed_at).alias("at"), F.lit(is_stored).alias("stored"),
                        nseq.alias("nseq"), F.col(fingerprint).alias("fp"))

    run = running_before(
        records, keys, seq, {"_held": ("max", held(False, -F.col(seq).cast("bigint")))}, span, levels
    )
    if stored is not None:
        first = stored.select(*[F.col(k).alias(f"_s_{k}") for k in keys],
                              held(True, F.lit(0).cast("bigint")).alias("_first"))
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"_s_{k}"))
        run = run.join(first, same, "left").withColumn("_held", F.greatest("_held", "_first")).drop(
            "_first", *[f"_s_{k}" for k in keys]
        )
    at, fp = F.col(observed_at), F.col(fingerprint)
    action = (
        F.when(F.col("_held").isNull(), F.lit("create"))
        .when(at < F.col("_held.at"), F.lit("keep"))
        .when(at > F.col("_held.at"), F.lit("update"))
        .when(fp == F.col("_held.fp"), F.lit("keep"))
        .otherwise(F.lit("reject"))
    )
    reason = (
        F.when(at < F.col("_held.at"), F.lit(NEWER_EXISTS))
        .when((at == F.col("_held.at")) & (fp == F.col("_held.fp")), F.lit(SAME_EXISTS))
        .when(at == F.col("_held.at"), F.lit(SAME_TIME_CONFLICT))
    )
    return (
        run.withColumns({"action": action, "reason": reason})
        .drop("_held")
    )


def winners(folded: DataFrame, keys: list[str], seq: str, observed_at: str) -> DataFrame:
    """The one record per key that the fold leaves in place, if it came from this batch.

    Every write is newer than the one before it, so the winner is simply the last write of the key.
    """
    writes = folded.filter(F.col("action").isin("create", "update"))
    last = writes.groupBy(*keys).agg(F.max(F.col(seq)).alias(seq))
    return writes.join(last, [*keys, seq], "left_semi")


def ledger(
    outcomes: DataFrame, previous: DataFrame | None = None, payload_hash: str = "payload_sha256"
) -> DataFrame:
    """One row per (raw evidence, object index) with status, stage, reason and attempts.

    A replay raises ``attempts``; a row whose recorded identity differs is left as it was and
    reported with ``identity_conflict``.
    """
    key = ["raw_evidence_id", "object_index"]
    current = outcomes.select(
        *key, "source_id", "source_native_id", "object_type", payload_hash, "status", "stage", "reason"
    )
    if previous is None:
        return current.withColumns({"attempts": F.lit(1), "identity_conflict": F.lit(False)})
    identity = ["source_id", "source_native_id", "object_type", payload_hash]
    old = previous.select(
        *key, F.struct(*identity).alias("_id"), F.col("attempts").alias("_attempts"),
        F.struct("status", "stage", "reason").alias("_state"),
    )
    joined = current.join(old, key, "full_outer")
    is_new = F.col("_id").isNull()
    untouched = F.col("status").isNull()
    clash = ~is_new & ~untouched & ~F.struct(*identity).eqNullSafe(F.col("_id"))
    keep_old = untouched | clash
    return joined.select(
        *key,
        *[F.when(keep_old, F.col(f"_id.{c}")).otherwise(F.col(c)).alias(c) for c in identity],
        *[
            F.when(keep_old, F.col(f"_state.{c}")).otherwise(F.col(c)).alias(c)
            for c in ("status", "stage", "reason")
        ],
        F.when(is_new, F.lit(1)).when(keep_old, F.col("_attempts"))
        .otherwise(F.col("_attempts") + 1).alias("attempts"),
        clash.alias("identity_conflict"),
    )


def bundle_outcomes(bundles: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects seen, emitted and failed per bundle, and the state its raw evidence ends in.

    ``objects`` has ``raw_evidence_id`` and ``failed``; ``bundles`` has ``bundle_error``, ``bytes``
    and ``already_succeeded``.
    """
    counts = objects.groupBy("raw_evidence_id").agg(
        F.count(F.lit(1)).alias("objects_seen"), F.count_if("failed").alias("objects_failed")
    )
    joined = bundles.join(counts, "raw_evidence_id", "left")
    seen = F.coalesce("objects_seen", F.lit(0))
    bad = F.coalesce("objects_failed", F.lit(0))
    skipped = F.col("already_succeeded")
    broken = F.col("bundle_error").isNotNull()
    return joined.select(
        "raw_evidence_id",
        "bytes",
        F.when(skipped | broken, F.lit(0)).otherwise(seen).cast("bigint").alias("objects_seen"),
        F.when(skipped | broken, F.lit(0)).otherwise(seen - bad).cast("bigint").alias("objects_emitted"),
        F.when(skipped, F.lit(0)).when(broken, F.lit(1)).otherwise(bad).cast("bigint").alias("objects_failed"),
        F.when(skipped, F.lit("skipped")).when(broken | (bad > 0), F.lit("failed"))
        .otherwise(F.lit("succeeded")).alias("status"),
        F.when(skipped, F.lit(None)).when(broken, F.col("bundle_error"))
        .when(bad > 0, F.concat(bad.cast("string"), F.lit(" of "), seen.cast("string"),
                                F.lit(" STIX objects failed at the normalization boundary")))
        .alias("error"),
    )


@dataclass
class NormalizationResult:
    """Everything one run produces."""

    outcomes: DataFrame
    changed: DataFrame
    ledger: DataFrame


def normalize_batch(
    objects: DataFrame,
    raw_evidence: DataFrame,
    stored: DataFrame | None = None,
    previous_ledger: DataFrame | None = None,
) -> NormalizationResult:
    """Run all five stages over split bundle objects.

    ``objects``: raw_evidence_id, source_id, bundle_seq, object_index, object_id, object_type, payload,
    object_error. Parsed records are numbered in order of arrival and thereby written once; three outputs read them.
    """
    sound = objects.filter(F.col("object_error").isNull())
    parsed = parse_intrusion_sets(sound)
    shaped = check_raw_provenance(to_observations(parsed), raw_evidence).withColumn(
        "payload_sha256", payload_sha256(F.col("payload"))
    ).drop("payload")
    shaped = numbered(shaped, ARRIVAL, number="seq")
    early = F.coalesce("parse_reason", "provenance_reason")
    stopped = shaped.filter(early.isNotNull()).withColumns(
        {
            "stage": F.when(F.col("parse_reason").isNotNull(), F.lit("parse")).otherwise(F.lit("validate")),
            "reason": bounded_reason(early, "normalization failed"),
            "action": F.lit(None).cast("string"),
            "status": F.lit("rejected"),
            "failed": F.coalesce(F.col("parse_outcome") != "unsupported", F.lit(True)),
        }
    )
    keys = ["source_id", "source_native_id"]
    folded = version_fold(
        shaped.filter(early.isNull()), keys, "seq", "observed_at", "fingerprint", stored
    )
    settled = folded.withColumns(
        {
            "stage": F.when(F.col("action") == "reject", F.lit("deduplicate")).otherwise(F.lit("persist")),
            "status": F.when(F.col("action") == "reject", F.lit("rejected"))
            .when(F.col("action") == "keep", F.lit("deduplicated"))
            .otherwise(F.lit("succeeded")),
            "failed": F.col("action") == "reject",
        }
    )
    outcomes = settled.unionByName(stopped)
    return NormalizationResult(
        outcomes=outcomes,
        changed=winners(folded, keys, "seq", "observed_at"),
        ledger=ledger(outcomes, previous_ledger),
    )
