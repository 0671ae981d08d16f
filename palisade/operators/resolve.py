"""Conservative resolution of alias labels to actors, with an idempotent decision audit.

Exact evidence can link; similarity only proposes. Candidates come from the state before the batch,
so labels of one batch do not see each other's links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.jsonx import escaped_sha256
from palisade.functions.text import ASCII_ONLY
from palisade.operators.scale import numbered, running_before, top_n
from palisade.operators.similarity import similar_pairs

# --- fixed values: bases, methods, reasons --------------------------------------------------
BASIS_CANONICAL = "exact canonical name"
BASIS_RULE = "curated known alias"
BASIS_ALIAS = "existing source alias assertion"
BASIS_SIMILAR_NAME = "similar canonical name"
BASIS_SIMILAR_RULE = "similar curated alias"
REASONS = {
    "existing_link": "Existing source-specific actor link retained.",
    "ambiguous_exact": "Exact evidence identifies multiple actors; manual review is required.",
    "exact_actor_name": "Alias exactly matches the canonical actor name.",
    "exact_candidates": "Matching source aliases are candidates but cannot establish identity.",
    "similarity_candidates": "Similar actor names found; similarity cannot auto-link actors.",
    "no_match": "No deterministic actor match was found.",
}
RULE_REASON = "Curated known-alias rule: "
THRESHOLD = 0.84
MAX_SIMILAR = 10
# ------------------------------------------------------------------------------------------


def name_evidence(
    names: DataFrame, actors: DataFrame, rules: DataFrame, linked: DataFrame
) -> DataFrame:
    """One row per (normalized_name, actor_id) with its bases; three equi joins on the name.

    Works on distinct names: all unlinked aliases of one name have the same evidence, and linked
    aliases are reduced to distinct (name, actor) pairs, so copies are never multiplied.
    """
    def row(actor, basis, by_name=False, confidence=None, reason=None):
        return [
            "normalized_name", F.col(actor).alias("actor_id"), F.lit(basis).alias("basis"),
            F.lit(by_name).alias("by_name"),
            (F.col(confidence) if confidence else F.lit(None)).cast("int").alias("rule_confidence"),
            (F.col(reason) if reason else F.lit(None)).cast("string").alias("rule_reason"),
        ]

    by_name = actors.join(names, "normalized_name", "left_semi").select(
        *row("id", BASIS_CANONICAL, by_name=True)
    )
    active = rules.filter("active").withColumnRenamed("normalized_alias", "normalized_name")
    by_rule = active.join(names, "normalized_name", "left_semi").select(
        *row("actor_id", BASIS_RULE, confidence="confidence", reason="reason")
    )
    held = linked.filter(F.col("actor_id").isNotNull()).select("normalized_name", "actor_id").distinct()
    by_alias = held.join(names, "normalized_name", "left_semi").select(*row("actor_id", BASIS_ALIAS))
    return (
        by_name.unionByName(by_rule).unionByName(by_alias)
        .groupBy("normalized_name", "actor_id")
        .agg(
            F.array_sort(F.collect_set("basis")).alias("bases"),
            F.max("by_name").alias("by_name"),
            F.max("rule_confidence").alias("rule_confidence"),
            F.max("rule_reason").alias("rule_reason"),
        )
    )


def exact_evidence(
    labels: DataFrame, actors: DataFrame, rules: DataFrame, linked: DataFrame
) -> DataFrame:
    """One row per (alias_id, actor_id) of unlinked aliases (alias_id, normalized_name)."""
    names = labels.select("normalized_name").distinct()
    found = name_evidence(names, actors, rules, linked)
    return labels.join(found, "normalized_name").drop("normalized_name")


def similar_candidates(
    labels: DataFrame,
    actors: DataFrame,
    rules: DataFrame,
    threshold: float = THRESHOLD,
    limit: int = MAX_SIMILAR,
) -> DataFrame:
    """Ten best actors per label by similarity to a canonical name or an active rule's alias."""
    names = labels.select("normalized_name").distinct()
    ranked = similar_to_names(names, actors, rules, threshold, limit)
    return labels.join(ranked, "normalized_name").drop("normalized_name")


def similar_to_names(
    names: DataFrame, actors: DataFrame, rules: DataFrame, threshold: float, limit: int
) -> DataFrame:
    """(normalized_name, actor_id, bases, similarity, position) for distinct names."""
    rule_names = rules.filter("active").select(F.col("normalized_alias").alias("name"), "actor_id")
    known = (
        actors.select(F.col("normalized_name").alias("name"), F.col("id").alias("actor_id"),
                      F.lit(BASIS_SIMILAR_NAME).alias("basis"))
        .unionByName(rule_names.withColumn("basis", F.lit(BASIS_SIMILAR_RULE)))
    )
    pairs = similar_pairs(names, known, threshold, "normalized_name", "name")
    best = (
        pairs.join(known, "name")
        .groupBy("normalized_name", "actor_id")
        .agg(F.max("similarity").alias("similarity"), F.array_sort(F.collect_set("basis")).alias("bases"))
    )
    order = (("similarity", False), ("actor_id", True))
    return top_n(best, ["normalized_name"], order, limit, "position")


def _candidate_list(rows: DataFrame, actors: DataFrame, order: str) -> DataFrame:
    named = rows.join(actors.select(F.col("id").alias("actor_id"), "canonical_name"), "actor_id")
    packed = F.array_sort(
        F.collect_list(
            F.struct(
                F.col(order).alias("o"),
                F.struct(
                    "actor_id", "bases", "canonical_name", F.round("similarity", 6).alias("similarity")
                ).alias("c"),
            )
        )
    )
    return named.groupBy("normalized_name").agg(
        F.transform(packed, lambda x: x.getField("c")).alias("candidates")
    )


def resolve(
    aliases: DataFrame,
    actors: DataFrame,
    rules: DataFrame,
    latest: DataFrame | None = None,
    threshold: float = THRESHOLD,
    evidence_id: str | None = None,
) -> DataFrame:
    """One decision per alias; the work is done once per distinct name.

    ``aliases``: id, normalized_name, actor_id (null if unlinked), confidence. ``latest`` holds the
    newest decision per alias; a linked alias returns it unchanged (``repeated``).
    """
    open_labels = aliases.filter(F.col("actor_id").isNull()).select(
        F.col("id").alias("alias_id"), "normalized_name"
    )
    names = open_labels.select("normalized_name").distinct()
    exact = name_evidence(names, actors, rules, aliases)
    summary = exact.groupBy("normalized_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("actor_id").alias("one_actor"),
        F.max("by_name").alias("by_name"),
        F.max("rule_confidence").alias("rule_confidence"),
        F.max("rule_reason").alias("rule_reason"),
    )
    unmatched = names.join(summary.select("normalized_name"), "normalized_name", "left_anti")
    similar = similar_to_names(unmatched, actors, rules, threshold, MAX_SIMILAR)
    listed = _candidate_list(
        exact.withColumn("similarity", F.lit(None).cast("double")), actors, "actor_id"
    ).unionByName(_candidate_list(similar, actors, "position"))
    per_name = names.join(summary, "normalized_name", "left").join(listed, "normalized_name", "left")
    joined = open_labels.join(per_name, "normalized_name")
    has_similar = F.col("n").isNull() & F.col("candidates").isNotNull()
    method = (
        F.when(F.col("n") > 1, F.lit("ambiguous_exact"))
        .when((F.col("n") == 1) & F.col("by_name"), F.lit("exact_actor_name"))
        .when((F.col("n") == 1) & F.col("rule_reason").isNotNull(), F.lit("known_alias"))
        .when(F.col("n") == 1, F.lit("exact_candidates"))
        .when(has_similar, F.lit("similarity_candidates"))
        .otherwise(F.lit("no_match"))
    )
    reasons = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    decided = joined.withColumn("method", method)
    links = F.col("method").isin("exact_actor_name", "known_alias")
    fresh = decided.select(
        "alias_id",
        F.when(links, F.col("one_actor")).alias("actor_id"),
        F.lit(None).cast("string").alias("previous_actor_id"),
        F.lit(evidence_id).cast("string").alias("evidence_id"),
        F.when(links, F.lit("auto_link")).otherwise(F.lit("unresolved")).alias("decision"),
        "method",
        F.when(F.col("method") == "known_alias", F.concat(F.lit(RULE_REASON), F.col("rule_reason")))
        .otherwise(F.try_element_at(reasons, F.col("method"))).alias("reason"),
        F.when(F.col("method") == "exact_actor_name", F.lit(100))
        .when(F.col("method") == "known_alias", F.col("rule_confidence")).alias("confidence"),
        F.lit("system").alias("decided_by"),
        F.coalesce("candidates", _no_candidates()).alias("candidates"),
        F.lit(False).alias("repeated"),
    )
    return fresh.unionByName(_retained(aliases, latest, evidence_id))


def _no_candidates() -> Column:
    return F.array().cast(
        "array<struct<actor_id:string,bases:array<string>,canonical_name:string,similarity:double>>"
    )


def _retained(aliases: DataFrame, latest: DataFrame | None, evidence_id: str | None) -> DataFrame:
    linked = aliases.filter(F.col("actor_id").isNotNull()).select(
        F.col("id").alias("alias_id"), F.col("actor_id").alias("_actor"),
        F.col("confidence").alias("_confidence"),
    )
    columns = ["actor_id", "previous_actor_id", "evidence_id", "decision", "method", "reason",
               "confidence", "decided_by"]
    if latest is not None:
        held = latest.select("alias_id", F.struct(*columns).alias("_d"))
    else:
        held = aliases.sparkSession.createDataFrame(
            [], "alias_id string, _d struct<actor_id:string,previous_actor_id:string,evidence_id:string,"
            "decision:string,method:string,reason:string,confidence:int,decided_by:string>"
        )
    rows = linked.join(held, "alias_id", "left")
    fallback = {
        "actor_id": F.col("_actor"), "previous_actor_id": F.col("_actor"),
        "evidence_id": F.lit(evidence_id).cast("string"), "decision": F.lit("auto_link"),
        "method": F.lit("existing_link"), "reason": F.lit(REASONS["existing_link"]),
        "confidence": F.col("_confidence"), "decided_by": F.lit("system"),
    }
    known = F.col("_d").isNotNull()
    return rows.select(
        "alias_id",
        *[F.when(known, F.col(f"_d.{c}")).otherwise(fallback[c]).alias(c) for c in columns],
        _no_candidates().alias("candidates"),
        known.alias("repeated"),
    )


def decision_hash(decisions: DataFrame) -> DataFrame:
    """Adds ``decision_hash``: SHA-256 of the decision as compact JSON with sorted keys.

    Rows with non-ASCII text are re-printed with ``\\uXXXX`` escapes, which the audit format wants.
    """
    candidates = F.transform(
        "candidates",
        lambda c: F.struct(
            c.getField("actor_id").alias("actor_id"), c.getField("bases").alias("bases"),
            c.getField("canonical_name").alias("canonical_name"),
            c.getField("similarity").alias("similarity"),
        ),
    )
    body = F.struct(
        "actor_id", candidates.alias("candidates"), "confidence", "decided_by", "decision",
        "evidence_id", "method", "previous_actor_id", "reason",
    )
    printed = F.to_json(body, {"ignoreNullFields": "false"})
    ascii_only = printed.rlike(ASCII_ONLY)
    native = F.sha2(printed, 256)
    return decisions.withColumn(
        "decision_hash", F.when(ascii_only, native).otherwise(escaped_sha256(F.when(~ascii_only, printed)))
    )


def append_decisions(decisions: DataFrame, stored: DataFrame, first_sequence: int) -> DataFrame:
    """Audit rows not stored yet, numbered from ``first_sequence`` in (alias, hash) order.

    A decision whose hash the alias already holds is reused, so a repeated run appends nothing.
    """
    hashed = decision_hash(decisions).filter(~F.col("repeated")).drop("repeated")
    fresh = hashed.dropDuplicates(["alias_id", "decision_hash"]).join(
        stored.select("alias_id", "decision_hash"), ["alias_id", "decision_hash"], "left_anti"
    )
    rows = numbered(fresh, (("alias_id", True), ("decision_hash", True)), number="_n")
    return rows.withColumn("sequence", F.col("_n") + (first_sequence - 1)).drop("_n")


def latest_decision(decisions: DataFrame, columns: list[str]) -> DataFrame:
    """Newest decision per alias, the one with the greatest sequence number, in one scan."""
    newest = decisions.groupBy("alias_id").agg(F.max_by(F.struct(*columns), "sequence").alias("_newest"))
    return newest.select("alias_id", *[F.col(f"_newest.{name}") for name in columns])


def manual_corrections(
    aliases: DataFrame, corrections: DataFrame, latest: DataFrame | None = None, seq: str = "seq",
    span: int = 1_000_000,
) -> DataFrame:
    """Apply link / relink / unlink requests in order; a repeat of the state in force is a no-op.

    Each request is compared with the request before it on the same alias (or with the stored
    decision for the first one), found by a chunked running maximum.
    """
    details = ["actor_id", "reason", "confidence", "evidence_id", "decided_by"]
    ready = corrections.withColumn(
        "confidence", F.when(F.col("actor_id").isNotNull(), F.col("confidence"))
    )
    state = F.struct(F.col(seq).alias("s"), F.struct(*details).alias("d"))
    run = running_before(ready, ["alias_id"], seq, {"_before": ("max", state)}, span)
    linked = aliases.select(F.col("id").alias("alias_id"), F.col("actor_id").alias("_stored_actor"))
    rows = run.join(linked, "alias_id")
    if latest is not None:
        manual = latest.filter(F.col("method") == "manual").select(
            "alias_id", F.struct(*details).alias("_stored")
        )
        rows = rows.join(manual, "alias_id", "left")
    else:
        kinds = {"confidence": "int"}
        blank = F.struct(*[F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in details])
        rows = rows.withColumn("_stored", F.when(F.lit(False), blank))
    first = F.col("_before").isNull()
    in_force = F.when(first, F.col("_stored")).otherwise(F.col("_before.d"))
    repeated = in_force.isNotNull() & F.struct(*details).eqNullSafe(in_force)
    return rows.select(
        "alias_id", seq, "actor_id",
        F.when(first, F.col("_stored_actor")).otherwise(F.col("_before.d.actor_id")).alias("previous_actor_id"),
        F.when(F.col("actor_id").isNotNull(), F.lit("manual_link"))
        .otherwise(F.lit("manual_unlink")).alias("decision"),
        F.lit("manual").alias("method"), "reason", "confidence", "evidence_id", "decided_by",
        repeated.alias("repeated"),
    )
