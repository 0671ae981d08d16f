"""Technical artifacts: validation as native VARIANT checks, identity, intake and search.

STIX validation covers the required properties of the common object types (table below), identifier
shape and version, for the object itself and for every object inside a bundle. It is not the full
object model of the standard. Detection-rule text is checked by a caller-supplied expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.jsonx import Members, fields, kinds, merge_right, strict_json, variant_kind
from palisade.functions.text import TECHNIQUE_ID, clean_query
from palisade.operators import postings as P
from palisade.operators.intake import first_per_key
from palisade.sources.stix_bundle import OBJECT_ID

# --- fixed values: required properties per object type beyond type and id -------------------
REQUIRED = {
    "attack-pattern": ("name",),
    "bundle": (),
    "campaign": ("name",),
    "course-of-action": ("name",),
    "grouping": ("context", "object_refs"),
    "identity": ("name",),
    "indicator": ("pattern", "pattern_type", "valid_from"),
    "infrastructure": ("name",),
    "intrusion-set": ("name",),
    "location": (),
    "malware": ("is_family",),
    "malware-analysis": ("product",),
    "note": ("content", "object_refs"),
    "observed-data": ("first_observed", "last_observed", "number_observed"),
    "opinion": ("opinion", "object_refs"),
    "relationship": ("relationship_type", "source_ref", "target_ref"),
    "report": ("name", "published", "object_refs"),
    "sighting": ("sighting_of_ref",),
    "threat-actor": ("name",),
    "tool": ("name",),
    "vulnerability": ("name",),
}
TECHNIQUE_SOURCES = ("mitre-attack", "mitre-mobile-attack")
MAX_ID, MAX_TITLE, MAX_VERSION, MAX_ERROR = 512, 500, 100, 500
INVALID_TITLES = {
    "stix_2_1": "Invalid STIX 2.1 artifact",
    "attack_technique": "Invalid ATT&CK technique reference",
    "sigma": "Invalid Sigma rule",
}
# ------------------------------------------------------------------------------------------


def _object_error(m: Members, nested: bool) -> Column:
    """First problem of one STIX object, null if none. Nested objects may not be bundles."""
    known = {k: v for k, v in REQUIRED.items() if not (nested and k == "bundle")}
    needs = F.create_map(
        *[x for kind, names in known.items() for x in (F.lit(kind), _needs(kind, names))]
    )
    kind, ident = m.text("type"), m.text("id")
    required = F.try_element_at(needs, kind)
    gaps = F.filter(
        required,
        lambda n: F.coalesce(F.try_element_at(m.member_kinds, n), F.lit("VOID")) == "VOID",
    )
    well_named = ident.rlike(OBJECT_ID) & F.startswith(ident, F.concat(kind, F.lit("--")))
    return (
        F.when(m.members.isNull(), F.lit("STIX content must be a JSON object."))
        .when(required.isNull(), F.lit("Unknown STIX object type."))
        .when(~F.coalesce(well_named, F.lit(False)), F.lit("Invalid STIX identifier."))
        .when(
            ~m.kind("spec_version").isin("", "VOID")
            & ~F.coalesce(m.text("spec_version") == "2.1", F.lit(False)),
            F.lit("Only STIX 2.1 artifacts are supported."),
        )
        .when(F.size(gaps) > 0,
              F.concat(F.lit("Missing required properties: "), F.array_join(gaps, ", ")))
    )


def _needs(kind: str, names: tuple[str, ...]) -> Column:
    stamps = () if kind == "bundle" else ("created", "modified")
    return F.array(*[F.lit(n) for n in (*stamps, *names)]).cast("array<string>")


def validate(artifacts: DataFrame, rule_error: Column | None = None) -> DataFrame:
    """Status, errors, identity and derived metadata of each artifact.

    Input: artifact_type, content, content_sha256. ``rule_error`` gives the problem of a detection
    rule (null if it is sound); without it such rules are kept as ``unchecked``.
    """
    rows = artifacts.withColumn(
        "_v", F.when(F.col("artifact_type") != "sigma", strict_json(F.col("content")))
    )
    rows = rows.withColumn("_m", fields(F.col("_v"))).withColumn("_k", kinds(F.col("_m")))
    m = Members(F.col("_m"), F.col("_k"))
    items = m.read("objects", "array<variant>")
    inner = F.try_element_at(
        F.array_compact(
            F.transform(items, lambda x: _object_error(Members(fields(x), kinds(fields(x))), True))
        ),
        F.lit(1),
    )
    not_json = F.when(F.col("_v").isNull(), F.lit("Content is not valid JSON."))
    rows = rows.withColumns(
        {
            "_object_error": _object_error(m, False),
            "_inner_error": F.when(m.text("type") == "bundle", inner),
        }
    )
    stix_error = F.coalesce(not_json, F.col("_object_error"), F.col("_inner_error"))
    refs = m.read("external_references", "array<struct<source_name:variant,external_id:variant>>")

    def as_text(x):
        return F.when(variant_kind(x) == "STRING", F.try_variant_get(x, "$", "string"))

    technique = F.try_element_at(
        F.transform(
            F.filter(
                refs,
                lambda r: F.coalesce(as_text(r.getField("source_name")).isin(*TECHNIQUE_SOURCES), F.lit(False))
                & as_text(r.getField("external_id")).isNotNull(),
            ),
            lambda r: as_text(r.getField("external_id")),
        ),
        F.lit(1),
    )
    name = m.text("name")
    attack_error = F.coalesce(
        not_json,
        F.when(m.members.isNull(), F.lit("ATT&CK technique content must be a JSON object.")),
        F.when(~F.coalesce(m.text("type") == "attack-pattern", F.lit(False)),
               F.lit("ATT&CK technique must be a STIX attack-pattern.")),
        F.col("_object_error"),
        F.when(~F.coalesce(technique.rlike(TECHNIQUE_ID), F.lit(False)),
               F.lit("ATT&CK technique requires a valid MITRE technique ID.")),
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", F.lit("ATT&CK technique requires a name.")),
    )
    is_stix, is_attack = F.col("artifact_type") == "stix_2_1", F.col("artifact_type") == "attack_technique"
    error = F.when(is_stix, stix_error).when(is_attack, attack_error)
    if rule_error is not None:
        error = error.otherwise(rule_error)
    checked = rows.withColumn("_error", F.substring(error, 1, MAX_ERROR))
    bad = F.col("_error").isNotNull()
    digest = F.col("content_sha256")
    invalid_titles = F.create_map(*[F.lit(x) for pair in INVALID_TITLES.items() for x in pair])
    status = F.when(bad, F.lit("invalid"))
    if rule_error is None:
        status = status.when(~is_stix & ~is_attack, F.lit("unchecked"))
    version = F.coalesce(F.nullif(m.read("x_mitre_version", "string"), F.lit("")), F.lit("2.1"))
    count = F.when(m.text("type") == "bundle", F.coalesce(F.size(items), F.lit(0))).otherwise(F.lit(1))
    pairs = F.create_map
    text_map = "map<string,string>"
    return checked.select(
        *artifacts.columns,
        status.otherwise(F.lit("valid")).alias("validation_status"),
        F.when(bad, F.array("_error")).otherwise(F.array().cast("array<string>")).alias("validation_errors"),
        F.when(bad, F.concat(F.lit("invalid:"), digest))
        .when(is_stix, F.substring(F.coalesce(F.nullif(m.text("id"), F.lit("")),
                                              F.concat(F.lit("bundle:"), digest)), 1, MAX_ID))
        .when(is_attack, technique)
        .otherwise(F.concat(F.lit("sigma:"), digest)).alias("canonical_id"),
        F.when(bad, F.try_element_at(invalid_titles, F.col("artifact_type")))
        .when(is_stix, F.substring(F.coalesce(F.nullif(name, F.lit("")), F.lit("STIX 2.1 bundle")), 1, MAX_TITLE))
        .when(is_attack, F.substring(name, 1, MAX_TITLE))
        .otherwise(F.lit("Sigma rule")).alias("title"),
        F.when(~bad & is_stix, F.lit("2.1"))
        .when(~bad & is_attack, F.substring(version, 1, MAX_VERSION)).alias("version"),
        F.when(~bad & is_stix, pairs(F.lit("stix_type"), m.text("type"),
                                     F.lit("object_count"), count.cast("string")))
        .when(~bad & is_attack, pairs(F.lit("stix_id"), m.text("id")))
        .otherwise(F.lit(None).cast(text_map)).alias("derived_metadata"),
    )


def intake(submissions: DataFrame, stored: DataFrame | None = None, order: str = "submission_id",
           rule_error: Column | None = None) -> DataFrame:
    """Deduplicate by (source, type, content hash), then validate the new ones only."""
    hashed = submissions.withColumn("content_sha256", F.sha2(F.encode("content", "UTF-8"), 256))
    marked = first_per_key(hashed, ["source_id", "artifact_type", "content_sha256"], order, stored)
    checked = validate(marked.filter(~F.col("duplicate")), rule_error)
    if "metadata_map" in submissions.columns:
        empty = F.create_map().cast("map<string,string>")
        checked = checked.withColumn(
            "metadata_map",
            merge_right(F.coalesce("metadata_map", empty), F.coalesce("derived_metadata", empty)),
        )
    return checked.unionByName(marked.filter(F.col("duplicate")), allowMissingColumns=True)


def search(artifacts: DataFrame, queries: DataFrame | None = None, posted: DataFrame | None = None,
           stemmed: bool = True, stop_words: bool = True, limit: int = 25, **equal) -> DataFrame:
    """Artifacts matching a query and equality filters, newest first (not ranked by text)."""
    from palisade.operators.scale import top_n

    rows = artifacts
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == value)
    if queries is None:
        return rows.orderBy(F.col("created_at").desc(), "id").limit(limit)
    if posted is None:
        posted = P.postings(P.artifact_documents(rows), stemmed, stop_words)
    queries = queries.select("query_id", clean_query(F.col("query")).alias("query")).filter(F.col("query").isNotNull())
    hits = P.match(P.query_terms(queries, stemmed, stop_words), posted).select("query_id", "id").distinct()
    return top_n(rows.join(hits, "id"), ["query_id"], (("created_at", False), ("id", True)), limit, "position")
