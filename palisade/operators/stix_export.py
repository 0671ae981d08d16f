"""STIX 2.1 export of every actor in one job.

Objects are built one kind at a time as (actor_id, type, id, json) rows and stay distributed. Every actor has
one bundle: its identifier is a hash fed with the sorted object identifiers one after the other, and its
content is a run of ordered rows, so that nothing of unbounded size is collected.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from uuid import NAMESPACE_URL, UUID, uuid5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import ids
from palisade.functions.jsonx import safe_url
from palisade.functions.times import utc_millis_text
from palisade.schemas import Graph
from palisade.session import materialize

# --- fixed values ---------------------------------------------------------------------------
EXPORTED_RELATION = "attributed-to"
MAX_DESCRIPTION = 1000
REFERENCE_DASH = " — "
# ------------------------------------------------------------------------------------------
_PLAIN = {"writeNonAsciiCharacterAsCodePoint": "true"}


@dataclass(frozen=True)
class Publisher:
    """Who exports: the identifier namespace, the label prefix and the name used in note texts.

    Set all three to those of an existing publisher to get its identifiers and texts.
    """

    namespace: UUID = uuid5(NAMESPACE_URL, "https://palisade.invalid/stix/2.1/export/v1")
    label: str = "palisade"
    product: str = "PALISADE"


def stix_id(publisher: Publisher, kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}--"), ids.uuid5(publisher.namespace, F.concat(F.lit(f"{kind}:"), key)))


def _reference(source_name, base_url, external_id=None, url=None, description=None) -> Column:
    """External reference; absent parts are null and vanish in JSON."""
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.substring(F.nullif(description, F.lit("")), 1, MAX_DESCRIPTION).alias("description")
        if description is not None else nothing.alias("description"),
        F.nullif(external_id, F.lit("")).alias("external_id")
        if external_id is not None else nothing.alias("external_id"),
        source_name.alias("source_name"),
        F.coalesce(safe_url(url) if url is not None else nothing, safe_url(base_url)).alias("url"),
    )


def _sorted_references(col: str) -> Column:
    """Distinct references in the order of their sorted-key JSON text, which is made after they are collected."""
    keyed = F.transform(F.collect_set(col), lambda r: F.struct(F.to_json(r, _PLAIN).alias("k"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda x: x.getField("r"))


def _base(publisher: Publisher, kind: str, key: Column, created: Column, modified: Column) -> list[Column]:
    return [
        F.lit(kind).alias("type"),
        F.lit("2.1").alias("spec_version"),
        stix_id(publisher, kind, key).alias("id"),
        utc_millis_text(created).alias("created"),
        utc_millis_text(modified).alias("modified"),
    ]


def _present(col: str) -> Column:
    return F.nullif(F.col(col), F.lit(""))


def _nonempty(col: str) -> Column:
    return F.when(F.size(col) > 0, F.col(col))


def _emit(df: DataFrame, fields: list[Column], owner: str = "actor_id") -> DataFrame:
    return df.select(owner, F.struct(*fields).alias("_o")).select(
        owner, F.col("_o.type").alias("type"), F.col("_o.id").alias("id"), F.to_json("_o").alias("json")
    )


def _named_sources(graph: Graph) -> DataFrame:
    return graph.sources.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), "base_url"
    )


def observation_references(graph: Graph, observation_ids: DataFrame | None = None) -> DataFrame:
    """(observation_id, reference) in long form: the observation's own source and its evidence."""
    src = _named_sources(graph)

    def asked(rows: DataFrame) -> DataFrame:
        return rows if observation_ids is None else rows.join(observation_ids, "observation_id", "left_semi")

    own = (
        asked(graph.observations.select(F.col("id").alias("observation_id"), "source_id", "source_native_id"))
        .join(src, "source_id")
        .select("observation_id", _reference(F.col("source_name"), F.col("base_url"),
                                             F.col("source_native_id")).alias("reference"))
    )
    cited = (
        asked(graph.observation_evidence)
        .join(graph.evidence.select(F.col("id").alias("evidence_id"), "source_id", "citation", "excerpt",
                                    "locator"), "evidence_id")
        .join(src, "source_id")
        .select("observation_id", _evidence_reference().alias("reference"))
    )
    return own.unionByName(cited)


def _evidence_reference() -> Column:
    described = F.when(
        F.coalesce(F.col("excerpt"), F.lit("")) != "",
        F.concat(F.col("citation"), F.lit(REFERENCE_DASH), F.col("excerpt")),
    ).otherwise(F.col("citation"))
    return _reference(F.col("source_name"), F.col("base_url"), url=F.col("locator"), description=described)


def export_objects(graph: Graph, publisher: Publisher = Publisher(), actor_ids: DataFrame | None = None) -> DataFrame:
    """(actor_id, type, id, json) for every object of every actor. Not publication-filtered."""
    actors = graph.actors.withColumnRenamed("id", "actor_id")
    links = graph.actor_observations
    relations = graph.relationships
    if actor_ids is not None:
        actors = actors.join(actor_ids, "actor_id", "left_semi")
        links = links.join(actor_ids, "actor_id", "left_semi")
        relations = relations.join(actor_ids, "actor_id", "left_semi")
    pairs = _technique_pairs(graph, links)
    parts = [
        _intrusion_sets(graph, publisher, actors),
        _attack_patterns(graph, publisher, pairs),
        _notes(graph, publisher, links),
        _uses(graph, publisher, links, pairs),
        *_campaigns(graph, publisher, relations),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _intrusion_sets(graph: Graph, publisher: Publisher, actors: DataFrame) -> DataFrame:
    src = _named_sources(graph)
    named = (
        graph.aliases.filter(F.col("actor_id").isNotNull())
        .join(src, "source_id")
        .withColumn("reference", _reference(F.col("source_name"), F.col("base_url"), F.col("source_native_id")))
        .groupBy("actor_id")
        .agg(F.collect_set("name").alias("_names"), _sorted_references("reference").alias("_refs"))
    )
    rows = actors.join(named, "actor_id", "left").withColumn(
        "_aliases", F.array_sort(F.array_remove("_names", F.col("canonical_name")))
    )
    return _emit(rows, [
        *_base(publisher, "intrusion-set", F.col("actor_id"), F.col("created_at"), F.col("updated_at")),
        F.col("canonical_name").alias("name"),
        _present("description").alias("description"),
        _nonempty("_aliases").alias("aliases"),
        _nonempty("_refs").alias("external_references"),
    ])


def _technique_pairs(graph: Graph, links: DataFrame) -> DataFrame:
    """Per (actor, technique): known observations counted (0: links to unknown ones only), first creation and last change.

    Observations meet the links before these are multiplied by techniques.
    """
    stamped = graph.observations.select(
        F.col("id").alias("observation_id"), F.col("id").alias("_known"), "created_at", "updated_at"
    )
    return (
        links.join(stamped, "observation_id", "left")
        .join(graph.observation_techniques, "observation_id")
        .groupBy("actor_id", "technique_id")
        .agg(
            F.count("_known").alias("observations"),
            F.min("created_at").alias("created_at"),
            F.max("updated_at").alias("updated_at"),
        )
    )


def _attack_patterns(graph: Graph, publisher: Publisher, pairs: DataFrame) -> DataFrame:
    """Each technique's object is made once and then given to its actors.

    The pairs are read just as ``_uses`` reads them, so that both share one shuffle: the count is asked for, although
    every count will do, and a null technique, which meets nothing, isn't left out before the join.
    """
    built = (
        graph.techniques.filter(F.col("id").isNotNull()).join(_named_sources(graph), "source_id")
        .withColumn("_refs", F.array(_reference(F.col("source_name"), F.col("base_url"), F.col("external_id"))))
        .withColumnRenamed("id", "technique_id")
    )
    objects = _emit(built, [
        *_base(publisher, "attack-pattern", F.col("technique_id"), F.col("created_at"), F.col("updated_at")),
        F.col("name"),
        _present("description").alias("description"),
        F.col("_refs").alias("external_references"),
    ], "technique_id").withColumnRenamed("technique_id", "_technique")
    used = pairs.filter("observations >= 0").select("actor_id", "technique_id")
    return used.join(objects, F.col("technique_id").eqNullSafe(F.col("_technique"))).select("actor_id", "type", "id", "json")


def note_text(publisher: Publisher) -> Column:
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit(f"{publisher.product} intelligence time: "), utc_millis_text(F.col("observed_at"))),
        F.concat(F.lit("First seen: "), utc_millis_text(F.col("first_seen"))),
        F.concat(F.lit("Last seen: "), utc_millis_text(F.col("last_seen"))),
    )
    return F.concat(F.col("title"), F.lit("\n\n"), F.col("summary"), F.lit("\n\n"), lines)


def _notes(graph: Graph, publisher: Publisher, links: DataFrame) -> DataFrame:
    ids_ = links.select("observation_id").distinct()
    refs = observation_references(graph, ids_).groupBy("observation_id").agg(
        _sorted_references("reference").alias("_refs")
    )
    techniques = (
        graph.observation_techniques.join(ids_, "observation_id", "left_semi")
        .groupBy("observation_id")
        .agg(F.array_sort(F.collect_set("technique_id")).alias("_techniques"))
    )
    seen = graph.observations.withColumnRenamed("id", "observation_id")
    rows = (
        links.join(seen, "observation_id")
        .join(refs, "observation_id", "left")
        .join(techniques, "observation_id", "left")
    )
    targets = F.concat(
        F.array(stix_id(publisher, "intrusion-set", F.col("actor_id"))),
        F.transform(
            F.coalesce("_techniques", F.array().cast("array<string>")),
            lambda t: stix_id(publisher, "attack-pattern", t),
        ),
    )
    return _emit(rows, [
        *_base(publisher, "note", F.col("observation_id"), F.col("created_at"), F.col("updated_at")),
        note_text(publisher).alias("content"),
        F.array(F.concat(F.lit(f"{publisher.label}:"), F.col("intelligence_type"))).alias("labels"),
        targets.alias("object_refs"),
        F.col("confidence"),
        _nonempty("_refs").alias("external_references"),
    ])


def uses_support(graph: Graph, links: DataFrame) -> DataFrame:
    """Per (actor, technique): supporting observations counted, first creation and last change."""
    return _supported(_technique_pairs(graph, links))


def _supported(pairs: DataFrame) -> DataFrame:
    return pairs.filter("observations > 0")


def uses_references(graph: Graph, links: DataFrame, stored: bool = False) -> DataFrame:
    """(actor_id, technique_id, reference) distinct, in long form: what a popular pair's list is made of.

    A reference that an actor has through one observation only meets the distinct techniques of that observation, which
    can't make a row twice. So texts move once for each (actor, reference) before they are multiplied; only references
    of several observations of an actor are compared after it. ``stored`` does the same work at once and keeps what the texts
    are multiplied from, so that they move fewer times; for readers of the whole table.
    """
    if stored:
        return _stored_uses_references(graph, links)
    refs = observation_references(graph, links.select("observation_id").distinct())
    techniques = graph.observation_techniques.select("observation_id", "technique_id").distinct()
    cited = links.select("actor_id", "observation_id").join(refs, "observation_id")
    found = cited.groupBy("actor_id", "reference").agg(
        F.min("observation_id").alias("observation_id"), F.max("observation_id").alias("_last"))
    lone = found.filter(F.col("observation_id") == F.col("_last")).drop("_last")
    many = found.filter(F.col("observation_id") != F.col("_last")).select(F.col("actor_id").alias("_actor"), F.col("reference").alias("_ref"))
    shared = cited.join(many, F.col("actor_id").eqNullSafe(F.col("_actor")) & F.col("reference").eqNullSafe(F.col("_ref")), "left_semi")
    columns = ["actor_id", "technique_id", "reference"]
    return lone.join(techniques, "observation_id").select(*columns).unionByName(
        shared.join(techniques, "observation_id").select(*columns).distinct())


def _stored_uses_references(graph: Graph, links: DataFrame) -> DataFrame:
    """``uses_references`` of all links, over a stored table.

    References are placed by observation once and meet there its actors and its list of techniques; these rows are stored. Which
    (actor, reference) comes more than once is found by a hash alone: one that doesn't is multiplied by its techniques where it
    stands, and only the rest, which may hold a few too many, is compared after it.
    """
    placed = links.select("actor_id", "observation_id").repartition("observation_id").distinct()
    refs = observation_references(graph).repartition("observation_id").distinct()
    techniques = graph.observation_techniques.select("observation_id", "technique_id").distinct().groupBy("observation_id").agg(
        F.collect_list(F.struct("technique_id")).alias("_techniques"))
    cited = materialize(placed.join(techniques, "observation_id").join(refs, "observation_id").select("actor_id", "_techniques", "reference"),
                        "cited-references", "zstd").withColumn("_key", F.xxhash64("actor_id", "reference"))
    many = materialize(cited.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key"), "cited-again")

    def multiplied(rows: DataFrame) -> DataFrame:
        return rows.select("actor_id", F.explode("_techniques").alias("_t"), "reference").select(
            "actor_id", F.col("_t.technique_id").alias("technique_id"), "reference")

    return multiplied(cited.join(many, "_key", "left_anti")).unionByName(multiplied(cited.join(many, "_key", "left_semi")).distinct())


def _uses(graph: Graph, publisher: Publisher, links: DataFrame, pairs: DataFrame) -> DataFrame:
    refs = uses_references(graph, links).groupBy("actor_id", "technique_id").agg(
        _sorted_references("reference").alias("_refs")
    )
    rows = _supported(pairs).join(refs, ["actor_id", "technique_id"], "left")
    key = F.concat("actor_id", F.lit(":"), "technique_id")
    return _emit(rows, [
        *_base(publisher, "relationship", key, F.col("created_at"), F.col("updated_at")),
        F.lit("uses").alias("relationship_type"),
        stix_id(publisher, "intrusion-set", F.col("actor_id")).alias("source_ref"),
        stix_id(publisher, "attack-pattern", F.col("technique_id")).alias("target_ref"),
        _nonempty("_refs").alias("external_references"),
    ])


def _campaigns(graph: Graph, publisher: Publisher, relations: DataFrame) -> list[DataFrame]:
    src = _named_sources(graph)
    approved = relations.filter(F.lower(F.trim("relationship_type")) == EXPORTED_RELATION)
    pairs = approved.select("actor_id", "campaign_id").distinct()
    built = (
        graph.campaigns.join(src, "source_id")
        .withColumn("_refs", F.array(_reference(F.col("source_name"), F.col("base_url"), F.col("source_native_id"))))
        .withColumnRenamed("id", "campaign_id")
    )
    campaigns = _emit(pairs.join(built, "campaign_id"), [
        *_base(publisher, "campaign", F.col("campaign_id"), F.col("created_at"), F.col("updated_at")),
        F.col("name"),
        _present("description").alias("description"),
        utc_millis_text(F.col("first_seen")).alias("first_seen"),
        utc_millis_text(F.col("last_seen")).alias("last_seen"),
        F.col("confidence"),
        F.col("_refs").alias("external_references"),
    ])
    cited = graph.evidence.select(
        F.col("id").alias("evidence_id"), F.col("source_id").alias("_es"), "citation", "excerpt", "locator"
    ).join(src.select(F.col("source_id").alias("_es"), "source_name", "base_url"), "_es").select(
        "evidence_id", _evidence_reference().alias("_cited")
    )
    rows = approved.join(src, "source_id").join(cited, "evidence_id", "left").withColumn(
        "_pair", F.array_compact(F.array(_reference(F.col("source_name"), F.col("base_url")), F.col("_cited")))
    )
    ordered = F.transform(
        F.array_sort(F.array_distinct(F.transform(
            "_pair", lambda r: F.struct(F.to_json(r, _PLAIN).alias("k"), r.alias("r"))))),
        lambda x: x.getField("r"),
    )
    attributed = _emit(rows.withColumn("_refs", ordered), [
        *_base(publisher, "relationship", F.col("id"), F.col("created_at"), F.col("updated_at")),
        F.lit(EXPORTED_RELATION).alias("relationship_type"),
        stix_id(publisher, "campaign", F.col("campaign_id")).alias("source_ref"),
        stix_id(publisher, "intrusion-set", F.col("actor_id")).alias("target_ref"),
        utc_millis_text(F.col("first_seen")).alias("start_time"),
        utc_millis_text(F.col("last_seen")).alias("stop_time"),
        F.col("confidence"),
        F.col("_refs").alias("external_references"),
    ])
    return [campaigns, attributed]


def _identified(namespace: bytes):
    """Bundle identifiers of runs of (actor_id, type, id) rows that are sorted and whole in their task."""
    def run(batches):
        actor, digest, count = None, None, 0

        def made():
            return pa.RecordBatch.from_arrays(
                [pa.array([actor]), pa.array([f"bundle--{UUID(bytes=digest.digest()[:16], version=5)}"]),
                 pa.array([count], pa.int64())], ["actor_id", "bundle_id", "objects"])

        for batch in batches:
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != actor or digest is None:
                    if digest is not None:
                        yield made()
                    actor, count = key, 0
                    digest = hashlib.sha1(namespace + f"bundle:actor:{key}:".encode())
                digest.update((("," if count else "") + name).encode())
                count += 1
        if digest is not None:
            yield made()

    return run


def _keys_in_order(objects: DataFrame) -> DataFrame:
    """(actor_id, type, id) of the objects of known actors, each actor's run sorted and whole in its task; no JSON."""
    keys = objects.filter(F.col("actor_id").isNotNull()).select("actor_id", "type", "id")
    return keys.repartition("actor_id").sortWithinPartitions("actor_id", "type", "id")


def bundle_ids(objects: DataFrame, publisher: Publisher = Publisher()) -> DataFrame:
    """(actor_id, bundle_id, objects): a name-based identifier over all sorted object identifiers."""
    return _keys_in_order(objects).select("actor_id", "id").mapInArrow(
        _identified(publisher.namespace.bytes), "actor_id string, bundle_id string, objects long"
    )


def bundles(objects: DataFrame, publisher: Publisher = Publisher()) -> DataFrame:
    """(actor_id, bundle_id, objects, ordinal, id, json): the objects of each actor's one bundle, numbered in order.

    Numbers come from the identifiers alone, in the one shuffle that ``bundle_ids`` needs as well. The JSON texts are
    joined to them by identifier, so that a reader who doesn't ask for them neither builds nor moves them.
    """
    order = Window.partitionBy("actor_id").orderBy("type", "id")
    placed = _keys_in_order(objects).withColumn("ordinal", F.row_number().over(order).cast("bigint"))
    named = placed.join(bundle_ids(objects, publisher), "actor_id")
    # copies of an object are told apart by a number; a missing identifier counts as the empty one
    filled = F.coalesce("id", F.lit(""))
    same = Window.partitionBy("actor_id", "type", "_id")
    named = named.withColumn("_id", filled).withColumn("_copy", F.row_number().over(same.orderBy("ordinal")))
    bodies = (
        objects.filter(F.col("actor_id").isNotNull()).select("actor_id", "type", filled.alias("_id"), "json")
        .withColumn("_copy", F.row_number().over(same.orderBy("json")))
        .groupBy("actor_id", "type", "_id", "_copy").agg(F.first("json").alias("json"))
    )
    return named.join(bodies, ["actor_id", "type", "_id", "_copy"], "left").select(
        "actor_id", "bundle_id", "objects", "ordinal", "id", "json"
    )


def bundle_lines(bundled: DataFrame) -> DataFrame:
    """(actor_id, ordinal, line): an actor's lines, joined in order, are its JSON document."""
    head = F.when(F.col("ordinal") == 1, F.concat(F.lit('{"type":"bundle","id":"'), F.col("bundle_id"), F.lit('","objects":['))).otherwise("")
    tail = F.when(F.col("ordinal") == F.col("objects"), F.lit("]}")).otherwise(",")
    return bundled.select("actor_id", "ordinal", F.concat(head, "json", tail).alias("line"))


def write_bundles(bundled: DataFrame, path: str) -> None:
    """Text files that hold the documents one after the other in the order of their actors."""
    lines = bundle_lines(bundled).repartitionByRange("actor_id", "ordinal").sortWithinPartitions("actor_id", "ordinal")
    lines.select("line").write.mode("overwrite").text(path)
