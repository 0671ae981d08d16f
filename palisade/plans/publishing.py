"""STIX export of the order graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import stix_export as X
from palisade.plans import adapters as A
from palisade.plans.registry import query, stamp

c = F.col
PUBLISHER = X.Publisher()


def _uuid(name: str) -> str:
    """SQL text of a version-5 UUID over an expression giving the name."""
    h = f"sha1(unhex('{PUBLISHER.namespace.hex}') || encode({name}))"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


def _sid(kind: str, key: str) -> str:
    return f"'{kind}--' || {_uuid(f"'{kind}:' || {key}")}"


_OBJECTS = f"""at_ AS (SELECT DISTINCT l.actor_id, t.technique_id FROM g_actor_obs l JOIN g_obs_techniques t USING (observation_id)),
rel AS (SELECT * FROM g_relationships WHERE lower(trim(relationship_type)) = 'attributed-to' AND actor_id IN (SELECT id FROM g_actors)),
obj AS (
  SELECT id AS actor_id, 'intrusion-set' AS type, {_sid('intrusion-set', 'id')} AS id FROM g_actors
  UNION ALL SELECT actor_id, 'attack-pattern', {_sid('attack-pattern', 'technique_id')} FROM at_
  UNION ALL SELECT actor_id, 'note', {_sid('note', 'observation_id')} FROM g_actor_obs
  UNION ALL SELECT actor_id, 'relationship', {_sid('relationship', "actor_id || ':' || technique_id")} FROM at_
  UNION ALL SELECT DISTINCT actor_id, 'campaign', {_sid('campaign', 'campaign_id')} FROM rel
  UNION ALL SELECT actor_id, 'relationship', {_sid('relationship', 'id')} FROM rel)"""
_NEEDS = ("g_actors", "g_actor_obs", "g_obs_techniques", "g_relationships")


def _actors_only(graph):
    """Relationships of users that are no customer have no actor to hang on."""
    return graph.actors.select(c("id").alias("actor_id"))


def _objects(spark, sf_dir):
    graph = A.order_graph(spark, sf_dir)
    return X.export_objects(graph, PUBLISHER, _actors_only(graph))


@query("stix_objects", f"WITH {_OBJECTS} SELECT actor_id, type, id FROM obj", _NEEDS)
def stix_objects(spark, sf_dir):
    return _objects(spark, sf_dir).select("actor_id", "type", "id")


@query("stix_bundles", f"""WITH {_OBJECTS},
b AS (SELECT actor_id, count(*)::BIGINT AS objects, string_agg(id, ',' ORDER BY type, id) AS ids FROM obj GROUP BY actor_id)
SELECT actor_id, objects, 'bundle--' || {_uuid("'bundle:actor:' || actor_id || ':' || ids")} AS bundle_id FROM b""", _NEEDS)
def stix_bundles(spark, sf_dir):
    return X.bundles(_objects(spark, sf_dir), PUBLISHER).filter("ordinal = 1").select("actor_id", "objects", "bundle_id")


@query("stix_bundle_rows", f"""WITH {_OBJECTS}
SELECT actor_id, id, row_number() OVER (PARTITION BY actor_id ORDER BY type, id) AS ordinal FROM obj""", _NEEDS)
def stix_bundle_rows(spark, sf_dir):
    return X.bundles(_objects(spark, sf_dir), PUBLISHER).select("actor_id", "id", "ordinal")


@query("stix_notes", f"""
SELECT {_sid('note', 'id')} AS id, title || chr(10) || chr(10) || summary || chr(10) || chr(10) || 'PALISADE intelligence time: ' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S.000Z')
   || chr(10) || 'First seen: ' || strftime(first_seen, '%Y-%m-%dT%H:%M:%S.000Z') AS content, 'palisade:' || intelligence_type AS label, confidence::VARCHAR AS confidence,
   strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') AS created FROM g_obs
""", ("g_obs",))
def stix_notes(spark, sf_dir):
    notes = _objects(spark, sf_dir).filter("type = 'note'")
    parsed = F.from_json("json", "content string, labels array<string>, confidence int, created string")
    return notes.select("id", parsed.alias("o")).select("id", "o.content", F.get("o.labels", F.lit(0)).alias("label"), c("o.confidence").cast("string").alias("confidence"), "o.created")


@query("stix_intrusion_sets", f"""
WITH al AS (SELECT actor_id, string_agg(DISTINCT name, '|' ORDER BY name) AS aliases, count(*) AS refs FROM g_aliases GROUP BY 1)
SELECT {_sid('intrusion-set', 'a.id')} AS id, canonical_name AS name, description, aliases, refs::BIGINT AS n_references,
   strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') AS created, strftime(updated_at, '%Y-%m-%dT%H:%M:%S.000Z') AS modified
FROM g_actors a JOIN al ON al.actor_id = a.id
""", ("g_actors", "g_aliases"))
def stix_intrusion_sets(spark, sf_dir):
    rows = _objects(spark, sf_dir).filter("type = 'intrusion-set'")
    parsed = F.from_json("json", "name string, description string, aliases array<string>, external_references array<string>, created string, modified string")
    return rows.select("id", parsed.alias("o")).select(
        "id", "o.name", "o.description", F.array_join("o.aliases", "|").alias("aliases"),
        F.size("o.external_references").cast("bigint").alias("n_references"), "o.created", "o.modified")


@query("uses_support", """
SELECT actor_id, technique_id, count(*)::BIGINT AS observations, strftime(min(o.created_at), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(max(o.updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at
FROM g_actor_obs l JOIN g_obs_techniques t USING (observation_id) JOIN g_obs o ON o.id = l.observation_id GROUP BY ALL
""", ("g_actor_obs", "g_obs_techniques", "g_obs"))
def uses_support(spark, sf_dir):
    graph = A.order_graph(spark, sf_dir)
    rows = X.uses_support(graph, graph.actor_observations)
    return rows.withColumns({"created_at": stamp("created_at"), "updated_at": stamp("updated_at")})


@query("stix_references", """
WITH p AS (SELECT l.actor_id, t.technique_id, l.observation_id FROM g_actor_obs l JOIN g_obs_techniques t USING (observation_id))
SELECT DISTINCT actor_id, technique_id, coalesce(description, '') AS description, coalesce(external_id, '') AS external_id, source_name, coalesce(url, '') AS url FROM (
  SELECT p.actor_id, p.technique_id, NULL AS description, o.source_native_id AS external_id, s.name AS source_name, s.base_url AS url
  FROM p JOIN g_obs o ON o.id = p.observation_id JOIN g_sources s ON s.id = o.source_id
  UNION ALL SELECT p.actor_id, p.technique_id, e.citation || ' — ' || e.excerpt, NULL, s.name, e.locator
  FROM p JOIN g_obs_evidence x USING (observation_id) JOIN g_evidence e ON e.id = x.evidence_id JOIN g_sources s ON s.id = e.source_id)
""", ("g_actor_obs", "g_obs_techniques", "g_obs", "g_sources", "g_obs_evidence", "g_evidence"))
def stix_references(spark, sf_dir):
    graph = A.order_graph(spark, sf_dir)
    rows = X.uses_references(graph, graph.actor_observations, stored=True)
    part = lambda n: F.coalesce(f"reference.{n}", F.lit("")).alias(n)
    return rows.select("actor_id", "technique_id", part("description"), part("external_id"), c("reference.source_name").alias("source_name"), part("url"))
