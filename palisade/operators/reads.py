"""Read models over the graph: actor search, timelines, aliases, associations, references.

Each function serves every actor in one job; ``actor_ids`` (a DataFrame with ``actor_id``) narrows
it by semi-join. Caps are applied with ranked windows before anything is collected into arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.text import normalize_name
from palisade.functions.times import within
from palisade.operators.paging import after_cursor
from palisade.operators.scale import Order, capped_children, top_n
from palisade.operators.visibility import own_published, published
from palisade.schemas import Graph
from palisade.session import materialize

# --- fixed values: limits of the read models ------------------------------------------------
MAX_ALIASES = 100
MAX_ASSOCIATIONS = 200
MAX_EVIDENCE = 200
MAX_SOURCES = 100
SEARCH_HITS = 20
MATCHED_NAMES = 5
NESTED_CAP = 50
# ------------------------------------------------------------------------------------------

NEWEST_FIRST: Order = (("observed_at", False), ("observation_id", False))


def _narrow(df: DataFrame, actor_ids: DataFrame | None) -> DataFrame:
    return df if actor_ids is None else df.join(actor_ids, "actor_id", "left_semi")


def public_actor_observations(graph: Graph, actor_ids: DataFrame | None = None) -> DataFrame:
    """(actor_id, observation_id) pairs in which both ends are public."""
    actors = own_published(graph.actors).select(F.col("id").alias("actor_id"))
    seen = published(graph.observations, graph.sources).select(F.col("id").alias("observation_id"))
    links = _narrow(graph.actor_observations, actor_ids)
    return links.join(actors, "actor_id", "left_semi").join(seen, "observation_id", "left_semi")


def public_actors(graph: Graph, actor_ids: DataFrame | None = None) -> DataFrame:
    """Point read by key: an internal actor looks the same as a missing one."""
    rows = own_published(graph.actors)
    if actor_ids is not None:
        keys = actor_ids.select(F.col("actor_id").alias("id"))
        rows = rows.join(keys, "id", "left_semi")
    return rows.select("id", "canonical_name", "description")


def timeline(
    graph: Graph,
    actor_ids: DataFrame | None = None,
    page_size: int = 25,
    after: tuple | None = None,
    date_from=None,
    date_to=None,
    intelligence_type: str | None = None,
    nested_cap: int = NESTED_CAP,
) -> DataFrame:
    """Newest public observations per actor with capped evidence, behaviors and techniques.

    The page is ranked on narrow rows first; details and children are joined to it afterwards.
    """
    seen = published(graph.observations, graph.sources).filter(
        within(F.col("observed_at"), date_from, date_to)
    )
    if intelligence_type is not None:
        seen = seen.filter(F.col("intelligence_type") == intelligence_type)
    actors = own_published(graph.actors).select(F.col("id").alias("actor_id"))
    links = _narrow(graph.actor_observations, actor_ids).join(actors, "actor_id", "left_semi")
    dated = links.join(
        seen.select(F.col("id").alias("observation_id"), "observed_at"), "observation_id"
    )
    if after is not None:
        dated = dated.filter(after_cursor(NEWEST_FIRST, after))
    ranked = top_n(dated, ["actor_id"], NEWEST_FIRST, page_size + 1, "position")
    shown = _drop_probe(ranked, ["actor_id"], page_size, "has_more").select(
        "actor_id", "observation_id", "position", "has_more"
    )
    ids = shown.select("observation_id").distinct()
    details = seen.select(
        F.col("id").alias("observation_id"), "source_id", "source_native_id", "title", "summary",
        "observed_at", "first_seen", "last_seen", "confidence", "intelligence_type", "origin",
        "raw_evidence_id",
    )
    result = shown.join(details, "observation_id")
    for children in _children(graph, ids, nested_cap):
        result = result.join(children, "observation_id", "left")
    for name in ("evidence", "behaviors", "techniques"):
        flag = f"{name}_truncated"
        result = result.withColumn(flag, F.coalesce(flag, F.lit(False)))
    return result


def _children(graph: Graph, ids: DataFrame, cap: int) -> list[DataFrame]:
    evidence = published(graph.evidence, graph.sources).select(
        F.col("id").alias("evidence_id"), F.col("id"), "citation", "excerpt", "locator",
        "confidence", "origin", "source_id",
    )
    behaviors = own_published(graph.behaviors).select(
        F.col("id").alias("behavior_id"), F.col("id"), "name", "description"
    )
    techniques = published(graph.techniques, graph.sources).select(
        F.col("id").alias("technique_id"), F.col("id"), "external_id", "name", "description",
        "source_id",
    )
    plan = [
        ("evidence", graph.observation_evidence, evidence, "evidence_id", "citation"),
        ("behaviors", graph.observation_behaviors, behaviors, "behavior_id", "name"),
        ("techniques", graph.observation_techniques, techniques, "technique_id", "external_id"),
    ]
    out = []
    for name, link, rows, key, sort_key in plan:
        near = link.join(ids, "observation_id", "left_semi").join(rows, key)
        fields = [c for c in rows.columns if c != key]
        order = ((sort_key, True), ("id", True))
        out.append(capped_children(near, ["observation_id"], order, cap, fields, name))
    return out


def aliases(graph: Graph, actor_ids: DataFrame | None = None, limit: int = MAX_ALIASES) -> DataFrame:
    rows = published(_narrow(graph.aliases, actor_ids), graph.sources, graph.actors)
    ranked = top_n(rows, ["actor_id"], (("normalized_name", True), ("id", True)), limit + 1,
                   "position")
    return _drop_probe(ranked, ["actor_id"], limit, "truncated").select(
        "actor_id", "position", "id", "name", "source_native_id", "confidence", "source_id",
        "truncated",
    )


def _drop_probe(ranked: DataFrame, by: list[str], limit: int, flag: str) -> DataFrame:
    """Drop the probe row of a top ``limit + 1`` per group and keep whether it existed.

    The window reuses the placement of the ranking and sees at most ``limit + 1`` rows per group.
    """
    last = F.max("position").over(Window.partitionBy(*by))
    return ranked.withColumn(flag, last > limit).filter(F.col("position") <= limit)


def associations(
    graph: Graph, actor_ids: DataFrame | None = None, limit: int = MAX_ASSOCIATIONS
) -> DataFrame:
    """Distinct public behaviors and techniques an actor is tied to through public observations."""
    pairs = public_actor_observations(graph, actor_ids)
    behaviors = (
        pairs.join(graph.observation_behaviors, "observation_id")
        .select("actor_id", F.col("behavior_id").alias("id"))
        .distinct()
        .join(own_published(graph.behaviors).select("id", "name", "normalized_name"), "id")
        .select("actor_id", F.lit("behavior").alias("kind"), "id", "name",
                F.col("normalized_name").alias("sort_key"))
    )
    techniques = (
        pairs.join(graph.observation_techniques, "observation_id")
        .select("actor_id", F.col("technique_id").alias("id"))
        .distinct()
        .join(published(graph.techniques, graph.sources).select("id", "name", "external_id"), "id")
        .select("actor_id", F.lit("technique").alias("kind"), "id", "name",
                F.col("external_id").alias("sort_key"))
    )
    order = (("sort_key", True), ("id", True))
    rows = behaviors.unionByName(techniques)
    ranked = top_n(rows, ["actor_id", "kind"], order, limit + 1, "position")
    return _drop_probe(ranked, ["actor_id", "kind"], limit, "truncated").select(
        "actor_id", "kind", "position", "id", "name", "sort_key", "truncated"
    )


def references(
    graph: Graph,
    actor_ids: DataFrame | None = None,
    source_limit: int = MAX_SOURCES,
    evidence_limit: int = MAX_EVIDENCE,
) -> DataFrame:
    """Distinct sources (of the observations and of their evidence) and distinct evidence."""
    pairs = public_actor_observations(graph, actor_ids)
    own = (
        pairs.join(
            graph.observations.select(F.col("id").alias("observation_id"), "source_id"),
            "observation_id",
        )
        .select("actor_id", "source_id")
        .distinct()
    )
    shown = (
        pairs.join(graph.observation_evidence, "observation_id")
        .select("actor_id", F.col("evidence_id").alias("id"))
        .distinct()
        .join(published(graph.evidence, graph.sources).select("id", "citation", "source_id"), "id")
    )
    source_ids = own.union(shown.select("actor_id", "source_id")).distinct()
    names = own_published(graph.sources).select(F.col("id").alias("source_id"), "name")
    sources = source_ids.join(names, "source_id").select(
        "actor_id", F.lit("source").alias("kind"), F.col("source_id").alias("id"),
        F.col("name").alias("label"),
    )
    cited = shown.select(
        "actor_id", F.lit("evidence").alias("kind"), "id", F.col("citation").alias("label")
    )
    order = (("label", True), ("id", True))
    out = None
    for rows, limit in ((sources, source_limit), (cited, evidence_limit)):
        ranked = top_n(rows, ["actor_id"], order, limit + 1, "position")
        part = _drop_probe(ranked, ["actor_id"], limit, "truncated")
        out = part if out is None else out.unionByName(part)
    return out.select("actor_id", "kind", "position", "id", "label", "truncated")


def _substrings(text: Column, width: int) -> Column:
    """Distinct substrings of one width."""
    places = F.sequence(F.lit(1), F.length(text) - (width - 1))
    return F.when(
        F.length(text) >= width, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, width)))
    ).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text) of all distinct texts that contain a needle: an equi join on three-letter substrings.

    A needle is looked up by its three letters that the fewest texts hold, a shorter one by itself; ``contains`` decides.
    """
    needles, texts = needles.select("needle").distinct(), texts.select("text").distinct()
    grams = texts.select("text", F.explode(F.concat(*[_substrings(F.col("text"), w) for w in (1, 2, 3)])).alias("gram"))
    width = F.least(F.length("needle"), F.lit(3))
    asked = needles.select("needle", F.explode(F.when(F.length("needle") >= 3, _substrings(F.col("needle"), 3))
                                               .otherwise(F.array(F.substring(F.col("needle"), F.lit(1), width)))).alias("gram"))
    found = grams.join(asked.select("gram").distinct(), "gram", "left_semi")
    held = found.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    rarest = asked.join(held, "gram", "left").groupBy("needle").agg(
        F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), F.col("gram"))).alias("gram")
    )
    return found.join(rarest, "gram").filter(F.contains(F.col("text"), F.col("needle"))).select("needle", "text")


def actor_search(graph: Graph, queries: DataFrame, hits: int = SEARCH_HITS,
                 names: int = MATCHED_NAMES) -> DataFrame:
    """Substring search on canonical names and public aliases for a table of queries of any size.

    ``queries`` has (query_id, query). Rank 0 canonical equal, 1 alias equal, 2 canonical contains, 3 alias
    contains. Matched names: the first five aliases by (normalized, id), repeats removed after that cut,
    canonical name put first, five kept.
    """
    needles = queries.select(
        F.col("query_id").cast("string").alias("query_id"), normalize_name(F.col("query")).alias("needle")
    ).filter(F.col("needle").isNotNull())
    # normalized and met once, read several times
    needles = materialize(needles, "needles")
    actors = own_published(graph.actors).select(
        F.col("id").alias("actor_id"), "canonical_name", "normalized_name", "description"
    )
    alias_rows = published(
        graph.aliases.filter(F.col("actor_id").isNotNull()), graph.sources, graph.actors
    ).select("actor_id", F.col("id").alias("alias_id"), "name",
             F.col("normalized_name").alias("alias_norm"))
    texts = actors.select(F.col("normalized_name").alias("text")).unionByName(
        alias_rows.select(F.col("alias_norm").alias("text"))
    )
    met = materialize(containing(needles, texts).join(needles, "needle").select("query_id", "needle", "text"), "needles-met")
    canonical = actors.join(met, F.col("normalized_name") == F.col("text")).select(
        "query_id", "actor_id",
        F.when(F.col("normalized_name") == F.col("needle"), 0).otherwise(2).alias("match_rank"),
    )
    by_alias = alias_rows.join(met, F.col("alias_norm") == F.col("text"))
    through = by_alias.select(
        "query_id", "actor_id",
        F.when(F.col("alias_norm") == F.col("needle"), 1).otherwise(3).alias("match_rank"),
    )
    best = (
        canonical.unionByName(through)
        .groupBy("query_id", "actor_id")
        .agg(F.min("match_rank").alias("match_rank"))
        .join(actors, "actor_id")
    )
    order = (("match_rank", True), ("normalized_name", True), ("actor_id", True))
    top = top_n(best, ["query_id"], order, hits, "position")
    first = top_n(
        by_alias.select("query_id", "actor_id", "alias_id", "name", "alias_norm"),
        ["query_id", "actor_id"], (("alias_norm", True), ("alias_id", True)), names, "_r",
    )
    listed = first.groupBy("query_id", "actor_id").agg(
        F.array_distinct(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x.getField("name")
            )
        ).alias("alias_names")
    )
    joined = top.join(listed, ["query_id", "actor_id"], "left").join(needles, "query_id")
    alias_names = F.coalesce("alias_names", F.array().cast("array<string>"))
    own = F.contains(F.col("normalized_name"), F.col("needle")) & ~F.array_contains(
        alias_names, F.col("canonical_name")
    )
    matched = F.when(own, F.concat(F.array("canonical_name"), alias_names)).otherwise(alias_names)
    return joined.select(
        "query_id", "position", "actor_id", "canonical_name", "description", "match_rank",
        F.slice(matched, 1, names).alias("matched_names"),
    )
