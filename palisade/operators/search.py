"""Ranked search across seven entity kinds with exact hits first and keyset pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.text import casefold, clean_query, normalize_name
from palisade.functions.times import overlaps, within
from palisade.operators import postings as P
from palisade.operators.paging import after_cursor
from palisade.operators.scale import Order, top_n
from palisade.operators.visibility import own_published, published
from palisade.schemas import ENTITY_ORDER, Graph
from palisade.sources.postings_index import PostingsIndex, stored_postings

SUMMARY_LENGTH = 500
EXACT_SCORE = 100.0
RESULT_ORDER: Order = (
    ("score", False), ("entity_order", True), ("sort_title", True), ("id", True),
)
# kinds that carry neither dates nor an intelligence type: such a filter removes them
_UNDATED = {"actor", "alias", "behavior", "technique", "source"}


def _branch(kind, rows, title, summary, exact, **extra) -> DataFrame:
    """One entity kind in the common shape; columns it lacks are typed nulls."""
    kinds = {
        "source_id": "string", "actor_id": "string", "external_id": "string",
        "observed_at": "timestamp", "intelligence_type": "string", "origin": "string",
    }
    return rows.select(
        F.lit(kind).alias("entity_type"),
        "id",
        F.col(title).alias("title"),
        F.substring(summary if not isinstance(summary, str) else F.col(summary), 1, SUMMARY_LENGTH).alias("summary"),
        *[
            (F.col(extra[name]) if name in extra else F.lit(None)).cast(type_).alias(name)
            for name, type_ in kinds.items()
        ],
        F.array(*[F.concat(F.lit(tag), col) for tag, col in exact]).alias("exact_keys"),
    )


def _in_source(graph: Graph, rows: DataFrame, source_id: str, link: str, id_col: str, with_alias: bool) -> DataFrame:
    """Rows linked to a public observation (or public alias) of the source: one semi-join on the
    union of both key sets."""
    seen = published(graph.observations, graph.sources).filter(F.col("source_id") == source_id)
    keys = getattr(graph, link).join(
        seen.select(F.col("id").alias("observation_id")), "observation_id", "left_semi"
    ).select(F.col(id_col).alias("id"))
    if with_alias:
        named = published(graph.aliases, graph.sources).filter(
            (F.col("source_id") == source_id) & F.col("actor_id").isNotNull()
        )
        keys = keys.union(named.select(F.col("actor_id").alias("id")))
    return rows.join(keys, "id", "left_semi")


def entity_rows(
    graph: Graph,
    entity_types: set[str] | None = None,
    source_id: str | None = None,
    intelligence_type: str | None = None,
    date_from=None,
    date_to=None,
) -> DataFrame | None:
    """Public rows of the selected kinds; branches a filter rules out are never planned."""
    wanted = set(entity_types or ENTITY_ORDER)
    if any(x is not None for x in (intelligence_type, date_from, date_to)):
        wanted -= _UNDATED
    norm, lower = "n:", "c:"

    def of_source(rows: DataFrame) -> DataFrame:
        return rows if source_id is None else rows.filter(F.col("source_id") == source_id)

    def of_type(rows: DataFrame) -> DataFrame:
        if intelligence_type is None:
            return rows
        return rows.filter(F.col("intelligence_type") == intelligence_type)

    branches = []
    if "actor" in wanted:
        rows = own_published(graph.actors)
        if source_id is not None:
            rows = _in_source(graph, rows, source_id, "actor_observations", "actor_id", True)
        branches.append(_branch("actor", rows, "canonical_name", "description",
                                [(norm, F.col("normalized_name"))]))
    if "alias" in wanted:
        rows = of_source(published(graph.aliases, graph.sources, graph.actors))
        branches.append(_branch("alias", rows, "name", F.lit("Source-preserved actor alias"),
                                [(norm, F.col("normalized_name"))], source_id="source_id", actor_id="actor_id"))
    if "campaign" in wanted:
        rows = of_type(of_source(published(graph.campaigns, graph.sources))).filter(
            overlaps(F.col("first_seen"), F.col("last_seen"), date_from, date_to)
        )
        branches.append(_branch("campaign", rows, "name", "description", [(norm, F.col("normalized_name"))],
                                source_id="source_id", observed_at="first_seen",
                                intelligence_type="intelligence_type", origin="origin"))
    if "behavior" in wanted:
        rows = own_published(graph.behaviors)
        if source_id is not None:
            rows = _in_source(graph, rows, source_id, "observation_behaviors", "behavior_id", False)
        branches.append(_branch("behavior", rows, "name", "description", [(norm, F.col("normalized_name"))]))
    if "technique" in wanted:
        rows = of_source(published(graph.techniques, graph.sources))
        branches.append(_branch("technique", rows, "name", "description",
                                [(lower, F.lower("external_id")), (lower, F.lower("name"))],
                                source_id="source_id", external_id="external_id"))
    if "observation" in wanted:
        rows = of_type(of_source(published(graph.observations, graph.sources))).filter(
            within(F.col("observed_at"), date_from, date_to)
        )
        branches.append(_branch("observation", rows, "title", "summary", [(lower, F.lower("title"))],
                                source_id="source_id", observed_at="observed_at",
                                intelligence_type="intelligence_type", origin="origin"))
    if "source" in wanted:
        rows = own_published(graph.sources)
        if source_id is not None:
            rows = rows.filter(F.col("id") == source_id)
        branches.append(_branch("source", rows, "name", "policy_notes", [(lower, F.lower("name"))],
                                source_id="id"))
    out = None
    for branch in branches:
        out = branch if out is None else out.unionByName(branch)
    return out


def stored_index(graph: Graph, label: str, inputs: Sequence[str], stemmed: bool = True, stop_words: bool = True) -> PostingsIndex:
    """The stored index over all entity kinds of a graph made from the files ``inputs``."""
    def build():
        exact = entity_rows(graph).select("entity_type", "id", "exact_keys")
        return P.index_input(P.documents(graph), stemmed, stop_words, exact)

    return stored_postings(graph.spark, f"{label}-{int(stemmed)}{int(stop_words)}", inputs, build)


def search(
    graph: Graph,
    queries: DataFrame,
    posted: DataFrame | PostingsIndex | None = None,
    rank: str = "cover",
    stemmed: bool = True,
    stop_words: bool = True,
    limit: int = 25,
    after: Sequence | None = None,
    **filters,
) -> DataFrame:
    """Best ``limit`` rows per query of ``queries`` (query_id, query), exact names before text.

    ``after``: the values of RESULT_ORDER of the last row of a page; the page that follows it is returned. ``has_more``
    tells whether a further row follows.

    Pass a stored index as ``posted`` for repeated use: it answers for words and exact names, and the entity rows are read
    once, for the hits. Postings as a table serve for words only; without either they are built in the same job.
    Keys and scores are joined to the entity rows after matching, so unmatched rows carry nothing.
    """
    rows = entity_rows(graph, **filters)
    cleaned = queries.select("query_id", clean_query(F.col("query")).alias("query")).filter(
        F.col("query").isNotNull()
    )
    if posted is None:
        posted = P.postings(P.documents(graph), stemmed, stop_words)
    matched = P.match(P.query_terms(cleaned, stemmed, stop_words), posted)
    ranked = P.cover_rank(matched) if rank == "cover" else P.frequency_rank(matched)
    keys = cleaned.select(
        "query_id",
        F.explode(
            F.array(
                F.concat(F.lit("n:"), normalize_name(F.col("query"))),
                F.concat(F.lit("c:"), casefold(F.col("query"))),
            )
        ).alias("_key"),
    ).filter(F.col("_key").isNotNull())
    if isinstance(posted, PostingsIndex):
        named = posted.exact(keys)
    else:
        named = rows.select("entity_type", "id", F.explode("exact_keys").alias("_key"))
    exact = (
        named.join(keys, "_key")
        .select("query_id", "entity_type", "id", F.lit(0.0).alias("rank"), F.lit(True).alias("exact"))
    )
    hits = (
        exact.unionByName(ranked.withColumn("exact", F.lit(False)))
        .groupBy("query_id", "entity_type", "id")
        .agg(F.max("rank").alias("rank"), F.max("exact").alias("exact"))
    )
    orders = F.create_map(*[F.lit(x) for pair in ENTITY_ORDER.items() for x in pair])
    scored = hits.join(rows.drop("exact_keys"), ["entity_type", "id"]).withColumns(
        {
            "score": F.when(F.col("exact"), F.lit(EXACT_SCORE)).otherwise(F.lit(0.0)) + F.col("rank"),
            "match_kind": F.when(F.col("exact"), F.lit("exact")).otherwise(F.lit("full_text")),
            "entity_order": F.try_element_at(orders, F.col("entity_type")),
            "sort_title": F.lower("title"),
        }
    )
    scored = scored.drop("rank", "exact")
    if after is not None:
        scored = scored.filter(after_cursor(RESULT_ORDER, after))
    found = top_n(scored, ["query_id"], RESULT_ORDER, limit + 1, "position")
    more = F.max("position").over(Window.partitionBy("query_id")) > limit
    return found.withColumn("has_more", more).filter(F.col("position") <= limit)
