"""Versioned advisories: pointer reads, numbered appends, publication and update feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.operators.scale import capped_children, numbered, top_n
from palisade.schemas import Graph

DETAIL_UPDATES = 50
#: Links of a kind nested under one revision or update; ``revision_links`` gives all in long form.
DETAIL_LINKS = 500
#: kind of link of a revision: table, column
REVISION_LINKS = {
    "evidence": ("revision_evidence", "evidence_id"),
    "actors": ("revision_actors", "actor_id"),
    "campaigns": ("revision_campaigns", "campaign_id"),
    "techniques": ("revision_techniques", "technique_id"),
}


def listing(graph: Graph, limit: int) -> DataFrame:
    """Published advisories with the revision they point to and the time of their newest update."""
    live = graph.advisories.filter(F.col("status") == "published").select(
        F.col("id").alias("advisory_id"), "slug", "published_revision", "published_at"
    )
    shown = live.orderBy(F.col("published_at").desc(), "advisory_id").limit(limit)
    revision = graph.advisory_revisions.select(
        "advisory_id", F.col("version").alias("published_revision"), "title", "summary"
    )
    latest = (
        graph.advisory_updates.join(shown.select("advisory_id"), "advisory_id", "left_semi")
        .groupBy("advisory_id").agg(F.max("occurred_at").alias("latest_update_at"))
    )
    return (
        shown.join(revision, ["advisory_id", "published_revision"])
        .join(latest, "advisory_id", "left")
        .select("advisory_id", "slug", "title", "summary", "published_revision", "published_at", "latest_update_at")
    )


def revisions(graph: Graph, published_only: bool = True) -> DataFrame:
    """Readable revisions of published advisories; ``current`` marks the one pointed to."""
    live = graph.advisories.filter(F.col("status") == "published").select(
        F.col("id").alias("advisory_id"), "slug", "published_revision"
    )
    rows = graph.advisory_revisions.join(live, "advisory_id")
    if published_only:
        rows = rows.filter(F.col("published_at").isNotNull())
    return rows.withColumn("current", F.col("version") == F.col("published_revision"))


def detail(graph: Graph, advisory_ids: DataFrame | None = None, updates: int = DETAIL_UPDATES) -> DataFrame:
    """Current revision with its sections by position and its newest updates in ascending order."""
    rows = revisions(graph).filter("current")
    if advisory_ids is not None:
        rows = rows.join(advisory_ids, "advisory_id", "left_semi")
    head = rows.select("advisory_id", "slug", "version", F.col("id").alias("revision_id"), "title", "summary")
    ids = head.select("advisory_id")
    ordered = F.array_sort(F.collect_list(F.struct(
        F.col("position").alias("at"),
        F.struct("section_type", "position", "intelligence_type", "content").alias("section"),
    )))
    sections = graph.advisory_sections.groupBy("revision_id").agg(
        F.transform(ordered, lambda x: x.getField("section")).alias("sections")
    )
    recent = capped_children(
        graph.advisory_updates.join(ids, "advisory_id", "left_semi"),
        ["advisory_id"], (("sequence", False),), updates,
        ["id", "sequence", "occurred_at", "title", "summary", "intelligence_type"], "updates",
    ).withColumn("updates", F.reverse("updates"))
    return head.join(sections, "revision_id", "left").join(recent, "advisory_id", "left")


def revision_links(graph: Graph, revision_ids: DataFrame | None = None) -> DataFrame:
    """revision_id, kind, target_id of all kinds of links, in long form; a repeated link counts once."""
    rows = None
    for kind, (table, column) in REVISION_LINKS.items():
        part = getattr(graph, table).select("revision_id", F.lit(kind).alias("kind"), F.col(column).alias("target_id"))
        if revision_ids is not None:
            part = part.join(revision_ids, "revision_id", "left_semi")
        rows = part if rows is None else rows.unionByName(part)
    return rows.distinct()


def nested_links(graph: Graph, revision_ids: DataFrame | None = None, cap: int = DETAIL_LINKS) -> DataFrame:
    """Per revision an array of ids for each kind, ascending, and whether any kind was cut.

    All kinds share one ranking and one aggregation: links past the cap never reach an array.
    """
    packed = capped_children(
        revision_links(graph, revision_ids), ["revision_id", "kind"], (("target_id", True),), cap, ["target_id"], "ids"
    )
    ids = F.transform("ids", lambda x: x.getField("target_id"))
    none = F.array().cast("array<string>")
    return packed.groupBy("revision_id").agg(
        *[F.coalesce(F.first(F.when(F.col("kind") == kind, ids), ignorenulls=True), none).alias(kind) for kind in REVISION_LINKS],
        F.max("ids_truncated").alias("links_truncated"),
    )


def _with_links(rows: DataFrame, graph: Graph, cap: int) -> DataFrame:
    linked = rows.join(nested_links(graph, rows.select("revision_id"), cap), "revision_id", "left")
    none = F.array().cast("array<string>")
    return linked.withColumns({
        **{kind: F.coalesce(kind, none) for kind in REVISION_LINKS},
        "links_truncated": F.coalesce("links_truncated", F.lit(False)),
    })


def linked_detail(
    graph: Graph, advisory_ids: DataFrame | None = None, updates: int = DETAIL_UPDATES, links: int = DETAIL_LINKS
) -> DataFrame:
    """``detail`` with the links of the revision and, in each update, the ids of its evidence.

    Evidence is looked up for the updates shown only.
    """
    rows = _with_links(detail(graph, advisory_ids, updates), graph, links)
    shown = rows.select("advisory_id", F.explode("updates").alias("u")).select("advisory_id", F.col("u.id").alias("update_id"))
    cited = graph.update_evidence.distinct().join(shown, "update_id")
    packed = capped_children(cited, ["advisory_id", "update_id"], (("evidence_id", True),), links, ["evidence_id"], "evidence_ids")
    ids = F.transform("evidence_ids", lambda x: x.getField("evidence_id"))
    by_update = packed.groupBy("advisory_id").agg(
        F.map_from_entries(F.collect_list(F.struct("update_id", ids.alias("ids")))).alias("_cited")
    )
    none = F.array().cast("array<string>")
    return rows.join(by_update, "advisory_id", "left").withColumn(
        "updates",
        F.transform("updates", lambda u: u.withField("evidence_ids", F.coalesce(F.col("_cited")[u.getField("id")], none))),
    ).drop("_cited")


def historic(graph: Graph, asked: DataFrame | None = None, links: int = DETAIL_LINKS) -> DataFrame:
    """Any readable revision of a published advisory, with sections and links and without updates.

    ``asked``: advisory_id, version; a revision that was never published has no row.
    """
    rows = revisions(graph)
    if asked is not None:
        rows = rows.join(asked, ["advisory_id", "version"], "left_semi")
    head = rows.select("advisory_id", "slug", "version", "current", F.col("id").alias("revision_id"), "title", "summary")
    section = F.struct("position", "section_type", "intelligence_type", "content")
    sections = (
        graph.advisory_sections.join(head.select("revision_id"), "revision_id", "left_semi")
        .groupBy("revision_id").agg(F.array_sort(F.collect_list(section)).alias("sections"))
    )
    return _with_links(head.join(sections, "revision_id", "left"), graph, links)


def recent_updates(updates: DataFrame, limit: int = DETAIL_UPDATES) -> DataFrame:
    """Newest updates per advisory, numbered oldest first."""
    newest = top_n(updates, ["advisory_id"], (("sequence", False),), limit, "_from_end")
    shown = F.count(F.lit(1)).over(Window.partitionBy("advisory_id"))
    return newest.withColumn("position", (shown - F.col("_from_end") + 1).cast("int")).drop("_from_end")


def update_feed(graph: Graph, advisory_id: str, after_sequence: int, limit: int) -> DataFrame:
    """Updates of a published advisory after a sequence number; a draft's feed is empty."""
    live = graph.advisories.filter(
        (F.col("status") == "published") & (F.col("id") == advisory_id)
    ).select(F.col("id").alias("advisory_id"))
    rows = graph.advisory_updates.join(live, "advisory_id", "left_semi")
    return rows.filter(F.col("sequence") > after_sequence).orderBy("sequence").limit(limit)


def next_numbers(batch: DataFrame, stored: DataFrame, key: str, number: str, order: str) -> DataFrame:
    """Append numbers: the stored maximum of the key plus the position within the batch."""
    held = stored.groupBy(key).agg(F.max(number).alias("_held"))
    placed = numbered(batch, ((order, True),), [key], "_n")
    return placed.join(held, key, "left").withColumn(
        number, (F.coalesce("_held", F.lit(0)) + F.col("_n")).cast("bigint")
    ).drop("_held", "_n")


def append_updates(batch: DataFrame, graph: Graph, order: str = "submission_id") -> DataFrame:
    """Updates need a published pointer that names a revision; the rest are refused with a reason."""
    live = graph.advisories.select(
        F.col("id").alias("advisory_id"), "status", F.col("published_revision").alias("_version")
    )
    revision = graph.advisory_revisions.select(
        "advisory_id", F.col("version").alias("_version"), F.col("id").alias("revision_id")
    )
    rows = batch.join(live, "advisory_id", "left").join(revision, ["advisory_id", "_version"], "left")
    refused = (
        F.when(F.col("status").isNull(), F.lit("advisory does not exist"))
        .when((F.col("status") != "published") | F.col("_version").isNull(),
              F.lit("publish a revision before adding updates"))
        .when(F.col("revision_id").isNull(), F.lit("the published revision pointer is invalid"))
    )
    rows = rows.withColumn("refused", refused).drop("status", "_version")
    accepted = next_numbers(
        rows.filter(F.col("refused").isNull()), graph.advisory_updates, "advisory_id", "sequence", order
    )
    return accepted.unionByName(
        rows.filter(F.col("refused").isNotNull()).withColumn("sequence", F.lit(None).cast("bigint"))
    )


def publish(revisions_: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply publish events (advisory_id, version, at): the first stamp of a revision stays, the
    pointer goes to the latest event. Events that name no revision are ignored."""
    known = revisions_.select("advisory_id", "version")
    real = events.join(known, ["advisory_id", "version"], "left_semi")
    stamps = real.groupBy("advisory_id", "version").agg(F.min("at").alias("published_at"))
    pointers = real.groupBy("advisory_id").agg(
        F.max_by("version", F.struct("at", "version")).alias("published_revision"),
        F.max("at").alias("published_at"),
    )
    return stamps, pointers
