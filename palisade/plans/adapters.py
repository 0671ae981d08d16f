"""The benchmark tables seen through the model's schema, in Spark and in SQL.

customer / orders / lineitem / part stand for actors, observations, evidence and techniques; documents
for observed text; events for campaigns and job logs; conversations for advisories. ``CTES`` states the
same mapping in SQL, for the oracle side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.schemas import Graph
from palisade.session import configure

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _state(cond: Column) -> Column:
    return F.when(cond, F.lit("published")).otherwise(F.lit("internal"))


def _day(base: str, days: Column) -> Column:
    return F.timestamp_add("DAY", days.cast("bigint"), F.lit(base).cast("timestamp"))


def _null() -> Column:
    return F.lit(None).cast("string")


class _Tables:
    """Input tables, opened on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = configure(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        setattr(self, name, df)
        return df


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Actors, observations, evidence, behaviors, techniques, campaigns and their links."""
    t = _Tables(spark, sf_dir)
    born = F.lit("2020-01-01 00:00:00").cast("timestamp")
    stamps = {"created_at": born, "updated_at": born}
    def nations():
        return t.nation.select(
            _text("nation:", c("n_name")).alias("id"), c("n_name").alias("name"), F.lit("registry").alias("kind"),
            _text("https://", F.lower("n_name"), ".example.org").alias("base_url"),
            _state(c("n_regionkey") != 2).alias("publication_state"),
        )

    def priorities():
        return t.orders.select("o_orderpriority").distinct().select(
            _text("prio:", c("o_orderpriority")).alias("id"), c("o_orderpriority").alias("name"),
            F.lit("queue").alias("kind"), _null().alias("base_url"),
            _state(c("o_orderpriority") != "4-NOT SPECIFIED").alias("publication_state"),
        )

    def sources():
        return nations().unionByName(priorities()).withColumns(
            {"policy_notes": _null(), "license_name": _null(), "license_url": _null(), "metadata": _null(), **stamps}
        )

    def actors():
        return t.customer.select(
            _text("cust-", c("c_custkey")).alias("id"), c("c_name").alias("canonical_name"),
            F.lower("c_name").alias("normalized_name"), c("c_mktsegment").alias("description"),
            _null().alias("metadata"), _state(c("c_acctbal") >= 0).alias("publication_state"),
            _day("2020-01-01", c("c_custkey") % 365).alias("created_at"),
            _day("2021-01-01", c("c_custkey") % 365).alias("updated_at"),
        )

    def alias_base():
        return t.customer.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))

    def aliases():
        return alias_base().select(
            _text("al-", c("c_custkey"), "-", c("k")).alias("id"),
            F.when(c("k") == 0, _text("nation:NATION_", c("c_nationkey")))
            .when(c("c_custkey") % 3 == 0, F.lit("prio:4-NOT SPECIFIED")).otherwise(F.lit("prio:1-URGENT")).alias("source_id"),
            _text("cust-", c("c_custkey")).alias("actor_id"),
            F.when(c("k") == 0, _text("Alias ", c("c_name"))).otherwise(_text(c("c_mktsegment"), " ", c("c_custkey"))).alias("name"),
            F.when(c("k") == 0, _text("alias ", F.lower("c_name"))).otherwise(_text(F.lower("c_mktsegment"), " ", c("c_custkey"))).alias("normalized_name"),
            _text("native-", c("c_custkey")).alias("source_native_id"),
            (c("c_custkey") % 101).cast("int").alias("confidence"), _null().alias("metadata"),
            _state(c("c_custkey") % 5 != 0).alias("publication_state"), born.alias("created_at"), born.alias("updated_at"),
        )

    def observations():
        return t.orders.select(
            _text("ord-", c("o_orderkey")).alias("id"), _text("prio:", c("o_orderpriority")).alias("source_id"),
            _null().alias("raw_evidence_id"), c("o_orderkey").cast("string").alias("source_native_id"),
            _text("Order ", c("o_orderkey")).alias("title"),
            _text("Status ", c("o_orderstatus"), " priority ", c("o_orderpriority")).alias("summary"),
            c("o_orderdate").cast("timestamp").alias("observed_at"),
            c("o_orderdate").cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("last_seen"),
            F.when(c("o_orderkey") % 7 != 0, c("o_orderkey") % 101).cast("int").alias("confidence"),
            F.when(c("o_orderstatus") == "F", F.lit("assessed")).otherwise(F.lit("observed")).alias("intelligence_type"),
            F.lit("imported").alias("origin"), _null().alias("metadata"),
            _state(c("o_orderstatus") != "P").alias("publication_state"),
            _day("2022-01-01", c("o_orderkey") % 365).alias("created_at"),
            _day("2023-01-01", c("o_orderkey") % 365).alias("updated_at"),
        )

    def items():
        return t.lineitem.join(
            t.supplier.select(c("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey"
        )

    item_id = _text("li-", c("l_orderkey"), "-", c("l_linenumber"), "-", c("l_partkey"), "-", c("l_suppkey"), "-", c("l_quantity").cast("int"))
    def evidence():
        return items().select(
            item_id.alias("id"), _text("nation:NATION_", c("s_nationkey")).alias("source_id"),
            _null().alias("raw_evidence_id"),
            _text("Shipment ", c("l_orderkey"), "/", c("l_linenumber")).alias("citation"),
            _text(c("l_returnflag"), " ", c("l_linestatus")).alias("excerpt"),
            _text("https://evidence.example.org/", c("l_orderkey"), "/", c("l_linenumber")).alias("locator"),
            c("l_shipdate").cast("timestamp").alias("captured_at"), F.lit(None).cast("int").alias("confidence"),
            F.lit("imported").alias("origin"), _state(c("l_returnflag") != "R").alias("publication_state"),
            born.alias("created_at"), born.alias("updated_at"),
        )

    def techniques():
        return t.part.select(
            _text("part-", c("p_partkey")).alias("id"),
            _text("nation:NATION_", c("p_partkey") % 25).alias("source_id"),
            _text(c("p_brand"), "-", c("p_partkey")).alias("external_id"), c("p_name").alias("name"),
            c("p_type").alias("description"), _null().alias("metadata"),
            _state(c("p_type") != "PROMO").alias("publication_state"), born.alias("created_at"), born.alias("updated_at"),
        )

    def behaviors():
        return t.orders.select("o_orderpriority").distinct().select(
            _text("beh:", c("o_orderpriority")).alias("id"), c("o_orderpriority").alias("name"),
            F.lower("o_orderpriority").alias("normalized_name"), _null().alias("description"),
            _null().alias("metadata"), _state(c("o_orderpriority") != "5-LOW").alias("publication_state"),
            born.alias("created_at"), born.alias("updated_at"),
        )

    def runs():
        return t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))

    def campaigns():
        return runs().select(
            _text("camp-", c("user_id"), "-", c("event_type")).alias("id"),
            _text("nation:NATION_", c("user_id") % 25).alias("source_id"),
            _text("Campaign ", c("event_type"), " ", c("user_id")).alias("name"),
            _text("campaign ", c("event_type"), " ", c("user_id")).alias("normalized_name"),
            c("user_id").cast("string").alias("source_native_id"), c("event_type").alias("description"),
            F.when(c("user_id") % 4 != 0, c("a").cast("timestamp")).alias("first_seen"),
            F.when(c("user_id") % 6 != 0, c("b").cast("timestamp")).alias("last_seen"),
            (c("user_id") % 101).cast("int").alias("confidence"), F.lit("observed").alias("intelligence_type"),
            F.lit("imported").alias("origin"), _null().alias("metadata"),
            _state(c("event_type") != "error").alias("publication_state"), born.alias("created_at"), born.alias("updated_at"),
        )

    def relationships():
        return runs().select(
            _text("rel-", c("user_id"), "-", c("event_type")).alias("id"), _text("cust-", c("user_id")).alias("actor_id"),
            F.when(c("event_type") == "purchase", F.lit("attributed-to"))
            .when(c("event_type") == "signup", F.lit(" Attributed-To ")).otherwise(F.lit("related-to")).alias("relationship_type"),
            _text("camp-", c("user_id"), "-", c("event_type")).alias("campaign_id"),
            _text("nation:NATION_", c("user_id") % 25).alias("source_id"), _null().alias("evidence_id"),
            c("a").cast("timestamp").alias("first_seen"), c("b").cast("timestamp").alias("last_seen"),
            (c("user_id") % 101).cast("int").alias("confidence"), F.lit("assessed").alias("intelligence_type"),
            F.lit("imported").alias("origin"), born.alias("created_at"), born.alias("updated_at"),
        )

    order_id = _text("ord-", c("l_orderkey"))
    return Graph(spark, {
        "sources": sources, "actors": actors, "aliases": aliases, "observations": observations,
        "evidence": evidence, "techniques": techniques, "behaviors": behaviors, "campaigns": campaigns,
        "relationships": relationships,
        "actor_observations": lambda: t.orders.select(
            _text("cust-", c("o_custkey")).alias("actor_id"), _text("ord-", c("o_orderkey")).alias("observation_id")),
        "observation_evidence": lambda: t.lineitem.select(order_id.alias("observation_id"), item_id.alias("evidence_id")),
        "observation_behaviors": lambda: t.orders.select(
            _text("ord-", c("o_orderkey")).alias("observation_id"), _text("beh:", c("o_orderpriority")).alias("behavior_id")),
        # distinct within the partitions of their observation, by which the links join other tables
        "observation_techniques": lambda: t.lineitem.select(order_id.alias("observation_id"), "l_partkey")
            .repartition("observation_id").distinct()
            .select("observation_id", _text("part-", c("l_partkey")).alias("technique_id")),
    })


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their publication state; an unlabelled document is internal."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "text", "lang", "source", "n_chars",
        _state((c("quality") == 1) & (c("toxic") == 0)).alias("publication_state"),
    )


def document_sources(documents: DataFrame) -> DataFrame:
    """A source is public if it has at least one public document."""
    grouped = documents.groupBy("source").agg(
        F.max(c("publication_state") == "published").alias("_any")
    )
    return grouped.select(c("source").alias("id"), c("source").alias("name"), F.lit("feed").alias("kind"),
                          _state(c("_any")).alias("publication_state"))


#: The tables that ``text_graph`` is made of.
TEXT_GRAPH_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def text_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Documents as observations beside actors, aliases, techniques, behaviors and sources with text."""
    docs = labelled_documents(spark, sf_dir)
    base = order_graph(spark, sf_dir)
    observations = docs.select(
        _text("doc-", c("doc_id")).alias("id"), c("source").alias("source_id"), _null().alias("raw_evidence_id"),
        c("doc_id").cast("string").alias("source_native_id"), _text("Document ", c("doc_id")).alias("title"),
        c("text").alias("summary"), _day("2024-01-01", c("doc_id") % 365).alias("observed_at"),
        F.lit(None).cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("last_seen"),
        F.lit(None).cast("int").alias("confidence"),
        F.when(c("lang") == "en", F.lit("observed")).otherwise(F.lit("assessed")).alias("intelligence_type"),
        F.lit("imported").alias("origin"), _null().alias("metadata"), "publication_state",
    )
    sources = document_sources(docs).withColumns(
        {"base_url": _null(), "policy_notes": _null(), "license_name": _null(), "metadata": _null()}
    )
    both = base.sources.unionByName(sources, allowMissingColumns=True)
    return Graph(spark, {**base.tables, "observations": observations, "sources": both})


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two search requests per benchmark item (its first two words, or its only one; words two to four as a phrase), and
    one per nation name. ``segment_queries`` has those per segment name."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    both = items.select(
        _text("and-", c("item_id")).alias("query_id"),
        F.array_join(F.slice("w", 1, 2), " ").alias("query"),
    ).unionByName(items.select(
        _text("phrase-", c("item_id")).alias("query_id"),
        F.concat(F.lit('"'), F.array_join(F.slice("w", 2, 3), " "), F.lit('"')).alias("query"),
    ))
    nations = table(spark, sf_dir, "nation").select(
        _text("name-", c("n_nationkey")).alias("query_id"), c("n_name").alias("query")
    )
    return both.unionByName(nations)


def segment_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search request per segment name."""
    segment = c("c_mktsegment")
    return table(spark, sf_dir, "customer").filter(segment.isNotNull()).select(segment).distinct().select(
        _text("segment-", segment).alias("query_id"), segment.alias("query"))


# Job log: 20 consecutive events form one job.
AS_OF = "2024-01-15 00:00:00"


def job_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job rows: the kind of event decides the state."""
    state = (
        F.when(c("event_type").isin("signup", "view"), F.lit("queued"))
        .when(c("event_type") == "click", F.lit("processing"))
        .when(c("event_type") == "purchase", F.lit("succeeded"))
        .otherwise(F.lit("failed"))
    )
    ev = table(spark, sf_dir, "events").withColumn("ts", c("ts").cast("timestamp"))
    rows = ev.select("event_id", "user_id", "ts", "value", state.alias("state"))
    later = lambda minutes: F.timestamp_add("MINUTE", minutes.cast("bigint"), c("ts"))
    k = c("event_id")
    return rows.select(
        k.alias("id"), F.when(k % 2 == 0, F.lit("feed_sync")).otherwise(F.lit("bundle_sync")).alias("job_kind"),
        c("user_id").cast("string").alias("source_id"), "state",
        _text("corr-", k).alias("correlation_id"), _text("key-", k % 97).alias("idempotency_key"),
        (k % 6).cast("int").alias("attempts"), ((k % 4) + 2).cast("int").alias("max_attempts"),
        F.when(c("state") == "queued", later(k % 600)).alias("next_attempt_at"),
        F.when(c("state") != "queued", c("ts")).alias("started_at"),
        F.when(c("state").isin("succeeded", "failed") & (k % 11 != 0), later(k % 50)).alias("finished_at"),
        F.when(c("state") == "processing", later(k % 900)).alias("lease_expires_at"),
        F.when((c("state") == "processing") & (k % 13 != 0), _text("lease-", k)).alias("lease_token"),
        F.when(c("state") == "failed", F.lit("upstream timed out")).alias("failure_reason"),
        c("ts").alias("created_at"),
    )


# --- the same mapping in SQL ----------------------------------------------------------------

_PUB = "CASE WHEN {} THEN 'published' ELSE 'internal' END"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "g_sources": ((), f"""
        SELECT 'nation:' || n_name AS id, n_name AS name, 'registry' AS kind,
               'https://' || lower(n_name) || '.example.org' AS base_url,
               {_PUB.format('n_regionkey <> 2')} AS publication_state FROM nation
        UNION ALL
        SELECT DISTINCT 'prio:' || o_orderpriority, o_orderpriority, 'queue', NULL,
               {_PUB.format("o_orderpriority <> '4-NOT SPECIFIED'")} FROM orders"""),
    "g_actors": ((), f"""
        SELECT 'cust-' || c_custkey AS id, c_name AS canonical_name, lower(c_name) AS normalized_name,
               c_mktsegment AS description, {_PUB.format('c_acctbal >= 0')} AS publication_state,
               TIMESTAMP '2020-01-01' + to_days((c_custkey % 365)::INT) AS created_at,
               TIMESTAMP '2021-01-01' + to_days((c_custkey % 365)::INT) AS updated_at FROM customer"""),
    "g_aliases": ((), f"""
        SELECT 'al-' || c_custkey || '-' || k AS id,
               CASE WHEN k = 0 THEN 'nation:NATION_' || c_nationkey
                    WHEN c_custkey % 3 = 0 THEN 'prio:4-NOT SPECIFIED' ELSE 'prio:1-URGENT' END AS source_id,
               'cust-' || c_custkey AS actor_id,
               CASE WHEN k = 0 THEN 'Alias ' || c_name ELSE c_mktsegment || ' ' || c_custkey END AS name,
               CASE WHEN k = 0 THEN 'alias ' || lower(c_name) ELSE lower(c_mktsegment) || ' ' || c_custkey END AS normalized_name,
               'native-' || c_custkey AS source_native_id, (c_custkey % 101)::INT AS confidence,
               {_PUB.format('c_custkey % 5 <> 0')} AS publication_state
        FROM customer, (VALUES (0), (1)) v(k)"""),
    "g_obs": ((), f"""
        SELECT 'ord-' || o_orderkey AS id, 'prio:' || o_orderpriority AS source_id,
               o_orderkey::VARCHAR AS source_native_id, 'Order ' || o_orderkey AS title,
               'Status ' || o_orderstatus || ' priority ' || o_orderpriority AS summary,
               o_orderdate AS observed_at, o_orderdate AS first_seen,
               CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 101)::INT END AS confidence,
               CASE WHEN o_orderstatus = 'F' THEN 'assessed' ELSE 'observed' END AS intelligence_type,
               {_PUB.format("o_orderstatus <> 'P'")} AS publication_state,
               TIMESTAMP '2022-01-01' + to_days((o_orderkey % 365)::INT) AS created_at,
               TIMESTAMP '2023-01-01' + to_days((o_orderkey % 365)::INT) AS updated_at FROM orders"""),
    "g_actor_obs": ((), "SELECT 'cust-' || o_custkey AS actor_id, 'ord-' || o_orderkey AS observation_id FROM orders"),
    "g_evidence": ((), f"""
        SELECT 'li-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT AS id,
               'nation:NATION_' || s_nationkey AS source_id,
               'Shipment ' || l_orderkey || '/' || l_linenumber AS citation,
               l_returnflag || ' ' || l_linestatus AS excerpt,
               'https://evidence.example.org/' || l_orderkey || '/' || l_linenumber AS locator,
               {_PUB.format("l_returnflag <> 'R'")} AS publication_state
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""),
    "g_obs_evidence": ((), """
        SELECT 'ord-' || l_orderkey AS observation_id,
               'li-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT AS evidence_id FROM lineitem"""),
    "g_techniques": ((), f"""
        SELECT 'part-' || p_partkey AS id, 'nation:NATION_' || (p_partkey % 25) AS source_id,
               p_brand || '-' || p_partkey AS external_id, p_name AS name, p_type AS description,
               {_PUB.format("p_type <> 'PROMO'")} AS publication_state FROM part"""),
    "g_obs_techniques": ((), "SELECT DISTINCT 'ord-' || l_orderkey AS observation_id, 'part-' || l_partkey AS technique_id FROM lineitem"),
    "g_behaviors": ((), f"""
        SELECT DISTINCT 'beh:' || o_orderpriority AS id, o_orderpriority AS name,
               lower(o_orderpriority) AS normalized_name,
               {_PUB.format("o_orderpriority <> '5-LOW'")} AS publication_state FROM orders"""),
    "g_obs_behaviors": ((), "SELECT 'ord-' || o_orderkey AS observation_id, 'beh:' || o_orderpriority AS behavior_id FROM orders"),
    "g_campaigns": ((), f"""
        SELECT 'camp-' || user_id || '-' || event_type AS id, 'nation:NATION_' || (user_id % 25) AS source_id,
               'Campaign ' || event_type || ' ' || user_id AS name,
               'campaign ' || event_type || ' ' || user_id AS normalized_name,
               user_id::VARCHAR AS source_native_id, event_type AS description,
               CASE WHEN user_id % 4 <> 0 THEN min(ts) END AS first_seen,
               CASE WHEN user_id % 6 <> 0 THEN max(ts) END AS last_seen,
               {_PUB.format("event_type <> 'error'")} AS publication_state
        FROM events GROUP BY user_id, event_type"""),
    "g_relationships": ((), """
        SELECT 'rel-' || user_id || '-' || event_type AS id, 'cust-' || user_id AS actor_id,
               CASE event_type WHEN 'purchase' THEN 'attributed-to' WHEN 'signup' THEN ' Attributed-To ' ELSE 'related-to' END AS relationship_type,
               'camp-' || user_id || '-' || event_type AS campaign_id,
               'nation:NATION_' || (user_id % 25) AS source_id, min(ts) AS first_seen, max(ts) AS last_seen
        FROM events GROUP BY user_id, event_type"""),
    "pub_sources": (("g_sources",), "SELECT id, name FROM g_sources WHERE publication_state = 'published'"),
    "pub_actors": (("g_actors",), "SELECT * FROM g_actors WHERE publication_state = 'published'"),
    "pub_obs": (("g_obs", "pub_sources"), """
        SELECT * FROM g_obs WHERE publication_state = 'published' AND source_id IN (SELECT id FROM pub_sources)"""),
    "pub_aliases": (("g_aliases", "pub_sources", "pub_actors"), """
        SELECT * FROM g_aliases WHERE publication_state = 'published'
          AND source_id IN (SELECT id FROM pub_sources) AND actor_id IN (SELECT id FROM pub_actors)"""),
    "pub_evidence": (("g_evidence", "pub_sources"), """
        SELECT * FROM g_evidence WHERE publication_state = 'published' AND source_id IN (SELECT id FROM pub_sources)"""),
    "pub_techniques": (("g_techniques", "pub_sources"), """
        SELECT * FROM g_techniques WHERE publication_state = 'published' AND source_id IN (SELECT id FROM pub_sources)"""),
    "pub_behaviors": (("g_behaviors",), "SELECT * FROM g_behaviors WHERE publication_state = 'published'"),
    "pub_campaigns": (("g_campaigns", "pub_sources"), """
        SELECT * FROM g_campaigns WHERE publication_state = 'published' AND source_id IN (SELECT id FROM pub_sources)"""),
    "pub_pairs": (("g_actor_obs", "pub_actors", "pub_obs"), """
        SELECT * FROM g_actor_obs WHERE actor_id IN (SELECT id FROM pub_actors)
          AND observation_id IN (SELECT id FROM pub_obs)"""),
    "docs": ((), f"""
        SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
               {_PUB.format('l.quality = 1 AND l.toxic = 0')} AS publication_state
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
    "doc_sources": (("docs",), f"""
        SELECT source AS id, source AS name, {_PUB.format("bool_or(publication_state = 'published')")} AS publication_state
        FROM docs GROUP BY source"""),
    "bench_queries": ((), r"""
        SELECT 'and-' || item_id AS query_id, w[1] || ' ' || w[2] AS query, [w[1], w[2]] AS words, FALSE AS phrase
        FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark)
        UNION ALL
        SELECT 'phrase-' || item_id, '"' || array_to_string(w[2:4], ' ') || '"', w[2:4], TRUE
        FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark)
        UNION ALL
        SELECT 'name-' || n_nationkey, n_name, list_filter(regexp_split_to_array(lower(n_name), '[^\p{L}\p{N}]+'), lambda x: x <> ''), TRUE FROM nation"""),
    "jobs": ((), """
        SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'feed_sync' ELSE 'bundle_sync' END AS job_kind,
               user_id::VARCHAR AS source_id, state, 'corr-' || event_id AS correlation_id,
               'key-' || (event_id % 97) AS idempotency_key,
               (event_id % 6)::INT AS attempts, ((event_id % 4) + 2)::INT AS max_attempts,
               CASE WHEN state = 'queued' THEN ts + to_minutes((event_id % 600)::INT) END AS next_attempt_at,
               CASE WHEN state <> 'queued' THEN ts END AS started_at,
               CASE WHEN state IN ('succeeded', 'failed') AND event_id % 11 <> 0 THEN ts + to_minutes((event_id % 50)::INT) END AS finished_at,
               CASE WHEN state = 'processing' THEN ts + to_minutes((event_id % 900)::INT) END AS lease_expires_at,
               CASE WHEN state = 'processing' AND event_id % 13 <> 0 THEN 'lease-' || event_id END AS lease_token,
               CASE WHEN state = 'failed' THEN 'upstream timed out' END AS failure_reason,
               ts AS created_at
        FROM (SELECT *, CASE WHEN event_type IN ('signup', 'view') THEN 'queued' WHEN event_type = 'click' THEN 'processing'
                             WHEN event_type = 'purchase' THEN 'succeeded' ELSE 'failed' END AS state FROM events)"""),
}


def sql(body: str, *needs: str) -> str:
    """Oracle text: the named mapping CTEs (with what they build on) in front of ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        for parent in CTES[name][0]:
            add(parent)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    parts = [f"{name} AS ({CTES[name][1]})" for name in order]
    if not parts:
        return body
    stripped = body.lstrip()
    if stripped[:4].upper() == "WITH" and stripped[4].isspace():
        return "WITH " + ",\n".join(parts) + ",\n" + stripped[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
