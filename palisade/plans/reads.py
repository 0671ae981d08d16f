"""Read models, visibility, paging and interval filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions.times import overlaps
from palisade.operators import paging, reads
from palisade.operators.scale import top_n
from palisade.operators.visibility import published
from palisade.plans import adapters as A
from palisade.plans.registry import joined_ids, query, stamp


def _capped(child: str, link: str, key: str, order: str, cap: int) -> str:
    return f"""
      SELECT observation_id, string_agg(id, ',' ORDER BY r) FILTER (r <= {cap}) AS ids, max(r) > {cap} AS more
      FROM (SELECT p.observation_id, c.id, row_number() OVER (PARTITION BY p.observation_id ORDER BY c.{order}, c.id) AS r
            FROM (SELECT DISTINCT observation_id FROM page WHERE position <= 5) p
            JOIN {link} l ON l.observation_id = p.observation_id JOIN {child} c ON c.id = l.{key}) GROUP BY 1"""


@query("actor_timeline", f"""
WITH page AS (
  SELECT * FROM (
    SELECT pp.actor_id, pp.observation_id, o.observed_at, o.title, o.confidence, o.intelligence_type,
           row_number() OVER (PARTITION BY pp.actor_id ORDER BY o.observed_at DESC, pp.observation_id DESC) AS position,
           count(*) OVER (PARTITION BY pp.actor_id) > 5 AS has_more
    FROM pub_pairs pp JOIN pub_obs o ON o.id = pp.observation_id)),
ev AS ({_capped('pub_evidence', 'g_obs_evidence', 'evidence_id', 'citation', 3)}),
be AS ({_capped('pub_behaviors', 'g_obs_behaviors', 'behavior_id', 'name', 3)}),
te AS ({_capped('pub_techniques', 'g_obs_techniques', 'technique_id', 'external_id', 3)})
SELECT actor_id, observation_id, position, has_more, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at,
       title, confidence::VARCHAR AS confidence, intelligence_type, coalesce(ev.ids, '') AS evidence, coalesce(ev.more, FALSE) AS evidence_truncated,
       coalesce(be.ids, '') AS behaviors, coalesce(te.ids, '') AS techniques, coalesce(te.more, FALSE) AS techniques_truncated
FROM page LEFT JOIN ev USING (observation_id) LEFT JOIN be USING (observation_id) LEFT JOIN te USING (observation_id)
WHERE position <= 5
""", ("pub_pairs", "pub_obs", "pub_evidence", "g_obs_evidence", "pub_behaviors", "g_obs_behaviors",
      "pub_techniques", "g_obs_techniques"))
def actor_timeline(spark, sf_dir):
    rows = reads.timeline(A.order_graph(spark, sf_dir), page_size=5, nested_cap=3)
    return rows.select(
        "actor_id", "observation_id", "position", "has_more", stamp("observed_at").alias("observed_at"), "title",
        F.col("confidence").cast("string").alias("confidence"), "intelligence_type", joined_ids("evidence").alias("evidence"), "evidence_truncated",
        joined_ids("behaviors").alias("behaviors"), joined_ids("techniques").alias("techniques"),
        "techniques_truncated",
    )


@query("timeline_filtered", """
SELECT actor_id, observation_id, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at, position FROM (
  SELECT pp.actor_id, pp.observation_id, o.observed_at,
         row_number() OVER (PARTITION BY pp.actor_id ORDER BY o.observed_at DESC, pp.observation_id DESC) AS position
  FROM pub_pairs pp JOIN pub_obs o ON o.id = pp.observation_id
  WHERE o.observed_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' AND o.intelligence_type = 'assessed'
    AND (o.observed_at < TIMESTAMP '1999-06-01' OR (o.observed_at = TIMESTAMP '1999-06-01' AND pp.observation_id < 'ord-5')))
WHERE position <= 3
""", ("pub_pairs", "pub_obs"))
def timeline_filtered(spark, sf_dir):
    at = lambda text: F.lit(text).cast("timestamp")
    rows = reads.timeline(
        A.order_graph(spark, sf_dir), page_size=3, after=(at("1999-06-01"), "ord-5"),
        date_from=at("1996-01-01"), date_to=at("1999-12-31"), intelligence_type="assessed",
    )
    return rows.select("actor_id", "observation_id", stamp("observed_at").alias("observed_at"), "position")


@query("keyset_page", """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
WHERE o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_totalprice < 250000.0)
   OR (o_orderpriority = '2-HIGH' AND o_totalprice = 250000.0 AND o_orderkey > 100)
ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 51
""")
def keyset_page(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    order = (("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", True))
    return paging.page(orders, order, 50, after=("2-HIGH", 250000.0, 100))


@query("page_with_more", """
SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment DESC, c_custkey) AS position, TRUE AS has_more
FROM customer QUALIFY position <= 20
""")
def page_with_more(spark, sf_dir):
    rows = A.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return paging.page_with_more(rows, (("c_mktsegment", False), ("c_custkey", True)), 20)


@query("all_pages", """
SELECT o_custkey, o_orderkey, ((n - 1) // 4 + 1)::BIGINT AS page, ((n - 1) % 4 + 1)::BIGINT AS position FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
""")
def all_pages(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    rows = paging.paginate_all(orders, (("o_orderdate", False), ("o_orderkey", False)), 4, ["o_custkey"])
    return rows.drop("o_orderdate")


@query("table_pages", """
SELECT event_id, ((n - 1) // 100 + 1)::BIGINT AS page, ((n - 1) % 100 + 1)::BIGINT AS position FROM (
  SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS n FROM events)
""")
def table_pages(spark, sf_dir):
    events = A.table(spark, sf_dir, "events").select("event_id", "value")
    return paging.paginate_all(events, (("value", False), ("event_id", True)), 100).drop("value")


@query("published_documents", """
SELECT doc_id, source, lang, n_chars FROM docs WHERE publication_state = 'published'
  AND source IN (SELECT id FROM doc_sources WHERE publication_state = 'published')
""", ("docs", "doc_sources"))
def published_documents(spark, sf_dir):
    docs = A.labelled_documents(spark, sf_dir).drop("text")
    rows = published(docs.withColumn("source_id", F.col("source")), A.document_sources(docs))
    return rows.select("doc_id", "source", "lang", "n_chars")


@query("public_actor_reads", """
SELECT a.id, canonical_name, description FROM pub_actors a
WHERE a.id IN (SELECT 'cust-' || user_id FROM events)
""", ("pub_actors",))
def public_actor_reads(spark, sf_dir):
    keys = A.table(spark, sf_dir, "events").select(F.concat(F.lit("cust-"), F.col("user_id").cast("string")).alias("actor_id"))
    return reads.public_actors(A.order_graph(spark, sf_dir), keys)


@query("actor_aliases", """
SELECT actor_id, position, id, name, source_native_id, confidence, source_id, more AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY normalized_name, id) AS position,
         count(*) OVER (PARTITION BY actor_id) > 1 AS more FROM pub_aliases) WHERE position <= 1
""", ("pub_aliases",))
def actor_aliases(spark, sf_dir):
    return reads.aliases(A.order_graph(spark, sf_dir), limit=1)


@query("associations", """
WITH b AS (SELECT DISTINCT p.actor_id, 'behavior' AS kind, b.id, b.name, b.normalized_name AS sort_key
           FROM pub_pairs p JOIN g_obs_behaviors l USING (observation_id) JOIN pub_behaviors b ON b.id = l.behavior_id),
t AS (SELECT DISTINCT p.actor_id, 'technique' AS kind, t.id, t.name, t.external_id AS sort_key
      FROM pub_pairs p JOIN g_obs_techniques l USING (observation_id) JOIN pub_techniques t ON t.id = l.technique_id)
SELECT actor_id, kind, position, id, name, sort_key, n > 10 AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY actor_id, kind ORDER BY sort_key, id) AS position,
         count(*) OVER (PARTITION BY actor_id, kind) AS n FROM (SELECT * FROM b UNION ALL SELECT * FROM t))
WHERE position <= 10
""", ("pub_pairs", "g_obs_behaviors", "pub_behaviors", "g_obs_techniques", "pub_techniques"))
def associations(spark, sf_dir):
    return reads.associations(A.order_graph(spark, sf_dir), limit=10)


@query("references_union", """
WITH shown AS (SELECT DISTINCT p.actor_id, e.id, e.citation, e.source_id
               FROM pub_pairs p JOIN g_obs_evidence l USING (observation_id) JOIN pub_evidence e ON e.id = l.evidence_id),
ids AS (SELECT p.actor_id, o.source_id FROM pub_pairs p JOIN g_obs o ON o.id = p.observation_id
        UNION SELECT actor_id, source_id FROM shown),
rows_ AS (SELECT actor_id, 'source' AS kind, s.id, s.name AS label, 8 AS cap FROM ids JOIN pub_sources s ON s.id = ids.source_id
          UNION ALL SELECT actor_id, 'evidence', id, citation, 15 FROM shown)
SELECT actor_id, kind, position, id, label, n > cap AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY actor_id, kind ORDER BY label, id) AS position,
         count(*) OVER (PARTITION BY actor_id, kind) AS n FROM rows_) WHERE position <= cap
""", ("pub_pairs", "g_obs", "g_obs_evidence", "pub_evidence", "pub_sources"))
def references_union(spark, sf_dir):
    return reads.references(A.order_graph(spark, sf_dir), source_limit=8, evidence_limit=15)


@query("actor_search", """
WITH q AS (SELECT 'n' || n_nationkey AS query_id, lower(regexp_replace(n_name, 'NATION_', '#00000')) AS needle FROM nation
           UNION ALL SELECT 's' || r_regionkey, 'furniture ' || r_regionkey FROM region
           UNION ALL SELECT 'c' || c_custkey, lower(c_name) FROM customer),
c AS (SELECT q.query_id, a.id AS actor_id, CASE WHEN a.normalized_name = q.needle THEN 0 ELSE 2 END AS r
      FROM q JOIN pub_actors a ON contains(a.normalized_name, q.needle)),
al AS (SELECT q.query_id, b.actor_id, b.id, b.name, b.normalized_name, CASE WHEN b.normalized_name = q.needle THEN 1 ELSE 3 END AS r
       FROM q JOIN pub_aliases b ON contains(b.normalized_name, q.needle)),
best AS (SELECT query_id, actor_id, min(r) AS match_rank FROM (SELECT query_id, actor_id, r FROM c UNION ALL SELECT query_id, actor_id, r FROM al) GROUP BY ALL),
top AS (SELECT * FROM (SELECT b.*, a.canonical_name, a.normalized_name, a.description,
          row_number() OVER (PARTITION BY query_id ORDER BY match_rank, a.normalized_name, actor_id) AS position
        FROM best b JOIN pub_actors a ON a.id = b.actor_id) WHERE position <= 20),
names AS (SELECT query_id, actor_id, list(name ORDER BY normalized_name, id) AS ns FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, actor_id ORDER BY normalized_name, id) AS k FROM al) WHERE k <= 5 GROUP BY ALL)
SELECT t.query_id, t.position, t.actor_id, t.canonical_name, t.description, t.match_rank,
       array_to_string((CASE WHEN contains(t.normalized_name, q.needle) THEN [t.canonical_name] ELSE [] END || coalesce(ns, []))[1:5], '|') AS matched_names
FROM top t JOIN q USING (query_id) LEFT JOIN names n USING (query_id, actor_id)
""", ("pub_actors", "pub_aliases"))
def actor_search(spark, sf_dir):
    nations = A.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("query_id"),
        F.regexp_replace("n_name", "NATION_", "#00000").alias("query"),
    )
    regions = A.table(spark, sf_dir, "region").select(
        F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("query_id"),
        F.concat(F.lit("Furniture  "), F.col("r_regionkey").cast("string")).alias("query"),
    )
    customers = A.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("query_id"), F.col("c_name").alias("query"),
    )
    asked = nations.unionByName(regions).unionByName(customers)
    hits = reads.actor_search(A.order_graph(spark, sf_dir), asked)
    return hits.withColumn("matched_names", F.array_join("matched_names", "|"))


@query("interval_overlap", """
SELECT id, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen
FROM pub_campaigns WHERE (last_seen IS NULL OR last_seen >= TIMESTAMP '2024-01-10')
  AND (first_seen IS NULL OR first_seen <= TIMESTAMP '2024-01-02')
""", ("pub_campaigns",))
def interval_overlap(spark, sf_dir):
    graph = A.order_graph(spark, sf_dir)
    at = lambda text: F.lit(text).cast("timestamp")
    window = overlaps(F.col("first_seen"), F.col("last_seen"), at("2024-01-10"), at("2024-01-02"))
    return published(graph.campaigns, graph.sources).filter(window).select(
        "id", stamp("first_seen").alias("first_seen"), stamp("last_seen").alias("last_seen"))


@query("interval_join", """
SELECT c.id AS campaign_id, r.id AS relationship_id FROM g_campaigns c JOIN g_relationships r ON r.campaign_id = c.id
WHERE (c.last_seen IS NULL OR c.last_seen >= r.first_seen + INTERVAL 10 DAY) AND (c.first_seen IS NULL OR c.first_seen <= r.last_seen)
""", ("g_campaigns", "g_relationships"))
def interval_join(spark, sf_dir):
    """Table-to-table overlap: relationships against their own campaign, whose activity has to reach
    ten days past the relationship's start. The key is an equi join; the interval test is residual."""
    graph = A.order_graph(spark, sf_dir)
    camps = graph.campaigns.select(F.col("id").alias("campaign_id"), "first_seen", "last_seen")
    rels = graph.relationships.select(
        "campaign_id", F.col("id").alias("relationship_id"),
        F.timestamp_add("DAY", F.lit(10), F.col("first_seen")).alias("a"), F.col("last_seen").alias("b"))
    meets = (F.col("last_seen").isNull() | (F.col("last_seen") >= F.col("a"))) & (
        F.col("first_seen").isNull() | (F.col("first_seen") <= F.col("b")))
    return camps.join(rels, "campaign_id").filter(meets).select("campaign_id", "relationship_id")


@query("late_materialised_topk", """
SELECT doc_id, n_chars, lang, sha256(text) AS text_sha256 FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25
""")
def late_materialised_topk(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    order = (("n_chars", False), ("doc_id", True))
    top = paging.late_top_k(docs.select("doc_id", "n_chars"), docs.drop("n_chars", "source"), "doc_id", order, 25)
    return top.select("doc_id", "n_chars", "lang", F.sha2("text", 256).alias("text_sha256"))


@query("actors_in_source", """
SELECT id FROM pub_actors WHERE id IN (SELECT actor_id FROM pub_aliases WHERE source_id = 'nation:NATION_3')
   OR id IN (SELECT actor_id FROM g_actor_obs WHERE observation_id IN (SELECT id FROM pub_obs WHERE source_id = 'nation:NATION_3'))
""", ("pub_actors", "pub_aliases", "g_actor_obs", "pub_obs"))
def actors_in_source(spark, sf_dir):
    from palisade.operators.search import entity_rows

    return entity_rows(A.order_graph(spark, sf_dir), {"actor"}, source_id="nation:NATION_3").select("id")


@query("top_events_per_user", """
SELECT user_id, event_id, value, rank FROM (SELECT user_id, event_id, value,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5
""")
def top_events_per_user(spark, sf_dir):
    events = A.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return top_n(events, ["user_id"], (("value", False), ("event_id", True)), 5)
