"""Data quality and submission rules on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import quality as Q
from palisade.plans import adapters as A
from palisade.plans.registry import query

_ROWS = """
SELECT 'ingestion_jobs' AS "table", id::VARCHAR AS key, 'attempts_within_limit' AS rule FROM jobs WHERE attempts > max_attempts
UNION ALL SELECT 'ingestion_jobs', id::VARCHAR, 'state_shape' FROM jobs WHERE NOT (
     (state = 'queued' AND finished_at IS NULL AND lease_expires_at IS NULL AND lease_token IS NULL AND next_attempt_at IS NOT NULL)
  OR (state = 'processing' AND started_at IS NOT NULL AND finished_at IS NULL AND lease_expires_at IS NOT NULL AND lease_token IS NOT NULL AND next_attempt_at IS NULL)
  OR (state = 'succeeded' AND finished_at IS NOT NULL AND lease_expires_at IS NULL AND lease_token IS NULL AND next_attempt_at IS NULL AND failure_reason IS NULL)
  OR (state = 'failed' AND finished_at IS NOT NULL AND lease_expires_at IS NULL AND lease_token IS NULL AND next_attempt_at IS NULL AND trim(failure_reason) <> ''))
UNION ALL SELECT 'observations', o_orderkey::VARCHAR, 'confidence_range' FROM orders WHERE (o_totalprice / 4000.0)::INT > 100
UNION ALL SELECT 'campaigns', 'camp-' || user_id || '-' || event_type, 'time_range_order' FROM (
  SELECT user_id, event_type, arg_min(ts, value) AS f, arg_max(ts, value) AS l FROM events GROUP BY ALL) WHERE f > l
"""


@query("constraint_violations", _ROWS, ("jobs",))
def constraint_violations(spark, sf_dir):
    jobs = Q.check_constraints(A.job_table(spark, sf_dir), "id", Q.rules("ingestion_jobs"), "ingestion_jobs")
    orders = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("t").alias("title"), F.lit("s").alias("summary"),
        F.round(F.col("o_totalprice") / 4000.0).cast("int").alias("confidence"),
        F.lit(None).cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("last_seen"),
    )
    seen = Q.check_constraints(orders, "id", Q.rules("observations"), "observations")
    runs = A.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.min_by("ts", "value").alias("first_seen"), F.max_by("ts", "value").alias("last_seen")
    ).select(
        F.concat(F.lit("camp-"), F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("id"),
        F.lit("n").alias("name"), F.lit("n").alias("normalized_name"), F.lit(None).cast("int").alias("confidence"),
        "first_seen", "last_seen",
    )
    camps = Q.check_constraints(runs, "id", Q.rules("campaigns"), "campaigns")
    return jobs.unionByName(seen).unionByName(camps)


@query("unique_violations", """
SELECT 'documents' AS "table", source || '/' || sha256(text) AS key, count(*)::BIGINT AS row_count FROM documents GROUP BY source, text HAVING count(*) > 1
UNION ALL SELECT 'ingestion_jobs', job_kind || '/' || idempotency_key, count(*) FROM jobs GROUP BY job_kind, idempotency_key HAVING count(*) > 1
UNION ALL SELECT 'raw_evidence', finished_at::DATE::VARCHAR || '/' || failure_reason, count(*) FROM jobs
  WHERE finished_at IS NOT NULL AND failure_reason IS NOT NULL GROUP BY finished_at::DATE, failure_reason HAVING count(*) > 1
""", ("jobs",))
def unique_violations(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("content_sha256"))
    jobs = A.job_table(spark, sf_dir)
    dated = jobs.withColumn("day", F.to_date("finished_at"))
    plan = [
        (docs, ("source", "content_sha256"), "documents"),
        (jobs, ("job_kind", "idempotency_key"), "ingestion_jobs"),
        (dated, ("day", "failure_reason"), "raw_evidence"),
    ]
    out = None
    for rows, key, name in plan:
        part = Q.unique_violations(rows, key, name).select(
            "table", F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("key"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


@query("fk_orphans", """
SELECT 'events.user_id' AS reference, event_id::VARCHAR AS key FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
UNION ALL SELECT 'labels.doc_id', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')
UNION ALL SELECT 'documents.doc_id', doc_id::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
""")
def fk_orphans(spark, sf_dir):
    t = lambda name: A.table(spark, sf_dir, name)
    plan = [
        (t("events"), "user_id", t("customer").filter("c_acctbal >= 0"), "c_custkey", "event_id", "events.user_id"),
        (t("labels"), "doc_id", t("documents").filter("lang = 'en'"), "doc_id", "doc_id", "labels.doc_id"),
        (t("documents"), "doc_id", t("embeddings"), "vec_id", "doc_id", "documents.doc_id"),
    ]
    out = None
    for child, column, parent, parent_key, key, name in plan:
        part = Q.foreign_key_orphans(child, column, parent, parent_key).select(
            F.lit(name).alias("reference"), F.col(key).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


_STATE = """CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing'
            WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END"""


@query("state_transitions", f"""
SELECT user_id, event_id, state, previous_state FROM (
  SELECT user_id, event_id, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_state FROM events)
WHERE NOT coalesce((previous_state IS NULL AND state = 'pending') OR (previous_state, state) IN
  (('pending','processing'), ('processing','succeeded'), ('processing','failed'), ('processing','pending'), ('succeeded','pending'), ('failed','pending')), FALSE)
""")
def state_transitions(spark, sf_dir):
    state = (
        F.when(F.col("event_type").isin("signup", "click"), F.lit("pending"))
        .when(F.col("event_type") == "view", F.lit("processing"))
        .when(F.col("event_type") == "purchase", F.lit("succeeded")).otherwise(F.lit("failed"))
    )
    log = A.table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state"))
    return Q.illegal_transitions(log, ["user_id"], "event_id", "state")


@query("missing_refs", """
SELECT conv_id, position, i * (conv_id + 1) AS doc_id, (i * (conv_id + 1)) IN (SELECT doc_id FROM documents) AS found
FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (0, 3), (1, 11), (2, 17)) v(position, i)
""")
def missing_refs(spark, sf_dir):
    asked = A.table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn(
        "ids", F.array(*[F.col("conv_id") * k + k for k in (3, 11, 17)]))
    return Q.missing_references(asked, "ids", A.table(spark, sf_dir, "documents"), "doc_id")


@query("submission_rules", """
SELECT page_id AS id, CASE WHEN contains(url, '?') THEN 'mime_type' ELSE '' END
  || CASE WHEN contains(url, '#') THEN (CASE WHEN contains(url, '?') THEN ',' ELSE '' END) || 'publication_order' ELSE '' END AS rejected
FROM pages
UNION ALL SELECT doc_id, CASE WHEN strlen(text) > 5000 THEN 'content_size' ELSE '' END FROM documents
""")
def submission_rules(spark, sf_dir):
    at = lambda text: F.lit(text).cast("timestamp")
    pages = A.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.encode("html", "UTF-8").alias("content"), F.col("url").alias("source_locator"),
        F.when(F.contains("url", F.lit("?")), F.lit("text/html; charset=utf-8")).otherwise(F.lit(" Text/HTML ")).alias("mime_type"),
        F.when(F.contains("url", F.lit("#")), at("2024-02-01")).alias("published_at"),
    )
    docs = A.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"), F.col("source").alias("source_locator"),
        F.lit("text/plain").alias("mime_type"), F.lit(None).cast("timestamp").alias("published_at"),
    )
    nothing = F.lit(None).cast("string")

    def checked(rows, limit):
        ready = rows.withColumns({"fetched_at": at("2024-01-01"), "filename_hint": nothing, "source_native_id": nothing})
        return Q.split_valid(ready, Q.submission_rules("raw_evidence", limit)).select(
            "id", F.array_join("rejected_rules", ",").alias("rejected"))

    return checked(pages, 50 << 20).unionByName(checked(docs, 5000))


@query("revision_rules", """
SELECT conv_id, array_to_string(list_filter([
   CASE WHEN n <> d THEN 'sections_unique' END, CASE WHEN m <> e THEN 'evidence_unique' END], lambda x: x IS NOT NULL), ',') AS rejected
FROM (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS d, count(*) AS m, count(DISTINCT length(text) % 7) AS e FROM conversations GROUP BY conv_id)
""")
def revision_rules(spark, sf_dir):
    rows = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.min("role").alias("title"), F.max("role").alias("summary"),
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.getField("role")).alias("section_types"),
        F.collect_list((F.length("text") % 7).cast("string")).alias("evidence_ids"),
    )
    return Q.split_valid(rows, Q.submission_rules("revision")).select(
        "conv_id", F.array_join("rejected_rules", ",").alias("rejected"))
