"""Advisories, jobs and run summaries on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions.times import retry_delay_seconds
from palisade.operators import advisories as D, jobs as J, metrics as M
from palisade.plans import adapters as A
from palisade.plans.registry import query, stamp
from palisade.schemas import Graph

c = F.col


def _at(text):
    return F.lit(text).cast("timestamp")


def _adv(col):
    return F.concat(F.lit("adv-"), col.cast("string"))


def advisory_graph(spark, sf_dir) -> Graph:
    """Conversations as advisories: user turns are revisions, all turns are updates."""
    turns = A.table(spark, sf_dir, "conversations")
    day = F.timestamp_add("DAY", c("conv_id") % 30, _at("2024-03-01"))
    hour = F.timestamp_add("HOUR", c("turn"), day)
    live = c("conv_id") % 4 != 0
    first = turns.groupBy("conv_id").agg(F.min(F.when(c("role") == "user", c("turn"))).alias("first_user"))
    advisories = first.select(
        _adv(c("conv_id")).alias("id"), F.concat(F.lit("slug-"), c("conv_id").cast("string")).alias("slug"),
        F.when(live, F.lit("published")).otherwise(F.lit("draft")).alias("status"),
        F.when(live, c("first_user") + 1).cast("int").alias("published_revision"), F.when(live, day).alias("published_at"))
    revisions = turns.filter("role = 'user'").select(
        F.concat(F.lit("rev-"), c("conv_id").cast("string"), F.lit("-"), c("turn").cast("string")).alias("id"), _adv(c("conv_id")).alias("advisory_id"),
        (c("turn") + 1).cast("int").alias("version"), F.concat(F.lit("Revision "), c("turn").cast("string")).alias("title"), F.md5("text").alias("summary"),
        F.when(c("turn") < 4, hour).alias("published_at"))
    updates = turns.select(
        F.concat(F.lit("upd-"), c("conv_id").cast("string"), F.lit("-"), c("turn").cast("string")).alias("id"), _adv(c("conv_id")).alias("advisory_id"),
        (c("turn") + 1).cast("int").alias("sequence"), hour.alias("occurred_at"), F.concat(F.lit("Update "), "role").alias("title"), F.md5("text").alias("summary"),
        F.lit("observed").alias("intelligence_type"))
    sections = turns.filter("role = 'user'").select(
        F.concat(F.lit("rev-"), c("conv_id").cast("string"), F.lit("-"), c("turn").cast("string")).alias("revision_id"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("section_type")) for i, n in enumerate(("overview", "detection"))])).alias("s")).select(
        "revision_id", "s.section_type", "s.position", F.lit("observed").alias("intelligence_type"), F.lit("text").alias("content"))
    return Graph(spark, {"advisories": advisories, "advisory_revisions": revisions, "advisory_updates": updates, "advisory_sections": sections})


_ADV = """adv AS (SELECT conv_id, 'adv-' || conv_id AS id, 'slug-' || conv_id AS slug, conv_id % 4 <> 0 AS live, min(turn) FILTER (role = 'user') + 1 AS version,
  TIMESTAMP '2024-03-01' + to_days((conv_id % 30)::INT) AS published_at FROM conversations GROUP BY conv_id),
rev AS (SELECT conv_id, turn, turn + 1 AS version, 'Revision ' || turn AS title, md5(text) AS summary, turn < 4 AS pub FROM conversations WHERE role = 'user'),
upd AS (SELECT conv_id, 'adv-' || conv_id AS advisory_id, turn + 1 AS sequence, role, TIMESTAMP '2024-03-01' + to_days((conv_id % 30)::INT) + to_hours(turn::INT) AS occurred_at FROM conversations)"""


@query("advisory_list", f"""WITH {_ADV}
SELECT a.id AS advisory_id, slug, r.title, r.summary, a.version AS published_revision, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at,
  strftime((SELECT max(occurred_at) FROM upd u WHERE u.conv_id = a.conv_id), '%Y-%m-%d %H:%M:%S') AS latest_update_at
FROM (SELECT * FROM adv WHERE live ORDER BY published_at DESC, id LIMIT 40) a JOIN rev r ON r.conv_id = a.conv_id AND r.version = a.version
""")
def advisory_list(spark, sf_dir):
    rows = D.listing(advisory_graph(spark, sf_dir), 40)
    return rows.withColumns({"published_at": stamp("published_at"), "latest_update_at": stamp("latest_update_at")})


@query("advisory_detail", f"""WITH {_ADV},
u AS (SELECT conv_id, string_agg(sequence::VARCHAR, ',' ORDER BY sequence) AS updates, max(n) > 3 AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY sequence DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM upd) WHERE k <= 3 GROUP BY conv_id)
SELECT a.id AS advisory_id, r.version, r.title, 'overview,detection' AS sections, u.updates, u.more AS updates_truncated
FROM adv a JOIN rev r ON r.conv_id = a.conv_id AND r.version = a.version LEFT JOIN u ON u.conv_id = a.conv_id WHERE live AND r.pub
""")
def advisory_detail(spark, sf_dir):
    rows = D.detail(advisory_graph(spark, sf_dir), updates=3)
    names = F.array_join(F.transform("sections", lambda x: x.getField("section_type")), ",")
    numbers = F.array_join(F.transform("updates", lambda x: x.getField("sequence").cast("string")), ",")
    return rows.select("advisory_id", "version", "title", names.alias("sections"), numbers.alias("updates"), "updates_truncated")


@query("advisory_revisions", f"WITH {_ADV} SELECT a.id AS advisory_id, r.version, r.version = a.version AS current FROM adv a JOIN rev r USING (conv_id) WHERE live AND pub")
def advisory_revisions(spark, sf_dir):
    return D.revisions(advisory_graph(spark, sf_dir)).select("advisory_id", "version", "current")


def linked_graph(spark, sf_dir) -> Graph:
    """Advisories with links: documents are evidence, customers actors, runs of events campaigns, parts techniques."""
    base = advisory_graph(spark, sf_dir)
    turns = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    named = lambda prefix: F.concat(F.lit(prefix), c("conv_id").cast("string"), F.lit("-"), c("turn").cast("string"))
    docs = A.table(spark, sf_dir, "documents").select((c("doc_id") % 50).alias("conv_id"), "doc_id", F.concat(F.lit("doc-"), c("doc_id").cast("string")).alias("evidence_id"))
    user = turns.filter("role = 'user'").select("conv_id", "turn", named("rev-").alias("revision_id"))
    customers = A.table(spark, sf_dir, "customer").select((c("c_custkey") % 60).alias("conv_id"), F.concat(F.lit("cust-"), c("c_custkey").cast("string")).alias("actor_id"))
    runs = A.table(spark, sf_dir, "events").select((c("user_id") % 70).alias("conv_id"), F.concat(F.lit("camp-"), c("user_id").cast("string"), F.lit("-"), "event_type").alias("campaign_id"))
    parts = A.table(spark, sf_dir, "part").select((c("p_partkey") % 80).alias("conv_id"), F.concat(F.lit("part-"), c("p_partkey").cast("string")).alias("technique_id"))
    cited = turns.join(docs, "conv_id").filter((c("doc_id") + c("turn")) % 3 == 0).select(named("upd-").alias("update_id"), "evidence_id")
    return Graph(spark, {
        **base.tables,
        "revision_evidence": user.join(docs, "conv_id").filter((c("doc_id") + c("turn")) % 2 == 0).select("revision_id", "evidence_id"),
        "revision_actors": user.join(customers, "conv_id").select("revision_id", "actor_id"),
        "revision_campaigns": user.join(runs, "conv_id").select("revision_id", "campaign_id"),
        "revision_techniques": user.join(parts, "conv_id").select("revision_id", "technique_id"),
        "update_evidence": cited})


def _linked(kind, source, key, prefix, more="TRUE"):
    """SQL of the first 20 links of a kind, per user turn."""
    return f"""{kind}_ AS (SELECT conv_id, turn, string_agg(id, ',' ORDER BY id) AS ids, max(n) > 20 AS cut FROM (
  SELECT conv_id, turn, id, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM (
    SELECT DISTINCT r.conv_id, r.turn, {prefix} AS id FROM rev r JOIN {source} x ON {key} = r.conv_id AND {more})
  WINDOW w AS (PARTITION BY conv_id, turn ORDER BY id)) WHERE k <= 20 GROUP BY ALL)"""


_LINKS = ",\n".join((
    _linked("evidence", "documents", "x.doc_id % 50", "'doc-' || x.doc_id", "(x.doc_id + r.turn) % 2 = 0"),
    _linked("actors", "customer", "x.c_custkey % 60", "'cust-' || x.c_custkey"),
    _linked("campaigns", "events", "x.user_id % 70", "'camp-' || x.user_id || '-' || x.event_type"),
    _linked("techniques", "part", "x.p_partkey % 80", "'part-' || x.p_partkey")))
_LINK_COLUMNS = ", ".join(f"coalesce({k}_.ids, '') AS {k}" for k in D.REVISION_LINKS) + ", " + " OR ".join(
    f"coalesce({k}_.cut, FALSE)" for k in D.REVISION_LINKS) + " AS links_truncated"
_LINK_JOINS = " ".join(f"LEFT JOIN {k}_ ON {k}_.conv_id = r.conv_id AND {k}_.turn = r.turn" for k in D.REVISION_LINKS)


def _link_texts():
    return [F.array_join(kind, ",").alias(kind) for kind in D.REVISION_LINKS]


@query("advisory_history", f"""WITH {_ADV}, {_LINKS}
SELECT a.id AS advisory_id, r.version, r.version = a.version AS current, r.title, 'overview,detection' AS sections, {_LINK_COLUMNS}
FROM adv a JOIN rev r ON r.conv_id = a.conv_id {_LINK_JOINS} WHERE live AND pub
""")
def advisory_history(spark, sf_dir):
    """Every published revision of every published advisory, as it was, with its links."""
    rows = D.historic(linked_graph(spark, sf_dir), links=20)
    names = F.array_join(F.transform("sections", lambda x: x.getField("section_type")), ",")
    return rows.select("advisory_id", "version", "current", "title", names.alias("sections"), *_link_texts(), "links_truncated")


@query("advisory_linked_detail", f"""WITH {_ADV}, {_LINKS},
cited AS (SELECT conv_id, turn, string_agg(id, ',' ORDER BY id) AS ids FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY id) AS k FROM (
    SELECT c.conv_id, c.turn, 'doc-' || x.doc_id AS id FROM conversations c JOIN documents x ON x.doc_id % 50 = c.conv_id AND (x.doc_id + c.turn) % 3 = 0)) WHERE k <= 20 GROUP BY ALL),
u AS (SELECT v.conv_id, string_agg(sequence || ':' || coalesce(ids, ''), ';' ORDER BY sequence) AS updates FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY sequence DESC) AS k FROM upd) v
  LEFT JOIN cited ON cited.conv_id = v.conv_id AND cited.turn = v.sequence - 1 WHERE k <= 3 GROUP BY 1)
SELECT a.id AS advisory_id, r.version, u.updates, {_LINK_COLUMNS}
FROM adv a JOIN rev r ON r.conv_id = a.conv_id AND r.version = a.version LEFT JOIN u ON u.conv_id = a.conv_id {_LINK_JOINS} WHERE live AND pub
""")
def advisory_linked_detail(spark, sf_dir):
    """The current revision with its links and its newest updates with their evidence."""
    rows = D.linked_detail(linked_graph(spark, sf_dir), updates=3, links=20)
    one = F.transform("updates", lambda u: F.concat(u.getField("sequence").cast("string"), F.lit(":"), F.array_join(u.getField("evidence_ids"), ",")))
    return rows.select("advisory_id", "version", F.array_join(one, ";").alias("updates"), *_link_texts(), "links_truncated")


@query("recent_updates", f"""WITH {_ADV}
SELECT advisory_id, sequence, row_number() OVER (PARTITION BY advisory_id ORDER BY sequence) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY advisory_id ORDER BY sequence DESC) AS k FROM upd) WHERE k <= 3
""")
def recent_updates(spark, sf_dir):
    return D.recent_updates(advisory_graph(spark, sf_dir).advisory_updates, 3).select("advisory_id", "sequence", "position")


@query("update_feed", f"WITH {_ADV} SELECT id, sequence FROM (SELECT 'upd-' || upd.conv_id || '-' || (sequence - 1) AS id, sequence FROM upd JOIN adv ON adv.id = advisory_id WHERE advisory_id = 'adv-1' AND live AND sequence > 2 ORDER BY sequence LIMIT 10)")
def update_feed(spark, sf_dir):
    return D.update_feed(advisory_graph(spark, sf_dir), "adv-1", 2, 10).select("id", "sequence")


@query("next_sequence", """
WITH held AS (SELECT conv_id, max(turn + 1) AS m FROM conversations GROUP BY 1)
SELECT doc_id AS submission_id, source AS advisory_id, coalesce((SELECT max(p_size) FROM part WHERE 'src' || (p_partkey % 10) = source), 0)
  + row_number() OVER (PARTITION BY source ORDER BY doc_id) AS sequence FROM documents
""")
def next_sequence(spark, sf_dir):
    batch = A.table(spark, sf_dir, "documents").select(c("doc_id").alias("submission_id"), c("source").alias("advisory_id"))
    stored = A.table(spark, sf_dir, "part").select(
        F.concat(F.lit("src"), (c("p_partkey") % 10).cast("string")).alias("advisory_id"), c("p_size").alias("sequence"))
    return D.next_numbers(batch, stored, "advisory_id", "sequence", "submission_id")


@query("append_updates", f"""WITH {_ADV}, b AS (SELECT doc_id, 'adv-' || (doc_id % 200) AS advisory_id FROM documents),
j AS (SELECT b.*, CASE WHEN a.id IS NULL THEN 'advisory does not exist' WHEN NOT a.live OR a.version IS NULL THEN 'publish a revision before adding updates' END AS refused,
   (SELECT max(sequence) FROM upd u WHERE u.advisory_id = b.advisory_id) AS m FROM b LEFT JOIN adv a ON a.id = b.advisory_id)
SELECT doc_id AS submission_id, advisory_id, refused, CASE WHEN refused IS NULL THEN (m + row_number() OVER (PARTITION BY advisory_id, refused IS NULL ORDER BY doc_id))::VARCHAR END AS sequence FROM j
""")
def append_updates(spark, sf_dir):
    batch = A.table(spark, sf_dir, "documents").select(
        c("doc_id").alias("submission_id"), _adv(c("doc_id") % 200).alias("advisory_id"))
    return D.append_updates(batch, advisory_graph(spark, sf_dir)).select(
        "submission_id", "advisory_id", "refused", c("sequence").cast("string").alias("sequence"))


_EVENTS = "ev AS (SELECT 'adv-' || user_id AS advisory_id, (event_id % 5 + 1)::INT AS version, ts FROM events), real AS (SELECT * FROM ev WHERE version <= 4)"


def _publish(spark, sf_dir):
    ev = A.table(spark, sf_dir, "events")
    revisions = ev.select(_adv(c("user_id")).alias("advisory_id")).distinct().withColumn(
        "version", F.explode(F.sequence(F.lit(1), F.lit(4))))
    events = ev.select(_adv(c("user_id")).alias("advisory_id"), (c("event_id") % 5 + 1).cast("int").alias("version"), c("ts").cast("timestamp").alias("at"))
    return D.publish(revisions, events)


@query("publish_pointer", f"WITH {_EVENTS} SELECT advisory_id, arg_max(version, ts) AS published_revision, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS published_at FROM real GROUP BY 1")
def publish_pointer(spark, sf_dir):
    return _publish(spark, sf_dir)[1].withColumn("published_at", stamp("published_at"))


@query("publish_stamps", f"WITH {_EVENTS} SELECT advisory_id, version, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS published_at FROM real GROUP BY ALL")
def publish_stamps(spark, sf_dir):
    return _publish(spark, sf_dir)[0].withColumn("published_at", stamp("published_at"))


_NOW = f"TIMESTAMP '{A.AS_OF}'"


@query("queue_metrics", f"""
SELECT job_kind, q AS queued, d AS due, p AS processing, oldest AS oldest_queued_at, q + p AS active, 2500::BIGINT AS capacity, greatest(0, 2500 - q - p) AS available FROM (
  SELECT job_kind, count_if(state = 'queued')::BIGINT AS q, count_if(state = 'queued' AND next_attempt_at <= {_NOW})::BIGINT AS d, count_if(state = 'processing')::BIGINT AS p,
    strftime(min(created_at) FILTER (state = 'queued'), '%Y-%m-%d %H:%M:%S') AS oldest FROM jobs GROUP BY job_kind)
""", ("jobs",))
def queue_metrics(spark, sf_dir):
    rows = J.queue_metrics(A.job_table(spark, sf_dir), _at(A.AS_OF), 2500, ["job_kind"])
    return rows.withColumn("oldest_queued_at", stamp("oldest_queued_at"))


@query("due_jobs", f"SELECT id, strftime(next_attempt_at, '%Y-%m-%d %H:%M:%S') AS next_attempt_at FROM (SELECT * FROM jobs WHERE state = 'queued' AND next_attempt_at <= {_NOW} ORDER BY jobs.next_attempt_at, id LIMIT 100)", ("jobs",))
def due_jobs(spark, sf_dir):
    return J.due_jobs(A.job_table(spark, sf_dir), _at(A.AS_OF), 100).withColumn("next_attempt_at", stamp("next_attempt_at"))


@query("expired_leases", f"SELECT id, 'queued' AS state, 'Worker lease expired; job queued for replay.' AS failure_reason FROM (SELECT * FROM jobs WHERE state = 'processing' AND lease_expires_at <= {_NOW} ORDER BY lease_expires_at, id LIMIT 100)", ("jobs",))
def expired_leases(spark, sf_dir):
    return J.expired_leases(A.job_table(spark, sf_dir), _at(A.AS_OF), 100).drop("lease_expires_at")


@query("claim_outcomes", f"""
SELECT id, outcome, CASE WHEN outcome = 'claimed' THEN attempts + 1 ELSE attempts END AS attempt FROM (SELECT *, CASE WHEN state <> 'queued' THEN 'not_queued'
  WHEN next_attempt_at > {_NOW} THEN 'not_due' WHEN attempts >= max_attempts THEN 'exhausted' ELSE 'claimed' END AS outcome FROM jobs)
""", ("jobs",))
def claim_outcomes(spark, sf_dir):
    return J.claim_outcomes(A.job_table(spark, sf_dir), _at(A.AS_OF)).select("id", "outcome", "attempt")


@query("failure_outcomes", """
SELECT id, d AS disposition, CASE WHEN d = 'retry' THEN (least(45 * (2 ** greatest(attempts - 1, 0))::BIGINT, 3600) * 1000)::VARCHAR END AS delay_ms, CASE WHEN d <> 'stale' THEN 'boom ' || (id % 3) END AS failure_reason
FROM (SELECT *, CASE WHEN NOT coalesce(state = 'processing' AND lease_token = 'lease-' || id AND attempts = (id % 7)::INT, FALSE) THEN 'stale'
  WHEN id % 5 <> 0 AND attempts < max_attempts THEN 'retry' ELSE 'failed' END AS d FROM jobs)
""", ("jobs",))
def failure_outcomes(spark, sf_dir):
    jobs = A.job_table(spark, sf_dir)
    failures = jobs.select(
        "id", F.concat(F.lit("lease-"), c("id").cast("string")).alias("lease_token"), (c("id") % 7).cast("int").alias("attempt"),
        F.concat(F.lit("  boom   "), (c("id") % 3).cast("string")).alias("reason"), (c("id") % 5 != 0).alias("retryable"))
    return J.failure_outcomes(jobs, failures, 45).withColumn("delay_ms", c("delay_ms").cast("string"))


@query("retry_backoff", """
SELECT id, CASE WHEN attempts < max_attempts THEN least(30 * (2 ** greatest(attempts - 1, 0))::BIGINT, 3600)::VARCHAR END AS delay_seconds FROM jobs
""", ("jobs",))
def retry_backoff(spark, sf_dir):
    jobs = A.job_table(spark, sf_dir)
    return jobs.select("id", F.when(c("attempts") < c("max_attempts"), retry_delay_seconds(c("attempts"), 30)).cast("string").alias("delay_seconds"))


@query("latency_summary", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*)::BIGINT AS requests, round(avg(value), 6) AS mean_ms, max(value) AS max_ms, max(CASE WHEN i = ceil(0.5 * n) THEN value END) AS p50_ms,
  max(CASE WHEN i = ceil(0.95 * n) THEN value END) AS p95_ms, round(count(*) / (sum(value) / 1000), 4) AS throughput FROM r GROUP BY 1
""")
def latency_summary(spark, sf_dir):
    rows = M.latency_summary(A.table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value")
    return rows.select("event_type", "requests", F.round("mean_ms", 6).alias("mean_ms"), "max_ms", "p50_ms", "p95_ms", F.round("throughput", 4).alias("throughput"))


@query("stage_summary", """
SELECT event_type AS stage, count(*)::BIGINT AS calls, round(sum(value), 4) AS total_ms, round(avg(value), 6) AS mean_ms, round(count(*) * 1000 / sum(value), 4) AS per_second FROM events GROUP BY 1
""")
def stage_summary(spark, sf_dir):
    rows = M.stage_summary(A.table(spark, sf_dir, "events").select(c("event_type").alias("stage"), "value"), "stage", "value")
    return rows.select("stage", "calls", F.round("total_ms", 4).alias("total_ms"), F.round("mean_ms", 6).alias("mean_ms"), F.round("per_second", 4).alias("per_second"))
