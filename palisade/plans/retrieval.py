"""Vector retrieval and grounding on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions.text import classify_intent
from palisade.functions.vectors import vector_problem
from palisade.operators import evaluate, retrieval as V
from palisade.plans import adapters as A
from palisade.plans.registry import query
from palisade.schemas import Graph
from palisade.session import materialize

c = F.col


def candidate_rows(spark, sf_dir):
    """Embeddings as evidence: the label is the actor, the vector id the evidence."""
    return A.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("actor-"), c("label").cast("string")).alias("actor_id"), F.lit("m1").alias("embedding_model"),
        F.size("embedding").alias("dimensions"), "embedding",
        F.timestamp_add("DAY", c("vec_id") % 90, F.lit("2024-01-01").cast("timestamp")).alias("observed_at"),
        F.concat(F.lit("ev-"), c("vec_id").cast("string")).alias("evidence_id"), F.lit("Vector store").alias("source_name"),
        F.concat(F.lit("Vector "), c("vec_id").cast("string")).alias("citation"),
        F.repeat(F.concat(F.lit("text "), c("vec_id").cast("string"), F.lit(" ")), (c("vec_id") % 40 + 1).cast("int")).alias("excerpt"),
        F.when(c("vec_id") % 3 == 0, F.lit("assessed")).otherwise(F.lit("observed")).alias("intelligence_type"))


def question_rows(spark, sf_dir):
    """One question per actor: the vector of its lowest id; every other actor's has a start date."""
    emb = A.table(spark, sf_dir, "embeddings")
    return emb.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(
        F.concat(F.lit("q-"), c("label").cast("string")).alias("question_id"), F.concat(F.lit("actor-"), c("label").cast("string")).alias("actor_id"),
        F.lit("m1").alias("embedding_model"), F.size("vector").alias("dimensions"), "vector",
        F.when(c("label") % 2 == 1, F.lit("2024-01-15").cast("timestamp")).alias("date_from"), F.lit(None).cast("timestamp").alias("date_to"))


_NEAR = """cand AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, TIMESTAMP '2024-01-01' + to_days((vec_id % 90)::INT) AS observed_at,
  repeat('text ' || vec_id || ' ', (vec_id % 40 + 1)::INT) AS excerpt, CASE WHEN vec_id % 3 = 0 THEN 'assessed' ELSE 'observed' END AS itype FROM embeddings),
qs AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS qv FROM embeddings GROUP BY label),
near AS (SELECT * FROM (SELECT c.*, 'q-' || c.label AS question_id, 'ev-' || c.vec_id AS evidence_id, list_cosine_distance(c.v, q.qv) AS distance,
    row_number() OVER (PARTITION BY c.label ORDER BY list_cosine_distance(c.v, q.qv), observed_at DESC, 'ev-' || c.vec_id) AS position
  FROM cand c JOIN qs q USING (label) WHERE (c.label % 2 <> 1 OR observed_at >= TIMESTAMP '2024-01-15') AND list_cosine_distance(c.v, q.qv) <= 0.95) WHERE position <= 12),
tok AS (SELECT *, greatest(1, ceil(length(evidence_id || ' Vector store Vector ' || vec_id || ' ' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S') || '+00:00 ' || itype) / 4))::INT AS fixed_tokens,
  greatest(1, ceil(length(excerpt) / 4))::INT AS et FROM near),
spent AS (SELECT *, 300 - coalesce(sum(fixed_tokens + et) OVER (PARTITION BY question_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM tok),
kept AS (SELECT *, least(et, left_ - fixed_tokens)::INT AS excerpt_tokens FROM (SELECT *, bool_and(left_ > fixed_tokens) OVER (PARTITION BY question_id ORDER BY position) AS k FROM spent) WHERE k)"""


@query("vector_topk", f"WITH {_NEAR} SELECT question_id, evidence_id, round(distance, 6) + 0.0 AS distance, position FROM near")
def vector_topk(spark, sf_dir):
    rows = V.nearest(question_rows(spark, sf_dir), candidate_rows(spark, sf_dir), max_distance=0.95)
    return rows.select("question_id", "evidence_id", (F.round("distance", 6) + 0.0).alias("distance"), "position")


@query("graph_retrieval", """WITH vec AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
linked AS (SELECT ao.actor_id, o.observed_at, e.id AS evidence_id, s.name AS source_name, o.intelligence_type, vec.v FROM g_actor_obs ao
  JOIN g_obs o ON o.id = ao.observation_id JOIN g_obs_evidence oe ON oe.observation_id = o.id
  JOIN (SELECT DISTINCT 'li-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT AS id, l_partkey FROM lineitem) k ON k.id = oe.evidence_id
  JOIN vec ON vec.vec_id = k.l_partkey JOIN g_evidence e ON e.id = oe.evidence_id JOIN g_sources s ON s.id = e.source_id),
asked AS (SELECT 'q-' || c_custkey AS question_id, 'cust-' || c_custkey AS actor_id, v AS qv, CASE WHEN c_custkey % 2 = 1 THEN TIMESTAMP '1995-01-01' END AS date_from
  FROM customer JOIN vec ON vec_id = c_custkey),
scored AS (SELECT *, list_cosine_distance(v, qv) AS distance FROM linked JOIN asked USING (actor_id) WHERE date_from IS NULL OR observed_at >= date_from)
SELECT question_id, evidence_id, source_name, intelligence_type, round(distance, 6) + 0.0 AS distance, position FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, observed_at DESC, evidence_id) AS position FROM scored WHERE distance <= 0.95) WHERE position <= 12
""", ("g_actor_obs", "g_obs", "g_obs_evidence", "g_evidence", "g_sources"))
def graph_retrieval(spark, sf_dir):
    """A question about every customer with a vector, answered from the evidence behind its orders."""
    graph = A.order_graph(spark, sf_dir)
    vectors = A.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    key = c("c_custkey")
    asked = A.table(spark, sf_dir, "customer").select("c_custkey").join(vectors, key == c("vec_id")).select(
        F.concat(F.lit("q-"), key.cast("string")).alias("question_id"), F.concat(F.lit("cust-"), key.cast("string")).alias("actor_id"),
        F.lit("m1").alias("embedding_model"), F.size("embedding").alias("dimensions"), c("embedding").alias("vector"),
        F.when(key % 2 == 1, F.lit("1995-01-01").cast("timestamp")).alias("date_from"), F.lit(None).cast("timestamp").alias("date_to"))
    # only actors that are asked about reach the chain of joins: their links are stored, so that tables meet them by their true size
    seen = graph.actor_observations.join(asked.select("actor_id"), "actor_id", "left_semi").select("observation_id")
    reached = materialize(graph.observation_evidence.join(seen, "observation_id", "left_semi"), "asked-evidence")
    evidence = graph.evidence.join(reached.select(c("evidence_id").alias("id")), "id", "left_semi")
    # the part of an item decides the vector of its evidence
    part = F.split_part("id", F.lit("-"), F.lit(4)).cast("bigint")
    embedded = evidence.select(c("id").alias("evidence_id"), part.alias("vec_id")).distinct().join(vectors, "vec_id").select(
        "evidence_id", F.lit("m1").alias("embedding_model"), F.size("embedding").alias("dimensions"), "embedding")
    linked = Graph(spark, {**graph.tables, "evidence": evidence, "observation_evidence": reached, "evidence_embeddings": embedded})
    rows = V.nearest(asked, V.candidates(linked, asked.select("actor_id")), max_distance=0.95)
    return rows.select("question_id", "evidence_id", "source_name", "intelligence_type", (F.round("distance", 6) + 0.0).alias("distance"), "position")


def _allocated(spark, sf_dir):
    near = V.nearest(question_rows(spark, sf_dir), candidate_rows(spark, sf_dir), max_distance=0.95)
    return near, V.allocate_context(near, budget=300)


@query("context_budget", f"WITH {_NEAR} SELECT question_id, evidence_id, fixed_tokens, excerpt_tokens, sha256(left(excerpt, excerpt_tokens * 4)) AS excerpt_sha256 FROM kept")
def context_budget(spark, sf_dir):
    _, kept = _allocated(spark, sf_dir)
    return kept.select("question_id", "evidence_id", "fixed_tokens", "excerpt_tokens", F.sha2("excerpt", 256).alias("excerpt_sha256"))


@query("stale_embeddings", """
SELECT doc_id AS evidence_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN quality = 1 THEN 'fresh' ELSE 'stale' END AS state,
  sha256('Citation: ' || source || chr(10) || 'Excerpt: ' || trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS content_sha256
FROM documents LEFT JOIN labels l USING (doc_id)
""")
def stale_embeddings(spark, sf_dir):
    docs, labels = A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "labels")
    evidence = docs.select(c("doc_id").alias("id"), c("source").alias("citation"), c("text").alias("excerpt"))
    held = evidence.join(labels.select(c("doc_id").alias("id"), "quality"), "id").select(
        c("id").alias("evidence_id"), F.lit("m1").alias("embedding_model"),
        F.when(c("quality") == 1, F.sha2(V.unit_text(c("citation"), c("excerpt")), 256)).otherwise(F.lit("old")).alias("content_sha256"))
    return V.embedding_work(evidence, held, "m1")


@query("vector_checks", """
SELECT vec_id, CASE WHEN label = 0 THEN 'missing_vector' WHEN label = 1 THEN 'unexpected_dimension' WHEN label = 2 THEN 'non_finite_value' END AS problem FROM embeddings
""")
def vector_checks(spark, sf_dir):
    v = c("embedding")
    nan = F.lit(float("nan")).cast("float")
    broken = F.when(c("label") == 0, F.slice(v, 1, 0)).when(c("label") == 1, F.slice(v, 1, 63)).when(
        c("label") == 2, F.concat(F.slice(v, 1, 63), F.array(nan))).otherwise(v)
    return A.table(spark, sf_dir, "embeddings").select("vec_id", vector_problem(broken, F.lit(64)).alias("problem"))


def _claims(spark, sf_dir):
    """Two claims per question: the first cites its own vectors, the second sometimes a foreign one."""
    emb = A.table(spark, sf_dir, "embeddings")
    per = emb.groupBy("label").agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("b"))
    ev = lambda x: F.concat(F.lit("ev-"), x.cast("string"))
    kind = lambda x: F.when(x % 3 == 0, F.lit("assessed")).otherwise(F.lit("observed"))
    q = F.concat(F.lit("q-"), c("label").cast("string"))
    first = per.select(q.alias("question_id"), F.lit(1).alias("claim_no"), kind(c("a")).alias("claim_type"), F.array(ev(c("a"))).alias("evidence_ids"))
    second = per.select(q.alias("question_id"), F.lit(2).alias("claim_no"), kind(c("a") + c("label") % 2).alias("claim_type"),
                        F.when(c("label") % 3 == 0, F.array(ev(c("a")), ev(c("b")))).otherwise(F.array(ev(c("a")))).alias("evidence_ids"))
    return first.unionByName(second)


_CLAIMS = """, per AS (SELECT label, min(vec_id) AS a, max(vec_id) AS b FROM embeddings GROUP BY label),
claims AS (SELECT 'q-' || label AS question_id, 1 AS claim_no, CASE WHEN a % 3 = 0 THEN 'assessed' ELSE 'observed' END AS claim_type, ['ev-' || a] AS ids FROM per
  UNION ALL SELECT 'q-' || label, 2, CASE WHEN (a + label % 2) % 3 = 0 THEN 'assessed' ELSE 'observed' END, CASE WHEN label % 3 = 0 THEN ['ev-' || a, 'ev-' || b] ELSE ['ev-' || a] END FROM per),
cited AS (SELECT question_id, claim_no, claim_type, unnest(ids) AS evidence_id FROM claims),
verdict AS (SELECT c.question_id, c.claim_no, bool_and(k.evidence_id IS NOT NULL) AS all_retrieved, coalesce(bool_or(k.itype = c.claim_type), FALSE) AS type_supported
  FROM cited c LEFT JOIN kept k ON k.question_id = c.question_id AND k.evidence_id = c.evidence_id GROUP BY ALL)"""


@query("grounding_check", f"WITH {_NEAR}{_CLAIMS} SELECT question_id, claim_no, all_retrieved, type_supported, all_retrieved AND type_supported AS grounded FROM verdict")
def grounding_check(spark, sf_dir):
    _, kept = _allocated(spark, sf_dir)
    return V.grounding(_claims(spark, sf_dir), kept)


@query("citations", f"WITH {_NEAR}{_CLAIMS} SELECT question_id, evidence_id, position FROM kept WHERE (question_id, evidence_id) IN (SELECT question_id, evidence_id FROM cited)")
def citations(spark, sf_dir):
    _, kept = _allocated(spark, sf_dir)
    return V.citations(_claims(spark, sf_dir), kept).select("question_id", "evidence_id", "position")


@query("answer_status", f"""WITH {_NEAR}{_CLAIMS},
q AS (SELECT DISTINCT label, 'q-' || label AS question_id FROM embeddings UNION ALL SELECT -1, 'q-none'),
n AS (SELECT question_id, count(*) AS n FROM near GROUP BY 1), u AS (SELECT question_id, sum(fixed_tokens + excerpt_tokens) AS u FROM kept GROUP BY 1),
g AS (SELECT question_id, bool_and(all_retrieved AND type_supported) AS ok FROM verdict GROUP BY 1),
s AS (SELECT q.question_id, q.label, n, u, CASE WHEN q.label = 4 THEN 'invalid_question' WHEN u IS NULL THEN 'no_matching_evidence' WHEN q.label = 5 THEN 'invalid_model_output' WHEN NOT ok THEN 'unsupported_model_output' END AS reason
  FROM q LEFT JOIN n USING (question_id) LEFT JOIN u USING (question_id) LEFT JOIN g USING (question_id))
SELECT question_id, CASE WHEN reason IS NULL THEN 'grounded' ELSE 'insufficient_evidence' END AS status, reason,
  CASE WHEN reason IN ('invalid_question', 'no_matching_evidence') THEN 0 ELSE n END::BIGINT AS retrieved_count,
  CASE WHEN reason IN ('invalid_question', 'no_matching_evidence') THEN 0 ELSE u END::BIGINT AS context_tokens_used, CASE WHEN reason IS NULL THEN 'answer ' || label END AS answer FROM s""")
def answer_status(spark, sf_dir):
    near, kept = _allocated(spark, sf_dir)
    labels = A.table(spark, sf_dir, "embeddings").select("label").distinct()
    q = F.concat(F.lit("q-"), c("label").cast("string"))
    asked = labels.select(q.alias("question_id"), F.when(c("label") == 4, F.lit("what \x01 changed")).otherwise(F.lit("What  changed?")).alias("question"))
    asked = asked.unionByName(spark.createDataFrame([("q-none", "Any evidence?")], "question_id string, question string"))
    drafts = labels.select(q.alias("question_id"), F.when(c("label") != 5, F.concat(F.lit("answer "), c("label").cast("string"))).alias("answer"))
    rows = V.answer_status(asked, near, kept, drafts, _claims(spark, sf_dir))
    return rows.select("question_id", "status", "reason", "retrieved_count", "context_tokens_used", "answer")


_FOLDED = "replace(lower(text), 'ß', 'ss')"


@query("intent", f"""
SELECT conv_id, turn, CASE WHEN contains({_FOLDED}, 'changed') OR contains({_FOLDED}, 'change') OR contains({_FOLDED}, 'evolution') OR contains({_FOLDED}, 'over time') THEN 'behavior_change'
  WHEN contains({_FOLDED}, 'evidence') OR contains({_FOLDED}, 'support') OR contains({_FOLDED}, 'source') OR contains({_FOLDED}, 'citation') THEN 'evidence_support' ELSE 'actor_overview' END AS intent
FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT doc_id, -1, source || ' ' || text FROM documents)
""")
def intent(spark, sf_dir):
    turns = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    docs = A.table(spark, sf_dir, "documents").select(
        c("doc_id").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"), F.concat_ws(" ", "source", "text").alias("text"))
    return turns.unionByName(docs).select("conv_id", "turn", classify_intent(c("text")).alias("intent"))


@query("retrieval_recall", f"""WITH {_NEAR}, own AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label UNION ALL SELECT label, max(vec_id) FROM embeddings GROUP BY label)
SELECT 'q-' || o.label AS question_id, count(*)::BIGINT AS expected, count(n.evidence_id)::BIGINT AS found, count(n.evidence_id) / count(*) AS recall
FROM own o LEFT JOIN near n ON n.question_id = 'q-' || o.label AND n.evidence_id = 'ev-' || o.vec_id AND n.position <= 5 GROUP BY 1""")
def retrieval_recall(spark, sf_dir):
    near = V.nearest(question_rows(spark, sf_dir), candidate_rows(spark, sf_dir), max_distance=0.95)
    ends = A.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array(F.min("vec_id"), F.max("vec_id")).alias("v"))
    wanted = ends.select(F.concat(F.lit("q-"), c("label").cast("string")).alias("question_id"), F.explode("v").alias("k")).select(
        "question_id", F.concat(F.lit("ev-"), c("k").cast("string")).alias("evidence_id"))
    return evaluate.recall_at(wanted, near, 5, "question_id", "evidence_id")
