"""Intake, registration and integrity on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import ids, text
from palisade.operators import artifacts, integrity
from palisade.operators import intake as I
from palisade.plans import adapters as A
from palisade.plans.registry import query
from palisade.session import scratch_dir
from palisade.sources.blobs import key_collisions as collisions, streamed_hashes, write_blobs


def _submissions(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("submission_id"), F.col("source").alias("source_id"),
        F.encode("text", "UTF-8").alias("content"),
        F.when(F.col("lang") == "en", F.lit("text/plain")).otherwise(F.lit("Application/JSON")).alias("mime_type"),
    )


_HASHED = """h AS (SELECT doc_id, source, lang, sha256(text) AS sha, strlen(text) AS size,
  'raw/' || source || '/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || CASE WHEN lang = 'en' THEN '.txt' ELSE '.json' END AS storage_key,
  row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS r FROM documents)"""


@query("intake_dedup", f"WITH {_HASHED} SELECT doc_id AS submission_id, source AS source_id, sha AS content_sha256, size AS content_size_bytes, storage_key, r > 1 AS duplicate FROM h")
def intake_dedup(spark, sf_dir):
    rows = I.raw_evidence(_submissions(spark, sf_dir))
    return rows.select("submission_id", "source_id", "content_sha256", "content_size_bytes", "storage_key", "duplicate")


@query("intake_against_stored", f"""WITH {_HASHED},
known AS (SELECT DISTINCT source, sha256(text) AS sha FROM docs WHERE publication_state = 'published')
SELECT doc_id AS submission_id, size AS content_size_bytes,
  size <= 20000 AND (row_number() OVER (PARTITION BY source, sha ORDER BY doc_id) > 1 OR EXISTS (SELECT 1 FROM known k WHERE k.source = h.source AND k.sha = h.sha)) AS duplicate,
  CASE WHEN size > 20000 THEN 'content_too_large' END AS rejection FROM h""", ("docs",))
def intake_against_stored(spark, sf_dir):
    stored = A.labelled_documents(spark, sf_dir).filter("publication_state = 'published'").select(
        F.col("source").alias("source_id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_sha256"))
    rows = I.raw_evidence(_submissions(spark, sf_dir), stored, max_bytes=20000)
    return rows.select("submission_id", "content_size_bytes", "duplicate", "rejection")


@query("object_keys", r"""
SELECT page_id, 'raw/pages/' || substr(sha256(html), 1, 2) || '/' || sha256(html) || '.html' AS storage_key, TRUE AS key_ok,
  NOT contains(url, '?') AND NOT contains(url, '#') AND NOT contains(url, ':') AS url_ok,
  CASE WHEN f = '' THEN 'evidence' ELSE f END AS filename
FROM (SELECT *, trim(regexp_replace(list_last(string_split_regex(url, '[/\\]')), '[^A-Za-z0-9._-]+', '-', 'g'), ' .-_') AS f FROM pages)
""")
def object_keys(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages")
    key = ids.object_key(F.lit("pages"), F.sha2("html", 256), F.lit("text/html"))
    return pages.select(
        "page_id", key.alias("storage_key"), text.object_key_ok(key).alias("key_ok"),
        text.object_key_ok(F.col("url")).alias("url_ok"), text.sanitize_filename(F.col("url")).alias("filename"))


@query("key_collisions", """
SELECT source || '/' || lang || '/' || n_chars AS storage_key, min(sha256(text)) AS first_sha256, max(sha256(text)) AS last_sha256, count(*)::BIGINT AS claims
FROM documents GROUP BY 1 HAVING min(sha256(text)) <> max(sha256(text))
""")
def key_collisions(spark, sf_dir):
    claims = A.table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", "lang", F.col("n_chars").cast("string")).alias("storage_key"), F.sha2("text", 256).alias("sha256"))
    return collisions(claims)


@query("source_conflicts", """
WITH held AS (SELECT DISTINCT source AS name, 'en' AS kind, CASE WHEN source < 'src2' THEN 'https://' || source END AS base_url FROM documents WHERE source >= 'src15'),
batch AS (SELECT doc_id, source AS name, lang AS kind, CASE WHEN n_chars % 2 = 0 THEN 'https://' || source END AS base_url,
          row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
basis AS (SELECT b.name, coalesce(h.kind, b.kind) AS kind, CASE WHEN h.name IS NULL THEN b.base_url ELSE h.base_url END AS base_url, h.name IS NULL AS fresh
          FROM batch b LEFT JOIN held h USING (name) WHERE b.r = 1)
SELECT doc_id AS submission_id, b.name, CASE WHEN fresh AND r = 1 THEN 'created'
  WHEN b.kind = s.kind AND b.base_url IS NOT DISTINCT FROM s.base_url THEN 'duplicate' ELSE 'conflict' END AS outcome
FROM batch b JOIN basis s USING (name)
""")
def source_conflicts(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    nothing = F.lit(None).cast("string")
    blank = {k: nothing for k in ("policy_notes", "license_name", "license_url", "metadata")}
    batch = docs.select(
        F.col("doc_id").alias("submission_id"), F.col("source").alias("name"), F.col("lang").alias("kind"),
        F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("https://"), "source")).alias("base_url")).withColumns(blank)
    stored = docs.filter("source >= 'src15'").select(F.col("source").alias("name")).distinct().withColumns(
        {"kind": F.lit("en"), "base_url": F.when(F.col("name") < "src2", F.concat(F.lit("https://"), "name")), **blank})
    return I.register_sources(batch, stored).select("submission_id", "name", "outcome")


@query("rule_registration", """
WITH b AS (SELECT p_partkey, lower(p_name) AS normalized_alias, p_name, p_brand, p_type, p_size,
           row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS r FROM part)
SELECT b.p_partkey AS submission_id, b.normalized_alias, CASE WHEN b.r = 1 THEN 'created'
  WHEN b.p_name = f.p_name AND b.p_brand = f.p_brand AND b.p_type = f.p_type THEN 'duplicate' ELSE 'conflict' END AS outcome
FROM b JOIN b f ON f.normalized_alias = b.normalized_alias AND f.r = 1
""")
def rule_registration(spark, sf_dir):
    nothing = F.lit(None).cast("string")
    batch = A.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("submission_id"), F.col("p_name").alias("alias_name"), F.col("p_brand").alias("actor_id"),
        F.col("p_type").alias("reason"), F.lit(90).alias("confidence"), nothing.alias("evidence_id"), F.lit("curator").alias("created_by"))
    stored = spark.createDataFrame([], "normalized_alias string, alias_name string, actor_id string, reason string, "
                                       "confidence int, evidence_id string, created_by string, active boolean")
    return I.register_alias_rules(batch, stored).select("submission_id", "normalized_alias", "outcome")


@query("alias_conflicts", """
WITH b AS (SELECT p_partkey, p_brand, lower(p_name) AS k, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS name,
           row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS r FROM part)
SELECT b.p_partkey AS submission_id, b.p_brand AS source_id, b.name, CASE WHEN b.r = 1 THEN 'created' WHEN b.name = f.name THEN 'duplicate' ELSE 'conflict' END AS outcome
FROM b JOIN b f ON f.p_brand = b.p_brand AND f.k = b.k AND f.r = 1
""")
def alias_conflicts(spark, sf_dir):
    nothing = F.lit(None).cast("string")
    batch = A.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("submission_id"), F.col("p_brand").alias("source_id"),
        F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"),
        nothing.alias("source_native_id"), nothing.alias("metadata"))
    stored = spark.createDataFrame([], "source_id string, normalized_name string, name string, source_native_id string, metadata string")
    return I.assert_aliases(batch, stored).select("submission_id", "source_id", "name", "outcome")


@query("job_submission", """
SELECT id AS submission_id, job_kind, idempotency_key, min(id) OVER (PARTITION BY job_kind, idempotency_key)::VARCHAR AS job_id,
  id <> min(id) OVER (PARTITION BY job_kind, idempotency_key) AS duplicate FROM jobs
""", ("jobs",))
def job_submission(spark, sf_dir):
    batch = A.job_table(spark, sf_dir).select(F.col("id").alias("submission_id"), "job_kind",
                                              F.concat(F.lit(" "), "idempotency_key", F.lit(" ")).alias("idempotency_key"))
    return I.submit_jobs(batch)


def _reconciled(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    labels = A.table(spark, sf_dir, "labels")
    key = F.concat(F.lit("raw/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    refs = docs.select(
        F.concat(F.lit("raw-"), F.col("doc_id").cast("string")).alias("raw_evidence_id"), key.alias("storage_key"),
        F.sha2("text", 256).alias("content_sha256"),
        F.when(F.col("lang") == "en", F.octet_length("text").cast("bigint")).alias("content_size_bytes"))
    stored = docs.join(labels, "doc_id").select(
        key.alias("storage_key"),
        F.when(F.col("quality") == 1, F.sha2("text", 256)).otherwise(F.sha2(F.concat("text", F.lit("x")), 256)).alias("blob_sha256"),
        (F.octet_length("text") + F.col("toxic")).cast("bigint").alias("blob_size"), F.lit("read").alias("blob_status"))
    pages = A.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("raw/page/"), F.col("page_id").cast("string")).alias("storage_key"), F.sha2("html", 256).alias("blob_sha256"),
        F.octet_length("html").cast("bigint").alias("blob_size"), F.lit("read").alias("blob_status"))
    return integrity.reconcile(refs, stored.unionByName(pages))


_RECONCILED = """rec AS (
  SELECT 'raw-' || d.doc_id AS raw_evidence_id, 'raw/' || source || '/' || d.doc_id AS storage_key,
    CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN quality = 1 AND (lang <> 'en' OR toxic = 0) THEN 'verified' ELSE 'mismatched' END AS kind
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  UNION ALL SELECT NULL, 'raw/page/' || page_id, 'orphaned' FROM pages)"""


_STORED_FILES = """one AS (SELECT text, sha256(text) AS sha, min(doc_id) AS first FROM documents GROUP BY text),
kinds AS (SELECT d.doc_id, 'raw/' || substr(sha, 1, 2) || '/' || sha AS storage_key,
    CASE WHEN first % 17 = 3 THEN 'missing' WHEN first % 17 = 5 THEN 'mismatched' ELSE 'verified' END AS kind FROM documents d JOIN one USING (text))"""


@query("integrity_files", f"""WITH {_STORED_FILES}
SELECT 'raw-' || doc_id AS raw_evidence_id, storage_key, kind FROM kinds
UNION ALL SELECT NULL, 'raw/stray/' || page_id, 'orphaned' FROM pages
""")
def integrity_files(spark, sf_dir):
    """Texts and pages are stored as files, some changed and some left out, and the folder is audited against the references."""
    root = scratch_dir(spark, "blobs")
    docs = A.table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", "text", F.sha2("text", 256).alias("sha"))
    key = F.concat(F.lit("raw/"), F.substring("sha", 1, 2), F.lit("/"), "sha")
    refs = docs.select(F.concat(F.lit("raw-"), F.col("doc_id").cast("string")).alias("raw_evidence_id"), key.alias("storage_key"),
                       F.col("sha").alias("content_sha256"), F.octet_length("text").cast("bigint").alias("content_size_bytes"))
    one = docs.groupBy("sha").agg(F.min("doc_id").alias("first"), F.any_value("text").alias("text"))
    fault = F.pmod("first", F.lit(17))
    kept = one.filter(fault != 3).select(key.alias("storage_key"), F.encode(
        F.when(fault == 5, F.concat("text", F.lit("x"))).otherwise(F.col("text")), "UTF-8").alias("content"))
    stray = A.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("raw/stray/"), F.col("page_id").cast("string")).alias("storage_key"), F.encode("html", "UTF-8").alias("content"))
    write_blobs(kept.unionByName(stray), root).agg(F.count(F.lit(1))).first()
    return integrity.reconcile(refs, streamed_hashes(spark, root, references=refs))


@query("integrity_reconcile", f"WITH {_RECONCILED} SELECT * FROM rec")
def integrity_reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir)


@query("integrity_counts", f"""WITH {_RECONCILED} SELECT count_if(kind <> 'orphaned')::BIGINT AS referenced, count_if(kind = 'verified')::BIGINT AS verified,
  count_if(kind = 'missing')::BIGINT AS missing, count_if(kind = 'mismatched')::BIGINT AS mismatched, 0::BIGINT AS storage_errors,
  count_if(kind = 'orphaned')::BIGINT AS orphaned, count_if(kind <> 'verified') = 0 AS clean FROM rec""")
def integrity_counts(spark, sf_dir):
    return integrity.counts(_reconciled(spark, sf_dir))


@query("integrity_findings", f"WITH {_RECONCILED} SELECT *, (SELECT count(*) FROM rec WHERE kind <> 'verified') > 100 AS truncated FROM rec WHERE kind <> 'verified' ORDER BY raw_evidence_id NULLS LAST, storage_key LIMIT 100")
def integrity_findings(spark, sf_dir):
    return integrity.findings(_reconciled(spark, sf_dir))


@query("provenance_check", """
SELECT d.doc_id, CASE WHEN d.lang = 'en' AND l.doc_id IS NULL THEN 'imported rows require raw evidence'
  WHEN l.doc_id IS NOT NULL AND l.toxic = 1 THEN 'raw evidence must exist and belong to the same source' END AS provenance_error
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def provenance_check(spark, sf_dir):
    docs, labels = A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "labels")
    raw_id = F.concat(F.lit("raw-"), F.col("doc_id").cast("string"))
    rows = docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("source").alias("source_id"), F.when(F.col("lang") == "en", F.lit("imported")).otherwise(F.lit("authored")).alias("origin"),
        F.when(F.col("quality").isNotNull(), raw_id).alias("raw_evidence_id"))
    raw = docs.join(labels, "doc_id").select(
        raw_id.alias("id"), F.when(F.col("toxic") == 1, F.lit("elsewhere")).otherwise(F.col("source")).alias("source_id"))
    return I.check_provenance(rows, raw).select("doc_id", "provenance_error")


def _artifact_rows(spark, sf_dir):
    """Parts as technique documents: some lack a name, a reference, a version or valid JSON."""
    k, c = F.col("p_partkey"), F.col
    technique = F.concat(F.lit("T"), F.lpad((k % 10000).cast("string"), 4, "0"))
    body = F.to_json(F.struct(
        F.when(k % 13 == 0, F.lit("malware")).otherwise(F.lit("attack-pattern")).alias("type"),
        F.when(k % 29 == 0, F.lit("2.0")).otherwise(F.lit("2.1")).alias("spec_version"),
        F.concat(F.when(k % 13 == 0, F.lit("malware--")).otherwise(F.lit("attack-pattern--")),
                 F.regexp_replace(F.md5(k.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).alias("id"),
        F.lit("2024-01-01T00:00:00Z").alias("created"), F.lit("2024-01-02T00:00:00Z").alias("modified"),
        F.when(k % 7 != 0, c("p_name")).alias("name"),
        F.when(k % 13 == 0, F.lit(True)).alias("is_family"),
        F.array(F.struct(F.lit("other").alias("source_name"), F.lit("X1").alias("external_id")),
                F.struct(F.lit("mitre-attack").alias("source_name"),
                         F.when(k % 5 == 0, F.lit("S1")).otherwise(technique).alias("external_id"))).alias("external_references"),
    ))
    return A.table(spark, sf_dir, "part").select(
        k.alias("submission_id"), c("p_brand").alias("source_id"),
        F.when(c("p_size") % 2 == 0, F.lit("stix_2_1")).otherwise(F.lit("attack_technique")).alias("artifact_type"),
        F.when(k % 31 == 0, F.concat(body, F.lit("]"))).otherwise(body).alias("content"))


_VALID = """v AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'stix_2_1' ELSE 'attack_technique' END AS artifact_type, p_name,
  CASE WHEN p_partkey % 31 = 0 THEN 'Content is not valid JSON.'
       WHEN p_size % 2 <> 0 AND p_partkey % 13 = 0 THEN 'ATT&CK technique must be a STIX attack-pattern.'
       WHEN p_partkey % 29 = 0 THEN 'Only STIX 2.1 artifacts are supported.'
       WHEN p_partkey % 7 = 0 AND p_partkey % 13 <> 0 THEN 'Missing required properties: name'
       WHEN p_size % 2 <> 0 AND p_partkey % 5 = 0 THEN 'ATT&CK technique requires a valid MITRE technique ID.' END AS error,
  CASE WHEN p_partkey % 13 = 0 THEN 'malware' ELSE 'attack-pattern' END AS kind FROM part)"""


@query("artifact_validation", f"""WITH {_VALID}
SELECT k AS submission_id, artifact_type, CASE WHEN error IS NULL THEN 'valid' ELSE 'invalid' END AS validation_status, coalesce(error, '') AS errors,
  CASE WHEN error IS NOT NULL THEN (CASE artifact_type WHEN 'stix_2_1' THEN 'Invalid STIX 2.1 artifact' ELSE 'Invalid ATT&CK technique reference' END)
       WHEN artifact_type = 'stix_2_1' AND k % 7 = 0 THEN 'STIX 2.1 bundle' ELSE p_name END AS title,
  CASE WHEN error IS NULL THEN '2.1' END AS version,
  CASE WHEN error IS NULL AND artifact_type = 'attack_technique' THEN 'T' || lpad((k % 10000)::VARCHAR, 4, '0')
       WHEN error IS NULL THEN kind || '--' || regexp_replace(md5(k::VARCHAR), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') END AS canonical_id
FROM v""")
def artifact_validation(spark, sf_dir):
    rows = _artifact_rows(spark, sf_dir).withColumn("content_sha256", F.sha2("content", 256))
    out = artifacts.validate(rows)
    return out.select(
        "submission_id", "artifact_type", "validation_status", F.array_join("validation_errors", "; ").alias("errors"), "title",
        "version", F.when(F.col("validation_status") == "valid", F.col("canonical_id")).alias("canonical_id"))


@query("artifact_intake", """
SELECT doc_id AS submission_id, row_number() OVER (PARTITION BY source, lang, sha256(text) ORDER BY doc_id) > 1 AS duplicate,
  CASE WHEN row_number() OVER (PARTITION BY source, lang, sha256(text) ORDER BY doc_id) = 1 THEN 'invalid:' || sha256(text) END AS canonical_id
FROM documents
""")
def artifact_intake(spark, sf_dir):
    """Documents submitted as STIX: no JSON, so each distinct one is kept as invalid."""
    rows = A.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("submission_id"), F.concat_ws("/", "source", "lang").alias("source_id"),
        F.lit("stix_2_1").alias("artifact_type"), F.col("text").alias("content"))
    return artifacts.intake(rows).select("submission_id", "duplicate", "canonical_id")
