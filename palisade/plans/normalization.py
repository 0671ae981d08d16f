"""Bundles made from conversations, and the version fold over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import normalize as N
from palisade.plans import adapters as A
from palisade.plans.registry import query, stamp
from palisade.session import scratch_dir
from palisade.sources.blobs import write_lines
from palisade.sources.bundle_ranges import read_split_bundles
from palisade.sources.changes import ChangeTable
from palisade.sources.stix_bundle import check_envelope, split_objects


def bundles(spark, sf_dir):
    """One bundle per conversation, one object per turn, with faults of every kind by rule."""
    c = F.col
    turns = A.table(spark, sf_dir, "conversations")
    native = F.regexp_replace(
        F.md5(F.concat((c("conv_id") % 20).cast("string"), F.lit("/"), c("turn").cast("string"))),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    kind = F.when(c("role") == "system", F.lit("identity")).otherwise(F.lit("intrusion-set"))
    both = c("conv_id") + c("turn")
    day = F.lpad((c("conv_id") % 7 + 2).cast("string"), 2, "0")
    item = F.struct(
        kind.alias("type"), F.lit("2.1").alias("spec_version"),
        F.when(both % 13 == 0, F.lit("broken")).otherwise(F.concat(kind, F.lit("--"), native)).alias("id"),
        F.lit("2024-01-01T00:00:00Z").alias("created"),
        F.concat(F.lit("2024-01-"), day, F.when(both % 11 == 0, F.lit("T00:00:00")).otherwise(F.lit("T02:00:00+02:00"))).alias("modified"),
        F.concat(F.lit("Group "), c("turn").cast("string"), F.lit(" "), c("role")).alias("name"),
        F.when(c("turn") % 2 == 0, c("role")).otherwise(c("text")).alias("description"),
        (c("turn") * 30).alias("confidence"),
        F.when(both % 17 == 0, F.array(F.lit("known"), F.lit("  "))).alias("aliases"),
    )
    packed = turns.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("o")))), lambda x: x.getField("o")).alias("objects"))
    bundle_uuid = F.regexp_replace(F.md5(c("conv_id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    body = F.to_json(F.struct(
        F.when(c("conv_id") % 19 == 3, F.lit("bundel")).otherwise(F.lit("bundle")).alias("type"),
        F.when(c("conv_id") % 23 == 5, F.lit("bundle-1")).otherwise(F.concat(F.lit("bundle--"), bundle_uuid)).alias("id"),
        "objects"))
    return packed.select(
        F.concat(F.lit("raw-"), c("conv_id").cast("string")).alias("raw_evidence_id"),
        F.concat(F.lit("feed-"), (c("conv_id") % 3).cast("string")).alias("source_id"), c("conv_id").alias("bundle_seq"),
        F.when(c("conv_id") % 17 == 4, F.concat(body, F.lit("}"))).otherwise(body).alias("content"))


def raw_rows(spark, sf_dir):
    """Raw evidence rows; a few belong to another source than their bundle says."""
    c = F.col
    return A.table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        F.concat(F.lit("raw-"), c("conv_id").cast("string")).alias("id"),
        F.when(c("conv_id") % 29 == 7, F.lit("feed-9")).otherwise(F.concat(F.lit("feed-"), (c("conv_id") % 3).cast("string"))).alias("source_id"))


def objects(spark, sf_dir):
    return split_objects(check_envelope(bundles(spark, sf_dir)), ["raw_evidence_id", "source_id", "bundle_seq"])


# the same rules in SQL
_ENV = r"""env AS (SELECT *, 'raw-' || conv_id AS raw_evidence_id, 'feed-' || (conv_id % 3) AS source_id,
  CASE WHEN conv_id % 17 = 4 THEN 'Payload is not valid UTF-8 JSON' WHEN conv_id % 19 = 3 THEN 'Payload must be a STIX bundle object'
       WHEN conv_id % 23 = 5 THEN 'Bundle has an invalid STIX identifier' END AS bundle_error,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS object_index FROM conversations),
obj AS (SELECT *, CASE WHEN role = 'system' THEN 'identity' ELSE 'intrusion-set' END AS object_type,
  CASE WHEN (conv_id + turn) % 13 = 0 THEN NULL ELSE (CASE WHEN role = 'system' THEN 'identity' ELSE 'intrusion-set' END) || '--' ||
    regexp_replace(md5((conv_id % 20) || '/' || turn), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') END AS object_id,
  CASE WHEN (conv_id + turn) % 13 = 0 THEN 'Object ' || object_index || ' has an invalid STIX identifier' END AS object_error
  FROM env WHERE bundle_error IS NULL),
parsed AS (SELECT *, CASE WHEN object_type <> 'intrusion-set' THEN 'unsupported object type: ' || object_type
  WHEN (conv_id + turn) % 17 = 0 OR turn * 30 > 100 OR (conv_id + turn) % 11 = 0 THEN 'invalid ATT&CK intrusion-set fields: ' || array_to_string(list_filter([
    CASE WHEN (conv_id + turn) % 17 = 0 THEN 'aliases' END, CASE WHEN turn * 30 > 100 THEN 'confidence' END, CASE WHEN (conv_id + turn) % 11 = 0 THEN 'modified' END], lambda x: x IS NOT NULL), ', ') END AS parse_reason
  FROM obj WHERE object_error IS NULL),
valid AS (SELECT *, parse_reason IS NULL AND conv_id % 29 = 7 AS foreign_raw FROM parsed),
fold AS (SELECT *, conv_id * 1048576 + object_index AS seq, TIMESTAMP '2024-01-01' + to_days((conv_id % 7 + 1)::INT) AS obs_at,
  turn || '|' || role || '|' || (CASE WHEN turn % 2 = 0 THEN role ELSE text END) AS body FROM valid WHERE parse_reason IS NULL AND NOT foreign_raw),
prev AS (SELECT *, max(obs_at) OVER (PARTITION BY source_id, object_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held_at FROM fold),
firsts AS (SELECT source_id, object_id, obs_at, arg_min(body, seq) AS held_body FROM fold GROUP BY ALL),
acted AS (SELECT p.*, CASE WHEN held_at IS NULL THEN 'create' WHEN p.obs_at < held_at THEN 'keep' WHEN p.obs_at > held_at THEN 'update'
  WHEN p.body = f.held_body THEN 'keep' ELSE 'reject' END AS action, CASE WHEN p.obs_at < held_at THEN 'existing observation has a newer source timestamp'
  WHEN p.obs_at = held_at AND p.body = f.held_body THEN 'canonical observation already exists'
  WHEN p.obs_at = held_at THEN 'conflicting canonical content has the same source timestamp' END AS reason
  FROM prev p LEFT JOIN firsts f ON f.source_id = p.source_id AND f.object_id = p.object_id AND f.obs_at = p.held_at),
outc AS (SELECT raw_evidence_id, object_index, object_id, action, 'persist' AS stage, reason,
    CASE action WHEN 'keep' THEN 'deduplicated' ELSE 'succeeded' END AS status, FALSE AS failed FROM acted WHERE action <> 'reject'
  UNION ALL SELECT raw_evidence_id, object_index, object_id, action, 'deduplicate', reason, 'rejected', TRUE FROM acted WHERE action = 'reject'
  UNION ALL SELECT raw_evidence_id, object_index, object_id, NULL, CASE WHEN parse_reason IS NULL THEN 'validate' ELSE 'parse' END,
    coalesce(parse_reason, 'raw evidence does not match the source provenance'), 'rejected', object_type = 'intrusion-set' FROM valid WHERE parse_reason IS NOT NULL OR foreign_raw)"""


@query("bundle_objects", f"WITH {_ENV} SELECT raw_evidence_id, object_index::BIGINT AS object_index, object_id, object_type, object_error FROM obj")
def bundle_objects(spark, sf_dir):
    rows = objects(spark, sf_dir)
    ok = F.col("object_error").isNull()
    return rows.select("raw_evidence_id", F.col("object_index").cast("bigint").alias("object_index"),
                       F.when(ok, F.col("object_id")).alias("object_id"), "object_type", "object_error")


@query("bundle_rejects", f"WITH {_ENV} SELECT DISTINCT raw_evidence_id, bundle_error FROM env WHERE bundle_error IS NOT NULL")
def bundle_rejects(spark, sf_dir):
    return check_envelope(bundles(spark, sf_dir)).filter("bundle_error is not null").select("raw_evidence_id", "bundle_error")


@query("bundle_file_objects", """
SELECT lang AS bundle, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS object_index, 'note--' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4)
  || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS object_id, 'note' AS object_type, NULL::VARCHAR AS object_error, sha256(text) AS content_sha256
FROM (SELECT *, md5(doc_id::VARCHAR) AS m FROM documents)
""")
def bundle_file_objects(spark, sf_dir):
    """A bundle file for each language, a note for each document; the files are read in byte ranges."""
    c = F.col
    native = F.concat(F.lit("note--"), F.regexp_replace(F.md5(c("doc_id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    docs = A.table(spark, sf_dir, "documents").select("lang", c("doc_id").alias("n"), F.to_json(F.struct(
        F.lit("note").alias("type"), native.alias("id"), F.struct(F.array(F.lit("}{")).alias("x_{")).alias("x_nested"), c("text").alias("content"))).alias("line"))
    ends = docs.groupBy("lang").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    heads = ends.select("lang", (c("low") - 1).alias("n"), F.concat(F.lit('{"type": "bundle", "x_list": [{"a": 1}], "id": "bundle--'), F.lit("0" * 36), F.lit('", "objects": [')).alias("line"))
    tails = ends.select("lang", (c("high") + 1).alias("n"), F.lit('], "x_{after": "\\"}]"}').alias("line"))
    notes = docs.join(F.broadcast(ends), "lang").select("lang", "n", F.when(c("n") > c("low"), F.concat(F.lit(","), c("line"))).otherwise(c("line")).alias("line"))
    root = scratch_dir(spark, "bundle-files")
    # a file is one run of lines by their numbers: it can be larger than a task
    write_lines(heads.unionByName(notes).unionByName(tails).filter(c("lang").isNotNull()).select(
        F.concat(F.lit("lang="), F.url_encode("lang"), F.lit("/lines.txt")).alias("file"), c("n").alias("place"), "line"), root)
    _, rows = read_split_bundles(spark, root)
    # the path is encoded once more in the file's address
    lang = F.url_decode(F.url_decode(F.regexp_extract("raw_path", "lang=([^/]*)/", 1)))
    return rows.select(lang.alias("bundle"), c("object_index").cast("bigint").alias("object_index"), "object_id",
                       "object_type", "object_error", F.sha2(F.get_json_object("payload", "$.content"), 256).alias("content_sha256"))


@query("parse_rejects", f"WITH {_ENV} SELECT raw_evidence_id, object_id, parse_reason FROM parsed WHERE parse_reason IS NOT NULL")
def parse_rejects(spark, sf_dir):
    sound = objects(spark, sf_dir).filter("object_error is null")
    return N.parse_intrusion_sets(sound).filter("parse_reason is not null").select("raw_evidence_id", "object_id", "parse_reason")


@query("normalization_outcomes", f"WITH {_ENV} SELECT raw_evidence_id, object_index::BIGINT AS object_index, object_id, action, stage, reason, status, failed FROM outc")
def normalization_outcomes(spark, sf_dir):
    result = N.normalize_batch(objects(spark, sf_dir), raw_rows(spark, sf_dir))
    return result.outcomes.select("raw_evidence_id", F.col("object_index").cast("bigint").alias("object_index"), "object_id",
                                  "action", "stage", "reason", "status", "failed")


@query("normalized_observations", f"""WITH {_ENV}, w AS (SELECT *, max(seq) FILTER (action IN ('create', 'update')) OVER (PARTITION BY source_id, object_id) AS last FROM acted)
SELECT source_id, object_id AS source_native_id, 'Group ' || turn || ' ' || role AS title, sha256(CASE WHEN turn % 2 = 0 THEN role ELSE text END) AS summary_sha256,
  strftime(obs_at, '%Y-%m-%d %H:%M:%S') AS observed_at, (turn * 30)::INT AS confidence FROM w WHERE seq = last""")
def normalized_observations(spark, sf_dir):
    result = N.normalize_batch(objects(spark, sf_dir), raw_rows(spark, sf_dir))
    return result.changed.select("source_id", "source_native_id", "title", F.sha2("summary", 256).alias("summary_sha256"),
                                 stamp("observed_at").alias("observed_at"), "confidence")


@query("ledger_replay", f"WITH {_ENV} SELECT raw_evidence_id, object_index::BIGINT AS object_index, status, stage, 2 AS attempts, FALSE AS identity_conflict FROM outc")
def ledger_replay(spark, sf_dir):
    """A second run over the same bundles: every ledger row is met again and counts two attempts."""
    batch, raw = objects(spark, sf_dir), raw_rows(spark, sf_dir)
    first = N.normalize_batch(batch, raw)
    again = N.ledger(first.outcomes, first.ledger)
    return again.select("raw_evidence_id", F.col("object_index").cast("bigint").alias("object_index"), "status", "stage",
                        "attempts", "identity_conflict")


@query("bundle_outcome", f"""WITH {_ENV},
n AS (SELECT raw_evidence_id, count(*) AS seen FROM obj GROUP BY 1),
bad AS (SELECT raw_evidence_id, count(*) AS bad FROM (SELECT raw_evidence_id FROM outc WHERE failed UNION ALL SELECT raw_evidence_id FROM obj WHERE object_error IS NOT NULL) GROUP BY 1),
b AS (SELECT DISTINCT raw_evidence_id, bundle_error, conv_id % 31 = 2 AS skipped FROM env)
SELECT raw_evidence_id, CASE WHEN skipped OR bundle_error IS NOT NULL THEN 0 ELSE seen END AS objects_seen,
  CASE WHEN skipped OR bundle_error IS NOT NULL THEN 0 ELSE seen - coalesce(bad, 0) END AS objects_emitted,
  CASE WHEN skipped THEN 0 WHEN bundle_error IS NOT NULL THEN 1 ELSE coalesce(bad, 0) END AS objects_failed,
  CASE WHEN skipped THEN 'skipped' WHEN bundle_error IS NOT NULL OR bad > 0 THEN 'failed' ELSE 'succeeded' END AS status,
  CASE WHEN skipped THEN NULL WHEN bundle_error IS NOT NULL THEN bundle_error WHEN bad > 0 THEN bad || ' of ' || seen || ' STIX objects failed at the normalization boundary' END AS error
FROM b LEFT JOIN n USING (raw_evidence_id) LEFT JOIN bad USING (raw_evidence_id)""")
def bundle_outcome(spark, sf_dir):
    checked = check_envelope(bundles(spark, sf_dir)).select(
        "raw_evidence_id", "bundle_error", F.octet_length("content").cast("bigint").alias("bytes"),
        (F.col("bundle_seq") % 31 == 2).alias("already_succeeded"))
    all_objects = objects(spark, sf_dir)
    done = N.normalize_batch(all_objects, raw_rows(spark, sf_dir)).outcomes.select("raw_evidence_id", "failed")
    broken = all_objects.filter("object_error is not null").select("raw_evidence_id", F.lit(True).alias("failed"))
    return N.bundle_outcomes(checked, done.unionByName(broken)).drop("bytes")


_DOCFOLD = """r AS (SELECT source, lang, doc_id, n_chars % 5 AS obs_at, sha256(text) AS fp FROM documents),
p AS (SELECT *, max(obs_at) OVER (PARTITION BY source, lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held_at FROM r),
f AS (SELECT source, lang, obs_at, arg_min(fp, doc_id) AS held_fp FROM r GROUP BY ALL),
a AS (SELECT p.*, CASE WHEN held_at IS NULL THEN 'create' WHEN p.obs_at < held_at THEN 'keep' WHEN p.obs_at > held_at THEN 'update' WHEN p.fp = held_fp THEN 'keep' ELSE 'reject' END AS action
      FROM p LEFT JOIN f ON f.source = p.source AND f.lang = p.lang AND f.obs_at = p.held_at)"""


def _document_versions(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select(
        "source", "lang", F.col("doc_id").alias("seq"), (F.col("n_chars") % 5).alias("observed_at"), F.sha2("text", 256).alias("fingerprint"))


@query("version_fold", f"WITH {_DOCFOLD} SELECT source, lang, doc_id AS seq, action FROM a")
def version_fold(spark, sf_dir):
    folded = N.version_fold(_document_versions(spark, sf_dir), ["source", "lang"], "seq", "observed_at", "fingerprint")
    return folded.select("source", "lang", "seq", "action")


@query("observation_upsert", f"""WITH {_DOCFOLD}
SELECT source, lang, max(doc_id) FILTER (action IN ('create', 'update')) AS seq FROM a GROUP BY ALL
UNION ALL SELECT DISTINCT 'nation', n_name, -1 FROM nation""")
def observation_upsert(spark, sf_dir):
    """Stored rows with untouched keys and the winners of the batch, which appends those and no others."""
    folded = N.version_fold(_document_versions(spark, sf_dir), ["source", "lang"], "seq", "observed_at", "fingerprint")
    changed = N.winners(folded, ["source", "lang"], "seq", "observed_at").select("source", "lang", "seq")
    stored = A.table(spark, sf_dir, "nation").select(F.lit("nation").alias("source"), F.col("n_name").alias("lang"), F.lit(-1).cast("bigint").alias("seq"))
    held = changed.select("source", "lang", F.lit(-2).cast("bigint").alias("seq"))
    kept = ChangeTable(spark, scratch_dir(spark, "upsert"), "source string, lang string, seq bigint", ["source", "lang"])
    kept.write(stored.unionByName(held), 0)
    kept.write(changed, 1)
    return kept.rows()
