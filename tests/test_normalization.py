import json
import random

from pyspark.sql import functions as F

from palisade.operators import normalize as N
from palisade.sources.stix_bundle import check_envelope, split_objects
from palisade.streaming.jobs import StreamingNormalization

UID = "1d9be2f4-77c3-4a58-8b16-0e4f2c9a6d35"


def item(number=1, **changes):
    body = {
        "type": "intrusion-set", "spec_version": "2.1", "id": f"intrusion-set--5c0f7d1e-2a64-4b0d-9e37-{number:012d}",
        "created": "2024-03-11T06:00:00Z", "modified": "2024-04-20T14:15:00+02:00", "name": " Rook Foundry ", "description": "",
        "first_seen": "2023-11-07T09:45:00-03:00", "aliases": ["Rook Works"],
        "external_references": [{"source_name": "mitre-attack", "external_id": "G7351"}],
    }
    body.update(changes)
    return {k: v for k, v in body.items() if v is not ...}


def bundle(*objects):
    return json.dumps({"type": "bundle", "id": f"bundle--{UID}", "objects": list(objects)})


def objects(spark, *contents):
    rows = [(f"r{i}", "s1", i, text) for i, text in enumerate(contents)]
    df = spark.createDataFrame(rows, "raw_evidence_id string, source_id string, bundle_seq long, content string")
    return split_objects(check_envelope(df), ["raw_evidence_id", "source_id", "bundle_seq"])


def raw(spark, n=9):
    return spark.createDataFrame([(f"r{i}", "s1") for i in range(n)], "id string, source_id string")


def test_envelope_faults(spark):
    cases = ["nope", "[]", bundle() + "x", json.dumps({"type": "bundle", "id": 5, "objects": []}),
             json.dumps({"type": "bundle", "id": f"bundle--{UID}", "objects": {}}), bundle()]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, content string")
    got = [r.bundle_error for r in check_envelope(df).orderBy("i").collect()]
    assert got == ["Payload is not valid UTF-8 JSON", "Payload must be a STIX bundle object", "Payload is not valid UTF-8 JSON",
                   "Bundle has an invalid STIX identifier", "Bundle objects must be an array", None]


def test_object_faults_and_payload_text(spark):
    rows = objects(spark, bundle("text", None, {"id": "x"}, {"id": f"identity--{UID}", "type": "tool"}, item())).orderBy("object_index").collect()
    assert [r.object_error for r in rows] == [
        "Object 0 must be a JSON object", "Object 1 must be a JSON object", "Object 2 has an invalid STIX identifier",
        "Object 3 type does not match its identifier", None]
    assert json.loads(rows[4].payload) == item()


def test_field_faults(spark):
    cases = [
        (item(), None),
        (item(name=5, confidence=101, modified="2024-04-20T12:15:00"), "confidence, modified, name"),
        (item(aliases=["ok", 3]), "aliases.1"),
        (item(aliases=["  "]), "aliases"),
        (item(external_references=[{"source_name": ""}, 4]), "external_references.0.source_name, external_references.1"),
        (item(modified="2024-02-01T00:00:00Z"), "record"),
        (item(last_seen="2022-01-01T00:00:00Z"), "record"),
        (item(revoked=None, x_mitre_version=2), "revoked, x_mitre_version"),
        (item(spec_version=...), "spec_version"),
        (item(confidence=None, description=None), None),
    ]
    parsed = N.parse_intrusion_sets(objects(spark, bundle(*[c for c, _ in cases]))).orderBy("object_index").collect()
    assert [r.parse_reason for r in parsed] == [w and f"invalid ATT&CK intrusion-set fields: {w}" for _, w in cases]
    assert parsed[0].name == "Rook Foundry" and str(parsed[0].modified) == "2024-04-20 12:15:00"


def outcomes(result):
    return [(r.status, r.stage, r.reason) for r in result.outcomes.orderBy("seq").collect()]


def test_versions_conflicts_and_replay(spark):
    batch = objects(spark, bundle(item(name="New name"), item(name="Old name", modified="2024-04-02T00:00:00Z"), item(name="Other"),
                                  item(name="New name"), {"type": "tool", "id": f"tool--{UID}"}, item(2)))
    result = N.normalize_batch(batch, raw(spark))
    assert outcomes(result) == [
        ("succeeded", "persist", None), ("deduplicated", "persist", "existing observation has a newer source timestamp"),
        ("rejected", "deduplicate", "conflicting canonical content has the same source timestamp"),
        ("deduplicated", "persist", "canonical observation already exists"), ("rejected", "parse", "unsupported object type: tool"), ("succeeded", "persist", None)]
    assert sorted(r.title for r in result.changed.collect()) == ["New name", "Rook Foundry"]
    stored = result.changed.select("source_id", "source_native_id", "observed_at", "fingerprint")
    again = N.normalize_batch(batch, raw(spark), stored, result.ledger)
    assert [o[0] for o in outcomes(again)] == ["deduplicated", "deduplicated", "rejected", "deduplicated", "rejected", "deduplicated"]
    assert {r.attempts for r in again.ledger.collect()} == {2} and again.changed.count() == 0


def test_foreign_raw_evidence_is_rejected(spark):
    result = N.normalize_batch(objects(spark, bundle(item())), spark.createDataFrame([("r0", "s2")], "id string, source_id string"))
    assert outcomes(result) == [("rejected", "validate", "raw evidence does not match the source provenance")]


def test_fold_equals_a_loop(spark):
    rng = random.Random(11)
    rows = [(rng.choice("kkkm"), i, rng.randrange(5), rng.choice("xyz")) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, seq long, t int, fp string")
    stored = spark.createDataFrame([("m", 3, "x"), ("unused", 1, "y")], "key string, t int, fp string")
    got = {r.seq: r.action for r in N.version_fold(df, ["key"], "seq", "t", "fp", stored, span=7, levels=3).collect()}
    held = {"m": (3, "x")}
    for key, seq, t, fp in rows:
        now = held.get(key)
        if now is None or t > now[0]:
            want, held[key] = ("create" if now is None else "update"), (t, fp)
        else:
            want = "keep" if t < now[0] or fp == now[1] else "reject"
        assert got[seq] == want, (key, seq)


def test_batches_equal_one_run_and_replays_change_nothing(spark, tmp_path):
    contents = [bundle(item(1, name=f"v{i}", modified=f"2024-05-{5 + i % 3:02d}T00:00:00Z"), item(i + 2)) for i in range(6)]
    rows = objects(spark, *contents).withColumn("object_index", F.col("object_index").cast("int")).cache()
    step = StreamingNormalization(spark, str(tmp_path), raw(spark))
    for batch_id, (low, high) in enumerate([(0, 1), (2, 3), (4, 5)]):
        for _ in range(2):
            step(rows.filter(F.col("bundle_seq").between(low, high)), batch_id)
    whole = N.normalize_batch(rows, raw(spark))
    key = lambda df: sorted((r.source_native_id, r.title) for r in df.collect())
    assert key(step.observations.rows()) == key(whole.changed)
    statuses = lambda df: sorted((r.raw_evidence_id, r.object_index, r.status, r.attempts) for r in df.collect())
    assert statuses(step.ledger.rows()) == statuses(whole.ledger)
