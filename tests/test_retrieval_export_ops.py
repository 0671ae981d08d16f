import hashlib
import json
import math
import random
import re
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from graphs import rows, search_graph
from palisade.functions.vectors import cosine_distance
from palisade.operators import integrity, jobs, quality, retrieval, stix_export
from palisade.plans import adapters
from palisade.schemas import Graph
from palisade.sources import blobs
from palisade.streaming import jobs as streams


def test_budget_equals_a_greedy_loop(spark):
    rng = random.Random(4)
    at = datetime(2025, 4, 2)
    rows = [(f"q{q}", f"e{i:02d}", i + 1, "src", "c" * rng.randrange(1, 60), at, "observed", "x" * rng.choice([0, 3, rng.randrange(400)]), i / 100)
            for q in range(40) for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "question_id string, evidence_id string, position int, source_name string, citation string, observed_at timestamp, intelligence_type string, excerpt string, distance double")
    got = {(r.question_id, r.evidence_id): r.excerpt for r in retrieval.allocate_context(df, 150).collect()}
    tokens = lambda s: max(1, math.ceil(len(s) / 4))
    want, left, stopped = {}, {}, set()
    for q, e, _, src, cit, t, kind, text, _ in rows:
        remaining = left.setdefault(q, 150)
        fixed = tokens(f"{e} {src} {cit} {t.isoformat()}+00:00 {kind}")
        if q in stopped or remaining <= fixed:
            stopped.add(q)
            continue
        use = min(tokens(text), remaining - fixed)
        want[(q, e)] = text[: use * 4]
        left[q] = remaining - fixed - use
    assert got == want


def test_retrieval_isolates_actors_and_dates(spark):
    day = datetime(2025, 4, 2)
    cand = spark.createDataFrame(
        [("alpha", "m", 3, [0.0, 1.0, 0.0], day, "e1"), ("alpha", "m", 3, [1.0, 0.0, 0.0], day + timedelta(50), "e2"), ("beta", "m", 3, [1.0, 0.0, 0.0], day, "e3"), ("alpha", "other", 3, [1.0, 0.0, 0.0], day, "e4")],
        "actor_id string, embedding_model string, dimensions int, embedding array<float>, observed_at timestamp, evidence_id string")
    asked = spark.createDataFrame(
        [("q1", "alpha", "m", 3, [0.0, 1.0, 0.0], None, None), ("q2", "alpha", "m", 3, [1.0, 0.0, 0.0], day + timedelta(31), None), ("q3", "beta", "m", 3, [1.0, 0.0, 0.0], None, None), ("q4", "alpha", "m", 3, [0.0, 0.0, 1.0], None, None)],
        "question_id string, actor_id string, embedding_model string, dimensions int, vector array<float>, date_from timestamp, date_to timestamp")
    got = sorted((r.question_id, r.evidence_id, round(r.distance, 6)) for r in retrieval.nearest(asked, cand).collect())
    assert got == [("q1", "e1", 0.0), ("q2", "e2", 0.0), ("q3", "e3", 0.0)]


def test_nearest_in_blocks_equals_all_pairs(spark, monkeypatch):
    """A hot actor in many blocks, ties, odd vectors, null dates, further columns, repeated rows."""
    monkeypatch.setattr(retrieval, "_BLOCK_ROWS", 7)
    rng = random.Random(9)
    day = datetime(2025, 4, 2)
    def vector():
        kind = rng.random()
        if kind < 0.1:
            return rng.choice([None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0, float("nan"), 0.0, 0.0], [1.0, float("inf"), 0.0, 0.0], [1.0, 2.0]])
        return [float(rng.randrange(-2, 3)) for _ in range(4)] if kind < 0.5 else [rng.gauss(0, 1) for _ in range(4)]

    def moment():
        return None if rng.random() < 0.15 else day + timedelta(rng.randrange(6))

    actor = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    cand = [(actor(), rng.choice(["m", "m", "n"]), 4, vector(), moment(), f"e{i}", f"cited {i}") for i in range(120)]
    asked = [(f"q{i}", actor(), "m", 4, vector(), rng.choice([None, day + timedelta(2)]), rng.choice([None, day + timedelta(4)]), i) for i in range(60)]
    c = spark.createDataFrame(cand, "actor_id string, embedding_model string, dimensions int, embedding array<double>, observed_at timestamp, evidence_id string, citation string")
    q = spark.createDataFrame(asked, "question_id string, actor_id string, embedding_model string, dimensions int, vector array<double>, date_from timestamp, date_to timestamp, more int")
    made = retrieval.nearest(q, c, limit=5, max_distance=0.8)
    assert made.columns == ["actor_id", "embedding_model", "dimensions", "observed_at", "evidence_id", "citation", "question_id", "more", "distance", "position"]
    got = sorted(((r.question_id, r.position, r.evidence_id, r.distance, r.citation, r.more) for r in made.collect()))
    # the same by expressions over all pairs
    pairs = q.join(c, ["actor_id", "embedding_model", "dimensions"]).withColumn("distance", cosine_distance(F.col("embedding"), F.col("vector"))).collect()
    want = []
    for name in sorted({r.question_id for r in pairs}):
        near = [r for r in pairs if r.question_id == name and r.distance is not None and r.distance <= 0.8
                and (r.date_from is None or (r.observed_at and r.observed_at >= r.date_from)) and (r.date_to is None or (r.observed_at and r.observed_at <= r.date_to))]
        near.sort(key=lambda r: (r.distance, r.observed_at is None, -(r.observed_at or day).timestamp(), r.evidence_id))
        want += [(name, k + 1, r.evidence_id, r.distance, r.citation, r.more) for k, r in enumerate(near[:5])]
    assert got == sorted(want) and len(got) > 100
    assert retrieval.nearest(q.limit(0), c).count() == retrieval.nearest(q, c.limit(0)).count() == 0
    assert retrieval.nearest(q, c, max_distance=-1.0).count() == 0


def test_equal_vectors_tie_exactly_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_BLOCK_ROWS", 5)
    day = datetime(2025, 4, 2)
    same = [0.1, 0.7, -0.3]
    cand = [("a", "m", 3, same, day, f"e{i:03d}") for i in range(90)]
    asked = [(f"q{i}", "a", "m", 3, [0.2 * i, 1.0, 0.1], None, None) for i in range(12)]
    c = spark.createDataFrame(cand, "actor_id string, embedding_model string, dimensions int, embedding array<float>, observed_at timestamp, evidence_id string")
    q = spark.createDataFrame(asked, "question_id string, actor_id string, embedding_model string, dimensions int, vector array<float>, date_from timestamp, date_to timestamp")
    found = {}
    for r in retrieval.nearest(q, c, limit=3, max_distance=2.0).collect():
        found.setdefault(r.question_id, []).append((r.position, r.evidence_id))
    assert len(found) == 12 and all(sorted(x) == [(1, "e000"), (2, "e001"), (3, "e002")] for x in found.values())


def test_embedding_provider_runs_in_batches(spark):
    texts = spark.createDataFrame([("a",), ("bb",)], "t string")
    out = retrieval.embed(texts, "t", lambda batch: [[float(len(x)), 0.0] for x in batch], 2).collect()
    assert [(list(r.embedding), r.problem) for r in out] == [([1.0, 0.0], None), ([2.0, 0.0], None)]


def test_export_is_complete_and_repeatable(spark):
    me = stix_export.Publisher()
    objects = stix_export.export_objects(search_graph(spark), me)
    def document(rows):
        lines = stix_export.bundle_lines(stix_export.bundles(rows, me)).filter("actor_id = 'a1'").orderBy("ordinal")
        return "".join(r.line for r in lines.collect())

    content = document(objects)
    body = json.loads(content)
    kinds = sorted((o["type"], o.get("relationship_type", "")) for o in body["objects"])
    assert kinds == [("attack-pattern", ""), ("campaign", ""), ("intrusion-set", ""), *[("note", "")] * 4, ("relationship", "attributed-to"), ("relationship", "uses")]
    ids = [o["id"] for o in body["objects"]]
    assert ids == [o["id"] for o in sorted(body["objects"], key=lambda o: (o["type"], o["id"]))]
    assert body["id"] == "bundle--" + str(uuid.uuid5(me.namespace, f"bundle:actor:a1:{','.join(ids)}"))
    by_type = {o["type"]: o for o in body["objects"] if o["type"] != "relationship"}
    assert by_type["intrusion-set"]["aliases"] == ["Amber Heron", "Buried Heron"] and "url" not in by_type["campaign"]["external_references"][0]
    link = next(o for o in body["objects"] if o.get("relationship_type") == "attributed-to")
    assert (link["start_time"], link["stop_time"], link["confidence"]) == ("2025-06-06T00:00:00.000Z", "2025-10-13T00:00:00.000Z", 70)
    assert {"description": "Round of March — scanned letter", "source_name": "Mill Street Desk", "url": "https://millstreet.example.org/round"} in link["external_references"]
    assert document(stix_export.export_objects(search_graph(spark), me)) == content


def test_a_large_actor_keeps_one_bundle(spark):
    """More objects than any batch or partition holds."""
    me, n = stix_export.Publisher(), 60_000
    objects = spark.range(n).select(F.lit("big").alias("actor_id"), F.lit("note").alias("type"), F.format_string("note--%08d", F.col("id")).alias("id"), F.lit("{}").alias("json"))
    rows = stix_export.bundles(objects, me).cache()
    want = "bundle--" + str(uuid.uuid5(me.namespace, "bundle:actor:big:" + ",".join(f"note--{k:08d}" for k in range(n))))
    assert rows.select("bundle_id", "objects").distinct().collect() == [(want, n)]
    assert rows.filter(F.format_string("note--%08d", F.col("ordinal") - 1) != F.col("id")).count() == 0


def test_blobs_reconcile(spark, tmp_path):
    for name, text in (("a", "good"), ("b", "changed"), ("stray", "x")):
        (tmp_path / "raw" / "s").mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / "s" / name).write_text(text)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    refs = spark.createDataFrame([("1", "raw/s/a", digest("good"), 4), ("2", "raw/s/b", digest("before"), None), ("3", "raw/s/gone", digest("z"), 1), ("4", None, digest("q"), 1)],
                                 "raw_evidence_id string, storage_key string, content_sha256 string, content_size_bytes long")
    scanned = integrity.reconcile(refs, blobs.hash_blobs(blobs.scan_blobs(spark, str(tmp_path))))
    assert integrity.counts(scanned).first().asDict() == {"referenced": 3, "verified": 1, "missing": 1, "mismatched": 1, "storage_errors": 0, "orphaned": 1, "clean": False}
    assert [(r.kind, r.storage_key) for r in integrity.findings(scanned).collect()] == [("mismatched", "raw/s/b"), ("missing", "raw/s/gone"), ("orphaned", "raw/s/stray")]
    (tmp_path / "raw" / "s" / "folder").mkdir()
    more = refs.union(spark.createDataFrame([("5", "raw/s/folder", digest("z"), 1)], refs.schema))
    opened = integrity.reconcile(more, blobs.read_listed_blobs(more.filter("storage_key is not null"), str(tmp_path)))
    assert {r.raw_evidence_id: r.kind for r in opened.collect() if r.raw_evidence_id in "1235"} == {"1": "verified", "2": "mismatched", "3": "missing", "5": "storage_error"}


def test_each_bad_row_breaks_exactly_its_rule(spark):
    def broken(table, schema, *values):
        return sorted(r.rule for r in quality.check_constraints(spark.createDataFrame([values], schema), "id", quality.rules(table), table).collect())

    assert broken("actors", "id string, canonical_name string, normalized_name string", "1", "  ", "x") == ["canonical_name_not_blank"]
    campaign = "id string, name string, normalized_name string, confidence int, first_seen int, last_seen int"
    assert broken("campaigns", campaign, "1", "n", "n", 101, None, None) == ["confidence_range"]
    assert broken("campaigns", campaign, "1", "n", "n", None, 5, 4) == ["time_range_order"]
    assert broken("campaigns", campaign, "1", None, "n", None, 5, None) == []
    assert broken("advisories", "id string, slug string, status string, published_revision int, published_at int", "1", "Bad Slug", "draft", 1, None) == ["publication_shape", "slug_safe_format"]


def test_queue_arithmetic(spark):
    now = datetime(2025, 4, 2)
    df = spark.createDataFrame([("queued", now, now), ("queued", now + timedelta(1), now), ("processing", None, now)], "state string, next_attempt_at timestamp, created_at timestamp")
    row = jobs.queue_metrics(df, now, 2).first()
    assert (row.queued, row.due, row.processing, row.active, row.available) == (2, 1, 1, 3, 0)


def monitor_by_hand(events):
    out, state = [], {}
    for job, seq, at, kind, lease, retryable, most in sorted(events, key=lambda e: (e[0], e[1])):
        tries, held, until = state.get(job, (0, None, None))
        if held is not None and until <= at:
            out.append((job, seq, "lease_expired", tries, None))
            held = None
        if kind == "claim":
            if tries >= most:
                out.append((job, seq, "exhausted", tries, None))
            else:
                tries, held, until = tries + 1, lease, at + timedelta(seconds=300)
                out.append((job, seq, "claimed", tries, None))
        elif lease != held:
            out.append((job, seq, "stale", tries, None))
        else:
            held = None
            retry = kind == "fail" and retryable and tries < most
            delay = min(30 * 2 ** (tries - 1), 3600) if retry else None
            out.append((job, seq, "succeeded" if kind == "succeed" else "retry_due" if retry else "failed", tries, delay))
        state[job] = (tries, held, until)
    return sorted(out, key=str)


def test_intake_step_survives_a_replay(spark, tmp_path):
    step = streams.EvidenceIntake(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "s", b"a", "text/plain"), (2, "s", b"a", "text/plain"), (3, "s", b"b", "text/plain")], "submission_id long, source_id string, content binary, mime_type string")
    more = spark.createDataFrame([(4, "s", b"b", "text/plain"), (5, "t", b"b", "text/plain")], rows.schema)
    for batch_id, batch in ((0, rows), (0, rows), (1, more), (1, more)):
        step(batch, batch_id)
    assert sorted(r.submission_id for r in step.known().collect()) == [1, 3, 5]


def test_bundle_numbers_come_from_identifiers_and_texts_are_joined_lazily(spark):
    objects = stix_export.export_objects(search_graph(spark))
    want = sorted(objects.select("actor_id", "type", "id", "json").collect())
    rows = stix_export.bundles(objects).collect()
    by_actor = {}
    for r in sorted(rows, key=lambda r: (r.actor_id, r.ordinal)):
        by_actor.setdefault(r.actor_id, []).append(r)
    assert len(rows) == len(want)
    for actor, of in by_actor.items():
        mine = [w for w in want if w.actor_id == actor]
        assert [(r.ordinal, r.objects, r.id, r.json) for r in of] == [(i + 1, len(mine), w.id, w.json) for i, w in enumerate(mine)]
        names = ",".join(r.id for r in of)
        assert {r.bundle_id for r in of} == {f"bundle--{uuid.uuid5(stix_export.Publisher().namespace, f'bundle:actor:{actor}:{names}')}"}
    narrow = stix_export.bundles(objects).select("actor_id", "id", "ordinal")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "structstojson" not in plan.lower() and "to_json" not in plan.lower() and "ObjectHashAggregate" not in plan and "palisade-" not in plan


def test_copies_in_a_bundle_keep_their_own_texts(spark):
    data = [("a", "note", "note--1", "x"), ("a", "note", "note--1", "x"), ("a", "note", "note--1", "y"), ("b", "tool", "tool--1", "w"), (None, "note", "note--2", "v")]
    objects = spark.createDataFrame(data, "actor_id string, type string, id string, json string")
    got = [(r.actor_id, r.objects, r.ordinal, r.id, r.json) for r in stix_export.bundles(objects).collect()]
    assert sorted(got) == [("a", 3, 1, "note--1", "x"), ("a", 3, 2, "note--1", "x"), ("a", 3, 3, "note--1", "y"), ("b", 1, 1, "tool--1", "w")]


def test_references_of_pairs_move_once_and_stay_distinct(spark):
    X = stix_export
    r = lambda table, *items: rows(spark, table, *items)
    graph = Graph(spark, {
        "sources": r("sources", {"id": "s", "name": "Desk"}),
        "observations": r("observations", *[{"id": f"o{k}", "source_id": "s", "source_native_id": "same" if k < 3 else None} for k in range(4)]),
        "evidence": r("evidence", {"id": "e", "source_id": "s", "citation": "Both"}, {"id": "f", "source_id": "s", "citation": "One"}),
        "observation_evidence": r("observation_evidence", *[{"observation_id": f"o{o}", "evidence_id": e} for o, e in ("0e", "1e", "1f", "1f")]),
        "observation_techniques": r("observation_techniques", *[{"observation_id": f"o{o}", "technique_id": t} for o, t in ("0t", "1t", "1t", "1u", "3u")]),
    })
    links = spark.createDataFrame([("a", "o0"), ("a", "o1"), ("a", "o1"), ("a", "o3"), ("b", "o1"), (None, "o1"), ("b", "o2")], "actor_id string, observation_id string")
    found = X.uses_references(graph, links)
    got = sorted(((x.actor_id or "", x.technique_id, x.reference.description or "", x.reference.external_id or "") for x in found.collect()))
    one = [("t", "Both", ""), ("t", "One", ""), ("t", "", "same"), ("u", "Both", ""), ("u", "One", ""), ("u", "", "same")]
    assert got == sorted([*[(a, *x) for a in ("", "a", "b") for x in one], ("a", "u", "", "")])
    # texts are told apart for each actor before they are multiplied
    assert "_last" in found._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_attack_patterns_and_uses_are_shuffled_once(spark):
    frame = lambda columns, *found: spark.createDataFrame(found, columns)
    day = datetime(2024, 1, 1)
    graph = Graph(spark, {
        "sources": frame("id string, name string, base_url string", ("s", "S", None)),
        "techniques": frame("id string, source_id string, external_id string, name string, description string, created_at timestamp, updated_at timestamp",
                            *[(t, s, "x", "n", None, day, day) for t, s in (("t1", "s"), ("t1", "s"), ("t2", "s"), ("t3", "no"), (None, "s"))]),
        "observations": frame("id string, source_id string, source_native_id string, title string, summary string, observed_at timestamp, first_seen timestamp,"
                              "last_seen timestamp, confidence int, intelligence_type string, created_at timestamp, updated_at timestamp",
                              *[(o, "s", o, "t", "s", day, None, None, 1, "observed", day + timedelta(k), day + timedelta(k)) for k, o in enumerate(("o1", "o2"))]),
        "actor_observations": frame("actor_id string, observation_id string",
                                    ("a1", "o1"), ("a1", "o2"), ("a2", "o1"), ("a2", "gone"), ("a3", "gone"), ("a3", None)),
        "observation_techniques": frame("observation_id string, technique_id string", ("o1", "t1"), ("o2", "t1"), ("o1", None), ("o1", "t3"), ("gone", "t2"), (None, "t1")),
    })
    me = stix_export.Publisher()
    name = lambda kind, key: f"{kind}--{uuid.uuid5(me.namespace, f'{kind}:{key}')}"
    objects = stix_export.export_objects(graph, me).filter("type in ('attack-pattern', 'relationship')").select("actor_id", "type", "id")
    # a link to an unknown observation gives its technique but no use; an unknown or null technique is used but has no object
    want = [("a1", "attack-pattern", name("attack-pattern", "t1"))] * 2 + [("a2", "attack-pattern", name("attack-pattern", "t1"))] * 2
    want += [(a, "attack-pattern", name("attack-pattern", "t2")) for a in ("a2", "a3")]
    want += [(a, "relationship", t and name("relationship", f"{a}:{t}")) for a in ("a1", "a2") for t in ("t1", "t3", None)]
    assert sorted(map(tuple, objects.collect()), key=str) == sorted(want, key=str)
    final = objects._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?<!, )Exchange hashpartitioning\(actor_id#\d+, technique_id#\d+", final)) == 1
    support = {(r.actor_id, r.technique_id): (r.observations, r.created_at, r.updated_at)
               for r in stix_export.uses_support(graph, graph.actor_observations).collect()}
    assert support == {("a1", "t1"): (2, day, day + timedelta(1))} | {
        pair: (1, day, day) for pair in (("a1", None), ("a1", "t3"), ("a2", "t1"), ("a2", None), ("a2", "t3"))}


def test_techniques_of_observations_are_placed_by_observation(spark, tmp_path):
    spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, 7), (None, 7), (None, 7), (2, None)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = adapters.order_graph(spark, str(tmp_path)).observation_techniques
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [("ord-1", "part-7"), ("ord-1", "part-8"), ("ord-2", "part-7"), (None, "part-7"), ("ord-2", None)], key=str)
    assert found.groupBy("observation_id").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_only_groups_of_several_blocks_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_BLOCK_ROWS", 5)
    stored, keep = [], retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, label: stored.append(keep(df, label)) or stored[-1])
    day = datetime(2025, 4, 2)
    vector = [0.1, 0.7, -0.3]
    # "asked" has many candidates, "quiet" as many and no question, the others one of each; a null actor meets nothing
    cand = [(a, "m", 3, vector, day, f"e-{a}-{i}") for a, n in (("asked", 12), ("quiet", 12), (None, 2)) for i in range(n)]
    cand += [(f"a{i}", "m", 3, vector, day, f"e-a{i}") for i in range(40)]
    asked = [(f"q-{a}", a, "m", 3, vector, None, None) for a in ["asked", None, *[f"a{i}" for i in range(40)]]]
    c = spark.createDataFrame(cand, "actor_id string, embedding_model string, dimensions int, embedding array<float>, observed_at timestamp, evidence_id string")
    q = spark.createDataFrame(asked, "question_id string, actor_id string, embedding_model string, dimensions int, vector array<float>, date_from timestamp, date_to timestamp")
    got = {}
    for r in retrieval.nearest(q, c, limit=3, max_distance=2.0).collect():
        got.setdefault(r.question_id, set()).add(r.evidence_id)
    assert got.pop("q-asked") == {"e-asked-0", "e-asked-1", "e-asked-10"}
    assert got == {f"q-a{i}": {f"e-a{i}"} for i in range(40)}
    assert sorted(tuple(r) for r in stored[0].collect()) == [("asked", "m", 3, 1, 3), ("quiet", "m", 3, 0, 3)]


def test_stored_references_of_pairs_equal_the_lazy_ones(spark, monkeypatch):
    X = stix_export
    r = lambda table, *items: rows(spark, table, *items)
    graph = Graph(spark, {
        "sources": r("sources", {"id": "s", "name": "Desk"}),
        "observations": r("observations", *[{"id": f"o{k}", "source_id": "s", "source_native_id": "same" if k < 3 else None} for k in range(4)]),
        "evidence": r("evidence", {"id": "e", "source_id": "s", "citation": "Both"}, {"id": "f", "source_id": "s", "citation": "One"}, {"id": "g", "source_id": "s", "citation": "One"}),
        "observation_evidence": r("observation_evidence", *[{"observation_id": f"o{o}", "evidence_id": e} for o, e in ("0e", "1e", "1f", "1f", "1g", "3f")]),
        "observation_techniques": spark.createDataFrame([("o0", "t"), ("o1", "t"), ("o1", "t"), ("o1", "u"), ("o3", "u"), ("o3", None), (None, "t")], "observation_id string, technique_id string"),
    })
    links = spark.createDataFrame([("a", "o0"), ("a", "o1"), ("a", "o1"), ("a", "o3"), ("b", "o1"), (None, "o1"), ("b", "o2"), ("b", None), ("b", "gone")],
                                  "actor_id string, observation_id string")
    kept, keep = {}, X.materialize
    monkeypatch.setattr(X, "materialize", lambda df, label, *how: kept.setdefault(label, keep(df, label, *how)))
    got = sorted(map(str, X.uses_references(graph, links, stored=True).collect()))
    assert got == sorted(map(str, X.uses_references(graph, links).collect())) and len(got) == len(set(got)) == 21
    # references of one observation of an actor are multiplied without being compared: only a's come more than once
    assert kept["cited-again"].count() == 3 and kept["cited-references"].count() == 13
