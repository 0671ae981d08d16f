from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphs import rows, search_graph
from palisade.operators import artifacts, evaluate, postings, reads, search
from palisade.schemas import Graph

CASES = [
    ("Copper Lantern", {}, "actor", "Copper Lantern"),
    ("Amber Heron", {}, "alias", "Amber Heron"),
    ("Salt Marsh Campaign", {"entity_types": {"campaign"}}, "campaign", "Salt Marsh Campaign"),
    ("Macro Dropper", {"entity_types": {"behavior"}}, "behavior", "Macro Dropper"),
    ("T1137.006", {}, "technique", "Macro Loading"),
    ("invoice wave", {"entity_types": {"observation"}}, "observation", "Invoice fraud wave"),
    ('"forged invoice round"', {}, "observation", "Invoice fraud wave"),
    ("tidewater shelf", {"entity_types": {"source"}}, "source", "Orchard Lab"),
    ("campaign", {"entity_types": {"campaign"}, "source_id": "s2"}, "campaign", "Salt Marsh Campaign"),
    ("invoice outlook", {"intelligence_type": "assessed"}, "observation", "Invoice fraud outlook"),
    ("invoice", {"entity_types": {"observation"}, "date_from": datetime(2025, 7, 4)}, "observation", "Invoice fraud outlook"),
]


@pytest.mark.parametrize("query,filters,kind,title", CASES, ids=[c[0] for c in CASES])
def test_expected_hit_is_first(spark, query, filters, kind, title):
    asked = spark.createDataFrame([("q", query)], "query_id string, query string")
    cases = spark.createDataFrame([("q", kind, title)], "query_id string, expected_type string, expected_title string")
    hits = search.search(search_graph(spark), asked, **filters)
    verdict = evaluate.first_hit(cases, hits).first()
    assert verdict.passed, verdict
    if query in ("Copper Lantern", "Amber Heron", "T1137.006"):
        assert verdict.score >= 100


def test_internal_rows_stay_hidden(spark):
    asked = spark.createDataFrame([("a", "Quiet Lantern"), ("b", "Buried Heron"), ("c", "Quiet Heron"), ("d", "Invoice draft"), ("e", "Cellar Feed")], "query_id string, query string")
    assert search.search(search_graph(spark), asked).count() == 0


def test_matching_equals_brute_force(spark):
    texts = ["the cat sat on the mat", "a cat on a mat", "mat cat", "on the mat the cat", "cat cat cat", "dog"]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, t string").select(
        F.lit("x").alias("entity_type"), "id", F.array(postings.field(F.col("t"), "A")).alias("fields"))
    queries = {"cat mat": {0, 1, 2, 3}, '"on the mat"': {0, 3}, "cat -mat": {4}, "dog OR sat": {0, 5}, '"the cat" -sat': {3}, '"cat cat"': {4}, "-dog": set(), "cat -dog OR dog": {0, 1, 2, 3, 4, 5}}
    asked = spark.createDataFrame([(q, q) for q in queries], "query_id string, query string")
    hits = postings.match(postings.query_terms(asked, False, False), postings.postings(docs, False, False))
    got = {q: set() for q in queries}
    for r in hits.select("query_id", "id").collect():
        got[r.query_id].add(int(r.id[1:]))
    assert got == queries


def test_closer_words_rank_higher(spark):
    docs = spark.createDataFrame([("near", "alpha beta gamma"), ("far", "alpha x y z w v u beta")], "id string, t string").select(
        F.lit("x").alias("entity_type"), "id", F.array(postings.field(F.col("t"), "A")).alias("fields"))
    asked = spark.createDataFrame([("q", "alpha beta")], "query_id string, query string")
    ranks = {r.id: r.rank for r in postings.cover_rank(postings.match(postings.query_terms(asked), postings.postings(docs))).collect()}
    assert 0 < ranks["far"] < ranks["near"] < 1


def test_timeline_pages_nest_public_children(spark):
    graph = search_graph(spark)
    first = reads.timeline(graph, page_size=2).orderBy("position").collect()
    assert [(r.actor_id, r.observation_id, r.has_more) for r in first] == [("a1", "o3", True), ("a1", "o2", True)]
    last = first[-1]
    rest = reads.timeline(graph, page_size=2, after=(last.observed_at, last.observation_id)).collect()
    assert [(r.observation_id, r.has_more) for r in rest] == [("o1", False)]
    assert [e.id for e in rest[0].evidence] == ["e1"] and [t.id for t in rest[0].techniques] == ["t1"] and not rest[0].evidence_truncated


def test_associations_and_references(spark):
    graph = search_graph(spark)
    assert sorted((r.kind, r.id) for r in reads.associations(graph).collect()) == [("behavior", "b1"), ("technique", "t1")]
    refs = sorted((r.kind, r.id) for r in reads.references(graph).collect())
    assert refs == [("evidence", "e1"), ("source", "s1"), ("source", "s2")]


def test_actor_search_takes_five_aliases_before_removing_repeats(spark):
    names = ["Bear X", "Bear X", "Bear X", "Bear X", "Bear X", "Bear Y"]
    graph = Graph(spark, {
        "sources": rows(spark, "sources", *[{"id": f"s{i}", "name": f"s{i}", "kind": "k"} for i in range(6)]),
        "actors": rows(spark, "actors", {"id": "a", "canonical_name": "Big Bear", "normalized_name": "big bear"}),
        "aliases": rows(spark, "aliases", *[{"id": f"l{i}", "source_id": f"s{i}", "actor_id": "a", "name": n, "normalized_name": n.lower()} for i, n in enumerate(names)])})
    asked = spark.createDataFrame([("q", " BEAR"), ("r", "bear y"), ("bad", "\t")], "query_id string, query string")
    got = {r.query_id: (r.match_rank, r.matched_names) for r in reads.actor_search(graph, asked).collect()}
    assert got == {"q": (2, ["Big Bear", "Bear X"]), "r": (1, ["Bear Y"])}


def test_artifacts_validate_and_search(spark):
    import json

    good = {"type": "attack-pattern", "spec_version": "2.1", "id": "attack-pattern--1d9be2f4-77c3-4a58-8b16-0e4f2c9a6d35", "created": "x", "modified": "x",
            "name": "Macro Loading", "x_mitre_version": "1.4", "external_references": [{"source_name": "mitre-attack", "external_id": "T1137.006"}]}
    inner = {**good, "name": None}
    cases = [("stix_2_1", good, "valid"), ("attack_technique", good, "valid"), ("stix_2_1", {**good, "spec_version": "2.0"}, "invalid"),
             ("attack_technique", {**good, "external_references": []}, "invalid"), ("stix_2_1", {"type": "bundle", "id": "bundle--" + "a" * 36, "objects": [good]}, "valid"),
             ("stix_2_1", {"type": "bundle", "id": "bundle--" + "a" * 36, "objects": [inner]}, "invalid"), ("stix_2_1", [1], "invalid")]
    df = spark.createDataFrame([(i, "s", t, json.dumps(c)) for i, (t, c, _) in enumerate(cases)], "submission_id long, source_id string, artifact_type string, content string")
    got = artifacts.intake(df).orderBy("submission_id").collect()
    assert [r.validation_status for r in got] == [w for _, _, w in cases]
    assert (got[1].canonical_id, got[1].version, got[0].version) == ("T1137.006", "1.4", "2.1")
    assert got[4].derived_metadata == {"stix_type": "bundle", "object_count": "1"} and got[2].canonical_id.startswith("invalid:")


def test_pages_of_a_ranked_search_join_up(spark):
    asked = spark.createDataFrame([("q", "invoice")], "query_id string, query string")
    whole = search.search(search_graph(spark), asked).orderBy("position").collect()
    assert len(whole) >= 3 and not whole[0].has_more
    pages, after = [], None
    while True:
        page = search.search(search_graph(spark), asked, limit=2, after=after).orderBy("position").collect()
        pages += page
        if not page[-1].has_more:
            break
        after = tuple(page[-1][name] for name, _ in search.RESULT_ORDER)
    assert [(r.entity_type, r.id) for r in pages] == [(r.entity_type, r.id) for r in whole]


def test_cover_density_counts_minimal_covers(spark):
    """By hand: two words at 0 and 1 and again at 4 and 6; the covers are (0, 1), (1, 4) and (4, 6)."""
    hits = [(0, "A", 1), (1, "A", 2), (4, "A", 1), (6, "A", 2)]
    df = spark.createDataFrame([(hits,), ([],)], "hits array<struct<pos:int,weight:string,slot:bigint>>")
    got = [r.r for r in df.select(postings.cover_density(F.col("hits")).alias("r")).collect()]
    a = postings.WEIGHTS["A"]
    total = a / 1 + a / (1 + 2) + a / (1 + 1)
    assert abs(got[0] - total / (1 + total)) < 1e-12 and got[1] == 0.0


def test_cover_density_of_many_hits_equals_a_plain_sweep_in_linear_time(spark):
    """Two hits of a rare word around 20,000 of a frequent one: adding up every prefix of the hits would be quadratic."""
    import random
    import time

    rng = random.Random(5)
    weights = postings.WEIGHTS

    def plain(hits):
        total, begin = 0.0, -1
        slots = {h[2] for h in hits}
        for at in range(len(hits)):
            seen = [max((i for i in range(at + 1) if hits[i][2] == s), default=-1) for s in slots]
            first = min(seen)
            if first > begin:
                cost = sum(1 / weights[h[1]] for h in hits[first : at + 1])
                total += (at - first + 1) / cost / (1 + max(hits[at][0] - hits[first][0] - (at - first), 0))
                begin = first
        return total / (total + 1)

    small = [sorted((p, rng.choice("ABCD"), rng.randrange(1, 4)) for p in rng.sample(range(200), rng.randrange(1, 30))) for _ in range(40)]
    large = [(0, "A", 1), *[(p, "B", 2) for p in range(1, 20_000)], (20_000, "A", 1)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(small)], "i int, hits array<struct<pos:int,weight:string,slot:bigint>>")
    got = {r.i: r.r for r in df.select("i", postings.cover_density(F.col("hits")).alias("r")).collect()}
    assert all(abs(got[i] - plain(h)) < 1e-12 for i, h in enumerate(small))
    begun = time.time()
    one = spark.createDataFrame([(large,)], "hits array<struct<pos:int,weight:string,slot:bigint>>").select(postings.cover_density(F.col("hits")).alias("r")).first().r
    assert 0 < one < 1 and time.time() - begun < 30


def test_cover_rank_asks_for_segments_and_items_of_one_word(spark, monkeypatch, tmp_path):
    from palisade.plans import resolution

    tables = {
        "benchmark": ([(1, "Copper lantern glow here"), (2, "Heron."), (3, None)], "item_id long, text string"),
        "nation": ([(0, "NATION_0")], "n_nationkey int, n_name string"),
        "customer": ([(0, "FURNITURE"), (1, "FURNITURE"), (2, "BUILDING"), (3, None)], "c_custkey long, c_mktsegment string"),
    }
    for name, (made, schema) in tables.items():
        spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    texts = ["a copper lantern", "one heron", "furniture 12", "building furniture", "lantern glow here", "nation 0"]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, t string").select(
        F.lit("x").alias("entity_type"), "id", F.array(postings.field(F.col("t"), "A")).alias("fields"))
    monkeypatch.setattr(resolution, "_graph_index", lambda *_: postings.postings(docs))
    got = sorted((r.query_id, r.id) for r in resolution.cover_rank(spark, str(tmp_path)).collect())
    assert got == [("and-1", "d0"), ("and-2", "d1"), ("name-0", "d5"), ("phrase-1", "d4"),
                   ("segment-BUILDING", "d3"), ("segment-FURNITURE", "d2"), ("segment-FURNITURE", "d3")]
