import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.functions.text import normalize_name
from palisade.operators import intake, resolve, similarity

RULES = "normalized_alias string, actor_id string, confidence int, reason string, active boolean"


def mutate(rng, name):
    chars = list(name)
    for _ in range(rng.randrange(0, 5)):
        at = rng.randrange(len(chars) + 1)
        if rng.random() < 0.5 and chars:
            chars.pop(min(at, len(chars) - 1))
        else:
            chars.insert(at, rng.choice("abcdé 12"))
    return "".join(chars)


@pytest.mark.parametrize("threshold", [0.84, 0.93, 0.6])
def test_similarity_join_loses_nothing(spark, threshold):
    rng = random.Random(int(threshold * 100))
    base = ["".join(rng.choice("abcdé 12") for _ in range(rng.randrange(1, 26))) for _ in range(60)]
    left = sorted({mutate(rng, b) for b in base for _ in range(3)} - {""})
    right = sorted({mutate(rng, b) for b in base for _ in range(2)} - {""})
    pairs = similarity.similar_pairs(
        spark.createDataFrame([(x,) for x in left + left], "label string"), spark.createDataFrame([(x,) for x in right], "name string"), threshold)
    got = {(r.label, r.name): r.similarity for r in pairs.collect()}
    want = {(a, b): s for a in left for b in right if (s := SequenceMatcher(None, a, b).ratio()) >= threshold}
    assert got == want


def test_similarity_plan_is_an_equi_join(spark):
    rows = spark.createDataFrame([("alpha group",)], "label string")
    pairs = similarity.similar_pairs(rows, rows.withColumnRenamed("label", "name"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert re.search(r"(SortMergeJoin|HashJoin) .*_h#\d+L?, _salt#", plan)


def world(spark):
    actors = spark.createDataFrame(
        [("a1", "Meridian Group"), ("a2", "Silver Wolf East"), ("a3", "Silver Wolf West"), ("a4", "Other One")], "id string, canonical_name string"
    ).withColumn("normalized_name", normalize_name(F.col("canonical_name")))
    rules = spark.createDataFrame([("night lantern", "a1", 96, "reviewed", True), ("old name", "a1", 90, "x", False)], RULES)
    aliases = spark.createDataFrame(
        [("l1", "Meridian  Group", None, None), ("l2", "Night Lantern", None, None), ("l3", "Silver Wolf Nest", None, None),
         ("l4", "Shared Vendor Label", "a2", 80), ("l5", "Shared Vendor Label", "a3", 80), ("l6", "Shared Vendor Label", None, None),
         ("l7", "Lone Label", "a4", 70), ("l8", "Lone Label", None, None), ("l9", "Nobody At All", None, None), ("l10", "old name", None, None)],
        "id string, name string, actor_id string, confidence int").withColumn("normalized_name", normalize_name(F.col("name")))
    return actors, rules, aliases


def test_decisions(spark):
    actors, rules, aliases = world(spark)
    got = {r.alias_id: r for r in resolve.resolve(aliases, actors, rules).collect()}
    assert (got["l1"].method, got["l1"].actor_id, got["l1"].confidence) == ("exact_actor_name", "a1", 100)
    assert (got["l2"].method, got["l2"].confidence) == ("known_alias", 96) and got["l2"].reason.startswith("Curated known-alias rule:")
    assert got["l3"].method == "similarity_candidates" and {c.actor_id for c in got["l3"].candidates} == {"a2", "a3"}
    assert got["l3"].decision == "unresolved" and all(c.similarity >= 0.84 for c in got["l3"].candidates)
    assert got["l6"].method == "ambiguous_exact" and [c.actor_id for c in got["l6"].candidates] == ["a2", "a3"]
    assert got["l8"].method == "exact_candidates" and got["l8"].actor_id is None
    assert got["l9"].method == got["l10"].method == "no_match"
    assert got["l4"].method == "existing_link" and got["l4"].confidence == 80


def test_audit_is_idempotent(spark):
    actors, rules, aliases = world(spark)
    decisions = resolve.resolve(aliases, actors, rules)
    empty = spark.createDataFrame([], "alias_id string, decision_hash string")
    first = resolve.append_decisions(decisions, empty, 1)
    assert sorted(r.sequence for r in first.collect()) == list(range(1, 11))
    assert resolve.append_decisions(decisions, first, 11).count() == 0


def test_manual_corrections(spark):
    aliases = spark.createDataFrame([("l1", "a9")], "id string, actor_id string")
    asked = spark.createDataFrame(
        [("l1", 1, "a1", "r", 90, None, "u"), ("l1", 2, "a1", "r", 90, None, "u"), ("l1", 3, None, "r", 90, None, "u"), ("l1", 4, "a2", "r", None, None, "u")],
        "alias_id string, seq long, actor_id string, reason string, confidence int, evidence_id string, decided_by string")
    got = [(r.seq, r.previous_actor_id, r.decision, r.confidence, r.repeated)
           for r in resolve.manual_corrections(aliases, asked, span=2).orderBy("seq").collect()]
    assert got == [(1, "a9", "manual_link", 90, False), (2, "a1", "manual_link", 90, True), (3, "a1", "manual_unlink", None, False), (4, None, "manual_link", None, False)]


def test_registration_outcomes(spark):
    schema = "submission_id long, name string, kind string, base_url string, policy_notes string, license_name string, license_url string, metadata string"
    stored = spark.createDataFrame([(0, "old", "feed", None, None, None, None, "{}")], schema)
    batch = spark.createDataFrame(
        [(1, "old", "feed", None, None, None, None, "{}"), (2, "old", "feed", "u", None, None, None, "{}"),
         (3, "new", "a", None, None, None, None, None), (4, "new", "a", None, None, None, None, None), (5, "new", "b", None, None, None, None, None)], schema)
    got = {r.submission_id: r.outcome for r in intake.register_sources(batch, stored).collect()}
    assert got == {1: "duplicate", 2: "conflict", 3: "created", 4: "duplicate", 5: "conflict"}


def test_query_of_similar_titles_keeps_every_title(spark, tmp_path):
    from palisade.plans.resolution import similar_candidates as asked

    long = "".join(random.Random(3).choice("abcdefgh ") for _ in range(400)) + "x"
    titles = ["Москва сегодня утром", "Москва сегодня  утром", "Crème brûlée À LA carte", "crème brûlée à la cartes", "x", long, long + "y", "", "東京都庁舎案内"]
    rows = [(k, f"<html><title>{t}</title></html>") for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.alias_id, r.actor_id): r.similarity for r in asked(spark, str(tmp_path)).collect()}
    names = {k: " ".join(t.casefold().split()) for k, t in enumerate(titles) if t}
    first = {}
    for k, n in names.items():
        first.setdefault(n, k)
    want = {(f"alias-{k}", f"actor-{a}"): round(s, 6) for k, n in names.items() for m, a in first.items()
            if (s := SequenceMatcher(None, n, m).ratio()) >= 0.84}
    assert got == want and len(names) == 8


@pytest.mark.parametrize("threshold", [0.84, 0.6])
def test_names_that_share_their_tokens_are_compared_in_blocks(spark, monkeypatch, threshold):
    rng = random.Random(11)
    words = ["the", "thing", "tion", "and", "shan", "er", "Ünder", "ing "]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(40)] + ["x", "𝄞y", "the " * 40]
    left, right = (sorted({mutate(rng, b) for b in base for _ in range(2)} - {""}) for _ in range(2))
    monkeypatch.setattr(similarity, "FEW_PAIRS", 0)
    monkeypatch.setattr(similarity, "BLOCK_NAMES", 7)
    monkeypatch.setattr(similarity, "PAIRS_PER_TASK", 1000)
    pairs = similarity.similar_pairs(
        spark.createDataFrame([(x,) for x in left + left], "label string"), spark.createDataFrame([(x,) for x in right], "name string"), threshold)
    got = [(r.label, r.name, r.similarity) for r in pairs.collect()]
    want = {(a, b, s) for a in left for b in right if (s := SequenceMatcher(None, a, b).ratio()) >= threshold}
    assert len(got) == len(want) and set(got) == want
    plan = pairs._jdf.queryExecution().toString()
    assert "_salt" not in plan
    # work is dealt out by pairs, however few bytes the names have
    assert len({r[0] for r in pairs.select(F.spark_partition_id()).collect()}) > 1


def test_pairs_are_held_against_common_characters_before_they_are_compared():
    rng = random.Random(2)
    names = sorted({"".join(rng.choice("abcdefgh Ü東") for _ in range(rng.randrange(1, 66))) for _ in range(60)} | {"x" * 64, "x" * 65, "東Ü"})
    p, q = (np.repeat(np.arange(len(names)), len(names)), np.tile(np.arange(len(names)), len(names)))
    bound = similarity._common_bound(p, q, similarity._placed_chars(names), similarity._coded_chars(names))
    for i, j, most in zip(p, q, bound):
        a, b = names[i], names[j]
        assert most == (similarity._longest_common(a, b) if max(len(a), len(b)) <= 64 else float("inf"))
    # the same characters in another order share their bigrams and characters, but no long run
    a, b = ["ab" * 10 + "cd" * 10 + "ef" * 10], ["ef" * 10 + "cd" * 10 + "ab" * 10]
    assert sum(len(x) for x, _ in similarity._share_tokens(a, b, 0.84, 2)) == 0
    assert sum(len(x) for x, _ in similarity._share_tokens(a, a, 0.84, 2)) == 1
