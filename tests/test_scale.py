import random
from math import ceil

import pytest
from pyspark.sql import functions as F

from palisade.operators import paging, scale
from palisade.operators.quality import illegal_transitions


@pytest.mark.parametrize("span,levels", [(3, 1), (4, 3), (1000, 1)])
def test_running_before_equals_a_loop(spark, span, levels):
    rng = random.Random(span)
    seqs = rng.sample(range(400), 240)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), s, rng.randrange(50)) for s in seqs]
    df = spark.createDataFrame(rows, "k string, seq long, v int")
    got = scale.running_before(
        df, ["k"], "seq", {"m": ("max", F.struct("v", "seq")), "s": ("sum", F.col("v")), "lo": ("min", F.col("v"))}, span, levels)
    seen, want = {}, {}
    for k, s, v in sorted(rows, key=lambda r: r[1]):
        past = seen.setdefault(k, [])
        want[(k, s)] = (max(((x, t) for t, x in past), default=None), sum(x for _, x in past), min((x for _, x in past), default=None))
        past.append((s, v))
    out = {(r.k, r.seq): (tuple(r.m) if r.m else None, r.s, r.lo) for r in got.collect()}
    assert out == want


def test_numbering_by_ranges_equals_one_sort(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([7, 7, 7, 7, rng.randrange(20)]), rng.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, score int, g string")
    order = (("score", False), ("id", True))
    whole = {r.id: r.n for r in scale.numbered(df, order, number="n").collect()}
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert whole == want
    grouped = {r.id: r.n for r in scale.numbered(df, order, ["g"], "n").collect()}
    for g in "ab":
        mine = sorted((r for r in rows if r[2] == g), key=lambda r: (-r[1], r[0]))
        assert [grouped[r[0]] for r in mine] == list(range(1, len(mine) + 1))


def test_nearest_rank(spark):
    rng = random.Random(9)
    data = {g: [rng.randrange(30) / 2 for _ in range(n)] for g, n in (("a", 1), ("b", 20), ("c", 333))}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in scale.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for g, vs in data.items():
        ordered = sorted(vs)
        assert got[g] == tuple(ordered[ceil(p * len(vs)) - 1] for p in (0.5, 0.95))


def test_children_are_capped_before_collection(spark):
    df = spark.createDataFrame([("p", i) for i in range(9)] + [("q", 1)], "parent string, c int")
    out = scale.capped_children(df, ["parent"], (("c", False),), 3, ["c"], "kids")
    got = {r.parent: ([x.c for x in r.kids], r.kids_truncated) for r in out.collect()}
    assert got == {"p": ([8, 7, 6], True), "q": ([1], False)}
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_pages_concatenate_to_the_whole(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), rng.choice("xyz")) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, score int, t string")
    order = (("score", False), ("t", True), ("id", True))
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[2], r[0]))]
    got, cursor = [], None
    while True:
        page = paging.page(df, order, 7, cursor).collect()
        got += [r.id for r in page[:7]]
        if len(page) <= 7:
            break
        cursor = (page[6].score, page[6].t, page[6].id)
    assert got == want
    whole = paging.paginate_all(df, order, 7).collect()
    assert [r.id for r in sorted(whole, key=lambda r: (r.page, r.position))] == want
    assert "TakeOrderedAndProject" in paging.page(df, order, 7)._jdf.queryExecution().executedPlan().toString()


def test_transitions(spark):
    log = spark.createDataFrame(
        [("a", 1, "pending"), ("a", 2, "processing"), ("a", 3, "failed"), ("a", 4, "processing"), ("b", 1, "succeeded")],
        "k string, seq long, state string")
    bad = illegal_transitions(log, ["k"], "seq", "state", span=2).collect()
    assert sorted((r.k, r.seq, r.previous_state) for r in bad) == [("a", 4, "failed"), ("b", 1, None)]


def test_scope_hash_ignores_set_order():
    from datetime import UTC, datetime, timedelta, timezone

    at = datetime(2026, 1, 1, tzinfo=UTC)
    same = [paging.scope_hash({"q": "x", "kinds": kinds, "from": when})
            for kinds, when in (({"a", "b"}, at), ({"b", "a"}, at.astimezone(timezone(timedelta(hours=5)))))]
    assert same[0] == same[1] != paging.scope_hash({"q": "x", "kinds": {"a"}, "from": at})


def test_generated_inputs_have_the_asked_size(spark):
    from palisade.sources import generated
    from palisade.sources.stix_bundle import check_envelope, split_objects

    objects = split_objects(check_envelope(generated.intrusion_set_bundles(spark, 3, 4)), ["raw_evidence_id"])
    assert objects.filter("object_error is null").select("object_id").distinct().count() == 12
    graph = generated.graph(spark, 5, observations_per_actor=3)
    assert (graph.actors.count(), graph.observations.select("id").distinct().count(), graph.evidence.count()) == (5, 15, 0)
