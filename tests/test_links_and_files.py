"""Advisory links, blobs as files and late stream rows."""

import hashlib
from datetime import datetime

from palisade.operators import advisories, integrity
from palisade.schemas import Graph
from palisade.sources import blobs
from palisade.streaming import jobs
from tests.graphs import T0, rows


def _graph(spark):
    links = lambda table, *pairs: spark.createDataFrame(list(pairs), Graph(spark).__getattr__(table).schema)
    return Graph(spark, {
        "advisories": rows(spark, "advisories", {"id": "a1", "slug": "one", "status": "published", "published_revision": 2, "published_at": T0},
                           {"id": "a2", "slug": "two", "status": "draft"}),
        "advisory_revisions": rows(spark, "advisory_revisions", *[
            {"id": f"r{v}", "advisory_id": "a1", "version": v, "title": f"v{v}", "summary": "s", "published_at": T0 if v < 3 else None} for v in (1, 2, 3)],
            {"id": "r9", "advisory_id": "a2", "version": 1, "title": "draft", "summary": "s", "published_at": T0}),
        "advisory_updates": rows(spark, "advisory_updates", *[{"id": f"u{n}", "advisory_id": "a1", "revision_id": "r2", "sequence": n, "title": "t"} for n in (1, 2, 3)]),
        "revision_evidence": links("revision_evidence", ("r1", "e1"), ("r2", "e3"), ("r2", "e2"), ("r2", "e2"), ("r2", "e1"), ("r9", "e1")),
        "revision_actors": links("revision_actors", ("r1", "x1")),
        "update_evidence": links("update_evidence", ("u1", "e1"), ("u3", "e5"), ("u3", "e4")),
    })


def test_current_revision_carries_its_links_and_those_of_its_updates(spark):
    (row,) = advisories.linked_detail(_graph(spark), updates=2, links=2).collect()
    assert (row.advisory_id, row.version, row.evidence, row.actors, row.links_truncated) == ("a1", 2, ["e1", "e2"], [], True)
    assert [(u.sequence, u.evidence_ids) for u in row.updates] == [(2, []), (3, ["e4", "e5"])]


def test_historic_revisions_were_published_and_keep_their_own_links(spark):
    found = {r.version: r for r in advisories.historic(_graph(spark)).collect()}
    assert sorted(found) == [1, 2] and not found[1].current and found[2].current
    assert (found[1].evidence, found[1].actors, found[1].campaigns) == (["e1"], ["x1"], [])
    assert found[2].evidence == ["e1", "e2", "e3"] and not found[2].links_truncated
    asked = spark.createDataFrame([("a1", 3), ("a1", 1), ("a2", 1)], "advisory_id string, version int")
    assert [r.version for r in advisories.historic(_graph(spark), asked).collect()] == [1]


def test_files_are_written_listed_and_hashed_in_streams(spark, tmp_path):
    big = b"z" * (3 << 20) + b"!"
    content = spark.createDataFrame([("raw/a/1", bytearray(b"one")), ("raw/b/2", bytearray(big)), ("raw/c", bytearray(b""))], "storage_key string, content binary")
    for _ in range(2):  # storing again changes nothing
        assert {r.storage_key: r.blob_size for r in blobs.write_blobs(content, str(tmp_path)).collect()} == {"raw/a/1": 3, "raw/b/2": len(big), "raw/c": 0}
    refs = spark.createDataFrame([("x", "raw/a/1", hashlib.sha256(b"one").hexdigest(), 3), ("y", "raw/c", hashlib.sha256(b"").hexdigest(), 0),
                                  ("z", "raw/none", "0", None), ("n", None, "0", None)],
                                 "raw_evidence_id string, storage_key string, content_sha256 string, content_size_bytes long")
    held = blobs.streamed_hashes(spark, str(tmp_path), references=refs)
    assert {r.storage_key: r.blob_sha256 for r in held.collect()} == {
        "raw/a/1": hashlib.sha256(b"one").hexdigest(), "raw/b/2": hashlib.sha256(big).hexdigest(),
        "raw/c": hashlib.sha256(b"").hexdigest(), "raw/none": None}
    kinds = {r.storage_key: r.kind for r in integrity.reconcile(refs, held).collect()}
    assert kinds == {"raw/a/1": "verified", "raw/b/2": "orphaned", "raw/none": "missing", "raw/c": "verified"}


def test_late_rows_are_counted_once_also_after_a_replay(spark, tmp_path):
    at = lambda hour, minute=0: (datetime(2025, 1, 1, hour, minute),)
    batch = lambda *items: spark.createDataFrame(list(items), "ts timestamp")
    step = jobs.LateRows(spark, str(tmp_path), "ts", "1 hour", "30 minutes")
    step(batch(at(1), at(2, 10)), 0)
    step(batch(at(0, 5), at(1, 50), at(5), (None,)), 1)  # the watermark stands at 01:40
    late = batch(at(0, 7), at(3, 1), at(4, 59))  # now at 04:30
    step(late, 2)
    step(late, 2)
    got = {r.window_start.hour: r.late for r in step.total().collect()}
    assert got == {0: 2, 3: 1}


def test_a_file_is_written_by_many_tasks(spark, tmp_path):
    lines = [("b/one.txt" if k % 3 else "a+%2F/two.txt", k, f"é line {k} " + "x" * (k % 50)) for k in range(3000)]
    rows = spark.createDataFrame(lines, "file string, place long, line string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blobs.write_lines(rows, f"file://{tmp_path}")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for name in ("b/one.txt", "a+%2F/two.txt"):
        assert (tmp_path / name).read_text() == "".join(f"{x}\n" for f, _, x in lines if f == name)


def test_listing_stays_in_tasks_and_passes_over_hidden_and_empty_files(spark, tmp_path):
    for name in ("raw/a/b/1", "raw/2", "raw/.x/3", "raw/_y", "raw/_k=1/4", "raw/none", "other/5"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name.endswith("none") else b"x")
    got = blobs.list_blobs(spark, str(tmp_path))
    assert sorted(r.storage_key for r in got.collect()) == ["raw/2", "raw/_k=1/4", "raw/a/b/1"]
    assert sorted(r.storage_key for r in blobs.scan_blobs(spark, str(tmp_path)).select("storage_key").collect()) == ["raw/2", "raw/_k=1/4", "raw/a/b/1"]
