"""Change tables: the latest row of each key, lookups by touched folders, flat writes, replays after a crash."""

import os

import pytest
from pyspark.sql import functions as F

from palisade.sources.changes import ChangeTable
from palisade.streaming import jobs

SCHEMA = "k string, part int, value string, n bigint"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def shown(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def written(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_the_latest_batch_of_a_key_counts(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), SCHEMA, ["k", "part"], buckets=4)
    assert table.rows().collect() == [] and not table.done(0)
    table.write(rows(spark, [("a", 1, "old", 1), ("b", 1, None, None), (None, 1, "null key", 2), ("a", None, "other", 3)]), 0)
    table.write(rows(spark, [("a", 1, None, 9), (None, 1, "null key, new", 2)]), 1)
    table.write(rows(spark, []), 2)
    want = [("a", 1, None, 9), ("b", 1, None, None), (None, 1, "null key, new", 2), ("a", None, "other", 3)]
    assert shown(table.rows()) == sorted(map(repr, want)) and table.done(1) and table.done(2)
    assert shown(table.rows(before=1)) == sorted(map(repr, [("a", 1, "old", 1), ("b", 1, None, None), (None, 1, "null key", 2), ("a", None, "other", 3)]))
    some = spark.createDataFrame([(None, 1), ("a", 1), ("a", 1), ("z", 5)], "k string, part int")
    assert shown(table.rows(of=some)) == sorted(map(repr, [("a", 1, None, 9), (None, 1, "null key, new", 2)]))
    assert shown(table.rewritten(str(tmp_path / "u"), 2).rows()) == sorted(map(repr, want))
    table.write(rows(spark, [("a", 1, "again", 1)]), 1)
    assert ("a", 1, "again", 1) in [tuple(r) for r in table.rows().collect()] and table.rows().count() == 4


def test_a_lookup_opens_the_folders_of_its_keys(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=16)
    table.write(spark.range(200).selectExpr("cast(id as string) as k", "1 as part", "'x' as value", "id as n"), 0)
    one = table.rows(of=spark.createDataFrame([("7",)], "k string"))
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "bucket" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert [tuple(r) for r in one.collect()] == [("7", 1, "x", 7)]


def test_bytes_written_follow_the_batch(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=4)
    batch = lambda low, n: spark.range(low, low + n).selectExpr("cast(id as string) as k", "1 as part", "sha2(cast(id as string), 256) as value", "id as n")
    table.write(batch(0, 2000), 0)
    table.write(batch(500, 100), 1)
    table.write(batch(2000, 18000), 2)
    table.write(batch(500, 100), 3)
    first, second = written(tmp_path / "t" / "batch=1"), written(tmp_path / "t" / "batch=3")
    assert abs(first - second) < 0.2 * first < 0.2 * written(tmp_path / "t" / "batch=2") and table.rows().count() == 20000


def submissions(spark, data):
    return spark.createDataFrame([(i, s, bytearray(t.encode()), "text/plain") for i, s, t in data],
                                 "submission_id long, source_id string, content binary, mime_type string")


def test_intake_keeps_the_first_of_each_key_over_batches_and_replays(spark, tmp_path):
    step = jobs.EvidenceIntake(spark, str(tmp_path))
    batches = [[(1, "s", "a"), (2, "s", "a"), (3, "t", "a")], [(4, "s", "a"), (5, "s", "b")], [(6, "s", "b"), (7, "t", "c"), (8, "t", "")]]
    for batch_id, data in enumerate(batches):
        for _ in range(2):
            step(submissions(spark, data), batch_id)
    assert sorted(r.submission_id for r in step.known().collect()) == [1, 3, 5, 7]


def test_a_crash_between_two_writes_is_mended_by_the_replay(spark, tmp_path, monkeypatch):
    from tests.test_normalization import bundle, item, objects, raw

    contents = [bundle(item(1, name=f"v{i}", modified=f"2024-05-{5 + i:02d}T00:00:00Z")) for i in range(2)]
    batches = [objects(spark, c).withColumn("object_index", F.col("object_index").cast("int")) for c in contents]
    step = jobs.StreamingNormalization(spark, str(tmp_path), raw(spark))
    step(batches[0], 0)
    write = step.ledger.write

    def dies(rows_, batch_id):
        raise RuntimeError("lost")

    monkeypatch.setattr(step.ledger, "write", dies)
    with pytest.raises(RuntimeError, match="lost"):
        step(batches[1], 1)
    assert step.observations.done(1) and not step.ledger.done(1)
    monkeypatch.setattr(step.ledger, "write", write)
    step(batches[1], 1)
    clean = jobs.StreamingNormalization(spark, str(tmp_path / "clean"), raw(spark))
    for batch_id, batch in enumerate(batches):
        clean(batch, batch_id)
    assert [r.title for r in step.observations.rows().collect()] == ["v1"]
    assert shown(step.observations.rows()) == shown(clean.observations.rows()) and shown(step.ledger.rows()) == shown(clean.ledger.rows())
