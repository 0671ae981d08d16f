"""Bundle files in byte ranges: the same objects as from the whole text, whatever the ranges and chunks."""

import json
import random

import pytest

from palisade.sources import bundle_ranges
from palisade.sources.stix_bundle import check_envelope, read_bundles, split_objects

UID = "0" * 36


def stix(rng, k):
    text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", "a", "é", "\n", ","]) for _ in range(rng.randrange(0, 60)))
    return {"type": "note", "id": f"note--{k:036d}", "content": text, "x": [{"y": {"z": [{}, text]}}, []]}


def files(rng):
    objects = [stix(rng, k) for k in range(40)]
    bundle = {"type": "bundle", "id": f"bundle--{UID}", "objects": objects}
    return {
        "plain": json.dumps(bundle), "spaced": json.dumps(bundle, indent=2, ensure_ascii=False) + "\n\n", "empty": json.dumps(bundle | {"objects": []}),
        "others": json.dumps({"x_list": [{"a": [1]}, {"b": 2}], "x_map": {"p": {"q": 1}, "r": 2}, **bundle, "x_after": [{"c": "}]"}], "x_deep": [[{"d": {}}, [{"e": 1}]], [[{}], {}]]}),
        "bad objects": json.dumps(bundle | {"objects": [{"type": "note", "id": "x"}, {"id": f"note--{UID}", "type": "tool"}, {}]}),
        "no objects": json.dumps({"type": "bundle", "id": f"bundle--{UID}"}), "no list": json.dumps(bundle | {"objects": {"a": {}}}),
        "cut": json.dumps(bundle)[:-1], "cut object": json.dumps(bundle)[:-40], "more": json.dumps(bundle) + "{}", "no json": "nothing", "nothing": "",
        "broken object": json.dumps(bundle).replace('"note"', '"note",,', 1), "id": json.dumps(bundle | {"id": "b"}), "type": json.dumps(bundle | {"type": "tool"}),
        "text": '"bundle"', "twice": '{"objects": [{"type": "note"}], ' + json.dumps(bundle)[1:],
    }


@pytest.mark.parametrize("chunk, split", [(1 << 20, 1 << 27), (1, 700), (300, 4000)])
def test_ranges_give_what_the_whole_text_gives(spark, tmp_path, monkeypatch, chunk, split):
    monkeypatch.setattr(bundle_ranges, "CHUNK", chunk)
    made = files(random.Random(chunk))
    for name, text in made.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    whole = check_envelope(read_bundles(spark, str(tmp_path)))
    objects = split_objects(whole, ["raw_path"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        heads, rows = bundle_ranges.read_split_bundles(spark, str(tmp_path))
        got_heads = {r.raw_path.rpartition("/")[2]: r.bundle_error for r in heads.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 128 << 20)
    columns = ["raw_path", "bundle_id", "object_index", "object_id", "object_type", "object_error"]
    # the whole reader gives payloads without their white space
    show = lambda df: sorted((*[str(r[c]) for c in columns], json.dumps(json.loads(r.payload))) for r in df.collect())
    want_heads = {r.raw_path.rpartition("/")[2]: r.bundle_error for r in whole.select("raw_path", "bundle_error").collect()}
    assert got_heads == {k: v for k, v in want_heads.items() if k != "nothing.json"}  # a file without bytes has no ranges
    assert show(rows) == show(objects) and rows.count() > 150


def test_a_file_goes_to_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    (tmp_path / "b.json").write_text(json.dumps({"type": "bundle", "id": f"bundle--{UID}", "objects": [stix(rng, k) for k in range(400)]}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        _, rows = bundle_ranges.read_split_bundles(spark, str(tmp_path))
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 128 << 20)
    assert sorted(r.object_index for r in rows.collect()) == list(range(400))
