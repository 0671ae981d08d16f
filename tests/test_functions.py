import hashlib
import json
import uuid

from pyspark.sql import functions as F

from palisade.functions import ids, jsonx, text, times


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_names(spark):
    got = one(spark, ["  Meridian   Group ", "STRASSE", "straße", "Ａｂｃ", "\t", "a\x07b", "x" * 256], text.normalize_name)
    assert got == ["meridian group", "strasse", "strasse", "abc", None, None, None]


def test_filenames_keys_and_media_types(spark):
    names = ["..\\dir/Report ü.pdf", "con.txt", "  ...  ", "a" * 300]
    assert one(spark, names, text.sanitize_filename) == ["Report-.pdf", "_con.txt", "evidence", "a" * 255]
    keys = ["raw/a/b.json", "/raw/a", "raw/../a", "raw\\a", "raw/.hidden", ""]
    assert one(spark, keys, text.object_key_ok) == [True, False, False, False, False, False]
    assert one(spark, [" Text/HTML ", "text/html; charset=x", "x"], text.media_type) == ["text/html", None, None]


def test_uuid5_equals_standard_library(spark):
    names = ["a", "bundle:actor:é", "x" * 300, ""]
    assert one(spark, names, lambda c: ids.uuid5(uuid.NAMESPACE_DNS, c)) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_offset_is_mandatory(spark):
    values = ["2024-04-20T14:15:00+02:00", "2024-04-20T12:15:00Z", "2024-04-20T12:15:00", "2026-08-05", "soon Z"]
    got = one(spark, values, lambda c: times.utc_millis_text(times.offset_timestamp(c)))
    assert got == ["2024-04-20T12:15:00.000Z", "2024-04-20T12:15:00.000Z", None, None, None]


def test_strict_json_rejects_what_follows_a_value(spark):
    values = ['{"a":1}', '{"a":1}]', '{"a":1} x', "[1,2]", "nope", "", '1,"x"']
    got = one(spark, values, lambda c: jsonx.strict_json(c).isNotNull())
    assert got == [True, False, False, True, False, False, False]


def test_payload_hash_is_canonical(spark):
    texts = ['{"b": 1.50, "a": [1, null, "é"]}', '{"a":[1,null,"é"],"b":1.5}', '{"a": NaN}']
    want = hashlib.sha256(json.dumps(json.loads(texts[0]), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert one(spark, texts, jsonx.payload_sha256) == [want, want, None]


def test_merge_right_and_urls(spark):
    row = spark.range(1).select(
        jsonx.merge_right(F.expr("map('a','1','b','2')"), F.expr("map('b','3')")).alias("m"),
        F.array(*[jsonx.safe_url(F.lit(u)) for u in ("HTTPS://x.org/a", "ftp://x", "http:///p", "x")]).alias("u")).first()
    assert row.m == {"a": "1", "b": "3"} and row.u == ["HTTPS://x.org/a", None, None, None]


def test_open_intervals_overlap(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 1, 3), ("c", 7, None), ("d", None, 2)], "k string, f int, l int")
    hit = df.filter(times.overlaps(F.col("f"), F.col("l"), 3, 6)).select("k").collect()
    assert sorted(r.k for r in hit) == ["a", "b"]


def test_retry_delay_and_intent(spark):
    assert one(spark, [0, 1, 2, 5, 9, 60], lambda c: times.retry_delay_seconds(c, 30), "int") == [30, 30, 60, 480, 3600, 3600]
    questions = ["What changed at the dockside office?", "What evidence supports it?", "Who are they?", "source CHANGES"]
    assert one(spark, questions, text.classify_intent) == ["behavior_change", "evidence_support", "actor_overview", "behavior_change"]


def test_clean_strings_and_first_match(spark):
    df = spark.createDataFrame([([" b", "a ", "", None, "b"],), ([],), (None,)], "xs array<string>")
    got = df.select(jsonx.clean_strings(F.col("xs")).alias("c")).collect()
    assert [r.c for r in got] == [["a", "b"], [], None]
    pairs = spark.createDataFrame([([("k", 1), ("m", 2), ("m", 3)],)], "p array<struct<name:string,v:int>>")
    row = pairs.select(jsonx.first_match(F.col("p"), lambda x: x.getField("name") == "m", "v").alias("m"),
                       jsonx.first_match(F.col("p"), lambda x: x.getField("name") == "z", "v").alias("z")).first()
    assert (row.m, row.z) == (2, None)
