"""Stored postings: same answers as a plain scan, only the folders of the words asked for, rebuilt when inputs change."""

import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from graphs import search_graph
from palisade.operators import postings, search
from palisade.sources import postings_index as store

WORDS = ["ash", "birch", "cedar", "elm", "fir"]


def documents(spark, n=120, seed=4):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12))) for _ in range(n)]
    rows = spark.createDataFrame([(f"d{k}", t if k % 9 else None) for k, t in enumerate(texts)], "id string, t string")
    fields = F.array(postings.field(F.col("t"), "A"), postings.field(F.lit("common ash"), "D"))
    return rows.select(F.lit("x").alias("entity_type"), "id", fields.alias("fields")), {f"d{k}": t if k % 9 else "" for k, t in enumerate(texts)}


QUERIES = {"and": "ash elm", "phrase": '"birch cedar"', "not": "ash -elm", "not phrase": 'cedar -"ash birch"', "or": "elm fir OR birch",
           "twice": '"ash ash"', "two phrases": '"ash elm" "cedar fir"', "only not": "-ash", "none": "oak", "dotted": "fir.ash"}


def plain(text):
    words = text.split() + ["common", "ash"]
    has = set(words).__contains__
    phrase = lambda *p: any(tuple(words[k : k + len(p)]) == p for k in range(len(words)))
    return {"and": has("ash") and has("elm"), "phrase": phrase("birch", "cedar"), "not": has("ash") and not has("elm"),
            "not phrase": has("cedar") and not phrase("ash", "birch"), "or": has("elm") and has("fir") or has("birch"),
            "twice": phrase("ash", "ash"), "two phrases": phrase("ash", "elm") and phrase("cedar", "fir"), "dotted": phrase("fir", "ash")}


@pytest.mark.parametrize("pushed", [0, 64])
def test_index_answers_like_a_scan(spark, tmp_path, monkeypatch, pushed):
    monkeypatch.setattr(store, "PUSHED", pushed)
    docs, texts = documents(spark)
    posted = postings.postings(docs, False, False)
    store.write_postings(posted, str(tmp_path / "ix"))
    index = store.PostingsIndex(spark, str(tmp_path / "ix"))
    asked = spark.createDataFrame(list(QUERIES.items()), "query_id string, query string")
    terms = postings.query_terms(asked, False, False)
    want = {(q, d) for d, t in texts.items() for q, ok in plain(t).items() if ok}
    by_index, by_scan = postings.match(terms, index), postings.match(terms, posted)
    assert {(r.query_id, r.id) for r in by_index.collect()} == want == {(r.query_id, r.id) for r in by_scan.collect()}
    hits = lambda rows: sorted((r.query_id, r.id, r.alt, sorted(map(tuple, r.hits))) for r in rows.collect())
    assert hits(by_index) == hits(by_scan)


def test_hits_are_the_positions_of_the_phrase(spark):
    docs, texts = documents(spark)
    asked = spark.createDataFrame([("p", '"ash elm" fir')], "query_id string, query string")
    found = postings.match(postings.query_terms(asked, False, False), postings.postings(docs, False, False)).collect()
    assert found
    for row in found:
        words = texts[row.id].split() + ["common", "ash"]
        pairs = [k for k in range(len(words) - 1) if words[k : k + 2] == ["ash", "elm"]]
        want = [*pairs, *[k + 1 for k in pairs], *[k for k, w in enumerate(words) if w == "fir"]]
        assert sorted(h.pos for h in row.hits) == sorted(k + 1 for k in want)


def test_lookup_opens_only_the_folders_of_its_words(spark, tmp_path):
    docs, _ = documents(spark)
    store.write_postings(postings.postings(docs, False, False), str(tmp_path / "ix"))
    terms = spark.createDataFrame([("elm",), ("elm",)], "term string")
    lists = store.PostingsIndex(spark, str(tmp_path / "ix")).lists(terms)
    text = lists._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", text) and "EqualTo(term,elm)" in text and "split(" not in text
    bucket = spark.range(1).select(store.bucket_of(F.lit("elm"))).first()[0]
    assert {re.search(r"bucket=(\d+)", f)[1] for f in lists.inputFiles()} >= {str(bucket)}
    assert {r["term"] for r in lists.collect()} == {"elm"}


def test_a_word_of_all_documents_is_spread_over_files(spark, tmp_path):
    rows = spark.range(20000).select(F.lit("x").alias("entity_type"), F.col("id").cast("string"), F.lit("hot").alias("term"),
                                     F.lit(1).alias("pos"), F.lit("A").alias("weight"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few here
    try:
        store.write_postings(rows, str(tmp_path / "ix"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = store.PostingsIndex(spark, str(tmp_path / "ix")).rows().groupBy(F.input_file_name()).count().collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(p["count"] for p in parts) < 10000


def test_search_by_index_equals_search_by_scan(spark, tmp_path):
    graph = search_graph(spark)
    asked = spark.createDataFrame([("a", "copper lynx"), ("b", "lynx"), ("c", "  LYNX "), ("d", "report"), ("e", "")], "query_id string, query string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_text("1")
    index = search.stored_index(graph, "test", [str(tmp_path / "in")])
    show = lambda rows: sorted(map(str, rows.collect()))
    assert show(search.search(graph, asked, index)) == show(search.search(graph, asked)) != []


def test_index_is_built_once_and_again_for_other_inputs(spark, tmp_path):
    docs, _ = documents(spark)
    source = tmp_path / "in"
    source.mkdir()
    (source / "x").write_text("1")
    calls = []

    def build():
        calls.append(1)
        return postings.postings(docs, False, False), None

    first = store.stored_postings(spark, "once", [str(source)], build)
    again = store.stored_postings(spark, "once", [str(source)], build)
    assert first.path == again.path and len(calls) == 1 and first.rows().count() > 0
    (source / "x").write_text("22")
    assert store.stored_postings(spark, "once", [str(source)], build).path != first.path and len(calls) == 2
    shutil.rmtree(source)


def test_positions_are_gathered_before_rows_move(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"term": ["a", "b", "a"], "entity_type": ["x"] * 3, "id": ["1", "1", "1"], "at": pa.array([4, 8, 12], pa.int32())})
    rows = [r for part in store._folded(iter([batch, batch])) for r in part.to_pylist()]
    assert sorted((r["term"], sorted(r["list"])) for r in rows) == [("a", [4, 4, 12, 12]), ("b", [8, 8])]
    monkeypatch.setattr(store, "FOLDED", 5)
    docs, _ = documents(spark)
    posted = postings.postings(docs.unionByName(docs.limit(7)), False, False)
    store.write_postings(posted, str(tmp_path / "ix"))
    got = {(r.term, r.id): r.list for r in store.PostingsIndex(spark, str(tmp_path / "ix")).rows().collect()}
    want = {}
    for r in posted.select("term", "id", postings.packed().alias("at")).collect():
        want.setdefault((r.term, r.id), []).append(r.at)
    assert got == {k: sorted(v) for k, v in want.items()}
    assert spark.conf.get("spark.sql.execution.useObjectHashAggregateExec") == "true"


def test_lists_of_the_index_move_once_by_document(spark, tmp_path):
    docs, _ = documents(spark)
    store.write_postings(postings.postings(docs, False, False), str(tmp_path / "ix"))
    asked = spark.createDataFrame([(f"q{k}", '"ash elm"') for k in range(50)], "query_id string, query string")
    found = postings.word_lists(postings.query_terms(asked, False, False), store.PostingsIndex(spark, str(tmp_path / "ix")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(entity_type#\d+, id#\d+, \d+\), REPARTITION_BY_COL", plan)


def test_stems_of_words_with_other_endings_stay(spark):
    words = ["cats", "class", "status", "thesis", "parties", "running", "ions", "markedly", "used", "quickly", "nation", "blue", "ash", "firm", "ing", "ly", "é", "x", "1", ""]
    want = ["cat", "class", "status", "thesis", "party", "runn", "ion", "mark", "used", "quick", "nat", "blu", "ash", "firm", "ing", "ly", "é", "x", "1", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(postings.light_stem(F.col("w"))).collect()] == want


@pytest.mark.parametrize("stemmed", [False, True])
def test_lists_of_whole_documents_equal_postings(spark, tmp_path, monkeypatch, stemmed):
    monkeypatch.setattr(store, "FOLDED", 9)
    docs, _ = documents(spark)
    odd = spark.createDataFrame([(None, "the cats of ash"), (None, "cat"), ("e", ""), ("f", None), ("g", "the of"), ("h", "elm " * 30)], "id string, t string").select(
        F.lit("x").alias("entity_type"), "id", F.array(postings.field(F.col("t"), "B"), postings.field(F.lit("ash"), "D")).alias("fields"))
    docs = docs.unionByName(docs.filter("id in ('d1', 'd2')")).unionByName(odd)
    exact = docs.select("entity_type", "id", F.array(F.col("id"), F.col("id"), F.lit("n")).alias("exact_keys"))
    store.write_postings(postings.postings(docs, stemmed, stemmed), str(tmp_path / "a"), exact)
    lists, names, again = postings.index_input(docs, stemmed, stemmed, exact)
    store.write_lists(lists, str(tmp_path / "b"), again, names)
    show = lambda at: sorted(map(str, spark.read.parquet(str(tmp_path / at)).select("term", "entity_type", "id", "list", "bucket").collect()))
    assert show("a") == show("b") and len(show("a")) > 300
    # nothing is put together for documents of one row
    assert lists.filter("id = 'h' and term = 'elm'").select(F.size("list")).first()[0] == 30
