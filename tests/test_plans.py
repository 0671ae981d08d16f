"""Plan guards on registered queries, and a sample of oracle comparisons at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from graphs import search_graph
from palisade.operators import reads
from palisade.operators.visibility import published
from palisade.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["actor_timeline", "associations", "intake_dedup", "version_fold", "exact_evidence", "vector_topk", "stix_objects", "uses_support"])
def test_no_nested_loops(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_n_is_limited_before_the_shuffle(spark):
    for name in ("actor_timeline", "top_events_per_user", "vector_topk"):
        assert "WindowGroupLimit" in plan(entry.queries()[name](spark, SF))


def test_scans_prune_and_push(spark):
    text = plan(entry.queries()["keyset_page"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderpriority:string>" in text and "o_totalprice" in text
    assert "PushedFilters: [Or(" in text


def test_model_tables_push_the_visibility_filter(spark, tmp_path):
    for name in ("observations", "sources"):
        getattr(search_graph(spark), name).write.parquet(str(tmp_path / name))
    seen = tables.scan(spark, str(tmp_path), "observations")
    shown = published(seen, tables.scan(spark, str(tmp_path), "sources")).select("id")
    text = plan(shown)
    assert "EqualTo(publication_state,published)" in text and "summary" not in text
    assert shown.count() == 3


def test_entry_is_the_timeline(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["actor_timeline", "state_transitions", "exact_resolution", "search_phrase", "context_budget", "stix_bundles", "sessions", "normalization_outcomes"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def tidy(frame):
        def cell(value):
            if pd.isna(value):
                return "~"
            return f"{value:.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)

        return sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).values.tolist())

    assert tidy(got) == tidy(want)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_actor_search_normalizes_its_queries_once(spark):
    asked = spark.createDataFrame([("q", "ámber")], "query_id string, query string")
    assert "ArrowEvalPython" not in plan(reads.actor_search(search_graph(spark), asked))


def test_graph_retrieval_joins_the_evidence_of_asked_actors_only(spark, monkeypatch, tmp_path):
    from palisade.plans import retrieval

    for name in TABLES:
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        (rows.filter("vec_id < 20") if name == "embeddings" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    held, candidates = [], retrieval.V.candidates
    monkeypatch.setattr(retrieval.V, "candidates", lambda graph, ids: held.append((graph, ids)) or candidates(graph, ids))
    retrieval.graph_retrieval(spark, str(tmp_path))
    (graph, ids), whole = held[0], retrieval.A.order_graph(spark, str(tmp_path))
    reached = whole.actor_observations.join(ids, "actor_id", "left_semi").join(whole.observation_evidence, "observation_id").select("evidence_id").distinct()
    assert sorted(r[0] for r in graph.evidence.select("id").distinct().collect()) == sorted(r[0] for r in reached.collect())
    assert graph.observation_evidence.count() < whole.observation_evidence.count()
