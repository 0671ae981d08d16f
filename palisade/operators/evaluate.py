"""Evaluation of search and retrieval runs against expected results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_hit(cases: DataFrame, results: DataFrame) -> DataFrame:
    """``passed`` if the expected row of each case is the first result of its query.

    ``cases``: query_id, expected_type, expected_title; ``results``: query_id, position, ...
    """
    top = results.filter(F.col("position") == 1).select("query_id", "entity_type", "title", "score")
    same = (F.col("entity_type") == F.col("expected_type")) & (F.col("title") == F.col("expected_title"))
    return cases.join(top, "query_id", "left").withColumn("passed", F.coalesce(same, F.lit(False)))


def recall_at(expected: DataFrame, results: DataFrame, k: int, query: str, item: str) -> DataFrame:
    """Share of a query's expected items among its first ``k`` results."""
    shown = results.filter(F.col("position") <= k).select(query, item).distinct().withColumn("_hit", F.lit(True))
    return (
        expected.join(shown, [query, item], "left")
        .groupBy(query)
        .agg(F.count(F.lit(1)).alias("expected"), F.count_if("_hit").alias("found"))
        .withColumn("recall", F.col("found") / F.col("expected"))
    )


def exclusions_respected(excluded: DataFrame, results: DataFrame, query: str, item: str) -> DataFrame:
    """Excluded items that were returned all the same; empty when the run is clean."""
    return excluded.join(results.select(query, item).distinct(), [query, item], "left_semi")


def same_runs(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows present in one run only; empty when a repeat run is identical."""
    a = first.select(*keys).withColumn("_run", F.lit(1))
    b = second.select(*keys).withColumn("_run", F.lit(-1))
    return a.unionByName(b).groupBy(*keys).agg(F.sum("_run").alias("balance")).filter(F.col("balance") != 0)
