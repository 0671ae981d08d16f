"""Scans of model tables with their declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from palisade.schemas import TABLES, Graph


def scan(spark: SparkSession, root: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Model table with its declared schema: no inference job, only the named columns are read."""
    df = spark.read.schema(TABLES[table]).parquet(f"{root}/{table}")
    return df.select(*columns) if columns else df


def load_graph(spark: SparkSession, root: str, tables: Sequence[str]) -> Graph:
    return Graph(spark, {name: scan(spark, root, name) for name in tables})
