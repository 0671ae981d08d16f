"""Named queries and, where SQL can state the same result, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.plans.adapters import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, needs: tuple[str, ...] = ()):
    """Register a plan under a name; ``needs`` are the mapping CTEs its oracle reads."""

    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = sql(oracle, *needs)
        return fn

    return keep


def stamp(col: str | Column) -> Column:
    """Timestamps leave a query as text, so that both engines print the same."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def joined_ids(col: str, field: str = "id") -> Column:
    return F.coalesce(F.array_join(F.transform(col, lambda x: x.getField(field)), ","), F.lit(""))
