"""Publication filter: a row is public only if it, its source and (for aliases) its actor are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUBLISHED = "published"


def own_published(df: DataFrame) -> DataFrame:
    """Missing state counts as internal."""
    return df.filter(F.col("publication_state") == PUBLISHED)


def published(
    df: DataFrame, sources: DataFrame | None = None, actors: DataFrame | None = None
) -> DataFrame:
    """Semi-joins only: never multiplies rows and carries no column of the other side.

    The source and actor sides are a filtered id list; Spark broadcasts them when their size
    statistics allow it and otherwise sort-merges with skew splitting.
    """
    rows = own_published(df)
    if sources is not None:
        ids = own_published(sources).select(F.col("id").alias("source_id"))
        rows = rows.join(ids, "source_id", "left_semi")
    if actors is not None:
        ids = own_published(actors).select(F.col("id").alias("actor_id"))
        rows = rows.join(ids, "actor_id", "left_semi")
    return rows
