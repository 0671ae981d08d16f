"""Top-k and keyset pages over a total order of any mix of directions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.operators.scale import Order, numbered, order_columns


def after_cursor(order: Order, cursor: Sequence) -> Column:
    """Rows that sort strictly after the cursor: an OR of ANDs, one term per order column."""
    if len(order) != len(cursor):
        raise ValueError("cursor must have one value per order column")
    found = F.lit(False)
    same = F.lit(True)
    for (name, ascending), value in zip(order, cursor):
        column, bound = F.col(name), F.lit(value)
        found = found | (same & (column > bound if ascending else column < bound))
        same = same & (column == bound)
    return found


def page(df: DataFrame, order: Order, limit: int, after: Sequence | None = None) -> DataFrame:
    """One page plus, if there is one, the row that proves another page follows.

    Plans as TakeOrderedAndProject: every task keeps ``limit + 1`` rows.
    """
    rows = df.filter(after_cursor(order, after)) if after is not None else df
    return rows.orderBy(*order_columns(order)).limit(limit + 1)


def page_with_more(
    df: DataFrame, order: Order, limit: int, after: Sequence | None = None
) -> DataFrame:
    """The page itself with ``position`` and ``has_more``; at most ``limit + 1`` rows are windowed."""
    rows = page(df, order, limit, after)
    window = Window.orderBy(*order_columns(order))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        rows.withColumn("position", F.row_number().over(window))
        .withColumn("has_more", F.count(F.lit(1)).over(whole) > limit)
        .filter(F.col("position") <= limit)
    )


def paginate_all(
    df: DataFrame,
    order: Order,
    page_size: int,
    group: Sequence[str] = (),
) -> DataFrame:
    """Page number and position of every row in one pass, per group or over the table."""
    rows = numbered(df, order, group, "_n")
    at = F.col("_n") - 1
    return rows.select(
        *df.columns,
        (F.floor(at / page_size) + 1).cast("bigint").alias("page"),
        (at % page_size + 1).cast("bigint").alias("position"),
    )


def late_top_k(keys: DataFrame, details: DataFrame, id_col: str, order: Order, k: int) -> DataFrame:
    """Rank on narrow key rows, then fetch the wide columns of the ``k`` winners only."""
    winners = keys.orderBy(*order_columns(order)).limit(k)
    return details.join(winners, id_col)


def scope_hash(filters: dict) -> str:
    """Binds a cursor to the filters it was made under; dates in UTC, sets sorted."""

    def plain(value):
        if isinstance(value, datetime):
            return value.astimezone(UTC).isoformat()
        if isinstance(value, (set, frozenset)):
            return sorted(value)
        return value

    encoded = json.dumps(
        {key: plain(value) for key, value in filters.items()},
        sort_keys=True,
        separators=(",", ":"),
    )
    return hashlib.sha256(encoded.encode()).hexdigest()
