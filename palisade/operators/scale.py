"""Building blocks that keep single groups, tasks and broadcasts bounded.

A plain window sends every row of a key to one task. The helpers here split a key that may hold a
large share of the data into pieces of bounded size, compute per piece, and combine piece totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.session import materialize

Order = Sequence[tuple[str, bool]]  # (column, ascending)


def order_columns(order: Order) -> list[Column]:
    return [F.col(name).asc() if asc else F.col(name).desc() for name, asc in order]


def top_n(df: DataFrame, by: Sequence[str], order: Order, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group.

    ``rank <= n`` plans a WindowGroupLimit before the shuffle (``configure`` lifts the optimizer's
    bound on n), so a hot group sends at most ``n`` rows per input task.
    """
    window = Window.partitionBy(*by).orderBy(*order_columns(order))
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def capped_children(
    df: DataFrame,
    parent: Sequence[str],
    order: Order,
    cap: int,
    fields: Sequence[str],
    name: str,
) -> DataFrame:
    """Per parent: the first ``cap`` children in order as an array, and a truncation flag.

    Children past ``cap + 1`` never reach the aggregation, so an array holds at most that many.
    """
    kept = top_n(df, parent, order, cap + 1, "_rank")
    packed = F.array_sort(
        F.collect_list(F.struct(F.col("_rank"), F.struct(*fields).alias("child")))
    )
    return (
        kept.groupBy(*parent)
        .agg(packed.alias("_packed"))
        .select(
            *parent,
            F.transform(F.slice("_packed", 1, cap), lambda x: x.getField("child")).alias(name),
            (F.size("_packed") > cap).alias(f"{name}_truncated"),
        )
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(right[key])
    return cond


def _combine(kind: str, before: Column, local: Column) -> Column:
    if kind == "max":
        return F.greatest(before, local)
    if kind == "min":
        return F.least(before, local)
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
    raise ValueError(f"unsupported running aggregate: {kind}")


_AGG = {"max": F.max, "min": F.min, "sum": F.sum}


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    values: dict[str, tuple[str, Column]],
    span: int = 1_000_000,
    levels: int = 1,
) -> DataFrame:
    """Running aggregates over the rows of a key that come strictly before the current one.

    ``seq`` is an integer, unique within the key. Rows are cut into chunks of ``span`` sequence
    numbers and the chunk totals are run up the same way, ``levels`` times. As long as ``seq`` spans
    no more than ``span ** (levels + 1)`` numbers, no window partition holds more than ``span``
    rows, whatever share of the table one key has.
    """
    chunk = f"_chunk{levels}"
    wide = df.withColumns({f"_v_{name}": expr for name, (_, expr) in values.items()})
    wide = wide.withColumn(chunk, F.floor(F.col(seq) / F.lit(span)))
    chunk_keys = [*keys, chunk]
    inside = Window.partitionBy(*chunk_keys).orderBy(seq).rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = wide.withColumns(
        {f"_l_{n}": _AGG[kind](f"_v_{n}").over(inside) for n, (kind, _) in values.items()}
    )
    totals = wide.groupBy(*chunk_keys).agg(
        *[_AGG[kind](f"_v_{n}").alias(f"_t_{n}") for n, (kind, _) in values.items()]
    )
    upper = {f"_b_{n}": (kind, F.col(f"_t_{n}")) for n, (kind, _) in values.items()}
    if levels > 1:
        run = running_before(totals, keys, chunk, upper, span, levels - 1)
    else:
        earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(
            Window.unboundedPreceding, -1
        )
        run = totals.withColumns(
            {name: _AGG[kind](expr).over(earlier) for name, (kind, expr) in upper.items()}
        )
    offsets = run.select(
        *[F.col(k).alias(f"_k_{k}") for k in chunk_keys], *[F.col(name) for name in upper]
    )
    cond = F.lit(True)
    for k in chunk_keys:
        cond = cond & local[k].eqNullSafe(offsets[f"_k_{k}"])
    joined = local.join(offsets, cond)
    return joined.select(
        *[joined[c] for c in df.columns],
        *[
            _combine(kind, F.col(f"_b_{n}"), F.col(f"_l_{n}")).alias(n)
            for n, (kind, _) in values.items()
        ],
    )


def numbered(
    df: DataFrame, order: Order, group: Sequence[str] = (), number: str = "row_number"
) -> DataFrame:
    """Exact 1-based row number, per group or over the whole table, without a single-task sort.

    The rows are range-partitioned on the full order (so one hot leading value is split as well),
    written once so that the ranges stay fixed, numbered inside each range, and shifted by the
    sizes of the earlier ranges. There are as many ranges as shuffle partitions.
    """
    staged = materialize(
        df.repartitionByRange(*order_columns(order)).withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    part_keys = [*group, "_part"]
    sizes = staged.groupBy(*part_keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *part_keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*part_keys).orderBy(*order_columns(order))
    local = staged.withColumn("_local", F.row_number().over(inside))
    renamed = offsets.select(
        *[F.col(k).alias(f"_k_{k}") for k in part_keys], F.col("_before")
    )
    cond = F.lit(True)
    for k in part_keys:
        cond = cond & local[k].eqNullSafe(renamed[f"_k_{k}"])
    return local.join(renamed, cond).select(
        *[local[c] for c in df.columns],
        (F.col("_before") + F.col("_local")).cast("bigint").alias(number),
    )


def nearest_rank(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    fractions: dict[str, float],
) -> DataFrame:
    """Nearest-rank percentiles: the value at position ``ceil(fraction * n)`` of each group.

    Equal values are counted first, so the numbered table has one row per distinct value.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    ordered = numbered(counted, [(value, True), *[(g, True) for g in group]], group, "_i")
    upto = running_before(ordered, group, "_i", {"_before": ("sum", F.col("_n"))})
    sizes = counted.groupBy(*group).agg(F.sum("_n").alias("_total"))
    cond = F.lit(True)
    for k in group:
        cond = cond & upto[k].eqNullSafe(sizes[k])
    ranked = upto.join(sizes, cond).select(
        *[upto[k] for k in group], value, "_before", "_n", "_total"
    )
    picks = []
    for name, fraction in fractions.items():
        target = F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("_total")))
        inside = (F.col("_before") < target) & (target <= F.col("_before") + F.col("_n"))
        picks.append(F.max(F.when(inside, F.col(value))).alias(name))
    return ranked.groupBy(*group).agg(*picks)
