"""Running totals over a whole ordering, and exact order statistics, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1 << 10  # ranges of an order; the only rows that one task sees of a whole table
_STEPS = [1 << i for i in reversed(range(RANGES.bit_length() - 1))]


def in_ranges(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add the number of the row's range, which grows with ``order`` and depends on the row alone.

    The bounds are the keys of ``RANGES - 1`` rows with the smallest hashes, a subquery of the plan: they
    are the same whenever it runs, so no rows have to be stored for a range to keep its number, and no
    job runs while the query is built. A range is found by bisection.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.withColumn("_key", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(keys))))
    sample = keyed.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(RANGES - 1)
    bounds = sample.agg(F.array_sort(F.collect_list("_key"))).scalar()
    placed = keyed.withColumns({"_bounds": bounds, name: F.lit(0)})
    # a column per step is compiled; as a function over the list of steps it takes a hundred times as long
    for by in _STEPS:
        at = F.col(name)
        placed = placed.withColumn(name, F.when(F.get("_bounds", at + (by - 1)) <= F.col("_key"), at + by).otherwise(at))
    return placed.drop("_key", "_bounds")


def running_before(df: DataFrame, order: Sequence[Column | str], totals: dict[str, Column]) -> DataFrame:
    """Add, for each ``name: value``, the sum of ``value`` over all rows ordered before the row.

    ``order`` must be a total order. The rows are dealt over its ranges; the totals of the ranges (one
    row each) are accumulated and joined back. Only that table is ever seen by a single task.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = in_ranges(df, order, "_range").repartition("_range")
    names = list(totals)
    per_range = dealt.groupBy("_range").agg(*[F.sum(totals[n]).alias(f"_t_{n}") for n in names])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_range.select(
        "_range", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in names]
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # RANGES rows at most
    joined = dealt.join(F.broadcast(carry), "_range")
    for name in names:
        local = F.coalesce(F.sum(totals[name]).over(inside), F.lit(0))
        joined = joined.withColumn(name, local + F.col(f"_c_{name}"))
    return joined.drop("_range", *[f"_c_{n}" for n in names])


def running_before_by(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column]
) -> DataFrame:
    """``running_before`` restarted at each key: the running total minus its value at the key's first row."""
    ranked = running_before(df, [*keys, *order], totals)
    first = ranked.groupBy(*keys).agg(*[F.min(n).alias(f"_f_{n}") for n in totals])
    joined = ranked.join(first, list(keys))
    for name in totals:
        joined = joined.withColumn(name, F.col(name) - F.col(f"_f_{name}"))
    return joined.drop(*[f"_f_{n}" for n in totals])


def following(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int, distinct: bool = False) -> DataFrame:
    """Add ``_next``, the struct of ``order`` of the key's next row; with ``distinct``, of the rows without their repeats.

    The lead runs inside stretches of ``width`` positions of the first order column; the last
    row of a stretch takes the head of the key's next stretch, found on one row per stretch.
    """
    keys, order = list(keys), list(order)
    position = F.struct(*order)
    blocked = df.withColumn("_block", F.floor(F.col(order[0]) / width))
    for key in [*keys, "_block"]:  # rows without a key meet no head; told here, both sides of the join read the same rows
        blocked = blocked.filter(F.col(key).isNotNull())
    if distinct:  # repeats lie in one stretch, where the rows are needed next
        blocked = blocked.repartition(*keys, "_block").distinct()
    local = blocked.withColumn("_next", F.lead(position).over(Window.partitionBy(*keys, "_block").orderBy(*order)))
    heads = blocked.groupBy(*keys, "_block").agg(F.min(position).alias("_head"))
    heads = heads.withColumn("_after", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_head")
    joined = local.join(heads, [*keys, "_block"])
    return joined.withColumn("_next", F.coalesce("_next", "_after")).drop("_block", "_after")


def exact_median(df: DataFrame, value: str) -> Column:
    """Scalar subquery: the median, averaging the two middle values, from counts per distinct value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_before(counts, [value], {"_before": F.col("_n")})
    total = ranked.agg(F.sum("_n")).scalar()
    low = F.floor((total - 1) / 2)
    high = F.floor(total / 2)
    covers = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    middle = ranked.agg(
        ((F.max(F.when(covers(low), F.col(value))) + F.max(F.when(covers(high), F.col(value)))) / 2).alias("m")
    )
    return middle.scalar()


def running_in_blocks(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], totals: dict[str, Column]
) -> DataFrame:
    """Per key, the sum of each total over the rows ordered before the row, spread over ``block``.

    ``block`` must grow with ``order``. The running sums run inside (key, block); what the
    earlier blocks of the key hold comes from one row per block.
    """
    keys, order = list(keys), list(order)
    blocked = df.withColumn("_block", block)
    per_block = blocked.groupBy(*keys, "_block").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(*keys, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in totals])
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in totals.items()})
    joined = local.join(carry, [*keys, "_block"])
    return joined.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in totals}).drop("_block", *[f"_c_{n}" for n in totals])


def least_from_here(df: DataFrame, position: str, value: Column, name: str, block: int = 1 << 16) -> DataFrame:
    """Add the minimum of ``value`` over the row and all later ones in ``position`` (0, 1, 2, ...).

    Blocks of ``block`` positions are scanned on their own; the minimum of the later blocks comes
    from one row per block.
    """
    blocked = df.withColumns({"_block": F.floor(F.col(position) / block), "_v": value})
    later = Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    # one row per block of positions
    carry = blocked.groupBy("_block").agg(F.min("_v").alias("_m")).select("_block", F.min("_m").over(later).alias("_after"))
    inside = Window.partitionBy("_block").orderBy(position).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    joined = blocked.withColumn("_here", F.min("_v").over(inside)).join(carry, "_block")
    return joined.withColumn(name, F.least("_here", "_after")).drop("_block", "_v", "_here", "_after")
