"""Interval merge and binned range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _islands(df: DataFrame, keys: Sequence[str], touching: bool) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max("end").over(before)
    opens = F.coalesce(F.col("start") > reach if touching else F.col("start") >= reach, F.lit(True))
    numbered = df.withColumn("_opens", opens.cast("int")).withColumn("_island", F.sum("_opens").over(upto))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def merge_intervals(
    df: DataFrame, keys: Sequence[str], touching: bool = False, block: int = 1 << 20
) -> DataFrame:
    """Merge overlapping [start, end] rows of each key into (keys, start, end).

    Half-open reading: intervals that only touch stay apart unless ``touching``. Merging is
    associative, so the rows are folded three times, each with fewer rows: the widest interval
    per start (map-side combined), then the islands inside one stretch of ``block`` bases, then
    the islands of the whole key. A key that holds most of the rows is thereby spread over its
    stretches before it meets in one task.
    """
    keys = list(keys)
    widest = df.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    stretch = widest.withColumn("_block", F.floor(F.col("start") / block))
    local = _islands(stretch, [*keys, "_block"], touching)
    return _islands(local.drop("_block"), keys, touching)


FACTOR_BITS = 3  # bins of a level are eight times as wide as those of the one below
LEVELS = 12


def level_width(level: Column, width: int) -> Column:
    """How wide the bins of a level are."""
    return F.call_function("shiftleft", F.lit(width).cast("long"), (level * FACTOR_BITS).cast("int"))


def bin_level(start: Column, end: Column, width: int) -> Column:
    """The lowest level at which an interval touches two bins at most."""
    return sum(((end - start) > (width << (FACTOR_BITS * i))).cast("int") for i in range(LEVELS))


def _bins(start: Column, end: Column, level: Column, width: int) -> Column:
    size = level_width(level, width)
    return F.transform(F.sequence(F.floor(start / size), F.floor(end / size)), lambda b: F.struct(level.alias("level"), b.alias("bin")))


def range_join(
    probes: DataFrame,
    stored: DataFrame,
    on: Sequence[str],
    probe_range: tuple[str, str],
    stored_range: tuple[str, str],
    width: int,
) -> DataFrame:
    """Pairs whose closed ranges overlap, as an equi-join on (``on``, level, bin), each pair once.

    A stored interval lies at the level of its length, under one or two bins however long it is; a
    probe visits the bins it touches at the levels that are in use, one or two at each if it is no
    longer than ``width``. A pair is kept only in the first bin both sides share, which removes
    repeats without a distinct. Hot bins are left to the optimiser's skew handling, which splits
    either side. Rows without an end take no part.
    """
    low, high = (F.col(c) for c in probe_range)
    first, last = (F.col(c) for c in stored_range)
    placed = stored.filter(first <= last).withColumn("_level", bin_level(first, last, width))
    # a handful of numbers
    levels = placed.agg(F.collect_set("_level")).scalar()
    placed = placed.withColumn("_bin", F.explode(F.transform(_bins(first, last, F.col("_level"), width), lambda b: b["bin"])))
    visiting = probes.filter(low <= high).withColumn("_levels", levels)
    visiting = visiting.withColumn("_v", F.explode(F.flatten(F.transform("_levels", lambda level: _bins(low, high, level, width)))))
    visiting = visiting.select("*", F.col("_v.level").alias("_level"), F.col("_v.bin").alias("_bin")).drop("_levels", "_v")
    later = F.greatest(low, first)
    joined = visiting.join(placed, [*on, "_level", "_bin"]).filter(
        (low <= last) & (first <= high) & (F.col("_bin") == F.floor(later / level_width(F.col("_level"), width)))
    )
    return joined.drop("_level", "_bin")
