"""Work on PSI values in long form (cell_id, event_id, psi); NULL means not quantified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introna.functions.columns import hash_fraction
from introna.functions.normal import normal_sf
from introna.session import stored


def first_values(summary: DataFrame, order: str) -> DataFrame:
    """(event_id, cell_id, psi, first_seen): the first non-missing value in ``order`` per cell and event.

    The sample id is cut at its first dot. Rows that already lie together by event, as those of a PSI table do,
    are summed up where they are.
    """
    cut = summary.withColumn("cell_id", F.substring_index("sample_id", ".", 1))
    return cut.groupBy("event_id", "cell_id").agg(
        F.min(F.when(F.col("psi").isNotNull(), F.struct(order, "psi"))).getField("psi").alias("psi"),
        F.min(order).alias("first_seen"),
    )


def psi_matrix(summary: DataFrame, cells: DataFrame, order: str) -> DataFrame:
    """First value per (cell, event) of the metadata's cells; a cell without values keeps one NULL row.

    The rows are stored, so that the cells without any are told from the ids alone and only the list of
    cells, not the rows, need travel.
    """
    listed = cells.select("cell_id")
    found = stored(first_values(summary, order).join(listed, "cell_id").select("cell_id", "event_id", "psi", "first_seen"))
    empty = listed.join(found.select("cell_id").distinct(), "cell_id", "left_anti")
    return found.unionByName(empty, allowMissingColumns=True)


def _most_frequent(events: DataFrame, isoform: str) -> DataFrame:
    """(event_id, name): the most frequent gene name of the isoform, the id where unnamed; ties by name."""
    name = F.coalesce(f"{isoform}_gene_name", f"{isoform}_gene_id")
    counts = events.groupBy("event_id", name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("name").isNull().alias("none"), "name"))
    return counts.groupBy("event_id").agg(best.getField("name").alias(isoform))


def event_gene(events: DataFrame) -> DataFrame:
    """(event_id, gene_name): the isoforms' genes, joined when they differ, ``Empty`` when both lack one."""
    both = _most_frequent(events, "isoform1").join(_most_frequent(events, "isoform2"), "event_id")
    one, two = F.col("isoform1"), F.col("isoform2")
    joined = F.array_join(F.array_sort(F.array_distinct(F.split(F.concat_ws(",", one, two), ","))), ",")
    return both.select("event_id", F.when(one.isNull() & two.isNull(), "Empty").otherwise(joined).alias("gene_name"))


def random_fill(cell: Column, event: Column, seed: int = 0) -> Column:
    """The value of any missing entry, stored or not: uniform in [0, 1), fixed by cell, event and seed."""
    return hash_fraction(cell.cast("string"), event, seed=seed)


def psi_random_impute(psi: DataFrame, seed: int = 0) -> DataFrame:
    """Missing values become uniform in [0, 1); entries without a row are looked up by ``random_fill``."""
    return psi.withColumn("psi", F.coalesce("psi", random_fill(F.col("cell_id"), F.col("event_id"), seed)))


def kept_rows(psi: DataFrame, n_cell: int = 10) -> DataFrame:
    """The rows of events with a value in at least ``n_cell`` cells; an event's rows, one per cell at most, meet once."""
    counted = psi.filter("event_id IS NOT NULL").withColumn("_n", F.count("psi").over(Window.partitionBy("event_id")))
    return counted.filter(F.col("_n") >= n_cell).drop("_n")


def cluster_means(kept: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, fill): average over the cluster's cells of each cell's mean, rounded to three places."""
    per_cell = kept.groupBy("cell_id").agg(F.avg("psi").alias("m")).join(clusters, "cell_id")
    return per_cell.groupBy("cluster").agg(F.bround(F.avg("m"), 3).alias("fill"))


def psi_cluster_impute(psi: DataFrame, clusters: DataFrame, n_cell: int = 10) -> DataFrame:
    """Rows of the kept events, missing values filled with the cluster's mean.

    Entries without a row stay implicit; ``psi_cluster_fill`` gives their value and number.
    """
    kept = kept_rows(psi, n_cell)
    filled = kept.join(clusters, "cell_id").join(cluster_means(kept, clusters), "cluster")
    return filled.select("cell_id", "event_id", "cluster", F.coalesce("psi", "fill").alias("psi"))


def psi_cluster_fill(psi: DataFrame, clusters: DataFrame, n_cell: int = 10) -> DataFrame:
    """(event_id, cluster, fill, missing): what every missing entry of the cluster is filled with, and how many there are.

    Missing are all cells of the cluster (listed in ``clusters``) without a value for a kept event, with
    or without a row. One row per kept event and cluster that misses any.
    """
    return filled_entries(stored(kept_rows(psi, n_cell)), clusters)


def filled_entries(kept: DataFrame, clusters: DataFrame) -> DataFrame:
    """``psi_cluster_fill`` of rows that are all of kept events."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("cells")).join(cluster_means(kept, clusters), "cluster", "left")
    # one array of clusters, so that no join without a key is needed
    listed = sizes.agg(F.collect_list(F.struct("cluster", "cells", "fill")))
    # a row of a cell outside the clusters keeps its event, under no cluster; an event's counts are few and stay together
    counts = kept.join(clusters, "cell_id", "left").select("event_id", "cluster", "psi").repartition("event_id")
    counts = counts.groupBy("event_id", "cluster").agg(F.count("psi").alias("n"))
    held = F.map_from_entries(F.collect_list(F.when(F.col("cluster").isNotNull(), F.struct("cluster", "n"))))
    grid = counts.groupBy("event_id").agg(held.alias("_found")).select("event_id", "_found", F.explode(listed.scalar()).alias("c"))
    missing = F.col("c.cells") - F.coalesce(F.try_element_at("_found", F.col("c.cluster")), F.lit(0))
    return grid.select("event_id", "c.cluster", "c.fill", missing.alias("missing")).filter("missing > 0")


def compare_psi(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: shared cells and events, exact equality, largest and mean absolute difference, Pearson.

    Differences run over pairs with both values; Pearson is NULL below two pairs or when a side
    is constant. The long forms are compared over the shared cells and events, an absent entry
    being a missing value. A table has one row of a cell and event.
    """
    held = lambda df: df.filter("cell_id IS NOT NULL AND event_id IS NOT NULL")
    sides = lambda c: (
        a.select(c, F.lit(1).alias("side")).unionByName(b.select(c, F.lit(2).alias("side"))).filter(F.col(c).isNotNull())
        .groupBy(c).agg(F.min("side").alias("low"), F.max("side").alias("high"))
    )
    cells, events = (sides(c).filter("low <> high") for c in ("cell_id", "event_id"))
    # what only one side has is mostly little, and stored its size is known
    alone_cells, alone_events = (stored(sides(c).filter("low = high").select(c)) for c in ("cell_id", "event_id"))
    rows = held(a).select("event_id", "cell_id", F.col("psi").alias("x"), F.lit(None).cast("double").alias("y"))
    rows = rows.unionByName(held(b).select("event_id", "cell_id", F.lit(None).cast("double").alias("x"), F.col("psi").alias("y")))
    inside = rows.join(alone_cells, "cell_id", "left_anti").join(alone_events, "event_id", "left_anti")
    # an event's rows travel together, so that its id is compressed away
    both = inside.repartition("event_id").groupBy("event_id", "cell_id").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    paired = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(paired, F.col("x")), F.when(paired, F.col("y"))
    stats = both.agg(
        F.bool_and(F.col("x").eqNullSafe(F.col("y"))).alias("exact_equal"),
        F.coalesce(F.max(F.abs(x - y)), F.lit(0.0)).alias("max_abs_diff"), F.coalesce(F.avg(F.abs(x - y)), F.lit(0.0)).alias("mean_abs_diff"),
        F.corr(x, y).alias("_corr"), F.count(x).alias("_n"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"),
    )
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return stats.select(
        count(cells).alias("shared_cells"), count(events).alias("shared_events"), "exact_equal", "max_abs_diff", "mean_abs_diff",
        F.when((F.col("_n") >= 2) & (F.col("_sx") > 0) & (F.col("_sy") > 0), F.col("_corr")).alias("pearson"),
    )


STRETCH_CELLS = 1 << 16  # below so many cells the rows of an event are one stretch


def rank_sum_test(psi: DataFrame, groups: DataFrame, stretches: int = 256, implicit: DataFrame | None = None) -> DataFrame:
    """(event_id, group, n, z, p_val): rank sum of each group against the rest, ties at average rank.

    ``implicit`` (event_id, group, psi, c) counts further entries of equal value, such as filled ones.

    An event's rows meet once and are ranked there, so its id, which is long, travels once per value and once
    per sum. With many cells they are dealt by stretches of the value range, so a crowded event is not one
    task; what the lower stretches hold comes from one row per stretch and group.
    """
    rows = psi.filter("psi IS NOT NULL AND event_id IS NOT NULL").join(groups.select("cell_id", "group"), "cell_id")
    cells = rows.select("event_id", "psi", "group", F.lit(1).cast("long").alias("c"))
    if implicit is not None:
        cells = cells.unionByName(implicit.filter("psi IS NOT NULL AND event_id IS NOT NULL").select("event_id", "psi", "group", F.col("c").cast("long").alias("c")))
    crowded = groups.agg(F.count(F.lit(1)) >= STRETCH_CELLS).scalar()
    block = F.when(crowded, F.floor(F.col("psi") * stretches)).otherwise(0)
    dealt = cells.withColumn("_block", block).repartition("event_id", "_block")
    cells = dealt.groupBy("event_id", "_block", "psi", "group").agg(F.sum("c").alias("c"))
    here = Window.partitionBy("event_id", "_block")
    upto = here.orderBy("psi").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = cells.withColumns({"_upto": F.sum("c").over(upto), "_ties": F.sum("c").over(Window.partitionBy("event_id", "_block", "psi"))})
    rank = F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2
    local = counted.groupBy("event_id", "_block", "group").agg(F.sum("c").alias("n"), F.sum(rank * F.col("c")).alias("r"))
    # the groups of a stretch side by side, again for the id
    packed = local.groupBy("event_id", "_block").agg(F.sum("n").alias("_n"), F.collect_list(F.struct("group", "n", "r")).alias("_g"))
    whole = Window.partitionBy("event_id")
    lower = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = packed.withColumns({"total": F.sum("_n").over(whole), "_before": F.coalesce(F.sum("_n").over(lower), F.lit(0))})
    listed = carried.select("event_id", "total", "_before", F.explode("_g").alias("_g")).select("event_id", "total", "_before", "_g.*")
    joined = listed.groupBy("event_id", "group").agg(
        F.max("total").alias("total"), F.sum("n").alias("n"), F.sum(F.col("r") + F.col("_before") * F.col("n")).alias("rank_sum")
    )
    rest = F.col("total") - F.col("n")
    spread = F.sqrt(F.col("n") * rest * (F.col("total") + 1) / 12.0)
    z = F.try_divide(F.col("rank_sum") - F.col("n") * (F.col("total") + 1) / 2.0, spread)
    return joined.filter(rest > 0).select("event_id", "group", "n", z.alias("z"), (2 * normal_sf(F.abs(z))).alias("p_val"))


def events_per_cell(psi: DataFrame) -> DataFrame:
    return psi.groupBy("cell_id").agg(F.count("psi").alias("n"))
