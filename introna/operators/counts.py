"""Count-table jobs on long tables (cell_id, annotation, count)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introna.functions.checks import require_empty
from introna.functions.cigar import covered_blocks, introns
from introna.operators.intervals import merge_intervals, range_join
from introna.operators.scans import running_before
from introna.session import stored

LABEL_PATTERN = "^[A-Za-z0-9_-]+$"


def _same_rows(df: DataFrame, group: str, annotation: Sequence[str]) -> DataFrame:
    """One row when the groups do not all list the same annotation rows, none otherwise.

    Each group is reduced to its row count and two order-free digests in one map-side-combined
    aggregate, so no group is gathered.
    """
    key = F.xxhash64(*annotation)
    prints = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(key).alias("x"), F.sum(key.cast("decimal(38,0)")).alias("s")
    )
    return prints.agg(F.count_distinct("n", "x", "s").alias("kinds")).filter("kinds > 1")


def combine_dense_counts(tables: DataFrame, annotation: Sequence[str]) -> DataFrame:
    """Per-cell tables stacked as (cell_id, annotation, count); differing rows are an error."""
    checked = require_empty(tables, _same_rows(tables, "cell_id", annotation), "annotation rows differ across cells")
    return checked.filter(F.col("count") > 0)


def combine_sparse_junctions(tables: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Outer union on the junction key: (key, row_no, cell_id, count).

    Counts that are not positive are skipped (missing is zero in long form); of a key repeated in
    one cell the last row stays; ``row_no`` numbers the keys by first appearance.
    """
    key = list(key)
    kept = tables.filter(F.col("count") > 0).select(*key, "cell_id", "count", F.struct(*order).alias("_p"))
    # the rows of a key meet once, and what it needs is told there; then its rows travel to their place in the order
    cells = kept.repartition(*key).groupBy(*key, "cell_id").agg(
        F.max(F.struct("_p", "count")).getField("count").alias("count"), F.min("_p").alias("_p")
    )
    here = Window.partitionBy(*key).orderBy("_p", "cell_id")
    opened = cells.withColumns({"_first": F.first("_p").over(here), "_opens": (F.row_number().over(here) == 1).cast("long")}).drop("_p")
    # the count tells nothing more; with it, the bounds of the order are taken from the same rows and no others are shuffled for them
    numbered = running_before(opened, ["_first", *key, F.col("_opens") == 0, "cell_id", "count"], {"row_no": F.col("_opens")})
    return numbered.select(*key, "cell_id", "count", (F.col("row_no") - 1 + F.col("_opens")).alias("row_no"))


def check_labels(labels: Sequence[str]) -> None:
    if len(set(labels)) != len(labels):
        raise ValueError(f"two samples are labelled {next(x for x in labels if labels.count(x) > 1)!r}")
    bad = [x for x in labels if not re.match(LABEL_PATTERN, x)]
    if bad:
        raise ValueError(f"sample label not allowed: {bad[0]!r}")


def _prefixed(tables: DataFrame) -> DataFrame:
    labelled = tables.withColumn("cell_id", F.concat("sample", F.lit("__"), "cell_id"))
    odd = tables.select("sample").distinct().filter(~F.col("sample").rlike(LABEL_PATTERN))
    twice = labelled.groupBy("cell_id").agg(F.min("sample").alias("a"), F.max("sample").alias("b")).filter("a <> b")
    labelled = require_empty(labelled, odd, "sample label not allowed")
    return require_empty(labelled, twice, "merged table would hold duplicate cell ids; use distinct sample labels")


def merge_samples_dense(tables: DataFrame, annotation: Sequence[str]) -> DataFrame:
    """Tables of several samples (column ``sample``) as one, cells named ``<sample>__<cell>``.

    All samples must list the same annotation rows.
    """
    rows = tables.select("sample", *annotation).distinct()
    merged = require_empty(_prefixed(tables), _same_rows(rows, "sample", annotation), "annotation rows differ across samples")
    return merged.filter(F.col("count") > 0)


def merge_samples_junction(tables: DataFrame) -> DataFrame:
    """Junction rows stacked per sample, not merged on their key; absent means zero."""
    return _prefixed(tables).filter(F.col("count") > 0)


def stack_samples(tables: dict[str, DataFrame]) -> DataFrame:
    """The ``sample``-labelled union that the two merges take."""
    check_labels(list(tables))
    stacked = None
    for label, table in tables.items():
        labelled = table.withColumn("sample", F.lit(label))
        stacked = labelled if stacked is None else stacked.unionByName(labelled)
    return stacked


def split_by_cell(table: DataFrame, cells: DataFrame, drop_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of the requested cells, requested cells that the table lacks)."""
    rows = table.join(cells.select("cell_id").distinct(), "cell_id", "left_semi")
    if drop_zero:
        rows = rows.filter(F.col("count") > 0)
    missing = cells.select("cell_id").distinct().join(table.select("cell_id"), "cell_id", "left_anti")
    return rows, missing


def store_by_cell(rows: DataFrame, table: str, path: str, buckets: int, sort: Sequence[str] = ()) -> DataFrame:
    """Store rows as a table bucketed by cell and sorted inside each bucket, and read it back.

    Joins and aggregates on ``cell_id`` of tables with as many buckets need no exchange, and one cell is
    one bucket file, of which the sorted row groups that hold other cells are skipped. A task writes one
    bucket, so there are ``buckets`` files however many cells there are.
    """
    rows.repartition(buckets, "cell_id").write.mode("overwrite").format("parquet").option("path", path).bucketBy(
        buckets, "cell_id"
    ).sortBy("cell_id", *sort).saveAsTable(table)
    return rows.sparkSession.table(table)


def export_by_cell(rows: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder per cell, for readers that want files of single cells; a cell is dealt over as many writers as its rows ask for."""
    files = rows.groupBy("cell_id").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.col("_files"))
    dealt = rows.join(files, "cell_id").repartition("cell_id", spread).drop("_files")
    dealt.write.mode("overwrite").partitionBy("cell_id").parquet(path)


def validate_counts(table: DataFrame, annotation: Sequence[str]) -> DataFrame:
    """One row: number of cells, annotation rows, and rows repeated for one cell."""
    per_key = table.groupBy("cell_id", *annotation).agg(F.count(F.lit(1)).alias("n"))
    per_row = per_key.groupBy(*annotation).agg(F.sum(F.col("n") - 1).alias("again"))
    cells = table.select("cell_id").distinct().agg(F.count(F.lit(1))).scalar()
    return per_row.agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("again"), F.lit(0)).cast("long").alias("duplicate_count")
    ).withColumn("group_count", cells)


def _tokens(value: Column) -> Column:
    parts = F.transform(F.split(value, ","), lambda p: F.trim(p))
    return F.coalesce(
        F.array_distinct(F.filter(parts, lambda p: (p != "") & (p != "NA"))), F.array().cast("array<string>")
    )


def primary_gene(sp1: Column, sp2: Column) -> Column:
    """The one gene both ends agree on, else NULL."""
    one, two = _tokens(sp1), _tokens(sp2)
    single = lambda a: F.when(F.size(a) == 1, F.element_at(a, 1))
    return F.when(F.size(one) == 0, single(two)).when(F.size(two) == 0, single(one)).otherwise(single(F.array_intersect(one, two)))


def normalize_junctions(rows: DataFrame) -> DataFrame:
    """(…, gene_id, chrom, start, end, count) of rows with a gene, numeric ends and a positive count.

    Two layouts: ``PrimaryGene, Site1_chr, Site1_location, Site2_location`` or ``Gene_SP1,
    Gene_SP2, Chr_SP1, Location_SP1, Location_SP2``.
    """
    if "PrimaryGene" in rows.columns:
        used = ["PrimaryGene", "Site1_chr", "Site1_location", "Site2_location"]
        gene, chrom, start, end = F.col(used[0]), *used[1:]
    else:
        used = ["Gene_SP1", "Gene_SP2", "Chr_SP1", "Location_SP1", "Location_SP2"]
        gene, chrom, start, end = primary_gene(F.col("Gene_SP1"), F.col("Gene_SP2")), *used[2:]
    rest = [c for c in rows.columns if c not in (*used, "count")]
    place = lambda c: F.col(c).try_cast("double").cast("long")
    shaped = rows.select(
        *rest, gene.alias("gene_id"), F.col(chrom).alias("chrom"), place(start).alias("start"), place(end).alias("end"),
        F.coalesce(F.col("count").try_cast("double"), F.lit(0.0)).alias("count"),
    )
    return shaped.filter("gene_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL AND count > 0")


def cell_counts(table: DataFrame, kind: str, cell: str | None = None) -> DataFrame:
    """Positive counts of one cell (or of every cell), tagged with their kind."""
    rows = table if cell is None else table.filter(F.col("cell_id") == cell)
    return rows.filter(F.col("count") > 0).withColumn("kind", F.lit(kind))


# Counting reads on features -----------------------------------------------------------------


def _alignments(reads: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct alignments with their number of reads: copies are counted before any join."""
    mapped = reads.filter("chrom <> '*' AND cigar <> '*'")
    return mapped.groupBy(*by, "chrom", "pos", "cigar").agg(F.count(F.lit(1)).alias("n"))


def overlap_counts(
    reads: DataFrame, features: DataFrame, keep: Sequence[str], by: Sequence[str] = (), width: int = 1024
) -> DataFrame:
    """Reads per feature (columns ``keep``), every overlapped feature and every mapping counted.

    ``reads``: (chrom, pos, cigar) and the ``by`` columns, one row per alignment; ``features``:
    (chrom, start, end) and ``keep``. A read counts once per distinct ``keep``, so exon counts
    keep the exon's key and gene counts the gene's. Overlaps are found once per distinct
    alignment shape, then weighted with its number of reads. Which pair of a shape and key counts
    is told from the pair alone, so pairs are summed up where they are found and do not travel.
    """
    shape = ["chrom", "pos", "cigar"]
    counted = stored(_alignments(reads, by), "alignments")
    shapes = counted.select(*shape).distinct() if by else counted
    carried = shape if by else [*shape, "n"]
    blocks = shapes.withColumn("_blocks", covered_blocks(F.col("cigar"), F.col("pos")))
    blocks = blocks.withColumn("_span", F.array_max("_blocks.end") - F.array_min("_blocks.start"))
    widest = blocks.agg(F.max("_span")).first()[0] or 0
    reach = min(widest, LONG_SPAN)
    # packed in files, millions of features look small enough for a broadcast
    placed = stored(_with_earlier(features, keep, reach), "features").hint("merge")

    def met(rows: DataFrame) -> DataFrame:
        each = rows.select(*carried, "_blocks", F.posexplode("_blocks").alias("_i", "_b"))
        probes = each.select(
            *carried, "_blocks", F.get("_blocks.end", F.col("_i") - 1).alias("_before"),
            F.col("_b.start").alias("b_start"), F.col("_b.end").alias("b_end"),
        )
        return range_join(probes, placed, ["chrom"], ("b_start", "b_end"), ("f_start", "f_end"), width)

    # of a read's pairs with one key the first counts: no earlier block meets the feature, no earlier feature the read
    inside = lambda f: F.exists("_blocks", lambda b: (b["start"] <= f["f_end"]) & (f["f_start"] <= b["end"]))
    first = (F.col("_before").isNull() | (F.col("_before") < F.col("f_start"))) & ((F.size("_earlier") == 0) | ~F.exists("_earlier", inside))
    once = met(blocks.filter(F.col("_span") <= reach)).filter(first).select(*carried, *keep)
    if widest > reach:
        once = once.unionByName(met(blocks.filter(F.col("_span") > reach)).select(*carried, *keep).distinct())
    weighted = once.join(counted, shape) if by else once
    return weighted.groupBy(*by, *keep).agg(F.sum("n").alias("count"))


LONG_SPAN = 1 << 16  # reads over more bases are told apart by a distinct, so that lists of earlier features stay short


def _with_earlier(features: DataFrame, keep: Sequence[str], reach: int) -> DataFrame:
    """(chrom, f_start, f_end, keep, _earlier): the merged features of each key, with those before it that a read over ``reach`` bases could also meet."""
    rows = features.filter("start <= end").select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *keep)
    rows = merge_intervals(rows, ["chrom", *keep], touching=True)
    merged = rows.select("chrom", F.col("start").alias("f_start"), F.col("end").alias("f_end"), *keep)
    place = F.struct("f_start", "f_end")
    order = Window.partitionBy("chrom", *keep).orderBy("f_start")
    near = F.collect_list(place).over(order.rangeBetween(-reach, Window.currentRow))
    # merged features do not overlap, so that one at most begins before these and ends among them
    before = F.last(place).over(order.rangeBetween(Window.unboundedPreceding, -reach - 1))
    listed = merged.withColumns({"_near": near, "_one": before})
    every = F.concat(F.when(F.col("_one").isNull(), F.array().cast("array<struct<f_start:bigint,f_end:bigint>>")).otherwise(F.array("_one")), "_near")
    earlier = F.filter(every, lambda g: (g["f_start"] < F.col("f_start")) & (g["f_end"] >= F.col("f_start") - reach))
    return listed.withColumn("_earlier", earlier).drop("_near", "_one")


def junction_counts(reads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reads per gap of the alignment: (by, chrom, start, end, count), the flanking exon bases."""
    spread = _alignments(reads, by).withColumn("_i", F.explode(introns(F.col("cigar"), F.col("pos"))))
    return spread.groupBy(*by, "chrom", (F.col("_i.start") - 1).alias("start"), (F.col("_i.end") + 1).alias("end")).agg(
        F.sum("n").alias("count")
    )
