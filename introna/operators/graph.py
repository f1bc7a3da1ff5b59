"""Per-cell exon graphs on long tables.

Nodes are the exons of a gene (0-based ``i``/``j`` inside the gene), edges carry junction
support. Features are (cell_id, gene_id, i, value), edges (cell_id, gene_id, i, j, weight).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introna.functions.checks import require_empty
from introna.operators.scans import running_before

CELL_GENE = ["cell_id", "gene_id"]


def exon_features(counts: DataFrame, exons: DataFrame, on: Sequence[str] = ("gene_id", "exon_number")) -> DataFrame:
    """Summed positive counts per cell and exon with the exon's columns; unknown exons are an error."""
    on = list(on)
    summed = counts.groupBy("cell_id", *on).agg(F.sum("count").alias("value"))
    known = exons.select(*on, *[c for c in exons.columns if c not in on and c != "line_no"])
    joined = summed.join(known.withColumn("_known", F.lit(True)), on, "left")
    # raised from the row itself: no second pass over the counts
    checked = F.when(F.col("_known").isNotNull(), F.col("value")).otherwise(F.raise_error("count on an unknown exon").cast("double"))
    return joined.withColumn("value", checked).drop("_known").filter("value > 0")


def gene_exons(exons: DataFrame) -> DataFrame:
    """(gene_id, n, spans): the sorted exon ranges of each gene, one row per gene."""
    spans = F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))))
    return exons.groupBy("gene_id").agg(spans.alias("spans")).withColumn("n", F.size("spans").cast("long"))


def junction_slot(position: Column, spans: Column, n: Column, strict_last_gap: bool = True) -> Column:
    """Place of a position among a gene's exons: -1 before, c inside, c + 0.5 in the gap after c.

    The gap before the last exon yields NULL, which loses the edge, unless ``strict_last_gap``
    is off; after the last exon the place is n - 0.5.
    """
    c = F.size(F.filter(spans, lambda s: s.getField("start") <= position)).cast("long") - 1
    # index 0 is read for positions before the first exon as well; that case is decided first
    reach = F.get(spans, F.greatest(c, F.lit(0)).cast("int")).getField("end")
    at = c.cast("double")
    last_gap = n - 2 if strict_last_gap else n - 1
    return (
        F.when(c < 0, F.lit(-1.0))
        .when(position <= reach, at)
        .when((c < last_gap) | (c == n - 1), at + 0.5)
    )


def locate_junction_ends(junctions: DataFrame, spans: DataFrame, strict_last_gap: bool = True) -> DataFrame:
    """Add ``start_slot`` and ``end_slot``; ``spans`` comes from ``gene_exons``."""
    joined = junctions.join(spans, "gene_id")
    slot = lambda c: junction_slot(F.col(c), F.col("spans"), F.col("n"), strict_last_gap)
    return joined.withColumns({"start_slot": slot("start"), "end_slot": slot("end")}).drop("spans")


def located_edges(located: DataFrame) -> DataFrame:
    """(…, i, j): a start in a gap moves back to the exon before, an end forward to the exon after.

    Junctions with both ends before the first exon are dropped, as are edges with an end outside.
    """
    half = lambda c: F.pmod(c, F.lit(1.0)) == 0.5
    i = F.floor("start_slot")
    j = F.when(half(F.col("end_slot")), F.least(F.ceil("end_slot"), F.col("n") - 1)).otherwise(F.floor("end_slot"))
    placed = located.withColumns({"i": i.cast("long"), "j": j.cast("long")})
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < F.col("n"))
    return placed.filter("NOT (start_slot = -1 AND end_slot = -1)").filter(inside("i") & inside("j"))


def build_gene_edges(
    features: DataFrame, junctions: DataFrame, exons: DataFrame, strict_last_gap: bool = True
) -> DataFrame:
    """(cell_id, gene_id, n, i, j, weight, added) for every gene with a counted exon in the cell.

    Missing neighbour pairs (i, i+1) are added with weight 1, and where any was added every
    other edge of that cell and gene gains 1. Chain and junction edges meet in one aggregate,
    whose groups are bounded by the pairs of exons of a gene.
    """
    spans = gene_exons(exons).filter("n > 1")
    active = features.select(*CELL_GENE).distinct()
    supported = junctions.groupBy(*CELL_GENE, "start", "end").agg(F.sum("count").alias("count"))
    supported = supported.join(active, CELL_GENE, "left_semi")
    found = located_edges(locate_junction_ends(supported, spans, strict_last_gap)).select(
        *CELL_GENE, "n", "i", "j", F.col("count").cast("double").alias("support")
    )
    chain = active.join(spans.select("gene_id", "n"), "gene_id").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 2)))
    chain = chain.select(*CELL_GENE, "n", "i", (F.col("i") + 1).alias("j"), F.lit(None).cast("double").alias("support"))
    edges = found.unionByName(chain).groupBy(*CELL_GENE, "n", "i", "j").agg(F.sum("support").alias("support"))
    any_added = F.max(F.col("support").isNull()).over(Window.partitionBy(*CELL_GENE))
    weight = F.when(F.col("support").isNull(), 1.0).when(any_added, F.col("support") + 1).otherwise(F.col("support"))
    return edges.select(*CELL_GENE, "n", "i", "j", weight.alias("weight"), F.col("support").isNull().alias("added"))


def graph_matrices(features: DataFrame, edges: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat places: (cell_id, pos, value) with pos = exon_st + i, and slot = ind_st + i*n + j."""
    x = features.join(index.select("gene_id", "exon_st"), "gene_id").select(
        "cell_id", (F.col("exon_st") + F.col("i")).alias("pos"), "value"
    )
    a = edges.select(*CELL_GENE, "i", "j", "weight").join(index.select("gene_id", "ind_st", "n_exons"), "gene_id").select(
        "cell_id", (F.col("ind_st") + F.col("i") * F.col("n_exons") + F.col("j")).alias("slot"), "weight"
    )
    return x, a


def drop_empty_features(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features renumbered per gene, var): exons that are zero in every cell vanish."""
    seen = features.filter("value <> 0").select("gene_id", "i").distinct()
    # at most the gene's exons per partition
    place = F.row_number().over(Window.partitionBy("gene_id").orderBy("i")).cast("long")
    var = seen.withColumn("k", place)
    renumbered = features.join(var, ["gene_id", "i"]).select("cell_id", "gene_id", "i", "k", "value")
    return renumbered, var


def compress_adjacency(features: DataFrame, edges: DataFrame) -> DataFrame:
    """Forward edges between exons expressed in the cell; silent neighbours among them get weight 1."""
    expressed = features.filter("value > 0").groupBy(*CELL_GENE).agg(F.array_sort(F.collect_set("i")).alias("on"))
    expressed = expressed.filter(F.size("on") > 1)
    kept = edges.filter("i < j AND weight <> 0").join(expressed, CELL_GENE).filter(
        F.array_contains("on", F.col("i")) & F.array_contains("on", F.col("j"))
    )
    kept = kept.select(*CELL_GENE, "i", "j", "weight")
    steps = F.arrays_zip(
        F.slice("on", 1, F.size("on") - 1).alias("i"), F.slice("on", 2, F.size("on") - 1).alias("j")
    )
    chain = expressed.select(*CELL_GENE, F.explode(steps).alias("_s")).select(
        *CELL_GENE, F.col("_s.i").alias("i"), F.col("_s.j").alias("j"), F.lit(None).cast("double").alias("weight")
    )
    both = kept.unionByName(chain).groupBy(*CELL_GENE, "i", "j").agg(F.max("weight").alias("weight"))
    return both.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def reduce_adjacency(features: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, var): exons without any edge and never expressed are dropped and the rest renumbered.

    ``var`` has (gene_id, i, k, m) with k = 0..m-1 in exon order.
    """
    ends = edges.filter("weight <> 0").select("gene_id", F.explode(F.array("i", "j")).alias("i"))
    kept = ends.unionByName(features.filter("value <> 0").select("gene_id", "i"))
    # the exons of a gene are few, and side by side they place both ends of an edge at once
    held = kept.filter("gene_id IS NOT NULL").groupBy("gene_id").agg(F.array_sort(F.collect_set("i")).alias("on"))
    var = held.select("gene_id", F.posexplode("on").alias("k", "i"), F.size("on").cast("long").alias("m"))
    var = var.select("gene_id", "i", F.col("k").cast("long").alias("k"), "m")
    place = lambda c: F.array_position("on", F.col(c)) - 1
    renumbered = edges.join(held, "gene_id").select(
        "cell_id", "gene_id", F.size("on").cast("long").alias("m"), place("i").alias("row"), place("j").alias("col"), "weight"
    ).filter("row >= 0 AND col >= 0")
    return renumbered.select("cell_id", "gene_id", "m", F.col("row").alias("i"), F.col("col").alias("j"), "weight"), var


def edge_normalize(edges: DataFrame) -> DataFrame:
    """Weights divided by the sum over the cell's edges of the gene; zero where that sum is zero."""
    total = F.sum("weight").over(Window.partitionBy(*CELL_GENE))
    return edges.withColumn("weight", F.when(total == 0, F.lit(0.0)).otherwise(F.col("weight") / total))


def of_genes(df: DataFrame, genes: DataFrame) -> DataFrame:
    return df.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")


def node_offsets(sizes: DataFrame) -> DataFrame:
    """(gene_id, m, node_st): genes in sorted id order, nodes of earlier genes first."""
    return running_before(sizes.select("gene_id", "m").distinct(), ["gene_id"], {"node_st": F.col("m")})


def edge_index(edges: DataFrame, offsets: DataFrame) -> DataFrame:
    """(cell_id, row, col, weight) with node numbers that are unique over all genes."""
    placed = edges.filter("weight <> 0").join(offsets.select("gene_id", "node_st"), "gene_id")
    return placed.select(
        "cell_id", (F.col("node_st") + F.col("i")).alias("row"), (F.col("node_st") + F.col("j")).alias("col"), "weight"
    )


def label_encode(cells: DataFrame, label: str) -> DataFrame:
    """Add ``code``: place among the sorted distinct labels, 0 for a missing one."""
    names = cells.select(F.col(label).alias("_label")).filter("_label IS NOT NULL").distinct()
    codes = running_before(names, ["_label"], {"code": F.lit(1)})
    joined = cells.join(codes, F.col(label) == F.col("_label"), "left")
    return joined.withColumn("code", F.coalesce("code", F.lit(0)).cast("long")).drop("_label")


def cell_graphs(nodes: DataFrame, edges: DataFrame, raw_edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per cell: ``x`` (pos, value), ``edges`` (row, col, weight), ``x_adj`` (row, col, raw weight), ``y``.

    ``labels`` (cell_id, code) fixes the cells. The arrays of one cell are bounded by the
    annotation: its exons and the exon pairs of its genes.
    """
    listed = lambda df, name, *cols: df.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    joined = labels.select("cell_id", F.col("code").alias("y"))
    for part in (
        listed(nodes, "x", "pos", "value"), listed(edges, "edges", "row", "col", "weight"), listed(raw_edges, "x_adj", "row", "col", "weight")
    ):
        joined = joined.join(part, "cell_id", "left")
    return joined


def edge_audit(located: DataFrame, edges: DataFrame) -> DataFrame:
    """Per cell and gene: edges, too few edges, ends in a gap before moving, edges over more than one exon."""
    final = edges.groupBy(*CELL_GENE, "n").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("j") - F.col("i") > 1).alias("n_spanning"))
    half = lambda c: F.coalesce(F.pmod(F.col(c), F.lit(1.0)) == 0.5, F.lit(False))
    gaps = located.groupBy(*CELL_GENE).agg(F.count_if(half("start_slot") | half("end_slot")).alias("n_gap_ends"))
    joined = final.join(gaps, CELL_GENE, "left").fillna({"n_gap_ends": 0})
    return joined.withColumn("too_few", F.col("n_edges") < F.col("n") - 1)


def exon_junction_listing(exons: DataFrame, junctions: DataFrame) -> DataFrame:
    """Exon and junction rows of the same columns in one sorted listing."""
    both = exons.withColumn("type", F.lit("Exon")).unionByName(junctions.withColumn("type", F.lit("Junction")))
    return both.orderBy("chrom", "gene_id", "start", "end", "type", "cell_id")


def gene_matrix(counts: DataFrame, cells: DataFrame, names: DataFrame) -> DataFrame:
    """(cell_id, cell_pos, gene_id, gene_name, value) for the cells of the metadata, in its order.

    Metadata cells without counts are an error; genes without a name keep their id.
    """
    summed = counts.groupBy(*CELL_GENE).agg(F.sum("count").alias("value"))
    missing = cells.select("cell_id").join(summed, "cell_id", "left_anti")
    known = require_empty(cells, missing, "metadata cells without counts")
    placed = summed.join(known.select("cell_id", "cell_pos"), "cell_id")
    named = placed.join(names.select("gene_id", "gene_name"), "gene_id", "left")
    return named.select("cell_id", "cell_pos", "gene_id", F.coalesce("gene_name", "gene_id").alias("gene_name"), "value").filter("value <> 0")
