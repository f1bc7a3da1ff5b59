"""End-to-end jobs. Each stage that later stages read more than once is written to Parquet below
``out`` and read back, so a lost executor or a rerun starts from the last finished stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from introna.operators import expression, graph, markers, neighbors, psi, reference, splice
from introna.session import configure
from introna.sources import tables, text


def _stage(df: DataFrame, out: str, name: str) -> DataFrame:
    path = f"{out.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def prepare_reference(spark: SparkSession, gtf_paths: str | Sequence[str], out: str) -> dict[str, DataFrame]:
    """Annotation files to merged exons, adjacency index, names and introns; writes the merged GTF and a manifest."""
    configure(spark)
    fields = ["gene_id", "gene_name", "transcript_id", "exon_number", "gene_version", "gene_source", "gene_biotype", "gene_type"]
    gtf = _stage(text.gtf_attributes(text.gtf_scan(spark, gtf_paths), fields), out, "annotation")
    reference.check_annotation(gtf)
    exons = reference.exon_prepare(gtf)
    merged = _stage(reference.exon_merge(exons), out, "merged_exons")
    order = ["gene_id", "start"]
    index = _stage(reference.adjacency_index(merged, order), out, "adjacency_index")
    placed = merged.join(index.select("gene_id", "exon_st"), "gene_id").withColumn("exon_pos", F.col("exon_st") + F.col("exon_number") - 1)
    placed = _stage(placed.drop("exon_st"), out, "exons")
    names = _stage(reference.unique_gene_names(merged, order), out, "gene_names")
    features = _stage(reference.feature_annotation(placed, names), out, "features")
    numeric = gtf.filter("feature = 'exon'").withColumns({c: F.col(c).cast("long") for c in ("start", "end")})
    introns = _stage(reference.annotated_introns(numeric), out, "introns")
    text.gtf_write(merged.drop("attribute", "transcript_id"), f"{out}/merged_gtf", ["gene_id", "start"])
    manifest = merged.agg(F.count_distinct("gene_id").alias("n_genes"), F.count(F.lit(1)).alias("n_exons"))
    overlaps = reference.exon_overlap_check(merged.select("gene_id", "start", "end")).agg(F.count(F.lit(1))).scalar()
    manifest.withColumn("n_overlaps", overlaps).write.mode("overwrite").json(f"{out}/manifest")
    return {"exons": placed, "index": index, "names": names, "features": features, "introns": introns}


def generate_graphs(
    exon_counts: DataFrame, junction_counts: DataFrame, gene_counts: DataFrame, exons: DataFrame, cells: DataFrame,
    names: DataFrame, label: str, out: str, n_top: int = 2000,
) -> dict[str, DataFrame]:
    """Count tables to the per-cell graph store.

    ``exon_counts``: (cell_id, gene_id, exon_number, count); ``junction_counts``: (cell_id,
    gene_id, start, end, count); ``gene_counts``: (cell_id, gene_id, count); ``cells``: (cell_id,
    cell_pos, the label column).
    """
    configure(exons.sparkSession)
    counted = graph.exon_features(exon_counts, exons.select("gene_id", "exon_number"))
    features = _stage(counted.select("cell_id", "gene_id", (F.col("exon_number") - 1).alias("i"), "value"), out, "feature")
    edges = _stage(graph.build_gene_edges(features, junction_counts, exons), out, "adjacency")
    small = _stage(graph.compress_adjacency(features, edges), out, "adjacency_compressed")
    reduced, var = graph.reduce_adjacency(features, small)
    reduced, var = _stage(reduced, out, "adjacency_reduced"), _stage(var, out, "adjacency_var")
    genes = _stage(graph.gene_matrix(gene_counts, cells, names), out, "gene_matrix")
    kept = expression.filter_features(genes, "gene_id")
    scaled = expression.log1p(expression.normalize_total(kept))
    variable = _stage(expression.highly_variable(scaled, "gene_id", expression.n_cells(cells), n_top), out, "variable_genes")
    nodes = _stage(expression.feature_hvg(features, cells, variable), out, "feature_hvg")
    raw = graph.of_genes(reduced, variable)
    offsets = _stage(graph.node_offsets(graph.of_genes(var, variable)), out, "node_offsets")
    weights = _stage(graph.edge_index(graph.edge_normalize(raw), offsets), out, "edge_index")
    labels = _stage(graph.label_encode(cells, label).select("cell_id", F.col("code")), out, "labels")
    store = tables.graph_store(weights, labels.withColumnRenamed("code", "label"))
    tables.graph_store_write(store, f"{out}/graphs")
    return {"features": features, "edges": edges, "variable": variable, "nodes": nodes, "raw_edges": raw, "edge_index": weights, "labels": labels}


def counted_junctions(rows: DataFrame, introns: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """Flanking-base junction counts to ``splice_psi``'s junctions: motif from the sequence, strand and annotation filled in."""
    return splice.backfill_annotation(splice.splice_motif(text.parse_jcounts(rows).drop("motif"), chunks, chunk), introns)


def event_genes(attributes: DataFrame) -> DataFrame:
    """(event_id, gene_name) from the isoforms' shared attributes."""
    pick = lambda isoform, key: F.max(F.when((F.col("isoform") == isoform) & (F.col("key") == key), F.nullif("value", F.lit(""))))
    wide = attributes.groupBy("event_id").agg(*[pick(i, k).alias(f"{i}_{k}") for i in ("isoform1", "isoform2") for k in ("gene_name", "gene_id")])
    return psi.event_gene(wide)


def splice_psi(
    embedding: DataFrame, junctions: DataFrame, reads: DataFrame, exons: DataFrame, cells: DataFrame, out: str, k: int = 10,
    method: str = "mean", attributes: DataFrame | None = None, chunks: DataFrame | None = None, chunk: int = 32,
    clusters: DataFrame | None = None, n_cell: int = 10,
) -> dict[str, DataFrame]:
    """Neighbour-pooled junctions to events and PSI per cell.

    ``junctions``: (sample_id, chrom, start, end, strand code, motif, annotated, uniq, multi,
    max_overhang); ``exons``: (exon_id, chrom, start, stop, strand) of the annotation. With the
    sequence (``chunks`` of ``chunk`` bases) only events with allowed splice sites stay; with exon
    ``attributes`` (exon_id, key, value) events get theirs and a gene name; with ``clusters``
    (cell_id, cluster) missing values are imputed, those of entries without a row as a fill table.
    """
    configure(embedding.sparkSession)
    lists = _stage(neighbors.nearest_neighbours(embedding, k), out, "neighbours")
    pooled = _stage(neighbors.pooled_sj_table(neighbors.pool_junctions(lists, junctions, reads, k)), out, "pooled_junctions")
    sign = F.when(F.col("strand") == 1, "+").when(F.col("strand") == 2, "-").otherwise(".")
    named = text.junction_ids(pooled.select(
        F.col("main_name").cast("string").alias("sample_id"), "chrom", F.col("start").alias("junction_start"), F.col("end").alias("junction_stop"),
        sign.alias("strand"), (F.col("uniq") + F.col("multi")).alias("reads"),
    ))
    named = _stage(named, out, "junction_reads")
    metadata = splice.junction_metadata(named, ["junction_id", "chrom", "junction_start", "junction_stop", "exon_start", "exon_stop", "strand"])
    metadata = _stage(metadata, out, "junction_metadata")
    found = splice.novel_exons(metadata.select("chrom", F.col("junction_start").alias("start"), F.col("junction_stop").alias("stop"), "strand"), exons)
    fresh = found.select(F.format_string("exon:%s:%d-%d:%s", "chrom", "start", "stop", "strand").alias("exon_id"), "chrom", "start", "stop", "strand")
    every = _stage(exons.select("exon_id", "chrom", "start", "stop", "strand").unionByName(fresh), out, "event_exons")
    edges = _stage(splice.exon_edges(splice.exon_junction_triples(every, metadata), every), out, "exon_edges")
    se = _stage(splice.event_ids(splice.skipped_exon_events(edges), "se"), out, "events_se")
    mxe = _stage(splice.incompatible_junctions(splice.event_ids(splice.mutually_exclusive_events(edges), "mxe")), out, "events_mxe")
    made = {}
    if chunks is not None:
        sites = splice.splice_sites(se, "se", chunks, chunk).unionByName(splice.splice_sites(mxe, "mxe", chunks, chunk))
        sites = made["sites"] = _stage(sites, out, "splice_sites")
        se = _stage(splice.validate_splice_sites(se, sites), out, "valid_se")
        mxe = _stage(splice.validate_splice_sites(mxe, sites), out, "valid_mxe")
    if attributes is not None:
        shared = splice.event_attributes(se, "se", attributes).unionByName(splice.event_attributes(mxe, "mxe", attributes))
        made["attributes"] = _stage(shared, out, "event_attributes")
        made["genes"] = _stage(event_genes(made["attributes"]), out, "event_genes")
    summary = _stage(splice.psi_table(se, mxe, named, method=method), out, "psi_summary")
    matrix = _stage(psi.psi_matrix(summary, cells, "sample_id"), out, "psi")
    if clusters is not None:
        found = matrix.select("cell_id", "event_id", "psi").filter("event_id IS NOT NULL")
        made["imputed"] = _stage(psi.psi_cluster_impute(found, clusters, n_cell), out, "psi_imputed")
        made["fill"] = _stage(psi.psi_cluster_fill(found, clusters, n_cell), out, "psi_fill")
    return {"neighbours": lists, "pooled": pooled, "se": se, "mxe": mxe, "summary": summary, "psi": matrix, **made}


def differential_genes(x: DataFrame, clusters: DataFrame, features: DataFrame, annotation: DataFrame, out: str) -> DataFrame:
    """Exon counts (cell_id, feature_id, value) to gene-level tests of every cluster, on each marker row."""
    configure(x.sparkSession)
    tested = markers.one_vs_rest_markers(markers.log_normalize(x), clusters)
    rows = tested.withColumn("gene", markers.feature_to_gene(F.col("feature_id")))
    placed = _stage(markers.length_weights(markers.exon_coordinates(rows, features, annotation)), out, "markers")
    genes = markers.weighted_stouffer(placed).join(markers.weighted_abs_log2fc(placed), ["cluster", "gene"])
    genes = _stage(genes, out, "genes")
    adjusted = markers.adjust_bh(markers.adjust_bonferroni(genes, "stouffer_p"), "stouffer_p", ["cluster", "gene"])
    return markers.to_rows(placed, _stage(adjusted, out, "genes_adjusted"))


def differential_junction_genes(x: DataFrame, clusters: DataFrame, out: str) -> DataFrame:
    """Junction counts to gene-level tests with equal weights."""
    configure(x.sparkSession)
    tested = markers.one_vs_rest_markers(markers.log_normalize(x), clusters)
    rows = _stage(tested.withColumn("gene", markers.feature_to_gene(F.col("feature_id"))), out, "markers")
    genes = markers.adjust_bonferroni(_stage(markers.stouffer(rows), out, "genes"), "stouffer_p")
    return markers.to_rows(rows, genes)
