"""The end-to-end jobs on the smallest driver tables."""

import os

import pytest
from pyspark.sql import functions as F

from introna.plans import pipelines
from introna.plans.bindings import Tables
from introna.sources.tables import graph_store_manifest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


def test_reference(spark, tmp_path):
    t = Tables(spark, FOLDER)
    t.b10().select("value").write.text(str(tmp_path / "gtf"))
    made = pipelines.prepare_reference(spark, str(tmp_path / "gtf"), str(tmp_path / "ref"))
    exons = made["exons"].orderBy("exon_pos").collect()
    assert [r["exon_pos"] for r in exons] == list(range(len(exons)))
    manifest = spark.read.json(str(tmp_path / "ref/manifest")).first()
    assert manifest["n_exons"] == len(exons) and manifest["n_overlaps"] == 0
    assert spark.read.text(str(tmp_path / "ref/merged_gtf")).count() == len(exons)


def test_graphs(spark, tmp_path):
    t = Tables(spark, FOLDER)
    counts = t.b2(fold_exons=True)
    label = t.read("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("cell_id"), F.col("c_custkey").alias("cell_pos"), F.col("c_mktsegment").alias("kind"))
    cells = label.join(counts.select("cell_id").distinct(), "cell_id", "left_semi")
    junctions = t.b3().select("cell_id", "gene_id", "start", "end", F.col("uniq").alias("count"))
    made = pipelines.generate_graphs(counts, junctions, counts.select("cell_id", "gene_id", "count"), t.exons(), cells, t.genes(), "kind", str(tmp_path), 8)
    sums = made["edge_index"].count()
    manifest = graph_store_manifest(spark, f"{tmp_path}/graphs").first()
    assert manifest["n_edges"] == sums and manifest["n_cells"] == cells.count()


def test_psi(spark, tmp_path):
    t = Tables(spark, FOLDER)
    exons = t.b5_exons().select("exon_id", "chrom", "start", "stop", "strand")
    cells = t.b4().select(F.col("cell_id").cast("string").alias("cell_id"))
    made = pipelines.splice_psi(t.b4(), t.b3p(), t.b4_reads(), exons, cells, str(tmp_path))
    assert made["summary"].filter("psi < 0 OR psi > 1").count() == 0
    assert made["psi"].select("cell_id").distinct().count() == cells.count()
    assert made["neighbours"].groupBy("main_name").count().filter("count <> 10").count() == 0


def test_psi_with_attributes_sites_and_clusters(spark, tmp_path):
    t = Tables(spark, FOLDER)
    exons = t.b5_exons().select("exon_id", "chrom", "start", "stop", "strand")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("gene_id", "gene_name")])
    attributes = t.b5_exons().select("exon_id", F.explode(pairs).alias("p")).select("exon_id", "p.*").filter("value IS NOT NULL")
    cells = t.b4().select(F.col("cell_id").cast("string").alias("cell_id"), (F.col("cell_id") % 3).alias("cluster"))
    # two bases between any two exons make every site GT/AG on the plus strand
    chunks = t.b5_exons().select("chrom").distinct().crossJoin(spark.range(60).select(F.col("id").alias("chunk_no")))
    chunks = chunks.withColumn("seq", F.lit("GTAG" * 8))
    made = pipelines.splice_psi(
        t.b4(), t.b3p(), t.b4_reads(), exons, cells, str(tmp_path), attributes=attributes, chunks=chunks, clusters=cells, n_cell=2
    )
    valid = made["sites"].groupBy("event_id").agg(F.bool_and("valid").alias("ok")).filter("ok").select("event_id")
    assert {r[0] for r in made["se"].unionByName(made["mxe"], allowMissingColumns=True).select("event_id").collect()} == {r[0] for r in valid.collect()}
    assert made["genes"].count() == made["attributes"].select("event_id").distinct().count()
    assert made["imputed"].filter("psi IS NULL").count() == 0
    kept, members = made["imputed"].select("event_id").distinct().count(), cells.count()
    known = made["psi"].filter("psi IS NOT NULL").join(made["imputed"].select("event_id").distinct(), "event_id", "left_semi").count()
    assert (made["fill"].agg(F.sum("missing")).first()[0] or 0) == kept * members - known


def test_counted_junctions(spark):
    t = Tables(spark, FOLDER)
    rows = spark.createDataFrame(
        [("s", 1, "chr1", "chr1", "10", "21", "", "", "NOVEL", "4"), ("s", 2, "chr1", "chr1", "10", "21", "+", "+", "x", "3"), ("s", 3, "chr1", "chr1", "40", "55", "-", "-", "NOVEL", "2")],
        "sample_id string, line_no long, chr_sp1 string, chr_sp2 string, location_sp1 string, location_sp2 string, strand_sp1 string, strand_sp2 string, status string, count string",
    )
    introns = spark.createDataFrame([("chr1", 11, 20, [2])], "chrom string, start long, end long, strands array<int>")
    chunks = spark.createDataFrame([("chr1", i, "GTAG" * 8) for i in range(4)], "chrom string, chunk_no long, seq string")
    got = {(r.start, r.end): (r.strand, r.annotated, r.uniq) for r in pipelines.counted_junctions(rows, introns, chunks, 32).collect()}
    assert got[(11, 20)] == (2, 1, 7.0) and got[(41, 54)][1:] == (0, 2.0)
    assert t.folder == FOLDER


def test_differential(spark, tmp_path):
    t = Tables(spark, FOLDER)
    x = t.b7().select("cell_id", "feature_id", "value")
    features = x.select("feature_id").distinct().select("feature_id", F.substring_index("feature_id", "-", 1).alias("gene_id"), F.substring_index("feature_id", "-", -1).cast("long").alias("k"))
    features = features.withColumn("gene_name", F.col("gene_id"))
    annotation = t.exons(7).select("gene_id", "gene_name", "exon_number", "start", "end", F.col("exon_number").alias("exon_pos"))
    rows = pipelines.differential_genes(x, t.b7_cells(), features, annotation, str(tmp_path / "e"))
    assert rows.filter("stouffer_p IS NOT NULL").count() > 0 and rows.filter("p_bh < stouffer_p - 1e-12").count() == 0
    junction = pipelines.differential_junction_genes(x, t.b7_cells(), str(tmp_path / "j"))
    assert junction.filter("p_bonferroni > 1").count() == 0
