"""Annotation operators on hand-made genes."""

import random

import pytest
from pyspark.sql import functions as F

from introna.operators import reference as ref


def exon_table(spark, data):
    return spark.createDataFrame(
        [(i, g, s, e, "1", "exon") for i, (g, s, e) in enumerate(data)],
        "line_no long, gene_id string, start long, end long, exon_number string, feature string",
    )


def test_exon_merge(spark):
    # touching stay apart, nested vanish, a one-base exon is dropped
    exons = exon_table(spark, [("g", 10, 20), ("g", 20, 30), ("g", 22, 25), ("g", 29, 40), ("g", 50, 50), ("h", 5, 9), ("h", 5, 9)])
    merged = ref.exon_merge(ref.exon_prepare(exons))
    got = sorted((r["gene_id"], r["exon_number"], r["start"], r["end"]) for r in merged.collect())
    assert got == [("g", 1, 10, 20), ("g", 2, 20, 40), ("h", 1, 5, 9)]
    assert ref.exon_overlap_check(merged.select("gene_id", "start", "end")).count() == 0
    assert ref.exon_overlap_check(exons.filter("gene_id = 'g'").select("gene_id", "start", "end")).count() > 0


def test_exon_merge_covers_union(spark):
    import random

    rng = random.Random(9)
    data = [(f"g{rng.randint(0, 3)}", s, s + rng.randint(1, 25)) for s in (rng.randint(0, 500) for _ in range(200))]
    merged = ref.exon_merge(exon_table(spark, data), block=32).collect()
    for gene in {d[0] for d in data}:
        spans = sorted((r["start"], r["end"]) for r in merged if r["gene_id"] == gene)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        cover = lambda pieces: {p for s, e in pieces for p in range(s, e)}
        assert cover(spans) == cover([(s, e) for g, s, e in data if g == gene])


def ids(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "gene_id string, pos long")


@pytest.mark.parametrize("values,want", [
    (["gene10", "gene2", "gene1", "gene2"], {"gene1": 0, "gene2": 1, "gene10": 2}),
    (["gene10", "gene2", "gene0304170_df_nrg"], {"gene10": 0, "gene2": 1, "gene0304170_df_nrg": 2}),
    (["b", "a", "b"], {"b": 0, "a": 1}),
])
def test_gene_order(spark, values, want):
    got = ref.gene_order(ids(spark, values), ["pos"])
    assert {r["gene_id"]: r["gene_pos"] for r in got.collect()} == want


def test_gene_order_mapping(spark):
    reference = ids(spark, ["gene10", "gene2", "gene1"])
    mapped = ref.map_gene_order(ids(spark, ["gene10", "gene1"]), reference, ["pos"])
    assert {r["gene_id"]: r["gene_pos"] for r in mapped.collect()} == {"gene10": 2, "gene1": 0}
    with pytest.raises(ValueError, match="gene7"):
        ref.map_gene_order(ids(spark, ["gene7"]), reference, ["pos"])


def test_adjacency_and_names(spark):
    exons = spark.createDataFrame(
        [("g2", "A", 1, 0), ("g2", "A", 5, 1), ("g1", "A", 1, 2), ("g3", "", 1, 3)], "gene_id string, gene_name string, start long, pos long"
    )
    index = {r["gene_id"]: (r["ind_st"], r["ind"], r["exon_st"]) for r in ref.adjacency_index(exons, ["pos"]).collect()}
    assert index == {"g2": (0, 4, 0), "g1": (4, 1, 2), "g3": (5, 1, 3)}
    names = {r[0]: r[1] for r in ref.unique_gene_names(exons, ["pos"]).collect()}
    assert names == {"g1": "A-g1", "g2": "A-g2", "g3": "g3"}


def test_genome_to_transcript(spark):
    exons = spark.createDataFrame([("t", "+", 10, 12), ("t", "+", 20, 22), ("m", "-", 10, 12), ("m", "-", 20, 22)], "transcript_id string, strand string, start long, end long")
    wanted = spark.createDataFrame([(t, p) for t in "tm" for p in (10, 12, 15, 20)], "transcript_id string, pos long")
    got = {(r["transcript_id"], r["pos"]): r["offset"] for r in ref.genome_to_transcript(wanted, exons).collect()}
    assert got == {("t", 10): 1, ("t", 12): 3, ("t", 15): None, ("t", 20): 4, ("m", 20): 3, ("m", 12): 4, ("m", 10): 6, ("m", 15): None}


def test_missing_attributes(spark):
    gtf = spark.createDataFrame([(None, "1")], "gene_id string, exon_number string")
    with pytest.raises(ValueError, match="gene_id"):
        ref.check_annotation(gtf)
    assert gtf.select(F.lit(1)).count() == 1


def test_gene_of_region_over_levels(spark):
    rng = random.Random(5)
    spans = lambda n, widths: [(f"c{rng.randrange(2)}", rng.choice("+-"), a, a + rng.choice(widths)) for a in (rng.randrange(-200, 3000) for _ in range(n))]
    genes = [(*g, f"g{i % 25}", None if i % 4 == 0 else f"n{i % 7}") for i, g in enumerate(spans(60, [0, 5, 40, 900, 2500, -1]))]
    regions = [(f"r{i}", *r) for i, r in enumerate(spans(80, [0, 10, 100, 1200, -1]))]
    table = spark.createDataFrame(regions, "region_id string, chrom string, strand string, start long, stop long")
    places = spark.createDataFrame(genes, "chrom string, strand string, g_start long, g_stop long, gene_id string, gene_name string")
    want = {}
    for name, chrom, strand, a, b in regions:
        hits = [g for g in genes if g[:2] == (chrom, strand) and a <= b and g[2] <= g[3] and g[2] <= b and g[3] >= a]
        if hits:
            want[name] = sorted({g[4] for g in hits}), sorted({g[5] for g in hits if g[5]})
    found = ref.gene_of_region(table.unionByName(table), places, 64)
    assert {r["region_id"]: (r["gene_ids"], r["gene_names"]) for r in found.collect()} == want and found.count() == len(want) > 40
    # the sets of a region are found whole and do not travel
    assert "hashpartitioning(region_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_exon_merge_takes_repeats(spark):
    rows = [("g1", 1, 10, 20, "a"), ("g1", 0, 10, 20, "b"), ("g1", 2, 15, 30, "c"), ("g1", 3, 40, 50, "d"), ("g2", 4, 5, 6, None), ("g2", 5, 5, 6, "e")]
    gtf = spark.createDataFrame(rows, "gene_id string, line_no long, start long, end long, gene_name string").withColumn("feature", F.lit("exon"))
    whole, plain = (ref.exon_merge(f(gtf)).select("gene_id", "start", "end", "exon_number", "gene_name").collect() for f in (ref.exon_prepare, ref.exon_rows))
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, plain), key=str) == [("g1", 10, 30, 1, "b"), ("g1", 40, 50, 2, "b"), ("g2", 5, 6, 1, None)]
