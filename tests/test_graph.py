"""Exon graphs: every branch of the edge rules on a gene with four exons."""

from introna.operators import graph

EXONS = [("g", i, 100 * i, 100 * i + 49) for i in range(1, 5)] + [("one", 1, 100, 149)]


def edges_of(spark, junctions, strict=True, gene="g"):
    exons = spark.createDataFrame(EXONS, "gene_id string, exon_number long, start long, end long")
    features = spark.createDataFrame([("c", gene, 0, 1.0)], "cell_id string, gene_id string, i long, value double")
    table = spark.createDataFrame([("c", gene, s, e, float(n)) for s, e, n in junctions], "cell_id string, gene_id string, start long, end long, count double")
    found = graph.build_gene_edges(features, table, exons, strict)
    return {(r["i"], r["j"]): r["weight"] for r in found.collect()}


def test_slots(spark):
    exons = spark.createDataFrame(EXONS, "gene_id string, exon_number long, start long, end long")
    points = [(50, 100), (149, 150), (249, 299), (349, 360), (449, 450)]
    table = spark.createDataFrame([("g", a, b) for a, b in points], "gene_id string, start long, end long")
    got = {(r["start"], r["end"]): (r["start_slot"], r["end_slot"]) for r in graph.locate_junction_ends(table, graph.gene_exons(exons)).collect()}
    assert got == {(50, 100): (-1.0, 0.0), (149, 150): (0.0, 0.5), (249, 299): (1.0, 1.5), (349, 360): (2.0, None), (449, 450): (3.0, 3.5)}
    loose = graph.locate_junction_ends(table, graph.gene_exons(exons), strict_last_gap=False)
    assert {r["end_slot"] for r in loose.filter("start = 349").collect()} == {2.5}


def test_no_junctions_gives_chain(spark):
    assert edges_of(spark, []) == {(0, 1): 1.0, (1, 2): 1.0, (2, 3): 1.0}


def test_one_exon_gene(spark):
    assert edges_of(spark, [(100, 149, 5)], gene="one") == {}


def test_added_pairs_raise_the_others(spark):
    # 149 -> 200 supports (0, 1); the two other pairs are added, so it gains one
    assert edges_of(spark, [(149, 200, 7)]) == {(0, 1): 8.0, (1, 2): 1.0, (2, 3): 1.0}


def test_all_pairs_present(spark):
    full = [(149, 200, 2), (249, 300, 3), (349, 400, 4), (149, 400, 5)]
    assert edges_of(spark, full) == {(0, 1): 2.0, (1, 2): 3.0, (2, 3): 4.0, (0, 3): 5.0}


def test_gaps_and_borders(spark):
    chain = {(0, 1): 1.0, (1, 2): 1.0, (2, 3): 1.0}
    # both ends before the first exon: deleted; start before only: dropped
    assert edges_of(spark, [(10, 20, 9), (10, 210, 9)]) == chain
    # a start in a gap goes back, an end in a gap goes on
    assert edges_of(spark, [(160, 260, 4)]) == {**chain, (0, 2): 5.0}
    # both past the end: the last exon's own edge
    assert edges_of(spark, [(500, 600, 4)]) == {**chain, (3, 3): 5.0}
    # an end in the last gap is lost, unless asked otherwise
    assert edges_of(spark, [(149, 360, 4)]) == chain
    assert edges_of(spark, [(149, 360, 4)], strict=False) == {**chain, (0, 3): 5.0}


def test_compress_and_reduce(spark):
    edges = spark.createDataFrame(
        [("c", "g", 0, 1, 3.0), ("c", "g", 0, 3, 2.0), ("c", "g", 2, 1, 4.0), ("c", "g", 3, 3, 1.0)], "cell_id string, gene_id string, i long, j long, weight double"
    )
    features = spark.createDataFrame([("c", "g", i, 1.0) for i in (0, 2, 3)] + [("d", "g", 0, 1.0)], "cell_id string, gene_id string, i long, value double")
    small = graph.compress_adjacency(features, edges)
    got = {(r["i"], r["j"]): r["weight"] for r in small.collect()}
    assert got == {(0, 3): 2.0, (0, 2): 1.0, (2, 3): 1.0} and all(i < j for i, j in got)
    kept, var = graph.reduce_adjacency(features, small)
    assert {(r["i"], r["k"], r["m"]) for r in var.collect()} == {(0, 0, 3), (2, 1, 3), (3, 2, 3)}
    assert {(r["i"], r["j"]) for r in kept.collect()} == {(0, 2), (0, 1), (1, 2)}
    total = graph.edge_normalize(kept).groupBy("cell_id", "gene_id").sum("weight").collect()
    assert all(abs(r[2] - 1) < 1e-9 for r in total)


def test_unknown_exon_is_an_error(spark):
    import pytest

    exons = spark.createDataFrame(EXONS, "gene_id string, exon_number long, start long, end long")
    counts = spark.createDataFrame([("c", "g", 9, 1.0)], "cell_id string, gene_id string, exon_number long, count double")
    with pytest.raises(Exception, match="unknown exon"):
        graph.exon_features(counts, exons).collect()
