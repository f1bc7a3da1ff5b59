"""Steps that took too much disk or time on large tables: what they shuffle, and their values on odd rows."""

import random

from pyspark.sql import functions as F

from introna.operators import counts, neighbors, reference, scans, splice
from introna.plans import source_queries
from introna.plans.bindings import Tables
from introna.sources import text

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_found_by_compiled_steps(spark):
    assert " aggregate(" not in plan_of(scans.in_ranges(spark.range(100), ["id"], "r"))


def test_junction_keys_are_numbered_without_a_join_of_the_rows(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(4)}", rng.randrange(5), f"c{rng.randrange(3)}", rng.randrange(-1, 4), i) for i in range(200)]
    table = spark.createDataFrame(rows, "gene_id string, start long, cell_id string, count long, line long")
    found = counts.combine_sparse_junctions(table, ["gene_id", "start"], ["cell_id", "line"])
    assert "SortMergeJoin" not in plan_of(found)
    cells, first = {}, {}
    for g, s, c, n, i in rows:
        if n > 0:
            cells[g, s, c] = n
            first[g, s] = min(first.get((g, s), (c, i)), (c, i))
    number = {k: n for n, k in enumerate(sorted(first, key=lambda k: (first[k], k)))}
    got = {(r["gene_id"], r["start"], r["cell_id"]): (r["count"], r["row_no"]) for r in found.collect()}
    assert got == {k: (n, number[k[:2]]) for k, n in cells.items()} and len(number) > 10


def test_equal_lines_keep_their_own_numbers(spark, tmp_path):
    """Two equal lines are two lines, each with its attributes once."""
    t = Tables(spark, SMALL)
    line = t.read("lineitem").filter("l_suppkey % 11 <> 0").limit(1)
    line.unionByName(line).unionByName(t.read("lineitem").limit(3)).write.parquet(f"{tmp_path}/lineitem.parquet")
    t.read("region").write.parquet(f"{tmp_path}/region.parquet")
    rows = [tuple(r) for r in source_queries._gtf_attribute_values(Tables(spark, str(tmp_path))).collect()]
    assert {r[0] for r in rows} == set(range(5)) and len(rows) == len({(r[0], r[1]) for r in rows})


def test_lines_are_taken_apart_once(spark):
    lines = spark.createDataFrame([('gene_id "a"; tag "x"; tag "y"; n 3; bare',), ("",), (None,), ('gene_id "b"; gene_name "c d";',)], "attribute string")
    found = lines.select(text.attribute_map(F.col("attribute")).alias("m"))
    assert [r["m"] for r in found.collect()] == [{"gene_id": "a", "tag": "y", "n": "3"}, {}, None, {"gene_id": "b", "gene_name": "c d"}]
    # the optimised plan has the pattern once, not once per use of the pairs
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1


def test_a_junction_meets_one_chunk_per_end(spark):
    rng = random.Random(8)
    sequence = {c: "".join(rng.choice("ACGT") for _ in range(90)) for c in ("chr1", "chr2")}
    chunks = spark.createDataFrame([(c, i, s[8 * i:8 * i + 8].lower()) for c, s in sequence.items() for i in range(12) if i != 5], "chrom string, chunk_no long, seq string")
    rows = [(c, a, b) for c in ("chr1", "chr2", "none") for a in range(0, 100, 3) for b in range(a + 3, 100, 2)]
    junctions = spark.createDataFrame(rows, "chrom string, start long, end long")
    found = splice.splice_motif(junctions, chunks, 8)
    assert plan_of(found).count("Join") == 2
    gone = {c: "".join("-" if 40 <= i < 48 else b for i, b in enumerate(s)) for c, s in sequence.items()}
    at = lambda c, i: gone.get(c, "")[i - 1:i + 1] if i > 0 else ""
    want = {(c, a, b): splice.MOTIF_CODES.get(f"{at(c, a)}/{at(c, b - 1)}", 0) for c, a, b in rows}
    assert {(r["chrom"], r["start"], r["end"]): r["motif"] for r in found.collect()} == want and len(set(want.values())) > 3


def test_introns_deal_their_exons_once(spark):
    plan = plan_of(reference.annotated_introns(Tables(spark, SMALL).b1()))
    assert plan.count("REPARTITION_BY_COL") <= 2 and "Exchange hashpartitioning(seqname#" in plan
    filters = [line.count("isnotnull") for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter") and "isnotnull(concat(" in line]
    assert len(filters) == 2 and len(set(filters)) == 1  # equal reads, so that one exchange serves both


def test_pooled_rows_travel_once(spark):
    lists = spark.createDataFrame([(a, b) for a in range(6) for b in range(6)], "main_name long, neighbor long")
    names = "sample_id long, chrom string, start long, end long, strand long, motif long, annotated long, uniq double, multi double, max_overhang long"
    junctions = spark.createDataFrame([(c, "chr1", s, s + 9, 1, 1, 0, 3.0, 1.0, 5) for c in range(6) for s in range(c % 3, 9, 2)], names)
    reads = spark.createDataFrame([(c, 10.0 + c) for c in range(6)], "sample_id long, num_seqs double")
    plan = plan_of(neighbors.pool_junctions(lists, junctions, reads, 6))
    assert plan.count("REPARTITION_BY_COL") == 1
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(main_name#" in line and "chrom#" in line]
    assert "Window" in plan  # what a cell keeps is told beside its rows, not joined to them
