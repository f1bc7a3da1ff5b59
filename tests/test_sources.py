"""Real files: round trips, streams, and the errors the readers must raise."""

import pytest
from pyspark.sql import functions as F

from introna.operators import barcodes, counts
from introna.sources import sequence, tables, text
from introna.streaming.retag import retag_stream, start_retag

GTF = """#!header
chr1\thavana\tgene\t1\t90\t.\t+\t.\tgene_id "g1"; gene_name "A";
chr1\thavana\texon\t1\t50\t.\t+\t.\tgene_id "g1"; gene_name "A"; exon_number 1; note "x y"
chr1\thavana\texon\t60\t90\t.\t-\t.\tgene_id "g2";exon_number "2"
"""
SAM = [
    "@HD\tVN:1.6", "@RG\tID:BC1-1\tSM:x",
    "r1\t0\tchr1\t100\t255\t10M5N10M\t*\t0\t0\t*\t*\tCB:Z:BC1\tRG:Z:old\tNH:i:1",
    "r2\t16\tchr1\t200\t3\t20M\t*\t0\t0\t*\t*\tNH:i:2",
    "r3\t0\tchr1\t300\t3\t5M2D5M3N5M\t*\t0\t0\t*\t*\tRG:Z:old\tCB:Z:BC9",
]


def test_gtf(spark, tmp_path):
    path = tmp_path / "a.gtf"
    path.write_text(GTF)
    gtf = text.gtf_attributes(text.gtf_scan(spark, str(path)), ["gene_id", "gene_name", "exon_number", "transcript_id"])
    got = [tuple(r) for r in gtf.orderBy("line_no").select("feature", "gene_id", "gene_name", "exon_number", "transcript_id").collect()]
    assert got == [("gene", "g1", "A", None, None), ("exon", "g1", "A", "1", None), ("exon", "g2", None, "2", None)]
    keys = sorted(r[0] for r in text.attribute_keys(gtf).collect())
    assert keys == ["exon_number", "gene_id", "gene_name", "note"]
    assert text.expand_attributes(gtf, ["note"]).filter("note = 'x y'").count() == 1
    out = str(tmp_path / "out")
    text.gtf_write(gtf.select(*text.GTF_COLUMNS[:8], "exon_number", "gene_name", "gene_id"), out, ["seqname"])
    back = text.gtf_attributes(text.gtf_scan(spark, out), ["gene_id", "transcript_id", "exon_number"])
    got = {tuple(r) for r in back.select("gene_id", "transcript_id", "exon_number").collect()}
    assert got == {("g1", "g1", None), ("g1", "g1", "1"), ("g2", "g2", "2")}


def test_sam_and_retag(spark, tmp_path):
    folder = tmp_path / "sam"
    folder.mkdir()
    (folder / "a.sam").write_text("\n".join(SAM) + "\n")
    lines = spark.read.text(str(folder))
    parsed = text.parse_sam(lines, ["CB"]).orderBy("name").collect()
    assert [(r["name"], r["CB"], r["tags"].get("RG")) for r in parsed] == [("r1", "BC1", "old"), ("r2", None, None), ("r3", "BC9", "old")]
    allow = spark.createDataFrame([("BC1",), ("BC2",)], "cell_id string")
    want = SAM[2].replace("\tRG:Z:old", "") + "\tRG:Z:BC1-1"
    kept = barcodes.retag(lines, allow, "-1")
    assert [r["value"] for r in kept.collect()] == [want]
    assert tuple(barcodes.retag_counters(lines, kept).first()) == (3, 1, 1, 2)
    headers = [r["value"] for r in barcodes.read_group_headers(allow, text.sam_header(lines), "-1").collect()]
    assert headers == ["@RG\tID:BC2-1\tSM:BC2-1\tLB:cells\tPL:ILLUMINA"]
    out = str(tmp_path / "out")
    start_retag(retag_stream(spark, str(folder), allow, "-1"), out, str(tmp_path / "cp")).awaitTermination(120)
    assert [r[0] for r in spark.read.text(out).collect()] == [want]


def test_read_counts(spark):
    lines = spark.createDataFrame([(x,) for x in SAM], "value string")
    reads = text.parse_sam(lines)
    features = spark.createDataFrame([("chr1", 95, 101, "e1", "g"), ("chr1", 116, 130, "e2", "g"), ("chr1", 110, 114, "gap", "h"), ("chr1", 305, 306, "del", "d")], "chrom string, start long, end long, exon string, gene string")
    exon = {r["exon"]: r["count"] for r in counts.overlap_counts(reads, features, ["exon"], width=8).collect()}
    assert exon == {"e1": 1, "e2": 1}
    gene = {r["gene"]: r["count"] for r in counts.overlap_counts(reads, features, ["gene"], by=["name"], width=8).collect()}
    assert gene == {"g": 1}
    assert sorted(tuple(r) for r in counts.junction_counts(reads).collect()) == [("chr1", 109, 115, 1), ("chr1", 311, 315, 1)]


def test_junction_files(spark, tmp_path):
    (tmp_path / "cellA.SJ.out.tab").write_text("chr1\t11\t20\t1\t2\t1\t5\t2\t30\nchr1\t31\t40\t0\t0\t0\t1\t0\t10\n")
    got = text.sj_tab_scan(spark, str(tmp_path / "*.tab")).orderBy("junction_start").collect()
    assert [(r["sample_id"], r["strand"], r["junction_motif"], r["annotated"], r["reads"]) for r in got] == [
        ("cellA", "+", "GT/AG", True, 7), ("cellA", "undefined", "non-canonical", False, 1)]
    assert {r["reads"] for r in text.sj_tab_scan(spark, str(tmp_path / "*.tab"), ignore_multimapping=True).collect()} == {5, 1}


def test_count_files(spark, tmp_path):
    wide = tmp_path / "wide.tsv"
    wide.write_text("# run\nGeneid\tChr\tStart\tEnd\tStrand\tLength\t/x/o.bam:c1\t/x/c2.bam\ng1\tchr1\t1\t9\t+\t9\t3\t0\ng2\tchr1\t1\t9\t+\t9\tbad\t0\n")
    got = tables.grouped_counts_scan(spark, str(wide)).select("Geneid", "cell_id", "count").collect()
    assert [tuple(r) for r in got] == [("g1", "c1", 3.0)]
    with pytest.raises(ValueError, match="duplicate"):
        tables.grouped_counts(spark.createDataFrame([("g", 1, 2)], "g string, `a/c.bam` long, `b/c.bam` long"), ["g"])
    for cell, n in (("k1", 4), ("k2", 0)):
        (tmp_path / f"{cell}.counts.tsv").write_text(f"Geneid\tcount\ng1\t{n}\ng2\t7\n")
    rows = tables.per_cell_counts_scan(spark, [str(tmp_path / "k*.counts.tsv")], ["Geneid"])
    assert sorted(tuple(r) for r in rows.select("cell_id", "Geneid", "count").collect()) == [("k1", "g1", 4.0), ("k1", "g2", 7.0), ("k2", "g2", 7.0)]


def test_metadata_and_lists(spark, tmp_path):
    good = tmp_path / "m.csv"
    good.write_text("CB,kind\n a ,x\nb,y\n")
    assert sorted(r["CB"] for r in tables.metadata_scan(spark, str(good)).collect()) == ["a", "b"]
    for name, content in (("empty.tsv", ""), ("nocb.tsv", "X\tY\n1\t2\n")):
        (tmp_path / name).write_text(content)
        with pytest.raises(ValueError):
            tables.metadata_scan(spark, str(tmp_path / name))
    (tmp_path / "blank.tsv").write_text("CB\tk\na\tx\n\ty\n")
    with pytest.raises(Exception, match="empty CB"):
        tables.metadata_scan(spark, str(tmp_path / "blank.tsv")).collect()
    with pytest.raises(ValueError):
        counts.check_labels(["a", "a"])
    with pytest.raises(ValueError):
        counts.check_labels(["a b"])


def test_split_undoes_combine(spark):
    table = spark.createDataFrame([(c, g, float(n)) for c, g, n in (("a", "g1", 1), ("a", "g2", 2), ("b", "g1", 3), ("b", "g2", 0))], "cell_id string, gene_id string, count double")
    combined = counts.combine_dense_counts(table, ["gene_id"])
    rows, missing = counts.split_by_cell(combined, spark.createDataFrame([("a",), ("z",)], "cell_id string"))
    assert sorted(tuple(r) for r in rows.collect()) == [("a", "g1", 1.0), ("a", "g2", 2.0)] and [r[0] for r in missing.collect()] == ["z"]
    with pytest.raises(Exception, match="annotation rows differ"):
        counts.combine_dense_counts(table.filter("count > 0"), ["gene_id"]).collect()
    merged = counts.merge_samples_dense(counts.stack_samples({"s1": table, "s2": table}), ["gene_id"])
    assert merged.filter("cell_id = 's2__a'").count() == 2


def test_fasta(spark, tmp_path):
    import random

    rng = random.Random(8)
    seqs = {"chrA": "".join(rng.choice("ACGT") for _ in range(101)), "chrB": "".join(rng.choice("ACGT") for _ in range(37))}
    path = tmp_path / "x.fa"
    path.write_text("".join(f">{c} rest\n" + "".join(s[i:i + 13] + "\n" for i in range(0, len(s), 13)) for c, s in seqs.items()))
    chunks = sequence.chunk_fasta(text.text_lines(spark, str(path)), 8)
    sites = spark.createDataFrame([("chrA", 8, 9, "+"), ("chrA", 8, 9, "-"), ("chrA", 15, 40, "+"), ("chrB", 37, 38, "+"), ("chrB", 90, 91, "+")], "chrom string, start long, end long, strand string")
    got = {(r["chrom"], r["start"], r["strand"]): r["bases"] for r in sequence.fetch_stranded(sites, chunks, 8).collect()}
    a, b = seqs["chrA"], seqs["chrB"]
    turn = str.maketrans("ACGT", "TGCA")
    assert got == {("chrA", 8, "+"): a[7:9], ("chrA", 8, "-"): a[7:9].translate(turn)[::-1], ("chrA", 15, "+"): a[14:40], ("chrB", 37, "+"): b[36:], ("chrB", 90, "+"): None}


def test_reads_keep_line_order(spark, tmp_path):
    path = tmp_path / "l.txt"
    path.write_text("\n".join(str(i) for i in range(200)) + "\n")
    lines = text.text_lines(spark, str(path)).repartition(4)
    assert [int(r["value"]) for r in lines.orderBy("line_no").collect()] == list(range(200))
    assert lines.select(F.max("line_no")).count() == 1
