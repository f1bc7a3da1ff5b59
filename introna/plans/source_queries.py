"""Queries over readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from introna.functions.columns import r6
from introna.operators.scans import running_before
from introna.plans.bindings import LINE_COLUMNS, Tables, with_sql
from introna.plans.registry import query
from introna.session import shared_path
from introna.sources import sequence, tables, text



@query("gtf_scan", with_sql("b1", """SELECT seqname, 'driver' AS source, feature, CAST("start" AS VARCHAR) AS "start",
CAST("end" AS VARCHAR) AS "end", '.' AS score, strand, '.' AS frame,
'gene_id "' || gene_id || '"; ' || coalesce('gene_name "' || gene_name || '"; ', '') || 'transcript_id "' || transcript_id || '"; exon_number "' || exon_number || '";' AS attribute
FROM b1"""))
def _gtf_scan(t: Tables):
    folder = shared_path(t.spark, "gtf")
    t.b10().select("value").write.text(folder)
    return text.gtf_scan(t.spark, folder).drop("line_no")


@query("gtf_attributes", with_sql("b1", """SELECT gene_id, gene_name, transcript_id, exon_number, CAST(NULL AS VARCHAR) AS gene_version,
CAST("start" AS BIGINT) AS "start" FROM b1"""))
def _gtf_attributes(t: Tables):
    fields = ["gene_id", "gene_name", "transcript_id", "exon_number", "gene_version"]
    parsed = text.gtf_attributes(text.parse_gtf(t.b10()), fields)
    return parsed.select(*fields, F.col("start").cast("long").alias("start"))


@query("gtf_attribute_map", with_sql("b1", """SELECT key, count(*) AS lines, count(DISTINCT value) AS distinct_values FROM (
SELECT 'gene_id' AS key, gene_id AS value FROM b1 UNION ALL SELECT 'gene_name', gene_name FROM b1 WHERE gene_name IS NOT NULL
UNION ALL SELECT 'transcript_id', transcript_id FROM b1 UNION ALL SELECT 'exon_number', exon_number FROM b1) GROUP BY key"""))
def _gtf_attribute_map(t: Tables):
    held = text.parse_gtf(t.b10()).select(F.explode(text.attribute_map(F.col("attribute"))).alias("key", "value"))
    values = held.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("key").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("distinct_values"))


@query("gtf_write", with_sql("b1", """SELECT seqname || chr(9) || 'merged' || chr(9) || feature || chr(9) || "start" || chr(9) || "end" || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9)
|| 'gene_id "' || gene_id || '"; transcript_id "' || gene_id || '";' || coalesce(' gene_name "' || gene_name || '";', '') || ' exon_number "' || exon_number || '";' AS value FROM b1"""))
def _gtf_write(t: Tables):
    return text.format_gtf(t.b1().drop("transcript_id", "line_no").withColumn("source", F.lit("merged")))


@query("gtf_attribute_values", with_sql("b1", """SELECT line_no - 1 AS line, key, value FROM (
SELECT line_no, 'gene_id' AS key, gene_id AS value FROM b1 UNION ALL SELECT line_no, 'gene_name', gene_name FROM b1 WHERE gene_name IS NOT NULL
UNION ALL SELECT line_no, 'transcript_id', transcript_id FROM b1 UNION ALL SELECT line_no, 'exon_number', exon_number FROM b1)"""))
def _gtf_attribute_values(t: Tables):
    """Every attribute of every line."""
    # numbered as items, which are narrower than their lines and need not be joined with them
    items = running_before(t.read("lineitem"), LINE_COLUMNS, {"line": F.lit(1)})
    lines = t.b10(items, ("line",)).filter("line IS NOT NULL")
    return text.parse_gtf(lines).select("line", F.explode(text.attribute_map(F.col("attribute"))).alias("key", "value"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def wide_counts(t: Tables):
    """One row per gene, one count column per order priority, named like alignment files."""
    held = t.b2(samples=True).groupBy("gene_id", "gene_name").pivot("sample", PRIORITIES).agg(F.sum("count"))
    cells = [F.col(f"`{p}`").cast("string").alias(f"/runs/x/out.bam:{p}") for p in PRIORITIES]
    return held.select("gene_id", "gene_name", *cells)


@query("grouped_counts_scan", with_sql("b2s", """SELECT gene_id, gene_name, sample AS cell_id, round(sum("count"), 6) AS "count" FROM b2s
WHERE sample IN ('2-HIGH', '5-LOW') GROUP BY ALL HAVING sum("count") > 0"""))
def _grouped_counts(t: Tables):
    folder = shared_path(t.spark, "counts")
    wide_counts(t).write.csv(folder, sep="\t", header=True, quote="")
    long = tables.grouped_counts_scan(t.spark, folder, ["gene_id", "gene_name"], ["2-HIGH", "5-LOW"])
    return long.select("gene_id", "gene_name", "cell_id", r6("count").alias("count"))


@query("per_cell_counts_scan", with_sql("b2s", """SELECT gene_id AS "Geneid", sample AS cell_id, round(sum("count"), 6) AS "count" FROM b2s GROUP BY ALL HAVING sum("count") > 0"""))
def _per_cell_counts(t: Tables):
    """Writes one count folder per cell, then reads all of them back as one long table."""
    counts = t.b2(samples=True).groupBy("gene_id", "sample").agg(F.sum("count").alias("count"))
    folder = shared_path(t.spark, "per-cell")
    lines = counts.select(F.col("gene_id").alias("Geneid"), F.col("sample").alias("cell"), "count")
    lines.write.partitionBy("cell").csv(folder, sep="\t", header=True)
    cells = [r[0] for r in counts.select("sample").distinct().collect()]  # one folder per sample
    rows = tables.per_cell_counts_scan(t.spark, [f"{folder}/cell={c}" for c in cells], ["Geneid"], F.url_decode(F.regexp_extract("path", "/cell=([^/]*)/", 1)))
    return rows.select("Geneid", "cell_id", r6("count").alias("count"))


@query("metadata_scan", with_sql("b6", """SELECT CB, segment, nation, cell_pos FROM b6"""))
def _metadata_scan(t: Tables):
    folder = shared_path(t.spark, "metadata")
    padded = t.b6().withColumn("CB", F.concat(F.lit(" "), "CB", F.lit(" ")))
    padded.write.csv(folder, sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tables.metadata_scan(t.spark, folder).select("CB", "segment", "nation", F.col("cell_pos").cast("long").alias("cell_pos"))


@query("sj_tab_scan", with_sql("b3", """SELECT sample AS sample_id, chrom, "start" AS junction_start, "end" AS junction_stop,
CASE strand WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE 'undefined' END AS strand,
CASE motif WHEN 0 THEN 'non-canonical' WHEN 1 THEN 'GT/AG' WHEN 2 THEN 'GT/AG' WHEN 3 THEN 'GC/AG' WHEN 4 THEN 'GC/AG' ELSE 'AT/AC' END AS junction_motif,
annotated = 1 AS annotated, uniq AS unique_junction_reads, multi AS multimap_junction_reads, max_overhang, uniq + multi AS reads FROM b3"""))
def _sj_tab(t: Tables):
    rows = t.b3().select(
        F.col("sample").alias("sample_id"),
        F.concat_ws("\t", "chrom", *[F.col(c).cast("string") for c in ("start", "end", "strand", "motif", "annotated", "uniq", "multi", "max_overhang")]).alias("value"),
    )
    return text.parse_junction_table(rows)


def jcount_rows(t: Tables):
    """B3 as flanking-base junction rows with the odd cases the reader must drop."""
    sign = F.when(F.col("strand") == 1, "+").when(F.col("strand") == 2, "-").otherwise(".")
    return t.b3().select(
        F.col("sample").alias("sample_id"), "line_no", F.col("chrom").alias("chr_sp1"),
        F.when(F.col("max_overhang") == 0, "chrX").otherwise(F.col("chrom")).alias("chr_sp2"),
        (F.col("start") - 1).cast("string").alias("location_sp1"),
        F.when(F.col("max_overhang") != 1, (F.col("end") + 1).cast("string")).alias("location_sp2"),
        F.when(F.col("motif") % 2 == 0, sign).otherwise(".").alias("strand_sp1"), sign.alias("strand_sp2"),
        F.when(F.col("annotated") == 1, "KNOWN").otherwise("Novel").alias("status"),
        (F.col("uniq") - 3).cast("string").alias("count"),
    )


@query("jcounts_scan", with_sql("b3", """,
kept AS (SELECT * FROM b3 WHERE max_overhang > 1 AND uniq > 3 AND "start" <= "end")
SELECT sample AS sample_id, chrom, "start", "end", arg_min(strand, line_no) AS strand, 0::BIGINT AS motif,
arg_min(annotated, line_no) AS annotated, CAST(sum(uniq - 3) AS DOUBLE) AS uniq, 0.0::DOUBLE AS multi, 0::BIGINT AS max_overhang
FROM kept GROUP BY sample, chrom, "start", "end" """))
def _jcounts(t: Tables):
    return text.parse_jcounts(jcount_rows(t))


@query("sam_text_scan", with_sql("b9", """SELECT name, flag, chrom, pos, mapq, cigar, barcode AS cb, 'old' AS rg FROM b9"""))
def _sam_scan(t: Tables):
    parsed = text.parse_sam(t.b9())
    return parsed.select("name", "flag", "chrom", "pos", "mapq", "cigar", F.col("tags")["CB"].alias("cb"), F.col("tags")["RG"].alias("rg"))


# splice-like sites on the sequence: two bases around chunk borders, both strands
SITES_SQL = """,
whole AS (SELECT chrom, string_agg(seq, '' ORDER BY chunk_no) AS bases FROM b8 GROUP BY chrom),
sites AS (SELECT DISTINCT 'chr' || (l_suppkey % 5 + 1) AS chrom, l_partkey + l_linenumber AS "start", l_partkey + l_linenumber + 1 AS "end",
  CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM lineitem)
"""


@query("fasta_fetch", with_sql("b8", SITES_SQL + """
SELECT chrom, "start", "end", strand, nullif(CASE WHEN strand = '-' THEN reverse(translate(substr(bases, "start", 2), 'ACGT', 'TGCA')) ELSE substr(bases, "start", 2) END, '') AS bases
FROM sites LEFT JOIN whole USING (chrom)"""))
def _fasta_fetch(t: Tables):
    start = F.col("l_partkey") + F.col("l_linenumber")
    sites = t.read("lineitem").select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 5 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + 1).alias("end"),
        F.when(F.col("l_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"),
    ).distinct()
    return sequence.fetch_stranded(sites, t.b8(), 32)


@query("cell_list", with_sql("b6", """SELECT CB AS cell_id FROM b6 WHERE cell_pos % 4 <> 0"""))
def _cell_list(t: Tables):
    cell = F.when(F.col("cell_pos") % 4 != 0, F.col("CB")).otherwise(F.lit(" "))
    return tables.cell_list(t.b6().select(F.concat_ws("\t", cell, "segment").alias("value")))


@query("cell_manifest", with_sql("b6", """SELECT CB AS cell_id, min(cell_pos) AS first_seen FROM b6 GROUP BY CB"""))
def _cell_manifest(t: Tables):
    padded = t.b6().select(F.concat(F.lit(" "), "CB").alias("cell_id"), "cell_pos")
    return tables.cell_manifest(padded, ["cell_pos"]).select("cell_id", F.col("first_seen.cell_pos").alias("first_seen"))


@query("matrix_store", with_sql("b2", """SELECT (SELECT count(DISTINCT cell_id) FROM b2) AS n_obs,
(SELECT count(*) FROM (SELECT DISTINCT gene_id, exon_number FROM b2)) AS n_var, gene_id, exon_number, count(*) AS cells, round(sum("count"), 6) AS total
FROM b2 GROUP BY gene_id, exon_number"""))
def _matrix_store(t: Tables):
    """Write two shards of the cell-exon matrix and read them back as one."""
    x = t.b2().select("cell_id", "gene_id", "exon_number", "count")
    var = x.select("gene_id", "exon_number").distinct()
    folder = shared_path(t.spark, "matrix")
    half = F.pmod(F.xxhash64("cell_id"), F.lit(2)) == 0
    for name, side in (("a", half), ("b", ~half)):
        part = x.filter(side)
        tables.matrix_write(f"{folder}/{name}", part.select("cell_id").distinct(), var, part)
    obs, features, values = tables.matrix_read(t.spark, [f"{folder}/a", f"{folder}/b"])
    per_feature = values.groupBy("gene_id", "exon_number").agg(F.count(F.lit(1)).alias("cells"), r6(F.sum("count")).alias("total"))
    n_obs, n_var = obs.agg(F.count(F.lit(1))).scalar(), features.agg(F.count(F.lit(1))).scalar()
    return per_feature.join(features, ["gene_id", "exon_number"]).withColumns({"n_obs": n_obs, "n_var": n_var})


@query("bed_export", with_sql("b1", """SELECT seqname AS chrom, "start" - 1 AS "start", "end" AS stop, transcript_id AS name, '.' AS score, strand FROM b1
WHERE "start" <= "end" """))
def _bed_export(t: Tables):
    rows = t.b1().filter("start <= end").select(F.col("seqname").alias("chrom"), "start", F.col("end").alias("stop"), "strand", "transcript_id")
    return text.bed_rows(rows, F.col("transcript_id"))


@query("gtf_to_bed", with_sql("b1", """SELECT DISTINCT seqname AS chrom, CAST("start" AS VARCHAR) AS "start", CAST("end" AS VARCHAR) AS stop, gene_name AS name, '.' AS score, strand FROM b1"""))
def _gtf_to_bed(t: Tables):
    return text.gtf_to_bed(text.gtf_attributes(text.parse_gtf(t.b10()), ["gene_name"]), "gene_name")


@query("gene_name_map", with_sql("b1", """SELECT gene_id, arg_max(gene_name, line_no) AS gene_name FROM (
SELECT gene_id || '/' || exon_number AS gene_id, gene_name || '/' || transcript_id AS gene_name, line_no FROM b1) WHERE gene_name IS NOT NULL GROUP BY gene_id"""))
def _gene_name_map(t: Tables):
    from introna.operators.reference import gene_name_map

    parsed = text.gtf_attributes(text.parse_gtf(t.b10()), ["gene_id", "gene_name", "transcript_id", "exon_number"])
    named = parsed.select(
        "line_no", F.concat("gene_id", F.lit("/"), "exon_number").alias("gene_id"),
        F.concat("gene_name", F.lit("/"), "transcript_id").alias("gene_name"),
    )
    return gene_name_map(named)
