"""Queries over count tables, barcodes and read counting."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from introna.functions.columns import r6
from introna.operators import barcodes, counts
from introna.operators.reference import exon_merge, exon_prepare
from introna.plans.bindings import Tables, with_sql
from introna.plans.reference_queries import MERGED_SQL
from introna.plans.registry import query
from introna.plans.source_queries import PRIORITIES
from introna.session import shared_path, stored
from introna.sources import tables, text


@query("cell_id_from_column", with_sql("b6", """SELECT name, cell_id FROM (
SELECT '/data/run.bam:' || CB AS name, CB AS cell_id FROM b6
UNION ALL SELECT '/data/' || CB || '.Aligned.sortedByCoord.out.bam', CB FROM b6
UNION ALL SELECT '/data/' || CB || '.x.bam', CB || '.x' FROM b6
UNION ALL SELECT CB || '.x.tsv', CB FROM b6)"""))
def _cell_ids(t: Tables):
    names = F.array(
        F.concat(F.lit("/data/run.bam:"), "CB"), F.concat(F.lit("/data/"), "CB", F.lit(".Aligned.sortedByCoord.out.bam")),
        F.concat(F.lit("/data/"), "CB", F.lit(".x.bam")), F.concat("CB", F.lit(".x.tsv")),
    )
    return t.b6().select(F.explode(names).alias("name")).withColumn("cell_id", tables.cell_id_from_column(F.col("name")))


def dense_rows(t: Tables):
    """Every (gene, exon) for every order priority, zero where nothing was counted."""
    counted = t.b2(samples=True).groupBy(F.col("sample").alias("cell_id"), "gene_id", "exon_number").agg(F.sum("count").alias("count"))
    rows = counted.select("gene_id", "exon_number").distinct()
    grid = rows.withColumn("cell_id", F.explode(F.array(*[F.lit(p) for p in PRIORITIES])))
    return grid.join(counted, ["cell_id", "gene_id", "exon_number"], "left").fillna({"count": 0.0})


@query("combine_dense_counts", with_sql("b2s", """SELECT sample AS cell_id, gene_id, exon_number, round(sum("count"), 6) AS "count" FROM b2s GROUP BY ALL HAVING sum("count") > 0"""))
def _combine_dense(t: Tables):
    combined = counts.combine_dense_counts(dense_rows(t), ["gene_id", "exon_number"])
    return combined.select("cell_id", "gene_id", "exon_number", r6("count").alias("count"))


@query("combine_sparse_junctions", with_sql("b3", """,
kept AS (SELECT *, uniq - 3 AS n FROM b3 WHERE uniq > 3),
cells AS (SELECT gene_id, chrom, "start", "end", sample AS cell_id, arg_max(n, line_no) AS "count", min((sample, line_no)) AS p FROM kept GROUP BY ALL),
keys AS (SELECT gene_id, chrom, "start", "end", row_number() OVER (ORDER BY min(p)) - 1 AS row_no FROM cells GROUP BY ALL)
SELECT gene_id, chrom, "start", "end", row_no, cell_id, "count" FROM cells JOIN keys USING (gene_id, chrom, "start", "end")"""))
def _combine_sparse(t: Tables):
    rows = t.b3().select("gene_id", "chrom", "start", "end", F.col("sample").alias("cell_id"), (F.col("uniq") - 3).alias("count"), "line_no")
    return counts.combine_sparse_junctions(rows, ["gene_id", "chrom", "start", "end"], ["cell_id", "line_no"])


def sample_tables(t: Tables):
    """Cells per order priority; label text without blanks."""
    label = F.translate("sample", " ", "_")
    return t.b2(samples=True).select(label.alias("sample"), "cell_id", "gene_id", "exon_number", "count")


@query("merge_samples_dense", with_sql("b2s", """SELECT replace(sample, ' ', '_') || '__' || cell_id AS cell_id, gene_id, round(sum("count"), 6) AS "count" FROM b2s GROUP BY ALL"""))
def _merge_dense(t: Tables):
    genes = sample_tables(t).groupBy("sample", "cell_id", "gene_id").agg(F.sum("count").alias("count"))
    return counts.merge_samples_dense(genes, ["gene_id"]).select("cell_id", "gene_id", r6("count").alias("count"))


@query("merge_samples_junction", with_sql("b3", """SELECT replace(sample, ' ', '_') || '__' || cell_id AS cell_id, gene_id, chrom, "start", "end", uniq - 3 AS "count" FROM b3 WHERE uniq > 3"""))
def _merge_junction(t: Tables):
    rows = t.b3().select(
        F.translate("sample", " ", "_").alias("sample"), "cell_id", "gene_id", "chrom", "start", "end", (F.col("uniq") - 3).alias("count")
    )
    return counts.merge_samples_junction(rows).drop("sample")


REQUESTED_SQL = """requested AS (SELECT 'C' || c_custkey AS cell_id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'X' || n_nationkey FROM nation)"""


def requested(t: Tables):
    cells = t.read("customer").filter("c_acctbal > 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("cell_id"))
    return cells.unionByName(t.read("nation").select(F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("cell_id")))


@query("split_by_cell", with_sql("b2", ",\n" + REQUESTED_SQL + """
SELECT cell_id, gene_id, exon_number, round("count", 6) AS "count" FROM b2 WHERE cell_id IN (SELECT cell_id FROM requested)"""))
def _split(t: Tables):
    rows, _ = counts.split_by_cell(t.b2(), requested(t), drop_zero=True)
    return rows.select("cell_id", "gene_id", "exon_number", r6("count").alias("count"))


@query("split_missing_cells", with_sql("b2", ",\n" + REQUESTED_SQL + """
SELECT DISTINCT cell_id FROM requested WHERE cell_id NOT IN (SELECT cell_id FROM b2)"""))
def _split_missing(t: Tables):
    return counts.split_by_cell(t.b2(), requested(t))[1]


@query("validate_counts", with_sql("b3", """SELECT (SELECT count(*) FROM (SELECT DISTINCT gene_id, chrom, "start", "end" FROM b3)) AS row_count,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT cell_id, gene_id, chrom, "start", "end" FROM b3)) AS duplicate_count, count(DISTINCT cell_id) AS group_count FROM b3"""))
def _validate(t: Tables):
    return counts.validate_counts(t.b3(), ["gene_id", "chrom", "start", "end"])


@query("stored_cells_join", with_sql("b2 b3", """,
junctions AS (SELECT cell_id, count(*) AS junction_rows FROM b3 GROUP BY cell_id)
SELECT cell_id, gene_id, exon_number, round("count", 6) AS "count", junction_rows FROM b2 JOIN junctions USING (cell_id)"""))
def _stored_join(t: Tables):
    """Two stored tables joined by cell, without an exchange."""
    folder, mark = shared_path(t.spark, "cells"), uuid.uuid4().hex
    exons = counts.store_by_cell(t.b2().select("cell_id", "gene_id", "exon_number", "count"), f"exons_{mark}", f"{folder}/exons", 8)
    junctions = counts.store_by_cell(t.b3().select("cell_id", "gene_id", "start", "end", "uniq"), f"junctions_{mark}", f"{folder}/junctions", 8)
    per_cell = junctions.groupBy("cell_id").agg(F.count(F.lit(1)).alias("junction_rows"))
    return exons.join(per_cell, "cell_id").select("cell_id", "gene_id", "exon_number", r6("count").alias("count"), "junction_rows")


TOKENS_SQL = """,
lists AS (SELECT part_key, gene_sp1, gene_sp2,
  list_distinct(list_filter(list_transform(string_split(coalesce(gene_sp1, ''), ','), lambda x: trim(x)), lambda x: x <> '' AND x <> 'NA')) AS a,
  list_distinct(list_filter(list_transform(string_split(coalesce(gene_sp2, ''), ','), lambda x: trim(x)), lambda x: x <> '' AND x <> 'NA')) AS b FROM tokens),
primaries AS (SELECT part_key, gene_sp1, gene_sp2, CASE WHEN len(a) = 0 THEN CASE WHEN len(b) = 1 THEN b[1] END
  WHEN len(b) = 0 THEN CASE WHEN len(a) = 1 THEN a[1] END
  ELSE CASE WHEN len(list_intersect(a, b)) = 1 THEN list_intersect(a, b)[1] END END AS gene_id FROM lists)
"""


@query("primary_gene", with_sql("tokens", TOKENS_SQL + "SELECT part_key, gene_sp1, gene_sp2, gene_id FROM primaries"))
def _primary_gene(t: Tables):
    return t.gene_tokens().withColumn("gene_id", counts.primary_gene(F.col("gene_sp1"), F.col("gene_sp2")))


@query("normalize_junctions", with_sql("b3 tokens", TOKENS_SQL + """
SELECT cell_id, p.gene_id, chrom, "start", "end", CAST(uniq - 3 AS DOUBLE) AS "count" FROM b3 JOIN primaries p USING (part_key)
WHERE p.gene_id IS NOT NULL AND uniq > 3 AND motif <> 2 AND max_overhang <> 5"""))
def _normalize(t: Tables):
    rows = t.b3().join(t.gene_tokens(), "part_key").select(
        "cell_id", F.col("gene_sp1").alias("Gene_SP1"), F.col("gene_sp2").alias("Gene_SP2"), F.col("chrom").alias("Chr_SP1"),
        F.when(F.col("motif") == 2, "NA").otherwise(F.col("start").cast("string")).alias("Location_SP1"),
        F.when(F.col("max_overhang") != 5, F.col("end").cast("string")).alias("Location_SP2"),
        (F.col("uniq") - 3).cast("string").alias("count"),
    )
    return counts.normalize_junctions(rows)


@query("cell_counts", with_sql("b2 b3", """SELECT 'exon' AS kind, cell_id, gene_id, round("count", 6) AS "count" FROM b2 WHERE "count" > 0
UNION ALL SELECT 'junction', cell_id, gene_id, CAST(uniq - 3 AS DOUBLE) FROM b3 WHERE uniq > 3"""))
def _cell_counts(t: Tables):
    exon = counts.cell_counts(t.b2().select("cell_id", "gene_id", r6("count").alias("count")), "exon")
    junction = counts.cell_counts(t.b3().select("cell_id", "gene_id", (F.col("uniq") - 3).cast("double").alias("count")), "junction")
    return exon.unionByName(junction)


def allow_list(t: Tables):
    return t.read("supplier").select(F.concat(F.lit("BC"), (F.col("s_suppkey") * 2).cast("string")).alias("cell_id"))


LINE_SQL = """name || chr(9) || flag || chr(9) || chrom || chr(9) || pos || chr(9) || mapq || chr(9) || cigar || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || '*' || chr(9) || '*' """


@query("retag_barcode", with_sql("b9", f"""SELECT {LINE_SQL} || chr(9) || 'CB:Z:' || barcode || chr(9) || 'RG:Z:' || barcode || '-1' AS value, barcode || '-1' AS cell_id
FROM b9 WHERE barcode IN (SELECT 'BC' || (s_suppkey * 2) FROM supplier)"""))
def _retag(t: Tables):
    return barcodes.retag(t.b9(), allow_list(t), "-1")


@query("retag_open", with_sql("b9", f"""SELECT {LINE_SQL} || coalesce(chr(9) || 'CB:Z:' || barcode || chr(9) || 'RG:Z:' || barcode, '') AS value, barcode AS cell_id FROM b9"""))
def _retag_open(t: Tables):
    """Without an allow list every line stays; lines without a barcode lose their old group only."""
    return barcodes.retag(t.b9())


@query("retag_job", with_sql("b9", f"""SELECT {LINE_SQL} || chr(9) || 'CB:Z:' || barcode || chr(9) || 'RG:Z:' || barcode || '-1' AS value, 'body' AS kind, NULL::BIGINT AS n
FROM b9 WHERE barcode IN (SELECT 'BC' || (s_suppkey * 2) FROM supplier)
UNION ALL SELECT '@RG' || chr(9) || 'ID:BC' || (s_suppkey * 2) || '-1' || chr(9) || CASE WHEN s_suppkey % 3 = 0 THEN 'SM:known' ELSE 'SM:BC' || (s_suppkey * 2) || '-1' || chr(9) || 'LB:cells' || chr(9) || 'PL:ILLUMINA' END, 'header', NULL FROM supplier
UNION ALL SELECT c.name, 'counter', c.n FROM (SELECT count(*) AS seen, count(*) FILTER (ok) AS kept FROM (SELECT coalesce(barcode IN (SELECT 'BC' || (s_suppkey * 2) FROM supplier), false) AS ok FROM b9)),
  LATERAL (VALUES ('seen', seen), ('tagged', kept), ('written', kept), ('filtered_out', seen - kept)) c(name, n)"""))
def _retag_job(t: Tables):
    """Header, missing read groups and body written in one pass, read back beside the counters of that pass."""
    folder = shared_path(t.spark, "retag")
    key = (F.col("s_suppkey") * 2).cast("string")
    header = t.read("supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("@RG\tID:BC"), key, F.lit("-1\tSM:known")).alias("value"))
    counters = barcodes.retag_write(t.b9(), header, folder, allow_list(t), "-1")
    written = t.spark.read.text(folder)
    kind = F.when(F.col("value").startswith("@"), "header").otherwise("body")
    told = t.spark.createDataFrame([(n, "counter", c) for n, c in counters.items()], "value string, kind string, n long")
    return written.select("value", kind.alias("kind"), F.lit(None).cast("long").alias("n")).unionByName(told)


@query("retag_counters", with_sql("b9", """SELECT count(*) AS seen, count(*) FILTER (ok) AS tagged, count(*) FILTER (ok) AS written, count(*) FILTER (NOT ok) AS filtered_out
FROM (SELECT coalesce(barcode IN (SELECT 'BC' || (s_suppkey * 2) FROM supplier), false) AS ok FROM b9)"""))
def _retag_counters(t: Tables):
    return barcodes.retag_counters(t.b9(), barcodes.retag(t.b9(), allow_list(t), "-1"))


@query("read_group_headers", """SELECT cell_id, '@RG' || chr(9) || 'ID:' || cell_id || chr(9) || 'SM:' || cell_id || chr(9) || 'LB:cells' || chr(9) || 'PL:ILLUMINA' AS value
FROM (SELECT DISTINCT 'BC' || (s_suppkey * 2) || '-1' AS cell_id FROM supplier) WHERE cell_id NOT IN (SELECT 'BC' || n_nationkey || '-1' FROM nation)""")
def _rg_headers(t: Tables):
    header = t.read("nation").select(F.concat(F.lit("@RG\tID:BC"), F.col("n_nationkey").cast("string"), F.lit("-1\tSM:x")).alias("value"))
    return barcodes.read_group_headers(allow_list(t), header, "-1")


@query("barcode_suffix_counts", with_sql("b6", """SELECT '_' || segment AS suffix, count(*) AS "count" FROM b6 GROUP BY ALL"""))
def _suffix_counts(t: Tables):
    return barcodes.suffix_counts(t.b6().select(F.col("CB").alias("cell_id")))


@query("barcode_suffix", with_sql("b6", """SELECT segment, CASE WHEN segment <> 'BUILDING' THEN '_' || segment END AS suffix FROM (SELECT DISTINCT segment FROM b6)"""))
def _suffix(t: Tables):
    """Common suffix per market segment; one segment gets an id without a suffix."""
    cells = t.b6().select("segment", F.when(F.col("segment") == "BUILDING", F.lit("plain")).otherwise(F.col("CB")).alias("cell_id"))
    return barcodes.common_suffix(cells, ["segment"])


@query("filter_by_suffix", with_sql("b6", """SELECT CB, segment, nation, cell_pos FROM b6 WHERE CB LIKE '%MACHINERY'"""))
def _filter_suffix(t: Tables):
    return barcodes.filter_by_suffix(t.b6(), "_MACHINERY").select("CB", "segment", "nation", "cell_pos")


META_SQL = """,
cut AS (SELECT 'BC' || (cell_pos % 300) AS CB, segment, nation, cell_pos FROM b6)
"""


def prepared(t: Tables):
    cells = t.b4().select(F.concat(F.lit("BC"), F.col("cell_id").cast("string")).alias("cell_id"))
    return barcodes.prepare_metadata(t.b6(), ["segment", "nation"], ["cell_pos"], cells, normalize=True)


@query("prepare_metadata", with_sql("b6 b4", META_SQL + """, picked AS (SELECT CB, arg_min(segment, cell_pos) AS segment, arg_min(nation, cell_pos) AS nation FROM cut GROUP BY CB)
SELECT 'BC' || cell_id AS CB, segment, nation FROM b4 LEFT JOIN picked ON CB = 'BC' || cell_id"""))
def _prepare_metadata(t: Tables):
    return prepared(t)[0]


@query("metadata_conflicts", with_sql("b6", META_SQL + """, long AS (SELECT CB, 'segment' AS "column", segment AS value, cell_pos FROM cut UNION ALL SELECT CB, 'nation', nation, cell_pos FROM cut),
vals AS (SELECT CB, "column", value, min(cell_pos) AS first FROM long GROUP BY ALL)
SELECT * FROM vals QUALIFY count(*) OVER (PARTITION BY CB, "column") > 1"""))
def _conflicts(t: Tables):
    return prepared(t)[1].withColumn("first", F.col("first.cell_pos"))


@query("metadata_missing", with_sql("b6 b4", """SELECT count(*) AS aligned_rows, count(*) FILTER (cell_id NOT IN (SELECT cell_pos % 300 FROM b6)) AS missing_segment,
count(*) FILTER (cell_id NOT IN (SELECT cell_pos % 300 FROM b6)) AS missing_nation FROM b4"""))
def _missing(t: Tables):
    return barcodes.missing_by_column(prepared(t)[0], ["segment", "nation"])


@query("reads_per_sample", with_sql("b9", """SELECT barcode AS sample, count(*) AS num_seqs, barcode IN (SELECT 'BC' || (s_suppkey * 2) FROM supplier) AS in_metadata FROM b9 WHERE barcode IS NOT NULL GROUP BY ALL"""))
def _reads_per_sample(t: Tables):
    named = text.parse_sam(t.b9(), ["CB"]).select(F.concat(F.lit("/x/"), "CB", F.lit(".std.Aligned.sortedByCoord.out.bam")).alias("file"))
    reads = named.filter("file IS NOT NULL").select(barcodes.clean_sample(F.col("file")).alias("sample"))
    return barcodes.matched_counts(barcodes.reads_per_sample(reads), allow_list(t))


COUNTED_SQL = MERGED_SQL + """,
shapes AS (SELECT chrom, pos, spliced, CASE WHEN spliced THEN gap END AS gap, count(*) AS n FROM b9 GROUP BY ALL),
parts AS (SELECT *, pos AS b, CASE WHEN spliced THEN pos + 49 ELSE pos + 99 END AS e FROM shapes
  UNION ALL SELECT *, pos + 50 + gap, pos + 99 + gap FROM shapes WHERE spliced)
"""


def merged_exons(t: Tables):
    # the range join reads them twice: once for the levels in use
    return stored(exon_merge(exon_prepare(t.b1_exons())).withColumnRenamed("seqname", "chrom").select("gene_id", "exon_number", "chrom", "start", "end"))


def reads(t: Tables):
    return text.parse_sam(t.b9()).select("name", "chrom", "pos", "cigar", "flag", "mapq")


@query("overlap_exon_counts", with_sql("b1 b9", COUNTED_SQL + """, hits AS (SELECT DISTINCT chrom, pos, spliced, gap, n, gene_id, exon_number FROM parts JOIN merged ON chrom = seqname AND b <= "end" AND "start" <= e)
SELECT gene_id, exon_number, CAST(sum(n) AS BIGINT) AS "count" FROM hits GROUP BY ALL"""))
def _exon_counts(t: Tables):
    return counts.overlap_counts(reads(t), merged_exons(t), ["gene_id", "exon_number"], width=128)


@query("overlap_gene_counts", with_sql("b1 b9", COUNTED_SQL + """, hits AS (SELECT DISTINCT chrom, pos, spliced, gap, n, gene_id FROM parts JOIN merged ON chrom = seqname AND b <= "end" AND "start" <= e)
SELECT gene_id, CAST(sum(n) AS BIGINT) AS "count" FROM hits GROUP BY ALL"""))
def _gene_counts(t: Tables):
    return counts.overlap_counts(reads(t), merged_exons(t), ["gene_id"], width=128)


@query("overlap_junction_counts", with_sql("b9", """SELECT chrom, pos + 49 AS "start", pos + 50 + gap AS "end", count(*) AS "count" FROM b9 WHERE spliced GROUP BY ALL"""))
def _junction_counts(t: Tables):
    return counts.junction_counts(reads(t))
