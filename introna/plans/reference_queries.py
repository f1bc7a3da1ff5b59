"""Queries over the annotation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from introna.operators import reference as ref
from introna.plans.bindings import Tables, with_sql
from introna.plans.registry import query

# merged exons of B1: islands per gene, 'first' row of the gene as template
MERGED_SQL = """,
usable AS (SELECT * FROM b1 WHERE "start" < "end"),
reached AS (SELECT gene_id, "start", "end", max("end") OVER (PARTITION BY gene_id ORDER BY "start", "end", line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM usable),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END)
  OVER (PARTITION BY gene_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM reached),
spans AS (SELECT gene_id, min("start") AS "start", max("end") AS "end" FROM islands GROUP BY gene_id, island),
template AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY "start", "end", line_no) = 1),
merged AS (SELECT s.gene_id, s."start", s."end", row_number() OVER (PARTITION BY s.gene_id ORDER BY s."start") AS exon_number,
  t.gene_name, t.seqname, t.strand, t.transcript_id FROM spans s JOIN template t USING (gene_id))
"""


def merged(t: Tables):
    return ref.exon_merge(ref.exon_rows(t.b1_exons()))


@query("exon_prepare", with_sql("b1", """SELECT gene_id, "start", "end", transcript_id, exon_number, strand FROM b1
WHERE feature = 'exon' QUALIFY row_number() OVER (PARTITION BY gene_id, "start", "end" ORDER BY line_no) = 1"""))
def _exon_prepare(t: Tables):
    return ref.exon_prepare(t.b1()).select("gene_id", "start", "end", "transcript_id", "exon_number", "strand")


@query("exon_merge", with_sql("b1", MERGED_SQL + "SELECT gene_id, gene_name, seqname, strand, \"start\", \"end\", exon_number FROM merged"))
def _exon_merge(t: Tables):
    return merged(t).select("gene_id", "gene_name", "seqname", "strand", "start", "end", "exon_number")


@query("exon_overlap_check", with_sql("b1", """,
prepared AS (SELECT DISTINCT gene_id, "start", "end" FROM b1),
ahead AS (SELECT *, lead("start") OVER (PARTITION BY gene_id ORDER BY "start", "end") AS next_start FROM prepared)
SELECT gene_id, "start", "end", next_start FROM ahead WHERE next_start < "end" """))
def _overlap_check(t: Tables):
    return ref.exon_overlap_check(ref.exon_prepare(t.b1_exons()).select("gene_id", "start", "end"))


@query("exon_gene_report", with_sql("b1", """,
kept AS (SELECT DISTINCT gene_id FROM b1),
want AS (SELECT DISTINCT 'gene' || s_suppkey * 2 AS gene_id FROM supplier)
SELECT gene_id, 'missing' AS status FROM want WHERE gene_id NOT IN (SELECT gene_id FROM kept)
UNION ALL SELECT gene_id, 'unexpected' FROM kept WHERE gene_id NOT IN (SELECT gene_id FROM want)"""))
def _gene_report(t: Tables):
    """All annotated genes against a list that lacks every other one and has as many unknown ones."""
    wanted = t.read("supplier").select(F.concat(F.lit("gene"), (F.col("s_suppkey") * 2).cast("string")).alias("gene_id"))
    return ref.gene_set_difference(t.b1(), wanted)


@query("adjacency_index", with_sql("b1", MERGED_SQL + """,
sizes AS (SELECT gene_id, count(*) AS n_exons FROM merged GROUP BY gene_id)
SELECT gene_id, n_exons, CAST(coalesce(sum(n_exons * n_exons) OVER w, 0) AS BIGINT) AS ind_st, n_exons * n_exons AS ind
FROM sizes WINDOW w AS (ORDER BY gene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def _adjacency_index(t: Tables):
    return ref.adjacency_index(merged(t), ["gene_id", "start"]).select("gene_id", "n_exons", "ind_st", "ind")


@query("adjacency_metadata", with_sql("b1", """,
exon_rows AS (SELECT gene_id, exon_number, min(line_no) AS line_no FROM b1 GROUP BY ALL),
firsts AS (SELECT gene_id, coalesce(arg_min(gene_name, line_no), gene_id) AS raw_name FROM b1 GROUP BY gene_id),
named AS (SELECT gene_id, CASE WHEN count(*) OVER (PARTITION BY raw_name) > 1 THEN raw_name || '-' || gene_id ELSE raw_name END AS gene_name FROM firsts),
sizes AS (SELECT gene_id, count(*) AS n FROM exon_rows GROUP BY gene_id),
slots AS (SELECT gene_id, unnest(generate_series(1, n * n)) AS slot FROM sizes)
SELECT gene_id, gene_name, slot, gene_name || '-' || slot AS junction_name FROM slots JOIN named USING (gene_id)"""))
def _adjacency_metadata(t: Tables):
    exons = t.b1().groupBy("gene_id", "gene_name", "exon_number").agg(F.min("line_no").alias("line_no"))
    return ref.adjacency_metadata(exons, ["line_no"])


@query("gene_order", with_sql("b1", """SELECT gene_id, row_number() OVER (ORDER BY CAST(substr(gene_id, 5) AS BIGINT)) - 1 AS gene_pos
FROM (SELECT DISTINCT gene_id FROM b1)"""))
def _gene_order(t: Tables):
    return ref.gene_order(t.b1(), ["line_no"])


@query("gene_order_mixed", with_sql("b1", """SELECT gene_id, row_number() OVER (ORDER BY f) - 1 AS gene_pos
FROM (SELECT gene_id, min(line_no) AS f FROM (SELECT line_no, coalesce(gene_name, gene_id) AS gene_id FROM b1) GROUP BY gene_id)"""))
def _gene_order_mixed(t: Tables):
    """Ids that are not all numbered keep their first-seen order."""
    return ref.gene_order(t.b1().withColumn("gene_id", F.coalesce("gene_name", "gene_id")), ["line_no"])


@query("feature_annotation", with_sql("b1", MERGED_SQL + """,
placed AS (SELECT gene_id, gene_name, row_number() OVER (ORDER BY gene_id, "start") - 1 AS exon_pos FROM merged),
named AS (SELECT gene_id, exon_pos, coalesce(gene_name, gene_id) AS gene_name FROM placed)
SELECT gene_id, gene_name, exon_pos, gene_name || '-' || row_number() OVER (PARTITION BY gene_name ORDER BY exon_pos) AS gene_exon_name FROM named"""))
def _feature_annotation(t: Tables):
    exons = merged(t)
    index = ref.adjacency_index(exons, ["gene_id", "start"])
    placed = exons.join(index.select("gene_id", "exon_st"), "gene_id").withColumn(
        "exon_pos", F.col("exon_st") + F.col("exon_number") - 1
    )
    names = t.b1().filter("gene_name IS NOT NULL").select("gene_id", "gene_name").distinct()
    return ref.feature_annotation(placed, names)


@query("genome_to_transcript", with_sql("b1", """,
distinct_exons AS (SELECT DISTINCT transcript_id, strand, "start", "end" FROM b1 WHERE "start" <= "end"),
placed AS (SELECT *, coalesce(sum("end" - "start" + 1) OVER (PARTITION BY transcript_id ORDER BY
  CASE WHEN strand = '-' THEN -"end" ELSE "start" END, CASE WHEN strand = '-' THEN -"start" ELSE "end" END
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM distinct_exons),
wanted AS (SELECT DISTINCT transcript_id, "start" + 7 AS pos FROM b1)
SELECT w.transcript_id, w.pos, CAST(min(before + CASE WHEN strand = '-' THEN "end" - pos ELSE pos - "start" END + 1) AS BIGINT) AS "offset"
FROM wanted w LEFT JOIN placed p ON w.transcript_id = p.transcript_id AND w.pos BETWEEN p."start" AND p."end" GROUP BY ALL"""))
def _genome_to_transcript(t: Tables):
    wanted = t.b1().select("transcript_id", (F.col("start") + 7).alias("pos")).distinct()
    return ref.genome_to_transcript(wanted, t.b1().filter("start <= end"))


@query("promoter_regions", with_sql("b1", """,
transcripts AS (SELECT transcript_id, gene_id, gene_name, seqname, strand, min("start") AS "start", max("end") AS "end" FROM b1 GROUP BY ALL),
sizes AS (SELECT seqname, max("end") + 500 AS size FROM b1 GROUP BY seqname),
windows AS (SELECT seqname AS chrom, gene_id || ', ' || gene_name AS name, strand,
  greatest(CASE WHEN strand = '+' THEN "start" - 2000 ELSE "end" - 200 END, 0) AS "start",
  least(CASE WHEN strand = '+' THEN "start" + 200 ELSE "end" + 2000 END, size) AS "end"
  FROM transcripts JOIN sizes USING (seqname) WHERE gene_name IS NOT NULL),
reached AS (SELECT *, max("end") OVER (PARTITION BY chrom, name ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM windows),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, name ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM reached),
merged AS (SELECT chrom, name, strand, min("start") AS "start", max("end") AS stop FROM islands GROUP BY chrom, name, strand, island)
SELECT chrom, "start", stop, (row_number() OVER (ORDER BY chrom, "start", stop, name) - 1) || ': ' || name AS name, '.' AS score, strand FROM merged"""))
def _promoters(t: Tables):
    transcripts = t.b1().groupBy("transcript_id", "gene_id", "gene_name", "seqname", "strand").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("line_no").alias("line_no")
    )
    sizes = t.b1().groupBy("seqname").agg((F.max("end") + 500).alias("size"))
    return ref.promoter_regions(transcripts, sizes)


@query("annotated_introns", with_sql("b1", """,
distinct_exons AS (SELECT DISTINCT seqname, strand, transcript_id, "start", "end" FROM b1),
ahead AS (SELECT *, lead("start") OVER (PARTITION BY seqname, strand, transcript_id ORDER BY "start", "end") AS nxt FROM distinct_exons)
SELECT seqname AS chrom, "end" + 1 AS "start", nxt - 1 AS "end",
  string_agg(DISTINCT CASE strand WHEN '+' THEN '1' WHEN '-' THEN '2' ELSE '0' END, ',' ORDER BY CASE strand WHEN '+' THEN '1' WHEN '-' THEN '2' ELSE '0' END) AS strands
FROM ahead WHERE "end" + 1 <= nxt - 1 GROUP BY ALL"""))
def _introns(t: Tables):
    introns = ref.annotated_introns(t.b1())
    return introns.withColumn("strands", F.concat_ws(",", F.col("strands").cast("array<string>")))


@query("gene_of_region", with_sql("b1", MERGED_SQL + """,
regions AS (SELECT DISTINCT seqname AS chrom, "start" - 40 AS "start", "start" + 60 AS stop, strand FROM b1),
named AS (SELECT *, 'exon:' || chrom || ':' || "start" || '-' || stop || ':' || strand AS region_id FROM regions),
places AS (SELECT gene_id, gene_name, seqname, strand, "start" AS g_start, "end" AS g_stop FROM merged)
SELECT region_id, string_agg(DISTINCT gene_id, ',' ORDER BY gene_id) AS gene_ids,
  coalesce(string_agg(DISTINCT gene_name, ',' ORDER BY gene_name), '') AS gene_names
FROM named n JOIN places i ON n.chrom = i.seqname AND n.strand = i.strand AND n."start" <= i.g_stop AND i.g_start <= n.stop GROUP BY region_id"""))
def _gene_of_region(t: Tables):
    rows = t.b1()
    regions = rows.select(
        F.col("seqname").alias("chrom"), (F.col("start") - 40).alias("start"), (F.col("start") + 60).alias("stop"), "strand"
    ).distinct()
    regions = regions.withColumn("region_id", F.format_string("exon:%s:%d-%d:%s", "chrom", "start", "stop", "strand"))
    genes = merged(t).select(
        F.col("seqname").alias("chrom"), "strand", F.col("start").alias("g_start"), F.col("end").alias("g_stop"), "gene_id", "gene_name"
    )
    merged_ids = ref.gene_of_region(regions, genes, width=512)
    return merged_ids.select(
        "region_id", F.concat_ws(",", "gene_ids").alias("gene_ids"), F.concat_ws(",", "gene_names").alias("gene_names")
    )


@query("region_ops", with_sql("b1", """,
named AS (SELECT DISTINCT seqname, "start" AS s, greatest("start", "end") AS e, strand, exon_number FROM b1)
SELECT 'exon:' || seqname || ':' || s || '-' || e || ':' || strand AS name,
  seqname || ':' || (s + 10 * (CAST(exon_number AS BIGINT) - 3)) || '-' || (s + 10 * (CAST(exon_number AS BIGINT) - 3) + 9) || ':+' AS other,
  'exon' AS kind, seqname AS chrom, s AS "start", e AS stop, strand, e - s + 1 AS length,
  CASE WHEN strand = '-' THEN -s ELSE s END AS signed_start,
  s + 10 * (CAST(exon_number AS BIGINT) - 3) <= e AND s + 10 * (CAST(exon_number AS BIGINT) - 3) + 9 >= s AS overlaps
FROM named WHERE s + 10 * (CAST(exon_number AS BIGINT) - 3) >= 0"""))
def _region_ops(t: Tables):
    shift = F.col("start") + 10 * (F.col("exon_number").cast("long") - 3)
    rows = t.b1().filter(shift >= 0).select(
        F.format_string("exon:%s:%d-%d:%s", "seqname", "start", F.greatest("start", "end"), "strand").alias("name"),
        F.format_string("%s:%d-%d:+", "seqname", shift, shift + 9).alias("other"),
    ).distinct()
    return ref.region_ops(rows, "name", "other")
