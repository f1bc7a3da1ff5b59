"""Queries over junction tables, splice events and PSI."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from introna.functions.columns import r6
from introna.operators import splice
from introna.plans.bindings import Tables, with_sql
from introna.plans.registry import query
from introna.session import stored
from introna.sources import text


def strand_name(column):
    return F.when(column == 1, "+").when(column == 2, "-").otherwise("undefined")


NAMED_SQL = """,
named AS (SELECT sample, chrom, "start" AS junction_start, "end" AS junction_stop, CASE strand WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE 'undefined' END AS strand, uniq + multi AS reads, annotated, motif FROM b3),
ids AS (SELECT *, junction_stop + 1 AS exon_start, junction_start - 1 AS exon_stop, 'junction:' || chrom || ':' || junction_start || '-' || junction_stop || ':' || strand AS junction_id FROM named)
"""


def named_junctions(t: Tables):
    rows = t.b3().select(
        "sample", "chrom", F.col("start").alias("junction_start"), F.col("end").alias("junction_stop"), strand_name(F.col("strand")).alias("strand"),
        (F.col("uniq") + F.col("multi")).alias("reads"), "annotated", "motif",
    )
    return text.junction_ids(rows)


@query("junction_ids", with_sql("b3", NAMED_SQL + "SELECT sample, junction_id, exon_start, exon_stop, reads FROM ids"))
def _ids(t: Tables):
    return named_junctions(t).select("sample", "junction_id", "exon_start", "exon_stop", "reads")


@query("junction_metadata", with_sql("b3", NAMED_SQL + "SELECT DISTINCT junction_id, chrom, junction_start, junction_stop, exon_start, exon_stop, strand, motif, annotated FROM ids WHERE reads >= 10"))
def _metadata(t: Tables):
    columns = ["junction_id", "chrom", "junction_start", "junction_stop", "exon_start", "exon_stop", "strand", "motif", "annotated"]
    return splice.junction_metadata(named_junctions(t), columns)


CIGAR_SQL = """,
gaps AS (SELECT chrom, pos + 50 AS "start", pos + 49 + gap AS stop, strand, count(*) FILTER (mapq >= 255) AS uniq, count(*) FILTER (mapq < 255) AS multi FROM b9 WHERE spliced GROUP BY ALL),
u AS (SELECT chrom, "start", stop, arg_max(strand, uniq * 2 + CASE WHEN strand = '+' THEN 1 ELSE 0 END) AS strand, CAST(sum(uniq) AS BIGINT) AS uniq FROM gaps WHERE uniq > 0 GROUP BY ALL),
m AS (SELECT chrom, "start", stop, arg_max(strand, multi * 2 + CASE WHEN strand = '+' THEN 1 ELSE 0 END) AS strand, CAST(sum(multi) AS BIGINT) AS multi FROM gaps WHERE multi > 0 GROUP BY ALL)
"""


def gaps(t: Tables):
    return splice.cigar_junctions(text.parse_sam(t.b9()))


@query("cigar_junctions", with_sql("b9", CIGAR_SQL + "SELECT * FROM gaps"))
def _cigar(t: Tables):
    return gaps(t)


@query("majority_strand", with_sql("b9", CIGAR_SQL + "SELECT * FROM u"))
def _majority(t: Tables):
    return splice.majority_strand(gaps(t), "uniq")


@query("combine_unique_multi", with_sql("b9", CIGAR_SQL + """SELECT u.chrom, u."start", u.stop, u.strand, uniq, coalesce(multi, 0) AS multi, uniq + coalesce(multi, 0) AS reads
FROM u LEFT JOIN m ON u.chrom = m.chrom AND u."start" = m."start" AND u.stop = m.stop AND u.strand = m.strand WHERE u."start" <> u.stop"""))
def _combine(t: Tables):
    counts = gaps(t)
    return splice.combine_unique_multi(splice.majority_strand(counts, "uniq"), splice.majority_strand(counts, "multi"))


@query("novel_exons", with_sql("b9", """,
js AS (SELECT DISTINCT chrom, pos + 50 AS "start", pos + 49 + gap AS stop, strand FROM b9 WHERE spliced),
known AS (SELECT DISTINCT chrom, pos AS "start", pos + 99 AS stop, strand FROM b9 WHERE NOT spliced),
found AS (SELECT DISTINCT a.chrom, a.stop + 1 AS "start", b."start" - 1 AS stop, CASE WHEN a.strand = b.strand THEN a.strand ELSE '.' END AS strand
  FROM js a JOIN js b ON a.chrom = b.chrom AND b."start" > a.stop AND b."start" <= a.stop + 100)
SELECT f.* FROM found f ANTI JOIN known k ON f.chrom = k.chrom AND f."start" = k."start" AND f.stop = k.stop AND f.strand = k.strand"""))
def _novel(t: Tables):
    # each line is parsed once; what counts is which alignments there are
    reads = stored(text.parse_sam(t.b9()).select("chrom", "pos", "cigar", "flag", "mapq").distinct())
    strand = F.when(F.col("flag") == 16, "-").otherwise("+")
    known = reads.filter("cigar = '100M'").select("chrom", F.col("pos").alias("start"), (F.col("pos") + 99).alias("stop"), strand.alias("strand"))
    return splice.novel_exons(splice.cigar_junctions(reads), known.distinct())


# Events on the contigs of B5 --------------------------------------------------------------------

EDGE_SQL = """,
js AS (SELECT DISTINCT junction_id, chrom, strand, "start", stop FROM b5),
hits AS (SELECT e.exon_id, CASE WHEN j.strand = '+' THEN 'upstream' ELSE 'downstream' END AS direction, junction_id FROM b5_exons e JOIN js j ON e.chrom = j.chrom AND e.strand = j.strand AND e.stop = j."start" - 1
  UNION SELECT e.exon_id, CASE WHEN j.strand = '+' THEN 'downstream' ELSE 'upstream' END, junction_id FROM b5_exons e JOIN js j ON e.chrom = j.chrom AND e.strand = j.strand AND e."start" = j.stop + 1),
ex AS (SELECT exon_id, chrom, "start" AS s, stop AS e, strand, CASE WHEN strand = '-' THEN -"start" ELSE "start" END AS signed FROM b5_exons),
ed AS (SELECT u.exon_id AS up, d.exon_id AS down, u.junction_id AS j FROM hits u JOIN hits d ON u.junction_id = d.junction_id WHERE u.direction = 'upstream' AND d.direction = 'downstream'),
se AS (SELECT a.up AS exon1, a.down AS exon2, b.down AS exon3, c.j AS junction13, a.j AS junction12, b.j AS junction23, x2.strand
  FROM ed a JOIN ed b ON a.down = b.up JOIN ed c ON c.up = a.up AND c.down = b.down JOIN ex x2 ON x2.exon_id = a.down JOIN ex x3 ON x3.exon_id = b.down
  WHERE x2.signed < x3.signed AND (x2.s > x3.e OR x2.e < x3.s)),
mxe AS (SELECT a.up AS exon1, a.down AS exon2, b.down AS exon3, c.down AS exon4, b.j AS junction13, d.j AS junction34, a.j AS junction12, c.j AS junction24, x2.strand, x2.chrom,
    CASE WHEN x2.strand = '+' THEN x1.e ELSE x4.e END + 1 AS s14, CASE WHEN x2.strand = '+' THEN x4.s ELSE x1.s END - 1 AS e14,
    CASE WHEN x2.strand = '+' THEN x2.e ELSE x3.e END + 1 AS s23, CASE WHEN x2.strand = '+' THEN x3.s ELSE x2.s END - 1 AS e23
  FROM ed a JOIN ed b ON a.up = b.up JOIN ed c ON c.up = a.down JOIN ed d ON d.up = b.down AND d.down = c.down
  JOIN ex x1 ON x1.exon_id = a.up JOIN ex x2 ON x2.exon_id = a.down JOIN ex x3 ON x3.exon_id = b.down JOIN ex x4 ON x4.exon_id = c.down
  WHERE x2.signed < x3.signed AND (x2.s > x3.e OR x2.e < x3.s)),
se_id AS (SELECT *, 'isoform1=' || junction13 || '|isoform2=' || junction12 || '@' || exon2 || '@' || junction23 AS event_id FROM se),
mxe_id AS (SELECT *, 'isoform1=' || junction13 || '@' || exon3 || '@' || junction34 || '|isoform2=' || junction12 || '@' || exon2 || '@' || junction24 AS event_id,
  'junction:' || chrom || ':' || s14 || '-' || e14 || ':' || strand AS junction14, 'junction:' || chrom || ':' || s23 || '-' || e23 || ':' || strand AS junction23 FROM mxe)
"""
EVENTS = "b5 b5_exons"


def exons(t: Tables):
    return t.b5_exons()


def stored_reads(t: Tables):
    """The splice reads, summed up and stored once per query."""
    if getattr(t, "splice_reads", None) is None:
        t.splice_reads = stored(t.b5().select("sample_id", "junction_id", "chrom", "strand", "start", "stop", "reads"))
    return t.splice_reads


def triples(t: Tables):
    rows = stored_reads(t).select("junction_id", "chrom", "strand", (F.col("stop") + 1).alias("exon_start"), (F.col("start") - 1).alias("exon_stop"))
    return splice.exon_junction_triples(exons(t), rows)


def edges(t: Tables):
    return splice.exon_edges(triples(t), exons(t))


def stored_edges(t: Tables):
    """The exon graph, built and stored once per query."""
    if getattr(t, "exon_graph", None) is None:
        t.exon_graph = stored(edges(t))
    return t.exon_graph


def events(t: Tables, splice_type: str):
    graph = stored_edges(t)
    if splice_type == "se":
        return splice.event_ids(splice.skipped_exon_events(graph), "se")
    return splice.incompatible_junctions(splice.event_ids(splice.mutually_exclusive_events(graph), "mxe"))


@query("exon_junction_triples", with_sql(EVENTS, EDGE_SQL + "SELECT * FROM hits"))
def _triples(t: Tables):
    return triples(t)


@query("skipped_exon_events", with_sql(EVENTS, EDGE_SQL + "SELECT exon1, exon2, exon3, junction13, junction12, junction23 FROM se"))
def _se(t: Tables):
    return events(t, "se").select("exon1", "exon2", "exon3", "junction13", "junction12", "junction23")


@query("mutually_exclusive_events", with_sql(EVENTS, EDGE_SQL + "SELECT exon1, exon2, exon3, exon4, junction13, junction34, junction12, junction24 FROM mxe"))
def _mxe(t: Tables):
    return events(t, "mxe").select("exon1", "exon2", "exon3", "exon4", "junction13", "junction34", "junction12", "junction24")


@query("event_ids", with_sql(EVENTS, EDGE_SQL + """SELECT event_id, 'se' AS splice_type, exon1 || '@' || exon2 || '@' || exon3 AS exons, junction13 || '@' || junction12 || '@' || junction23 AS junctions, strand FROM se_id
UNION ALL SELECT event_id, 'mxe', exon1 || '@' || exon2 || '@' || exon3 || '@' || exon4, junction13 || '@' || junction34 || '@' || junction12 || '@' || junction24, strand FROM mxe_id"""))
def _event_ids(t: Tables):
    columns = ["event_id", "splice_type", "exons", "junctions", "strand"]
    return events(t, "se").select(*columns).unionByName(events(t, "mxe").select(*columns))


@query("incompatible_junctions", with_sql(EVENTS, EDGE_SQL + "SELECT event_id, junction14 || '|' || junction23 AS incompatible_junctions FROM mxe_id"))
def _incompatible(t: Tables):
    return events(t, "mxe").select("event_id", "incompatible_junctions")


@query("event_regions", with_sql(EVENTS, EDGE_SQL + """,
places AS (SELECT event_id, 'se' AS splice_type, exon1 AS f, exon3 AS l FROM se_id UNION ALL SELECT event_id, 'mxe', exon1, exon4 FROM mxe_id),
spans AS (SELECT p.*, a.chrom, a.strand, CASE WHEN a.strand = '-' THEN b.e ELSE a.e END AS i1, CASE WHEN a.strand = '-' THEN a.s ELSE b.s END AS i2,
  CASE WHEN a.strand = '-' THEN b.s ELSE a.s END AS e1, CASE WHEN a.strand = '-' THEN a.e ELSE b.e END AS e2 FROM places p JOIN ex a ON a.exon_id = f JOIN ex b ON b.exon_id = l)
SELECT event_id, splice_type, i2 - i1 + 1 AS intron_length, e2 - e1 + 1 AS event_length, 50 AS exon1_length, 50 AS exon2_length,
'intron:' || chrom || ':' || i1 || '-' || i2 || ':' || strand AS intron_location, 'event:' || chrom || ':' || e1 || '-' || e2 || ':' || strand AS event_location FROM spans"""))
def _regions(t: Tables):
    columns = ["event_id", "splice_type", "intron_length", "event_length", "exon1_length", "exon2_length", "intron_location", "event_location"]
    return splice.event_regions(events(t, "se"), "se").select(*columns).unionByName(splice.event_regions(events(t, "mxe"), "mxe").select(*columns))


def attribute_rows(t: Tables):
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("gene_id", "gene_name", "transcript_id")])
    rows = exons(t).select("exon_id", F.explode(pairs).alias("p")).select("exon_id", "p.key", "p.value")
    return rows.filter("value IS NOT NULL")


@query("event_attributes", with_sql(EVENTS, EDGE_SQL + """,
members AS (SELECT event_id, 'isoform1' AS isoform, 2 AS n, unnest([exon1, exon3]) AS exon_id FROM se_id UNION ALL SELECT event_id, 'isoform2', 3, unnest([exon1, exon2, exon3]) FROM se_id
  UNION ALL SELECT event_id, 'isoform1', 3, unnest([exon1, exon3, exon4]) FROM mxe_id UNION ALL SELECT event_id, 'isoform2', 3, unnest([exon1, exon2, exon4]) FROM mxe_id),
attrs AS (SELECT exon_id, 'gene_id' AS key, gene_id AS value FROM b5_exons UNION ALL SELECT exon_id, 'gene_name', gene_name FROM b5_exons WHERE gene_name IS NOT NULL
  UNION ALL SELECT exon_id, 'transcript_id', transcript_id FROM b5_exons),
per AS (SELECT event_id, isoform, n, key, value, count(*) AS c FROM members JOIN attrs USING (exon_id) GROUP BY ALL)
SELECT event_id, isoform, key, coalesce(string_agg(DISTINCT value, ',' ORDER BY value) FILTER (c = n), '') AS value FROM per GROUP BY event_id, isoform, key"""))
def _attributes(t: Tables):
    rows = attribute_rows(t)
    return splice.event_attributes(events(t, "se"), "se", rows).unionByName(splice.event_attributes(events(t, "mxe"), "mxe", rows))


SITE_SQL = EDGE_SQL + """,
whole AS (SELECT chrom, string_agg(seq, '' ORDER BY chunk_no) AS bases FROM b8 GROUP BY chrom),
pairs AS (SELECT event_id, 'isoform1' AS isoform, 'exon1-exon3' AS pair, exon1 AS a, exon3 AS b FROM se_id UNION ALL SELECT event_id, 'isoform2', 'exon1-exon2', exon1, exon2 FROM se_id
  UNION ALL SELECT event_id, 'isoform2', 'exon2-exon3', exon2, exon3 FROM se_id
  UNION ALL SELECT event_id, 'isoform1', 'exon1-exon3', exon1, exon3 FROM mxe_id UNION ALL SELECT event_id, 'isoform1', 'exon3-exon4', exon3, exon4 FROM mxe_id
  UNION ALL SELECT event_id, 'isoform2', 'exon1-exon2', exon1, exon2 FROM mxe_id UNION ALL SELECT event_id, 'isoform2', 'exon2-exon4', exon2, exon4 FROM mxe_id),
flanks AS (SELECT p.*, xa.strand, CASE WHEN xa.strand = '-' THEN xa.s - 2 ELSE xa.e + 1 END AS da, CASE WHEN xb.strand = '-' THEN xb.e + 1 ELSE xb.s - 2 END AS ab,
  bases FROM pairs p JOIN ex xa ON xa.exon_id = a JOIN ex xb ON xb.exon_id = b LEFT JOIN whole ON whole.chrom = 'chr' || (CAST(substr(xa.chrom, 4) AS BIGINT) % 5 + 1)),
sites AS (SELECT event_id, isoform, pair, CASE WHEN strand = '-' THEN reverse(translate(substr(bases, da, 2), 'ACGT', 'TGCA')) || '/' || reverse(translate(substr(bases, ab, 2), 'ACGT', 'TGCA'))
  ELSE substr(bases, da, 2) || '/' || substr(bases, ab, 2) END AS site FROM flanks)
"""


def on_sequence(rows, splice_type: str):
    """Event rows moved onto B8's chromosomes: contig g of B5 reads chromosome g % 5 + 1."""
    number = lambda c: F.substring(F.col(f"{c}.chrom"), 4, 20).cast("long")
    moved = {
        f"{e}_at": F.col(f"{e}_at").withField("chrom", F.concat(F.lit("chr"), (number(f"{e}_at") % 5 + 1).cast("string")))
        for e in splice.EXONS[splice_type]
    }
    return rows.withColumns(moved)


def sites(t: Tables):
    chunks = stored(t.b8())
    parts = [splice.splice_sites(on_sequence(events(t, s), s), s, chunks, 32) for s in ("se", "mxe")]
    return parts[0].unionByName(parts[1])


@query("validate_splice_sites", with_sql(EVENTS + " b8", SITE_SQL + """SELECT event_id, isoform, pair, site, site IN ('GT/AG', 'GC/AG', 'AT/AC') AS valid,
bool_and(site IN ('GT/AG', 'GC/AG', 'AT/AC')) OVER (PARTITION BY event_id) AS all_valid FROM sites"""))
def _validate(t: Tables):
    rows = stored(sites(t))
    good = splice.validate_splice_sites(rows.select("event_id").distinct(), rows).withColumn("all_valid", F.lit(True))
    return rows.join(good, "event_id", "left").fillna({"all_valid": False})


PSI_SQL = EDGE_SQL + """,
rd AS (SELECT sample_id, junction_id, sum(reads) AS reads FROM b5 GROUP BY ALL),
se_long AS (SELECT DISTINCT event_id, r.role, r.j FROM (SELECT event_id, unnest([{{'role': 'a', 'j': junction13}}, {{'role': 'c', 'j': junction12}}, {{'role': 'd', 'j': junction23}}]) AS r FROM se_id)),
mxe_long AS (SELECT DISTINCT event_id, r.role, r.j FROM (SELECT event_id, unnest([{{'role': 'a', 'j': junction13}}, {{'role': 'b', 'j': junction34}}, {{'role': 'c', 'j': junction12}}, {{'role': 'd', 'j': junction24}},
  {{'role': 'x', 'j': junction14}}, {{'role': 'y', 'j': junction23}}]) AS r FROM mxe_id)),
sums AS (SELECT 'se' AS splice_type, sample_id, event_id, coalesce(sum(reads) FILTER (role = 'a'), 0) AS a, NULL AS b, coalesce(sum(reads) FILTER (role = 'c'), 0) AS c, coalesce(sum(reads) FILTER (role = 'd'), 0) AS d, 0 AS x, 0 AS y
  FROM se_long JOIN rd ON j = junction_id GROUP BY ALL
  UNION ALL SELECT 'mxe', sample_id, event_id, coalesce(sum(reads) FILTER (role = 'a'), 0), coalesce(sum(reads) FILTER (role = 'b'), 0), coalesce(sum(reads) FILTER (role = 'c'), 0), coalesce(sum(reads) FILTER (role = 'd'), 0),
  coalesce(sum(reads) FILTER (role = 'x'), 0), coalesce(sum(reads) FILTER (role = 'y'), 0) FROM mxe_long JOIN rd ON j = junction_id GROUP BY ALL),
flags AS (SELECT *, a >= 10 AND coalesce(b, 10) >= 10 AS e1, c >= 10 AND d >= 10 AS e2, a < 10 AND coalesce(b, 0) < 10 AS n1, c < 10 AND d < 10 AS n2, a = 0 AND coalesce(b, 0) = 0 AS z1, c = 0 AND d = 0 AS z2,
  a + coalesce(b, 0) + c + d AS total, CASE WHEN b IS NULL THEN 30 ELSE 40 END AS need FROM sums WHERE a + coalesce(b, 0) + c + d + x + y > 0),
noted AS (SELECT *, CASE WHEN greatest(x, y) >= 10 THEN 'Case 1: >= 10 reads on junctions that are incompatible with the annotation'
  WHEN z1 AND z2 THEN 'Case 2: Zero observed reads' WHEN n1 AND n2 THEN 'Case 3: All junctions with insufficient reads'
  WHEN (NOT e1 AND n2) OR (n1 AND NOT e2) THEN 'Case 4: Only one junction with sufficient reads'
  WHEN greatest(c, d) + 1 > (least(c, d) + 1) * 10 OR (b IS NOT NULL AND greatest(a, b) + 1 > (least(a, b) + 1) * 10) THEN 'Case 5: Unequal read coverage (one side has at least 10x more reads)'
  WHEN e1 AND z2 THEN 'Case 6: Exclusion' WHEN z1 AND e2 THEN 'Case 7: Inclusion' WHEN e1 AND e2 THEN 'Case 8: Sufficient reads on all junctions'
  WHEN e1 THEN 'Case 9' || CASE WHEN total >= need THEN 'a' ELSE 'b' END || ': Isoform1 with sufficient reads but Isoform2 has 1+ junctions with insufficient reads' || CASE WHEN total >= need THEN ': There are sufficient junction reads' ELSE ': There are insufficient junction reads' END
  WHEN e2 THEN 'Case 10' || CASE WHEN total >= need THEN 'a' ELSE 'b' END || ': Isoform1 has 1+ junction with insufficient reads but Isoform2 with sufficient reads' || CASE WHEN total >= need THEN ': There are sufficient junction reads' ELSE ': There are insufficient junction reads' END
  ELSE 'Case 11' || CASE WHEN total >= need THEN 'a' ELSE 'b' END || ': Isoform1 and Isoform2 each have both sufficient and insufficient junctions' || CASE WHEN total >= need THEN ': There are sufficient junction reads' ELSE ': There are insufficient junction reads' END
  END AS notes FROM flags),
scored AS (SELECT *, CASE WHEN regexp_matches(notes, '^Case (6|7|8|9a|10a|11a)') THEN {fold} END AS psi FROM noted)
"""
MEAN_SQL = PSI_SQL.format(fold="((c + d) / 2) / ((c + d) / 2 + (a + coalesce(b, 0)) / CASE WHEN b IS NULL THEN 1 ELSE 2 END)")
MIN_SQL = PSI_SQL.format(fold="least(c, d) / nullif(least(c, d) + least(a, coalesce(b, a)), 0)")


def psi_rows(t: Tables, method: str = "mean"):
    """PSI summary of both event types."""
    graph = stored_edges(t)
    se = splice.event_ids(splice.skipped_exon_events(graph), "se")
    mxe = splice.incompatible_junctions(splice.event_ids(splice.mutually_exclusive_events(graph), "mxe"))
    return splice.psi_table(se, mxe, stored_reads(t).select("sample_id", "junction_id", "reads"), method=method)


DENSE_SQL = """,
known AS (SELECT DISTINCT event_id, splice_type FROM scored), takers AS (SELECT DISTINCT sample_id FROM b5),
dense AS (SELECT k.event_id, k.splice_type, t.sample_id, s.psi, coalesce(s.notes, 'Case 2: Zero observed reads') AS notes, coalesce(s.a, 0)::BIGINT AS first_reads,
  CASE WHEN k.splice_type = 'mxe' THEN coalesce(s.x, 0)::BIGINT END AS incompatible_reads
  FROM known k CROSS JOIN takers t LEFT JOIN scored s ON s.event_id = k.event_id AND s.sample_id = t.sample_id)
"""


def sparse_rows(t: Tables):
    """The PSI table with its default; its tiles are read by several steps."""
    table = splice.sparse_psi(events(t, "se"), events(t, "mxe"), stored_reads(t).select("sample_id", "junction_id", "reads"))
    return replace(table, tiles=stored(table.tiles), events=stored(table.events))


@query("psi_cases", with_sql(EVENTS, MEAN_SQL + """,
pairs AS (SELECT event_id, splice_type, sample_id FROM (SELECT DISTINCT event_id, 'se' AS splice_type FROM se_id UNION ALL SELECT DISTINCT event_id, 'mxe' FROM mxe_id) CROSS JOIN (SELECT DISTINCT sample_id FROM b5))
SELECT p.splice_type, coalesce(notes, 'Case 2: Zero observed reads') AS notes, count(*) AS n FROM pairs p
LEFT JOIN scored s ON s.event_id = p.event_id AND s.sample_id IS NOT DISTINCT FROM p.sample_id GROUP BY ALL"""))
def _cases(t: Tables):
    """Cases of every event and sample, whether or not the sample has a read on the event's junctions."""
    return sparse_rows(t).case_counts()


@query("psi_lookup", with_sql(EVENTS, MEAN_SQL + DENSE_SQL + "SELECT sample_id, event_id, splice_type, first_reads, incompatible_reads, round(psi, 6) AS psi, notes FROM dense"))
def _psi_lookup(t: Tables):
    """The default filled in for every sample of every scored event."""
    table = sparse_rows(t)
    takers = table.samples.agg(F.collect_set("sample_id")).scalar()  # fifty samples
    pairs = table.events.select("event_id", F.explode(takers).alias("sample_id"))
    return table.lookup(pairs).select(
        "sample_id", "event_id", "splice_type", F.col("isoform1_junction13").alias("first_reads"),
        F.col("incompatible_junction14").alias("incompatible_reads"), r6("psi").alias("psi"), "notes",
    )


@query("psi_case_counts", with_sql(EVENTS, MEAN_SQL + DENSE_SQL + "SELECT splice_type, notes, count(*) AS n FROM dense GROUP BY ALL"))
def _case_counts(t: Tables):
    """Cases over all samples and events, without listing those that are not stored."""
    return sparse_rows(t).case_counts()


@query("psi", with_sql(EVENTS, MEAN_SQL + "SELECT sample_id, event_id, round(psi, 6) AS psi FROM scored"))
def _psi(t: Tables):
    return psi_rows(t).select("sample_id", "event_id", r6("psi").alias("psi"))


@query("psi_min", with_sql(EVENTS, MIN_SQL + "SELECT sample_id, event_id, round(psi, 6) AS psi FROM scored"))
def _psi_min(t: Tables):
    return psi_rows(t, "min").select("sample_id", "event_id", r6("psi").alias("psi"))


@query("psi_summary", with_sql(EVENTS, MEAN_SQL + """SELECT sample_id, event_id, splice_type, CAST(a AS BIGINT) AS isoform1_junction13, CAST(b AS BIGINT) AS isoform1_junction34, CAST(c AS BIGINT) AS isoform2_junction12,
CASE WHEN splice_type = 'se' THEN CAST(d AS BIGINT) END AS isoform2_junction23, CASE WHEN splice_type = 'mxe' THEN CAST(d AS BIGINT) END AS isoform2_junction24,
CASE WHEN splice_type = 'mxe' THEN CAST(x AS BIGINT) END AS incompatible_junction14, CASE WHEN splice_type = 'mxe' THEN CAST(y AS BIGINT) END AS incompatible_junction23,
round(psi, 6) AS psi, notes FROM scored"""))
def _summary(t: Tables):
    return psi_rows(t).withColumn("psi", r6("psi"))
