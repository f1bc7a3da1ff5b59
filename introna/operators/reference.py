"""Annotation jobs: exon preparation and merge, id allocation, names, introns, promoters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from introna.functions.columns import parse_region, regions_overlap, signed_start
from introna.operators.intervals import bin_level, level_width, merge_intervals, range_join
from introna.operators.scans import following, running_before, running_before_by

STRETCH = 1 << 16  # bases per stretch when a key is spread along the genome
EXON_BIN = 512  # narrowest bins of exons


def check_annotation(gtf: DataFrame, fields: Sequence[str] = ("gene_id", "exon_number")) -> None:
    """Raise when a required attribute is missing from every row."""
    seen = gtf.agg(*[F.count(f).alias(f) for f in fields]).first()
    empty = [f for f in fields if not seen[f]]
    if empty:
        raise ValueError(f"annotation has no value for: {', '.join(empty)}")


def exon_rows(gtf: DataFrame) -> DataFrame:
    """Every exon row, with integer coordinates."""
    return gtf.filter(F.col("feature") == "exon").withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


def exon_prepare(gtf: DataFrame) -> DataFrame:
    """Exon rows with integer coordinates, the first line of each (gene, start, end)."""
    exons = exon_rows(gtf)
    rest = [c for c in exons.columns if c not in ("gene_id", "start", "end", "line_no")]
    first = exons.groupBy("gene_id", "start", "end").agg(F.min(F.struct("line_no", *rest)).alias("_first"))
    return first.select("gene_id", "start", "end", "_first.*")


def exon_merge(exons: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Non-overlapping exons per gene, numbered 1..n; other columns from the gene's first exon.

    Repeats of a (gene, start, end) change nothing, so ``exon_rows`` will do.
    """
    usable = exons.filter(F.col("start") < F.col("end"))
    merged = merge_intervals(usable, ["gene_id"], block=block)
    numbered = merged.withColumn(
        "exon_number", F.row_number().over(Window.partitionBy("gene_id").orderBy("start")).cast("long")
    )
    rest = [c for c in exons.columns if c not in ("gene_id", "start", "end", "line_no", "exon_number")]
    template = usable.groupBy("gene_id").agg(F.min(F.struct("start", "end", "line_no", *rest)).alias("_t"))
    template = template.select("gene_id", *[F.col(f"_t.{c}").alias(c) for c in rest])
    return numbered.join(template, "gene_id")


def exon_overlap_check(exons: DataFrame) -> DataFrame:
    """Exons that reach past the start of the gene's next exon."""
    ahead = following(exons, ["gene_id"], ["start", "end"], STRETCH)
    return ahead.filter(F.col("_next.start") < F.col("end")).select(
        *exons.columns, F.col("_next.start").alias("next_start")
    )


def gene_set_difference(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Genes missing from or unexpected in ``found``: (gene_id, status)."""
    have = found.select("gene_id").distinct()
    want = expected.select("gene_id").distinct()
    missing = want.join(have, "gene_id", "left_anti").withColumn("status", F.lit("missing"))
    extra = have.join(want, "gene_id", "left_anti").withColumn("status", F.lit("unexpected"))
    return missing.unionByName(extra)


def adjacency_index(exons: DataFrame, order: Sequence[str]) -> DataFrame:
    """(gene_id, n_exons, ind_st, ind, exon_st, gene_pos): n*n slots per gene, genes by first row in ``order``."""
    genes = exons.groupBy("gene_id").agg(
        F.count(F.lit(1)).alias("n_exons"), F.min(F.struct(*order)).alias("_first")
    )
    slots = F.col("n_exons") * F.col("n_exons")
    placed = running_before(
        genes, ["_first", "gene_id"], {"ind_st": slots, "exon_st": F.col("n_exons"), "gene_pos": F.lit(1)}
    )
    return placed.select("gene_id", "n_exons", "ind_st", slots.alias("ind"), "exon_st", "gene_pos")


def unique_gene_names(exons: DataFrame, order: Sequence[str]) -> DataFrame:
    """(gene_id, gene_name): first name of the gene, the id where blank, ``name-id`` where shared."""
    first = exons.groupBy("gene_id").agg(F.min(F.struct(*order, "gene_name")).getField("gene_name").alias("_raw"))
    named = first.select("gene_id", F.coalesce(F.nullif(F.col("_raw"), F.lit("")), "gene_id").alias("gene_name"))
    shared = named.groupBy("gene_name").agg(F.count(F.lit(1)).alias("_genes"))
    label = F.when(F.col("_genes") > 1, F.concat("gene_name", F.lit("-"), "gene_id")).otherwise(F.col("gene_name"))
    return named.join(shared, "gene_name").select("gene_id", label.alias("gene_name"))


def adjacency_metadata(exons: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per gene and slot 1..n*n: (gene_id, gene_name, slot, junction_name)."""
    sizes = exons.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))
    slots = sizes.join(unique_gene_names(exons, order), "gene_id").withColumn(
        "slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") * F.col("n")))
    )
    return slots.select(
        "gene_id", "gene_name", "slot", F.concat("gene_name", F.lit("-"), F.col("slot").cast("string")).alias("junction_name")
    )


def gene_order(ids: DataFrame, order: Sequence[str]) -> DataFrame:
    """(gene_id, gene_pos): by number when every id is ``gene<digits>``, else by first appearance."""
    first = ids.groupBy("gene_id").agg(F.min(F.struct(*order)).alias("_first"))
    pattern = "^gene([0-9]+)$"
    numeric = first.agg(F.bool_and(F.col("gene_id").rlike(pattern))).scalar()
    number = F.regexp_extract("gene_id", pattern, 1).try_cast("decimal(38,0)")
    keyed = first.withColumn("_number", F.when(numeric, number))
    ranked = running_before(keyed, ["_number", "_first", "gene_id"], {"gene_pos": F.lit(1)})
    return ranked.select("gene_id", "gene_pos")


def map_gene_order(ids: DataFrame, reference: DataFrame, order: Sequence[str]) -> DataFrame:
    """Attach ``gene_pos`` of the reference order to each row; ids outside it are an error."""
    mapped = ids.join(gene_order(reference, order), "gene_id", "left")
    unknown = [r[0] for r in mapped.filter("gene_pos IS NULL").select("gene_id").distinct().orderBy("gene_id").limit(5).collect()]
    if unknown:
        raise ValueError("gene ids not found in the reference order: " + ", ".join(unknown))
    return mapped


def feature_annotation(exons: DataFrame, names: DataFrame) -> DataFrame:
    """(gene_id, gene_name, exon_pos, gene_exon_name); the number in the name counts within the *name*.

    A gene's exons lie next to each other in ``exon_pos``, so the count before a gene is the
    number of exons of earlier genes with its name, which needs one row per gene only.
    """
    genes = exons.groupBy("gene_id").agg(F.count(F.lit(1)).alias("_n"), F.min("exon_pos").alias("_first"))
    named = genes.join(names.select("gene_id", "gene_name"), "gene_id", "left").withColumn(
        "gene_name", F.coalesce("gene_name", "gene_id")
    )
    offsets = running_before_by(named, ["gene_name"], ["_first"], {"_earlier": F.col("_n")})
    joined = exons.select("gene_id", "exon_pos").join(offsets.select("gene_id", "gene_name", "_first", "_earlier"), "gene_id")
    number = F.col("_earlier") + F.col("exon_pos") - F.col("_first") + 1
    return joined.select("gene_id", "gene_name", "exon_pos", F.concat("gene_name", F.lit("-"), number.cast("string")).alias("gene_exon_name"))


def gene_name_map(attributes: DataFrame) -> DataFrame:
    """(gene_id, gene_name): the last line that carries both."""
    # the test sits inside the aggregate: as a filter it would be pushed down and parse the line again
    both = F.col("gene_id").isNotNull() & F.col("gene_name").isNotNull()
    last = F.max(F.when(both, F.struct("line_no", "gene_name"))).getField("gene_name")
    return attributes.groupBy("gene_id").agg(last.alias("gene_name")).filter("gene_name IS NOT NULL")


def genome_to_transcript(positions: DataFrame, exons: DataFrame) -> DataFrame:
    """Add ``offset``: 1-based place of ``pos`` in the transcript's joined exons, NULL outside.

    ``positions`` has (transcript_id, pos); exons are taken in transcription order, so from the
    right on the minus strand.
    """
    distinct = exons.select("transcript_id", "strand", "start", "end").distinct()
    minus = F.col("strand") == "-"
    ranked = distinct.withColumns(
        {
            "_a": F.when(minus, -F.col("end")).otherwise(F.col("start")),
            "_b": F.when(minus, -F.col("start")).otherwise(F.col("end")),
            "_len": F.col("end") - F.col("start") + 1,
        }
    )
    # a transcript has few exons, so they are summed in place
    earlier = Window.partitionBy("transcript_id").orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("_before", F.coalesce(F.sum("_len").over(earlier), F.lit(0)))
    wanted = positions.select("transcript_id", "pos").distinct().withColumn("pos_end", F.col("pos"))
    hits = range_join(wanted, placed, ["transcript_id"], ("pos", "pos_end"), ("start", "end"), EXON_BIN)
    inside = F.when(F.col("strand") == "-", F.col("end") - F.col("pos")).otherwise(F.col("pos") - F.col("start"))
    offsets = hits.groupBy("transcript_id", "pos").agg(F.min(F.col("_before") + inside + 1).alias("offset"))
    return positions.join(offsets, ["transcript_id", "pos"], "left")


def promoter_regions(
    transcripts: DataFrame, sizes: DataFrame, upstream: int = 2000, downstream: int = 200
) -> DataFrame:
    """(chrom, start, stop, name, score, strand) around each start site, merged per gene and numbered.

    ``transcripts`` has (seqname, start, end, strand, gene_id, gene_name, line_no), ``sizes``
    (seqname, size). Genes without a name are left out.
    """
    plus = F.col("strand") == "+"
    left = F.when(plus, F.col("start") - upstream).otherwise(F.col("end") - downstream)
    right = F.when(plus, F.col("start") + downstream).otherwise(F.col("end") + upstream)
    named = transcripts.filter("gene_id IS NOT NULL AND gene_name IS NOT NULL").join(sizes, "seqname")
    windows = named.select(
        F.col("seqname").alias("chrom"), F.concat("gene_id", F.lit(", "), "gene_name").alias("name"), "strand", "line_no",
        F.greatest(left, F.lit(0).cast("long")).alias("start"), F.least(right, F.col("size")).alias("end"),
    )
    strands = windows.groupBy("name").agg(F.min(F.struct("line_no", "strand")).getField("strand").alias("strand"))
    merged = merge_intervals(windows, ["chrom", "name"], touching=True).join(strands, "name")
    numbered = running_before(merged, ["chrom", "start", "end", "name"], {"_i": F.lit(1)})
    return numbered.select(
        "chrom", "start", F.col("end").alias("stop"),
        F.concat(F.col("_i").cast("string"), F.lit(": "), "name").alias("name"), F.lit(".").alias("score"), "strand",
    )


def annotated_introns(exons: DataFrame) -> DataFrame:
    """(chrom, start, end, strands): gaps between consecutive exons of a transcript.

    ``strands`` is the sorted set of strand codes (1 plus, 2 minus, 0 otherwise).
    """
    code = F.when(F.col("strand") == "+", 1).when(F.col("strand") == "-", 2).otherwise(0)
    rows = exons.filter("transcript_id IS NOT NULL").select("seqname", "strand", "transcript_id", "start", "end")
    ahead = following(rows, ["seqname", "strand", "transcript_id"], ["start", "end"], STRETCH, distinct=True)
    gaps = ahead.select(
        F.col("seqname").alias("chrom"), (F.col("end") + 1).alias("start"), (F.col("_next.start") - 1).alias("end"), code.alias("code")
    ).filter(F.col("start") <= F.col("end"))
    # at most three codes per gap
    return gaps.groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_set("code")).alias("strands"))


def gene_of_region(regions: DataFrame, genes: DataFrame, width: int = STRETCH) -> DataFrame:
    """(region_id, gene_ids, gene_names) merged over all same-strand genes that overlap a region.

    ``regions``: (region_id, chrom, start, stop, strand), an id having one place; ``genes``: (chrom,
    strand, g_start, g_stop, gene_id, gene_name).

    A region looks in one block only, that of its start at the level of its length, so its sets are
    whole where they are found and do not travel. The genes lie, side by side, under every block
    from which a region can reach them; ``width`` should suit the lengths of both.
    """
    block = ["chrom", "strand", "_level", "_block"]
    at = lambda position, level: F.floor(position / level_width(level, width))
    start, stop = F.col("start"), F.col("stop")
    homes = regions.select("region_id", "chrom", "strand", "start", "stop").filter(start <= stop)
    homes = homes.withColumn("_level", bin_level(start, stop, width)).withColumn("_block", at(start, F.col("_level")))
    # a handful of numbers
    reach = homes.groupBy("_level").agg(F.max(stop - start).alias("reach")).agg(F.collect_list(F.struct("_level", "reach"))).scalar()
    listed = genes.select("chrom", "strand", "g_start", "g_stop", "gene_id", "gene_name").filter("g_start <= g_stop").withColumn("_r", F.explode(reach))
    first, last = at(F.col("g_start") - F.col("_r.reach"), F.col("_r._level")), at(F.col("g_stop"), F.col("_r._level"))
    listed = listed.withColumn("_level", F.col("_r._level")).withColumn("_block", F.explode(F.sequence(first, last))).drop("_r")
    # the genes over one position are few by nature, so those of a block stay small
    packed = listed.repartition(*block).groupBy(*block).agg(F.collect_list(F.struct("g_start", "g_stop", "gene_id", "gene_name")).alias("_genes"))
    met = homes.repartition(*block).dropDuplicates([*block, "region_id", "start", "stop"]).join(packed, block)
    over = F.filter("_genes", lambda g: (g["g_start"] <= stop) & (g["g_stop"] >= start))
    found = met.select("region_id", over.alias("_found")).filter(F.size("_found") > 0)
    values = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.col(f"_found.{c}")))).alias(f"{c}s")
    return found.select("region_id", values("gene_id"), values("gene_name"))


def region_ops(df: DataFrame, name: str, other: str) -> DataFrame:
    """Parse two region names and add length, strand-signed start and whether they overlap."""
    parsed = df.withColumns({"_a": parse_region(F.col(name)), "_b": parse_region(F.col(other))})
    side = lambda s: (F.col(f"{s}.chrom"), F.col(f"{s}.start"), F.col(f"{s}.stop"))
    return parsed.select(
        *df.columns, F.col("_a.kind").alias("kind"), F.col("_a.chrom").alias("chrom"), F.col("_a.start").alias("start"),
        F.col("_a.stop").alias("stop"), F.col("_a.strand").alias("strand"),
        (F.col("_a.stop") - F.col("_a.start") + 1).alias("length"),
        signed_start(F.col("_a.start"), F.col("_a.strand")).alias("signed_start"),
        regions_overlap(*side("_a"), *side("_b")).alias("overlaps"),
    )


