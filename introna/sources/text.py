"""Readers and writers of the text formats: annotation, alignments, junction tables, BED.

``parse_*`` works on a DataFrame of lines (``value``), so it serves batch and stream reads
alike; ``*_scan`` reads files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from introna.functions.columns import blank_to_null

# Column names and codes of the formats.
GTF_COLUMNS = ["seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attribute"]
GTF_ATTRIBUTE_ORDER = [
    "gene_id", "transcript_id", "gene_name", "exon_number", "gene_version", "gene_source", "gene_biotype", "gene_type",
]
SAM_COLUMNS = ["name", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "length", "seq", "qual"]
SJ_COLUMNS = [
    "chrom", "junction_start", "junction_stop", "strand", "junction_motif", "annotated",
    "unique_junction_reads", "multimap_junction_reads", "max_overhang",
]
MOTIF_NAMES = ["non-canonical", "GT/AG", "GT/AG", "GC/AG", "GC/AG", "AT/AC", "AT/AC"]
STRAND_NAMES = ["undefined", "+", "-"]


def text_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines with ``line_no``, a struct that sorts like (file, line)."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return lines.select("value", place.alias("line_no"))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Nine text columns; comment lines are skipped; other columns of the input are kept."""
    fields = F.split("value", "\t")
    rest = [c for c in lines.columns if c != "value"]
    body = lines.filter(~F.col("value").startswith("#") & (F.length("value") > 0))
    return body.select(*rest, *[fields.getItem(i).alias(c) for i, c in enumerate(GTF_COLUMNS)])


def gtf_scan(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_gtf(text_lines(spark, paths))


def attribute(name: str, raw: str = "attribute") -> Column:
    """Value of one key, quoted or bare; NULL when the key is absent.

    The usual form ``; key "value"`` is cut out by plain text search; only other spellings pay
    for a pattern match.
    """
    whole = F.concat(F.lit("; "), F.col(raw))
    opening = f'; {name} "'
    # of a repeated key the first value counts
    first = F.substring_index(F.substring_index(whole, opening, 2), opening, -1)
    quoted = F.substring_index(first, '"', 1)
    other = F.regexp_extract(raw, rf'(?:^|;)\s*{name}\s+"?([^";]*)"?', 1)
    return blank_to_null(F.when(F.contains(whole, F.lit(opening)), quoted).when(F.contains(whole, F.lit(name)), other).otherwise(""))


def gtf_attributes(gtf: DataFrame, fields: Sequence[str]) -> DataFrame:
    return gtf.withColumns({f: attribute(f) for f in fields})


def attribute_map(raw: Column) -> Column:
    """All keys of a line as a map; of a repeated key the last value stays."""
    parts = F.filter(F.transform(F.split(raw, ";"), lambda p: F.trim(p)), lambda p: F.instr(p, " ") > 0)
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.substring_index(p, " ", 1).alias("key"), F.regexp_extract(p, r'^\S+\s+"?([^"]*)"?$', 1).alias("value")
        ),
    )

    def held(found: Column) -> Column:
        keys = F.transform(found, lambda p: p.getField("key"))
        names = F.array_distinct(keys)
        last = lambda k: F.element_at(F.filter(found, lambda p: p.getField("key") == k), -1).getField("value")
        plain = F.map_from_arrays(keys, F.transform(found, lambda p: p.getField("value")))
        return F.when(F.size(names) == F.size(keys), plain).otherwise(F.map_from_arrays(names, F.transform(names, last)))

    # an array of one gives the pairs a name, else the line is taken apart again for every key
    return F.element_at(F.transform(F.array(pairs), held), 1)


def attribute_keys(gtf: DataFrame) -> DataFrame:
    """The distinct attribute keys that occur."""
    return gtf.select(F.explode(F.map_keys(attribute_map(F.col("attribute")))).alias("key")).distinct()


def expand_attributes(gtf: DataFrame, keys: Sequence[str]) -> DataFrame:
    held = gtf.withColumn("_map", attribute_map(F.col("attribute")))
    return held.select(*gtf.columns, *[F.col("_map")[k].alias(k) for k in keys])


def format_gtf(df: DataFrame) -> DataFrame:
    """One ``value`` line per row: eight fixed columns, the rest as ``key "value";``, NULL left out."""
    fixed = [c for c in GTF_COLUMNS if c != "attribute"]
    if "transcript_id" not in df.columns and "gene_id" in df.columns:
        df = df.withColumn("transcript_id", F.col("gene_id"))
    extra = [c for c in df.columns if c not in fixed and c not in ("attribute", "line_no")]
    ordered = [c for c in GTF_ATTRIBUTE_ORDER if c in extra] + [c for c in extra if c not in GTF_ATTRIBUTE_ORDER]
    column = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(".")
    pieces = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'{c} "'), column(c), F.lit('";'))) for c in ordered]
    attributes = F.concat_ws(" ", *pieces) if pieces else F.lit("")
    return df.select(F.concat_ws("\t", *[F.coalesce(column(c), F.lit(".")) for c in fixed], attributes).alias("value"))


def gtf_write(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    if order:
        df = df.orderBy(*order)
    format_gtf(df).write.mode("overwrite").text(path)


def sam_tag(name: str, raw: str = "value") -> Column:
    """Value of one optional tag of an alignment line, NULL when absent."""
    return blank_to_null(F.regexp_extract(raw, rf"\t{name}:[^:\t]*:([^\t]*)", 1))


def parse_sam(lines: DataFrame, tags: Sequence[str] = ()) -> DataFrame:
    """Eleven fixed fields and ``tags`` (map of tag name to value); header lines are left out.

    Tags named in ``tags`` come as columns of their own, which is cheaper than the map.
    """
    fields = F.split("value", "\t")
    body = lines.filter(~F.col("value").startswith("@"))
    optional = F.slice(fields, 12, F.greatest(F.size(fields) - 11, F.lit(0)))
    entries = F.transform(
        optional, lambda f: F.struct(F.substring_index(f, ":", 1).alias("key"), F.substr(f, F.lit(len("CB:Z:") + 1)).alias("value"))
    )
    numeric = {"flag": "int", "pos": "long", "mapq": "int", "mate_pos": "long", "length": "long"}
    rest = [c for c in lines.columns if c != "value"]
    return body.select(
        *rest,
        *[fields.getItem(i).cast(numeric.get(c, "string")).alias(c) for i, c in enumerate(SAM_COLUMNS)],
        *[sam_tag(t).alias(t) for t in tags],
        F.map_from_entries(entries).alias("tags"),
    )


def sam_header(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("value").startswith("@"))


def parse_junction_table(lines: DataFrame, ignore_multimapping: bool = False) -> DataFrame:
    """Nine-column junction rows with names for the codes and ``reads``; other columns are kept."""
    fields = F.split(F.trim("value"), r"\s+")
    rest = [c for c in lines.columns if c != "value"]
    number = lambda i: fields.getItem(i).cast("long")
    named = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (number(i) + 1).cast("int"))
    rows = lines.select(
        *rest, fields.getItem(0).alias("chrom"), number(1).alias("junction_start"), number(2).alias("junction_stop"),
        named(STRAND_NAMES, 3).alias("strand"), named(MOTIF_NAMES, 4).alias("junction_motif"),
        (number(5) == 1).alias("annotated"), number(6).alias("unique_junction_reads"),
        number(7).alias("multimap_junction_reads"), number(8).alias("max_overhang"),
    )
    multi = F.lit(0) if ignore_multimapping else F.col("multimap_junction_reads")
    return rows.withColumn("reads", F.col("unique_junction_reads") + multi)


def sj_tab_scan(
    spark: SparkSession, paths: str | Sequence[str], ignore_multimapping: bool = False, suffix: str = "SJ.out.tab"
) -> DataFrame:
    """Junction tables of many samples; ``sample_id`` is the file name without the suffix."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    sample = F.regexp_replace(name, r"\.?" + suffix.replace(".", r"\.") + "$", "")
    return parse_junction_table(lines.select("value", sample.alias("sample_id")), ignore_multimapping)


def junction_ids(junctions: DataFrame) -> DataFrame:
    """Add the flanking exon bases and the name ``junction:chrom:start-stop:strand``."""
    return junctions.withColumns(
        {
            "exon_start": F.col("junction_stop") + 1,
            "exon_stop": F.col("junction_start") - 1,
            "junction_id": F.format_string("junction:%s:%d-%d:%s", "chrom", "junction_start", "junction_stop", "strand"),
        }
    )


def parse_jcounts(rows: DataFrame) -> DataFrame:
    """Flanking-base junction counts to intron coordinates.

    ``rows``: (sample_id, line_no, chr_sp1, chr_sp2, location_sp1, location_sp2, strand_sp1,
    strand_sp2, status, count) as text. Rows without ends, across chromosomes or without a
    positive count are dropped; repeats of a key are summed under the first row's annotation.
    """
    whole = lambda c: F.floor(F.col(c).try_cast("double")).cast("long")
    code = lambda c: F.when(F.col(c).isin("+", "1"), 1).when(F.col(c).isin("-", "2"), 2).otherwise(0)
    other = F.coalesce(F.nullif("chr_sp2", F.lit("")), "chr_sp1")
    kept = rows.filter((F.coalesce("chr_sp1", F.lit("")) != "") & (other == F.col("chr_sp1"))).select(
        "sample_id", F.col("chr_sp1").alias("chrom"), (whole("location_sp1") + 1).alias("start"),
        (whole("location_sp2") - 1).alias("end"), whole("count").alias("n"), "line_no",
        F.coalesce(F.nullif(code("strand_sp1"), F.lit(0)), code("strand_sp2")).cast("long").alias("strand"),
        F.when(F.upper(F.coalesce("status", F.lit(""))) == "NOVEL", 0).otherwise(1).cast("long").alias("annotated"),
    )
    kept = kept.filter((F.col("n") > 0) & (F.col("start") <= F.col("end")))
    merged = kept.groupBy("sample_id", "chrom", "start", "end").agg(
        F.sum("n").cast("double").alias("uniq"), F.min(F.struct("line_no", "strand", "annotated")).alias("_first")
    )
    zero = F.lit(0).cast("long")
    return merged.select(
        "sample_id", "chrom", "start", "end", F.col("_first.strand").alias("strand"), zero.alias("motif"),
        F.col("_first.annotated").alias("annotated"), "uniq", F.lit(0.0).alias("multi"), zero.alias("max_overhang"),
    )


def bed_rows(regions: DataFrame, name: Column, score: Column | None = None) -> DataFrame:
    """BED columns with a 0-based start from (chrom, start, stop, strand)."""
    return regions.select(
        "chrom", (F.col("start") - 1).alias("start"), "stop", name.alias("name"),
        (score if score is not None else F.lit(".")).alias("score"), "strand",
    )


def gtf_to_bed(gtf: DataFrame, name: str) -> DataFrame:
    """Distinct (chrom, start, stop, name, score, strand) of annotation rows, coordinates untouched."""
    return gtf.select(
        F.col("seqname").alias("chrom"), F.col("start").alias("start"), F.col("end").alias("stop"),
        F.col(name).alias("name"), "score", "strand",
    ).distinct()


def bed_write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", quote="")
