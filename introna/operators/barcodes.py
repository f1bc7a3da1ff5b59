"""Barcodes, sample names and cell metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from introna.functions.checks import require_rows

FIELDS = 11  # fixed fields of an alignment line


def _read_groups(lines: DataFrame, allow: DataFrame | None, suffix: str, tag: str, group: str) -> DataFrame:
    """(value, cell_id, is_body, is_kept) of every line: body lines with their barcode repeated as the read group."""
    fixed = F.substring_index("value", "\t", FIELDS)
    optional = F.substr("value", F.length(fixed) + 1)
    barcode = F.regexp_extract(optional, rf"^.*\t{tag}:[^:\t]*:([^\t]*)", 1)
    body = ~F.col("value").startswith("@")
    marked = lines.withColumns({"is_body": body, "_cell": F.when(body, barcode)})
    if allow is None:
        marked = marked.withColumn("is_kept", body)
    else:
        # an absent barcode is the empty text here, which no allow list holds
        listed = allow.filter("cell_id <> ''").select(F.col("cell_id").alias("_cell")).distinct().withColumn("_listed", F.lit(True))
        marked = marked.join(listed, "_cell", "left").withColumn("is_kept", F.coalesce("_listed", F.lit(False)))
    kept = F.concat(fixed, F.regexp_replace(optional, rf"\t{group}:[^\t]*", ""))
    named = F.concat(F.nullif("_cell", F.lit("")), F.lit(suffix))
    line = F.coalesce(F.concat(kept, F.lit(f"\t{group}:Z:"), named), kept)
    return marked.select(F.when(F.col("is_body"), line).otherwise(F.col("value")).alias("value"), named.alias("cell_id"), "is_body", "is_kept")


def retag(lines: DataFrame, allow: DataFrame | None = None, suffix: str = "", tag: str = "CB", group: str = "RG") -> DataFrame:
    """Alignment lines whose barcode tag is repeated as the read group.

    Old read groups are dropped. With ``allow`` (cell_id) lines without a barcode, or with one
    outside the list, are left out. Works line by line, so a streaming ``lines`` stays a stream.
    """
    return _read_groups(lines, allow, suffix, tag, group).filter("is_kept").select("value", "cell_id")


def retag_observed(
    lines: DataFrame, observation: Observation | str, allow: DataFrame | None = None, suffix: str = "", tag: str = "CB", group: str = "RG"
) -> DataFrame:
    """`retag` whose counters are taken in the same pass: seen, tagged, written and filtered_out lines.

    A batch reads them from the `Observation`, a stream (which takes a name) from its progress.
    """
    body = F.col("is_body")
    counted = _read_groups(lines, allow, suffix, tag, group).observe(
        observation, F.count_if(body).alias("seen"), F.count_if(F.col("is_kept") & F.col("cell_id").isNotNull()).alias("tagged"),
        F.count_if("is_kept").alias("written"), F.count_if(body & ~F.col("is_kept")).alias("filtered_out"),
    )
    return counted.filter("is_kept").select("value", "cell_id")


def retag_write(
    lines: DataFrame, header: DataFrame, path: str, allow: DataFrame | None = None, suffix: str = "", library: str = "cells"
) -> dict[str, int]:
    """Header, missing ``@RG`` lines and rewritten body as one text output; returns the counters.

    The body is scanned once, for its lines and for the counters. ``header`` holds the ``@`` lines, a few
    that a reader finds at the head of a file; those among ``lines`` are not written again.
    """
    observation = Observation("retag")
    parts = header.filter(F.col("value").startswith("@")).select("value")
    if allow is not None:
        parts = parts.unionByName(read_group_headers(allow, header, suffix, library).select("value"))
    # parts of a union keep their order, and so do the files written from them
    parts.unionByName(retag_observed(lines, observation, allow, suffix).select("value")).write.text(path)
    return dict(observation.get)


def read_group_headers(allow: DataFrame, header: DataFrame, suffix: str = "", library: str = "cells") -> DataFrame:
    """``@RG`` lines for the listed cells that the header lacks: (cell_id, value)."""
    known = header.filter(F.col("value").startswith("@RG\t")).select(
        F.regexp_extract("value", "\tID:([^\t]*)", 1).alias("cell_id")
    )
    wanted = allow.select(F.concat("cell_id", F.lit(suffix)).alias("cell_id")).distinct()
    line = F.concat(F.lit("@RG\tID:"), "cell_id", F.lit("\tSM:"), "cell_id", F.lit(f"\tLB:{library}\tPL:ILLUMINA"))
    return wanted.join(known, "cell_id", "left_anti").select("cell_id", line.alias("value"))


def retag_counters(lines: DataFrame, written: DataFrame) -> DataFrame:
    """One row: alignments seen, tagged, written and filtered out."""
    seen = lines.filter(~F.col("value").startswith("@")).agg(F.count(F.lit(1))).scalar()
    totals = written.agg(F.count("cell_id").alias("tagged"), F.count(F.lit(1)).alias("written"))
    return totals.select(seen.alias("seen"), "tagged", "written", (seen - F.col("written")).alias("filtered_out"))


def barcode_suffix(cell: Column) -> Column:
    """Text from the first ``_`` on; NULL without one."""
    place = F.instr(cell, "_")
    return F.when(place > 0, cell.substr(place, F.length(cell)))


def common_suffix(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one per value of ``by``: the suffix all cells share, else NULL."""
    suffix = barcode_suffix(F.col("cell_id"))
    return cells.groupBy(*by).agg(
        F.when((F.count(suffix) == F.count(F.lit(1))) & (F.min(suffix) == F.max(suffix)), F.min(suffix)).alias("suffix")
    )


def suffix_counts(cells: DataFrame) -> DataFrame:
    counted = cells.withColumn("suffix", barcode_suffix(F.col("cell_id"))).filter("suffix IS NOT NULL")
    return counted.groupBy("suffix").agg(F.count(F.lit(1)).alias("count"))


def filter_by_suffix(metadata: DataFrame, suffix: str) -> DataFrame:
    kept = metadata.filter(F.col("CB").endswith(suffix))
    return require_rows(kept, kept, f"no metadata row ends in {suffix}") if not metadata.isStreaming else kept


def normalize_barcode(cell: Column) -> Column:
    return F.substring_index(F.substring_index(cell, "_", 1), "-", 1)


def _long_values(metadata: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(CB, column, value, first): distinct non-empty values with the place they first occur."""
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    long = metadata.select("CB", F.struct(*order).alias("_p"), F.explode(values).alias("_v")).select(
        "CB", "_p", F.col("_v.column").alias("column"), F.col("_v.value").alias("value")
    )
    named = long.filter("value IS NOT NULL AND value <> '' AND value <> 'nan'")
    return named.groupBy("CB", "column", "value").agg(F.min("_p").alias("first"))


def prepare_metadata(
    metadata: DataFrame, columns: Sequence[str], order: Sequence[str], cells: DataFrame, normalize: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(metadata aligned to ``cells``, conflicts).

    Per barcode each column takes its first non-empty value; ``conflicts`` lists every value of
    a (CB, column) that has more than one.
    """
    if normalize:
        metadata = metadata.withColumn("CB", normalize_barcode(F.col("CB")))
    values = _long_values(metadata, columns, order)
    picked = values.groupBy("CB").agg(
        *[F.min(F.when(F.col("column") == c, F.struct("first", "value"))).getField("value").alias(c) for c in columns]
    )
    aligned = cells.select(F.col("cell_id").alias("CB")).join(picked, "CB", "left")
    several = values.groupBy("CB", "column").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return aligned, values.join(several, ["CB", "column"])


def missing_by_column(aligned: DataFrame, columns: Sequence[str]) -> DataFrame:
    return aligned.agg(
        F.count(F.lit(1)).alias("aligned_rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns]
    )


def reads_per_sample(reads: DataFrame) -> DataFrame:
    return reads.groupBy("sample").agg(F.count(F.lit(1)).alias("num_seqs"))


def clean_sample(name: Column) -> Column:
    """File name without folder and alignment suffixes."""
    base = F.substring_index(name, "/", -1)
    return F.regexp_replace(base, r"(\.std)?(\.Aligned\.sortedByCoord\.out)?\.bam$", "")


def matched_counts(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Add ``in_metadata``; an error only when no sample at all is a known cell."""
    known = cells.select(F.col("cell_id").alias("sample")).distinct().withColumn("_known", F.lit(True))
    joined = counts.join(known, "sample", "left").withColumn("in_metadata", F.coalesce("_known", F.lit(False))).drop("_known")
    return require_rows(joined, counts.join(known, "sample", "left_semi"), "no sample name matches the metadata")


def required_cells(neighbours: DataFrame, main: DataFrame) -> DataFrame:
    """Distinct ids among the chosen main cells and their neighbours."""
    chosen = neighbours.join(main.select(F.col("cell_id").alias("main_name")).distinct(), "main_name", "left_semi")
    return chosen.select(F.explode(F.array("main_name", "neighbor")).alias("cell_id")).distinct()
