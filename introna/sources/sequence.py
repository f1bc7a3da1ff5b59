"""Reference bases held as fixed-size chunks (chrom, chunk_no, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from introna.functions.columns import reverse_complement


def fetch_bases(sites: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """(chrom, start, end, bases) of the distinct sites, 1-based closed; bases past the end are absent.

    Each site is listed under the chunks it touches (two at most for a splice site), so the
    lookup is an equi-join; repeated sites are looked up once.
    """
    distinct = sites.select("chrom", "start", "end").distinct()
    first, last = F.floor((F.col("start") - 1) / chunk), F.floor((F.col("end") - 1) / chunk)
    spread = distinct.withColumn("chunk_no", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    base = F.col("chunk_no") * chunk
    begin = F.greatest(F.col("start") - base, F.lit(1))
    stop = F.least(F.col("end") - base, F.lit(chunk))
    piece = F.substring(F.col("seq"), begin.cast("int"), (stop - begin + 1).cast("int"))
    found = spread.filter("end >= 1").join(chunks, ["chrom", "chunk_no"]).select("chrom", "start", "end", "chunk_no", piece.alias("piece"))
    # an array per site of the chunks it touches
    joined = found.groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "piece"))).alias("_p"))
    return joined.select("chrom", "start", "end", F.array_join(F.col("_p.piece"), "").alias("bases"))


def fetch_stranded(sites: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """Add ``bases`` to (chrom, start, end, strand) rows, reverse-complemented on the minus strand."""
    fetched = fetch_bases(sites, chunks, chunk)
    joined = sites.join(fetched, ["chrom", "start", "end"], "left")
    return joined.withColumn("bases", F.when(F.col("strand") == "-", reverse_complement(F.col("bases"))).otherwise(F.col("bases")))


def chunk_fasta(lines: DataFrame, chunk: int) -> DataFrame:
    """FASTA lines with ``line_no`` to (chrom, chunk_no, seq).

    The place of a line in its record comes from a running count over all lines; each line is
    then cut at the chunk borders.
    """
    from introna.operators.scans import running_before

    head = F.col("value").startswith(">")
    marked = running_before(
        lines.filter("value <> ''"), ["line_no"],
        {"_record": head.cast("long"), "_bases": F.when(head, 0).otherwise(F.length("value")).cast("long")},
    )
    records = marked.filter(head).select(
        (F.col("_record") + 1).alias("_record"), F.regexp_extract("value", r"^>(\S+)", 1).alias("chrom"), F.col("_bases").alias("_start")
    )
    body = marked.filter(~head).join(records, "_record")
    at = F.col("_bases") - F.col("_start")
    spread = body.withColumn("_at", at).withColumn(
        "chunk_no", F.explode(F.sequence(F.floor(F.col("_at") / chunk), F.floor((F.col("_at") + F.length("value") - 1) / chunk)))
    )
    low = F.greatest(F.col("chunk_no") * chunk - F.col("_at"), F.lit(0))
    high = F.least((F.col("chunk_no") + 1) * chunk - F.col("_at"), F.length("value"))
    pieces = spread.select("chrom", "chunk_no", "_at", F.substring(F.col("value"), (low + 1).cast("int"), (high - low).cast("int")).alias("piece"))
    # a chunk meets a bounded number of lines
    joined = pieces.groupBy("chrom", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("_at", "piece"))).alias("_p"))
    return joined.select("chrom", "chunk_no", F.array_join(F.col("_p.piece"), "").alias("seq"))
