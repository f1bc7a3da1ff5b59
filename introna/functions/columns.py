"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(value: Column | str) -> Column:
    """Six decimals; adding zero folds -0.0 into 0.0."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def tail(p: Column | str) -> Column:
    """-log10 of a p-value to four decimals; 400 stands for a p-value of 0."""
    column = F.col(p) if isinstance(p, str) else p
    return F.when(column > 0, F.round(-F.log10(column), 4) + F.lit(0.0)).when(column == 0, F.lit(400.0))


def tail_sql(p: str) -> str:
    return f"CASE WHEN {p} > 0 THEN round(-log10({p}), 4) + 0.0 WHEN {p} = 0 THEN 400.0 END"


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def region_name(kind: str, chrom: Column, start: Column, stop: Column, strand: Column) -> Column:
    """``kind:chrom:start-stop:strand``."""
    return F.concat(
        F.lit(kind + ":"), chrom, F.lit(":"), start.cast("string"),
        F.lit("-"), stop.cast("string"), F.lit(":"), strand,
    )


def parse_region(name: Column) -> Column:
    """Struct (kind, chrom, start, stop, strand) of a three- or four-part name."""
    pattern = r"^(?:([^:]+):)?([^:]+):([0-9]+)-([0-9]+):([-+.])$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    start = part(3).try_cast("bigint")
    stop = part(4).try_cast("bigint")
    parsed = F.struct(
        blank_to_null(part(1)).alias("kind"), part(2).alias("chrom"),
        start.alias("start"), stop.alias("stop"), part(5).alias("strand"),
    )
    return F.when(name.rlike(pattern) & (start <= stop), parsed)


def regions_overlap(
    chrom_a: Column, start_a: Column, stop_a: Column,
    chrom_b: Column, start_b: Column, stop_b: Column,
) -> Column:
    return (chrom_a == chrom_b) & (start_b <= stop_a) & (stop_b >= start_a)


def signed_start(start: Column, strand: Column) -> Column:
    return F.when(strand == "-", -start).otherwise(start)


def reverse_complement(bases: Column) -> Column:
    return F.reverse(F.translate(bases, "ACGTacgt", "TGCAtgca"))


def hash_fraction(*parts: Column | str, seed: int = 0) -> Column:
    """A value in [0, 1) that depends on the row's key only, never on its partition."""
    text = F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def horner(x: Column, coefficients: Sequence[float]) -> Column:
    total = F.lit(float(coefficients[0]))
    for value in coefficients[1:]:
        total = total * x + F.lit(float(value))
    return total


def horner_sql(x: str, coefficients: Sequence[float]) -> str:
    total = f"{float(coefficients[0])!r}::DOUBLE"
    for value in coefficients[1:]:
        total = f"({total} * {x} + {float(value)!r}::DOUBLE)"
    return total
