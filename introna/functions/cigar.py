"""Alignment strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operations that move along the reference, and those that cover it with bases.
ADVANCING = ("M", "D", "N", "=", "X")
COVERING = ("M", "=", "X")


def _walk(cigar: Column, pos: Column, wanted: tuple[str, ...]) -> Column:
    """Reference ranges of the wanted operations, as array<struct<start, end>>, 1-based closed."""
    steps = F.transform(
        F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)),
        lambda s: F.struct(
            F.substring(s, -1, 1).alias("op"), F.regexp_extract(s, "^([0-9]+)", 1).cast("long").alias("len")
        ),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, s: Column) -> Column:
        op, size, at = s.getField("op"), s.getField("len"), acc.getField("pos")
        found = F.struct(at.alias("start"), (at + size - 1).alias("end"))
        return F.struct(
            (at + F.when(op.isin(*ADVANCING), size).otherwise(F.lit(0).cast("long"))).alias("pos"),
            F.when(op.isin(*wanted), F.concat(acc.getField("found"), F.array(found))).otherwise(acc.getField("found")).alias("found"),
        )

    start = F.struct(pos.cast("long").alias("pos"), empty.alias("found"))
    return F.aggregate(steps, start, step, lambda acc: acc.getField("found"))


def covered_blocks(cigar: Column, pos: Column) -> Column:
    return _walk(cigar, pos, COVERING)


def introns(cigar: Column, pos: Column) -> Column:
    return _walk(cigar, pos, ("N",))
