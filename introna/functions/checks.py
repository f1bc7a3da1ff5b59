"""Lazy data checks: the query fails when it runs, no extra job beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_empty(df: DataFrame, violations: DataFrame, message: str) -> DataFrame:
    """``df`` unchanged, raising ``message`` at run time when ``violations`` has rows."""
    # one row is enough to fail, so the scan of the violations may stop early
    count = violations.select(F.lit(1).alias("_v")).limit(1).agg(F.count("_v")).scalar()
    return df.filter(F.when(count == 0, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def require_rows(df: DataFrame, witnesses: DataFrame, message: str) -> DataFrame:
    """``df`` unchanged, raising ``message`` at run time when ``witnesses`` is empty."""
    count = witnesses.select(F.lit(1).alias("_v")).limit(1).agg(F.count("_v")).scalar()
    return df.filter(F.when(count > 0, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
