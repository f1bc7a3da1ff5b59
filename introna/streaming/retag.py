"""The line-wise barcode rewrite as a Structured Streaming job; it keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from introna.operators.barcodes import retag_observed


def retag_stream(spark: SparkSession, folder: str, allow: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """Rewritten lines of the text files that arrive in ``folder``; ``allow`` is a static list.

    The counters of each batch are the observed metrics ``retag`` in the query's progress.
    """
    return retag_observed(spark.readStream.text(folder), "retag", allow, suffix).select("value")


def start_retag(rewritten: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; files already done are remembered in ``checkpoint``."""
    return (
        rewritten.writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
