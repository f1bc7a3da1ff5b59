"""Exact length histogram of encoded documents.

Documents are encoded once and counted by exact length; the histogram has at most one row per length,
and suffix sums over it answer every context limit at once: how many documents and tokens there are,
how many fit, what a truncation would keep, and which share of documents is no longer than the limit. A limit
at which no document ends has the sums of the next longer length, found by block.

Defined results: a null or empty text has length 0; repeated rows count one by one; texts of any length
are encoded whole; only the text and the columns of ``by`` are read, so further ones and their names do
not matter; a limit that is null or negative gives no answer; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from introna.llm import bpe
from introna.llm.common import stored

BLOCK = 1024  # lengths per block of the suffix sums


def histogram(docs: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of documents of each encoded length (in each group), counted before the shuffle."""
    lengths = bpe.token_counts(docs.select(*by, "text"), path)
    return lengths.groupBy(*by, "n_tokens").agg(F.count("*").alias("docs"))


def limits(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Answers for the limit at each length that occurs.

    docs_longer, tokens_longer: documents above the limit, and their tokens; total_docs, total_tokens: all;
    truncated_tokens: tokens kept when every document is cut at the limit; quantile: share of documents
    within the limit. Sums run within blocks of 1,024 lengths and carry over the blocks.
    """
    made = counts.select(*by, "n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"))
    made = made.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    above = Window.partitionBy(*by).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*by)
    blocks = made.groupBy(*by, "block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).select(
        *by, "block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"),
    )
    joined = made.alias("m").join(blocks.alias("b"), [F.col(f"m.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "block")])
    inside = Window.partitionBy(*(f"m.{c}" for c in (*by, "block"))).orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    longer = F.col("docs_above") + F.coalesce(F.sum("docs").over(inside), F.lit(0))
    more = F.col("tokens_above") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    return joined.select(
        *(F.col(f"m.{c}") for c in by), F.col("n_tokens").alias("context_limit"), "docs", longer.alias("docs_longer"), more.alias("tokens_longer"),
        "total_docs", "total_tokens", (F.col("total_tokens") - more + longer * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("total_docs") - longer) / F.col("total_docs")).alias("quantile"),
    )


def at(counts: DataFrame, asked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`limits` at any context limit: one row per group and distinct ``context_limit`` of ``asked``, whether a document has that length or not.

    A limit is put beside the lengths of its block, with no documents of its own, and takes its place in
    the block's suffix sums; in a group that has no length in that block, the blocks above give them.
    """
    wanted = asked.where("context_limit >= 0").select(F.col("context_limit").cast("long").alias("n_tokens")).distinct()
    # the limits asked for are a stated few; every group is held against them
    listed = wanted.agg(F.collect_list("n_tokens")).scalar()
    grid = counts.select(*by).distinct().select(*by, F.explode(listed).alias("n_tokens")) if by else wanted
    both = counts.select(*by, "n_tokens", "docs", F.lit(False).alias("is_asked")).unionByName(grid.select(*by, "n_tokens", F.lit(0).cast("long").alias("docs"), F.lit(True).alias("is_asked")))
    merged = both.groupBy(*by, "n_tokens").agg(F.sum("docs").alias("docs"), F.bool_or("is_asked").alias("is_asked"))
    answers = limits(merged, by).where("total_docs > 0")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by] + [F.col("a.context_limit") == F.col("w.n_tokens")]
    return answers.alias("a").join(merged.where("is_asked").alias("w"), same, "left_semi")


def quantile_lengths(answers: DataFrame, shares: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """The smallest length that holds each share of the documents."""
    found = [F.min(F.when(F.col("quantile") >= s, F.col("context_limit"))).alias(f"q{round(100 * s)}") for s in shares]
    return answers.groupBy(*by).agg(*found)


def token_limits(docs: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    return limits(stored(histogram(docs, path, by), "token-lengths"), by)
