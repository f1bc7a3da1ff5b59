"""Differential features: one-vs-rest tests, and their combination into gene-level results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from introna.functions.normal import normal_isf, normal_sf
from introna.operators.scans import least_from_here, running_before


def log_normalize(x: DataFrame, scale_factor: float = 1e4) -> DataFrame:
    """ln(1 + scale * value / cell total)."""
    totals = x.groupBy("cell_id").agg(F.sum("value").alias("_total")).filter("_total > 0")
    return x.join(totals, "cell_id").withColumn("value", F.log1p(F.col("value") * scale_factor / F.col("_total"))).drop("_total")


def one_vs_rest_markers(x: DataFrame, clusters: DataFrame, min_pct: float = 0.0, logfc_threshold: float = 0.0) -> DataFrame:
    """(cluster, feature_id, p_val, avg_log2fc, pct_1, pct_2, p_val_adj) of each cluster against all other cells.

    The test is the closed-form hurdle likelihood ratio for one binary covariate: the G statistic
    of detection plus n*ln(RSS0/RSS1) of the detected values, read as chi-squared with two degrees
    of freedom. Each feature's and cluster's sums come from one pass over the stored entries, the
    rest by subtraction from the feature's totals; a cluster without any stored entry of a
    feature still gets its row.
    """
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("cells"))
    everyone = sizes.agg(F.sum("cells")).scalar()
    rows = x.filter("value > 0").join(clusters.select("cell_id", "cluster"), "cell_id")
    v = F.col("value")
    part = rows.groupBy("feature_id", "cluster").agg(
        F.count(F.lit(1)).alias("k"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.sum(F.expm1(v)).alias("e")
    )
    total = part.groupBy("feature_id").agg(*[F.sum(c).alias(f"t_{c}") for c in ("k", "s", "q", "e")])
    # few clusters: the list of them is one row, taken apart again per feature
    names = sizes.agg(F.array_sort(F.collect_list(F.struct("cluster", "cells")))).scalar()
    grid = total.withColumn("_c", F.explode(names)).select("*", "_c.cluster", F.col("_c.cells").alias("n1")).drop("_c")
    joined = grid.join(part, ["feature_id", "cluster"], "left").fillna({"k": 0, "s": 0.0, "q": 0.0, "e": 0.0})
    n1, n2 = F.col("n1"), everyone - F.col("n1")
    k1, k2 = F.col("k"), F.col("t_k") - F.col("k")
    n, k = everyone, F.col("t_k")

    def cell(observed: Column, row: Column, column: Column) -> Column:
        return F.when(observed > 0, observed * F.ln(observed * n / (row * column))).otherwise(0.0)

    detection = 2 * (cell(k1, n1, k) + cell(n1 - k1, n1, n - k) + cell(k2, n2, k) + cell(n2 - k2, n2, n - k))
    rss = lambda q, s, c: F.when(c > 0, F.greatest(q - s * s / c, F.lit(0.0))).otherwise(0.0)
    rss0 = rss(F.col("t_q"), F.col("t_s"), k)
    rss1 = rss(F.col("q"), F.col("s"), k1) + rss(F.col("t_q") - F.col("q"), F.col("t_s") - F.col("s"), k2)
    usable = (k1 > 0) & (k2 > 0) & (k > 2) & (rss0 > 1e-9) & (rss1 > 1e-9)
    level = F.when(usable, F.greatest(k * F.ln(rss0 / rss1), F.lit(0.0))).otherwise(0.0)
    p = F.least(F.exp(-(F.greatest(detection, F.lit(0.0)) + level) / 2), F.lit(1.0))
    fold = F.log2(F.col("e") / n1 + 1) - F.log2((F.col("t_e") - F.col("e")) / n2 + 1)
    tested = joined.filter(n2 > 0).select(
        "cluster", "feature_id", p.alias("p_val"), fold.alias("avg_log2fc"), (k1 / n1).alias("pct_1"), (k2 / n2).alias("pct_2")
    )
    tested = tested.filter((F.greatest("pct_1", "pct_2") >= min_pct) & (F.abs("avg_log2fc") >= logfc_threshold))
    features = total.agg(F.count(F.lit(1))).scalar()
    return tested.withColumn("p_val_adj", F.least(F.col("p_val") * features, F.lit(1.0)))


def feature_to_gene(feature: Column) -> Column:
    """``/`` becomes ``_``; the text before the last dash."""
    return F.regexp_replace(F.translate(feature, "/", "_"), "-[^-]*$", "")


def exon_coordinates(markers: DataFrame, features: DataFrame, annotation: DataFrame) -> DataFrame:
    """Add start, end and length of each marker's exon; the length is NULL without a p-value.

    ``features``: (feature_id, gene_id, gene_name, k), the k-th exon of its gene; ``annotation``:
    (gene_id, gene_name, exon_number, start, end, exon_pos). Looked up by gene id first, then by
    gene name; of repeats the last in ``exon_pos`` counts.
    """
    def by(column: str, prefix: str) -> DataFrame:
        rows = annotation.filter(F.col(column).isNotNull())
        last = rows.groupBy(F.col(column), F.col("exon_number").alias("k")).agg(F.max(F.struct("exon_pos", "start", "end")).alias("_l"))
        return last.select(column, "k", F.col("_l.start").alias(f"{prefix}_start"), F.col("_l.end").alias(f"{prefix}_end"))

    placed = features.join(by("gene_id", "i"), ["gene_id", "k"], "left").join(by("gene_name", "n"), ["gene_name", "k"], "left")
    placed = placed.select("feature_id", F.coalesce("i_start", "n_start").alias("start"), F.coalesce("i_end", "n_end").alias("end"))
    length = F.when(F.col("p_val").isNotNull(), F.col("end") - F.col("start") + 1)
    return markers.join(placed, "feature_id", "left").withColumn("exon_length", length)


def length_weights(markers: DataFrame) -> DataFrame:
    """Add ``weight``: the exon's share of the summed length of its cluster's gene."""
    sums = markers.groupBy("cluster", "gene").agg(F.sum("exon_length").alias("_sum"))
    return markers.join(sums, ["cluster", "gene"]).withColumn("weight", F.col("exon_length") / F.col("_sum")).drop("_sum")


def weighted_stouffer(markers: DataFrame) -> DataFrame:
    """(cluster, gene, stouffer_p): sum(w*z) / sqrt(sum(w*w)); NULL when p-values and weights differ in number."""
    z = normal_isf(F.col("p_val"))
    sums = markers.groupBy("cluster", "gene").agg(
        F.count("p_val").alias("n_p"), F.count("weight").alias("n_w"),
        F.sum(F.col("weight") * z).alias("wz"), F.sum(F.col("weight") * F.col("weight")).alias("ww"),
    )
    score = F.try_divide(F.col("wz"), F.sqrt("ww"))
    paired = (F.col("n_p") > 0) & (F.col("n_p") == F.col("n_w"))
    return sums.select("cluster", "gene", F.when(paired, normal_sf(score)).alias("stouffer_p"))


def weighted_abs_log2fc(markers: DataFrame) -> DataFrame:
    """(cluster, gene, abs_log2fc): sum(|fold| * w), NULL when folds and weights differ in number."""
    sums = markers.groupBy("cluster", "gene").agg(
        F.count("avg_log2fc").alias("n_f"), F.count("weight").alias("n_w"), F.sum(F.abs("avg_log2fc") * F.col("weight")).alias("v")
    )
    return sums.select("cluster", "gene", F.when((F.col("n_f") > 0) & (F.col("n_f") == F.col("n_w")), F.col("v")).alias("abs_log2fc"))


def stouffer(markers: DataFrame) -> DataFrame:
    """(cluster, gene, stouffer_p, mean_abs_log2fc) with equal weights: sum(z) / sqrt(n)."""
    z = normal_isf(F.col("p_val"))
    sums = markers.groupBy("cluster", "gene").agg(
        F.count("p_val").alias("n"), F.sum(z).alias("z"), F.avg(F.abs("avg_log2fc")).alias("mean_abs_log2fc")
    )
    return sums.select("cluster", "gene", F.when(F.col("n") > 0, normal_sf(F.col("z") / F.sqrt("n"))).alias("stouffer_p"), "mean_abs_log2fc")


def adjust_bonferroni(genes: DataFrame, p: str, name: str = "p_bonferroni") -> DataFrame:
    """p times the number of p-values, at most 1; NULL p-values count for nothing."""
    tests = genes.agg(F.count(p)).scalar()
    return genes.withColumn(name, F.least(F.col(p) * tests, F.when(F.col(p).isNotNull(), F.lit(1.0))))


def adjust_bh(genes: DataFrame, p: str, key: list[str], name: str = "p_bh") -> DataFrame:
    """Benjamini-Hochberg: the least p*n/rank from here upwards. ``key`` makes the order total."""
    given = genes.filter(F.col(p).isNotNull())
    tests = genes.agg(F.count(p)).scalar()
    ranked = running_before(given.select(*key, p), [p, *key], {"_rank": F.lit(1)})
    lowest = least_from_here(ranked, "_rank", F.col(p) * tests / (F.col("_rank") + 1), "_q")
    adjusted = lowest.select(*key, F.least("_q", F.lit(1.0)).alias(name))
    return genes.join(adjusted, key, "left")


def to_rows(markers: DataFrame, genes: DataFrame) -> DataFrame:
    """Gene-level columns on every marker row of the gene."""
    return markers.join(genes, ["cluster", "gene"], "left")


def select_de(genes: DataFrame, adjusted: str, fold: str, alpha: float = 0.05, min_fold: float = 1.0) -> DataFrame:
    return genes.filter((F.col(adjusted) < alpha) & (F.abs(fold) > min_fold))


def compare_de(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, gene, side): genes of the first list only, the second only, or both; one comparison per value of ``by``."""
    listed = lambda df, name: df.select(*by, "gene", F.lit(name).alias("side"))
    sides = listed(a, "first").unionByName(listed(b, "second")).groupBy(*by, "gene").agg(F.min("side").alias("_low"), F.max("side").alias("_high"))
    return sides.select(*by, "gene", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("both").alias("side"))


def merge_enrichment(a: DataFrame, b: DataFrame, term: str = "", by: Sequence[str] = ()) -> DataFrame:
    """Full join of two enrichment tables (by, id, name, category, q) on by and id, of terms that contain ``term``.

    A term missing on one side counts as q = 0 there, as its logarithm column shows by NULL.
    """
    key = [*by, "id"]
    pick = lambda df, s: df.filter(F.col("name").ilike(f"%{term}%")).select(*key, *[F.col(c).alias(f"{c}_{s}") for c in ("name", "category", "q")])
    joined = pick(a, "a").join(pick(b, "b"), key, "full")
    q = lambda s: F.coalesce(F.col(f"q_{s}"), F.lit(0.0))
    log = lambda s: F.when(q(s) > 0, -F.log10(q(s)))
    return joined.select(
        *key, F.coalesce("name_a", "name_b").alias("name"), F.coalesce("category_a", "category_b").alias("category"),
        q("a").alias("q_a"), q("b").alias("q_b"), log("a").alias("log_q_a"), log("b").alias("log_q_b"),
    )
