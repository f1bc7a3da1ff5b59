"""Cell-by-feature statistics on the long sparse form (cell_id, feature, value).

Absent entries are zeros: means and variances run over ``n_cells`` from sums of the stored
entries, the matrix is never filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from introna.operators.scans import exact_median
from introna.session import stored


def n_cells(cells: DataFrame) -> Column:
    return cells.agg(F.count(F.lit(1))).scalar()


def filter_features(x: DataFrame, feature: str, min_cells: int = 3) -> DataFrame:
    """Entries of features that are positive in at least ``min_cells`` cells."""
    kept = x.groupBy(feature).agg(F.count_if(F.col("value") > 0).alias("_n")).filter(F.col("_n") >= min_cells)
    return x.join(kept.select(feature), feature, "left_semi")


def cell_qc(x: DataFrame, name: str, prefix: str = "MT-") -> DataFrame:
    """Per cell: features, total, total and percent of the features whose name starts with ``prefix``."""
    marked = F.col(name).startswith(prefix)
    totals = x.groupBy("cell_id").agg(
        F.count_if(F.col("value") > 0).alias("n_genes"), F.sum("value").alias("total_counts"),
        F.sum(F.when(marked, F.col("value")).otherwise(0.0)).alias("total_counts_mt"),
    )
    return totals.withColumn("pct_counts_mt", F.coalesce(F.try_divide(F.col("total_counts_mt") * 100, "total_counts"), F.lit(0.0)))


def feature_qc(x: DataFrame, feature: str, cells: Column) -> DataFrame:
    return x.groupBy(feature).agg(F.count_if(F.col("value") > 0).alias("n_cells"), F.sum("value").alias("total_counts")).withColumn(
        "mean_counts", F.col("total_counts") / cells
    )


def normalize_total(x: DataFrame) -> DataFrame:
    """Scale each cell to the median of the positive cell totals."""
    totals = x.groupBy("cell_id").agg(F.sum("value").alias("_total")).filter("_total > 0")
    target = exact_median(totals, "_total")
    return x.join(totals, "cell_id").withColumn("value", F.col("value") / F.col("_total") * target).drop("_total")


def log1p(x: DataFrame) -> DataFrame:
    return x.withColumn("value", F.log1p("value"))


def moments(x: DataFrame, feature: str, cells: Column, value: Column | None = None) -> DataFrame:
    """(feature, mean, var) over all cells, zeros included; sample variance, NULL of a single cell."""
    v = F.col("value") if value is None else value
    sums = x.groupBy(feature).agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    mean = F.col("_s") / cells
    var = F.try_divide(F.greatest(F.col("_q") - cells * mean * mean, F.lit(0.0)), cells - 1)
    return sums.select(feature, mean.alias("mean"), var.alias("var"))


def dispersion(x: DataFrame, feature: str, cells: Column, n_bins: int = 20) -> DataFrame:
    """(feature, mean, dispersion, bin, score) of log-normalised values.

    The score is the log dispersion's z-score among the features of its mean bin; a bin with one
    feature scores it 1.
    """
    stats = moments(x, feature, cells, F.expm1("value"))
    mean = F.when(F.col("mean") == 0, F.lit(1e-12)).otherwise(F.col("mean"))
    ratio = F.col("var") / mean
    # one row per feature, read by every step below
    shaped = stored(stats.select(feature, F.log1p(mean).alias("mean"), F.when(ratio > 0, F.ln(ratio)).alias("dispersion")))
    low, high = shaped.agg(F.min("mean")).scalar(), shaped.agg(F.max("mean")).scalar()
    # equal means leave no width; all features share the first bin then
    place = F.ceil(F.try_divide(F.col("mean") - low, (high - low) / n_bins))
    binned = shaped.withColumn("bin", F.coalesce(F.least(F.greatest(place, F.lit(1)), F.lit(n_bins)), F.lit(1)).cast("long"))
    per_bin = binned.groupBy("bin").agg(F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_sd"))
    # one row per bin
    joined = binned.join(F.broadcast(per_bin), "bin", "left")
    sd = F.coalesce("_sd", "_m")
    centre = F.when(F.col("_sd").isNull(), 0.0).otherwise(F.col("_m"))
    return joined.select(feature, "mean", "dispersion", "bin", F.try_divide(F.col("dispersion") - centre, sd).alias("score"))


def highly_variable(x: DataFrame, feature: str, cells: Column, n_top: int = 2000) -> DataFrame:
    """Features whose score reaches the n_top-th largest; a missing score counts as zero there."""
    scored = dispersion(x, feature, cells)
    cut = scored.filter("score IS NOT NULL").select("score").orderBy(F.col("score").desc()).limit(n_top).agg(F.min("score")).scalar()
    return scored.filter(F.coalesce("score", F.lit(0.0)) >= cut)


def feature_hvg(exon_x: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Exon entries of the kept cells, normalised over all exons, of the variable genes, rounded half to even."""
    kept = exon_x.join(cells.select("cell_id"), "cell_id", "left_semi")
    scaled = normalize_total(kept).join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    return scaled.withColumn("value", F.bround("value", 0)).filter("value <> 0")


def regress_out(x: DataFrame, feature: str, covariates: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(residuals of the stored entries, coefficients) of value ~ 1 + a + b over all cells.

    The covariate matrix is shared, so each feature needs only its sums with the centred
    covariates. An absent entry's residual is minus the fit: -(b0 + b1*a + b2*b).
    """
    shared = covariates.agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.covar_pop(a, a).alias("saa"),
        F.covar_pop(b, b).alias("sbb"), F.covar_pop(a, b).alias("sab"),
    )
    part = {c: shared.select(c).scalar() for c in shared.columns}
    joined = x.join(covariates.select("cell_id", a, b), "cell_id")
    da, db = F.col(a) - part["ma"], F.col(b) - part["mb"]
    sums = joined.groupBy(feature).agg(
        (F.sum("value") / part["n"]).alias("my"), (F.sum(F.col("value") * da) / part["n"]).alias("say"),
        (F.sum(F.col("value") * db) / part["n"]).alias("sby"),
    )
    det = part["saa"] * part["sbb"] - part["sab"] * part["sab"]
    b1 = F.when(det > 0, (F.col("say") * part["sbb"] - F.col("sby") * part["sab"]) / det).otherwise(
        F.coalesce(F.try_divide(F.col("say"), part["saa"]), F.lit(0.0))
    )
    b2 = F.when(det > 0, (F.col("sby") * part["saa"] - F.col("say") * part["sab"]) / det).otherwise(0.0)
    fit = sums.select(feature, "my", b1.alias("b1"), b2.alias("b2")).select(
        feature, (F.col("my") - F.col("b1") * part["ma"] - F.col("b2") * part["mb"]).alias("b0"), "b1", "b2"
    )
    residual = F.col("value") - (F.col("b0") + F.col("b1") * F.col(a) + F.col("b2") * F.col(b))
    return joined.join(fit, feature).select("cell_id", feature, residual.alias("value")), fit


def scale(x: DataFrame, feature: str, cells: Column, max_value: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(z-scores of the stored entries, (feature, mean, sd, zero_value)), cut at ``max_value``.

    ``zero_value`` is the z-score of every absent entry of the feature.
    """
    stats = moments(x, feature, cells)
    sd = F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0)
    var = stats.select(feature, "mean", sd.alias("sd"), F.least(-F.col("mean") / sd, F.lit(max_value)).alias("zero_value"))
    z = F.least((F.col("value") - F.col("mean")) / F.col("sd"), F.lit(max_value))
    return x.join(var, feature).select("cell_id", feature, z.alias("value")), var


def principal_components(embedding: DataFrame, vector: str, n: int) -> DataFrame:
    """(cell_id, pc): scores on the first ``n`` principal components of an array column."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = embedding.withColumn("_v", array_to_vector(F.col(vector)))
    model = PCA(k=n, inputCol="_v", outputCol="_p").fit(data)
    return model.transform(data).select("cell_id", vector_to_array("_p").alias("pc"))


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari``: chance-corrected agreement of two labelings."""
    table = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: c * (c - 1) / 2.0
    one = table.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n")))).scalar()
    two = table.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n")))).scalar()
    both = table.agg(F.sum(pairs(F.col("n"))).alias("same"), F.sum("n").alias("total"))
    expected = one * two / pairs(F.col("total"))
    ceiling = (one + two) / 2
    return both.select(F.coalesce(F.try_divide(F.col("same") - expected, ceiling - expected), F.lit(1.0)).alias("ari"))


def histogram(values: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin 1..bins, low, high, count) of equal-width bins; the last one is closed on the right."""
    low, high = values.agg(F.min(value)).scalar(), values.agg(F.max(value)).scalar()
    width = (high - low) / bins
    place = F.when(high == low, F.lit(1)).otherwise(F.least(F.floor((F.col(value) - low) / width) + 1, F.lit(bins)))
    counted = values.groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select("bin", (low + (F.col("bin") - 1) * width).alias("low"), (low + F.col("bin") * width).alias("high"), "count")


def features_per_cell(x: DataFrame) -> DataFrame:
    return x.groupBy("cell_id").agg(F.count_if(F.col("value") > 0).alias("n"))


def highest_expressed(x: DataFrame, feature: str, cells: Column, n: int = 20) -> DataFrame:
    """The ``n`` features with the largest mean percentage of the cell total."""
    totals = x.groupBy("cell_id").agg(F.sum("value").alias("_total")).filter("_total > 0")
    share = x.join(totals, "cell_id").groupBy(feature).agg((F.sum(F.col("value") * 100 / F.col("_total")) / cells).alias("mean_percent"))
    return share.orderBy(F.col("mean_percent").desc(), feature).limit(n)
