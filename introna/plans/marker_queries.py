"""Queries over differential features."""

from __future__ import annotations

from pyspark.sql import functions as F

from introna.functions.columns import r6, tail, tail_sql
from introna.functions.normal import normal_isf_sql, normal_sf_sql
from introna.operators import markers as mk
from introna.operators.reference import adjacency_index
from introna.plans.bindings import Tables, with_sql
from introna.plans.reference_queries import MERGED_SQL, merged
from introna.plans.registry import query
from introna.session import stored

TEST_SQL = """,
tot AS (SELECT cell_id, sum(value) AS total FROM b7 GROUP BY cell_id),
logged AS (SELECT cell_id, cluster, feature_id, ln(1 + value * 10000 / total) AS value FROM b7 JOIN tot USING (cell_id)),
sizes AS (SELECT cluster, count(DISTINCT cell_id) AS n1 FROM b7 GROUP BY cluster),
everyone AS (SELECT sum(n1) AS n FROM sizes),
part AS (SELECT feature_id, cluster, count(*) AS k, sum(value) AS s, sum(value * value) AS q, sum(exp(value) - 1) AS e FROM logged GROUP BY ALL),
total AS (SELECT feature_id, sum(k) AS tk, sum(s) AS ts, sum(q) AS tq, sum(e) AS te FROM part GROUP BY feature_id),
grid AS (SELECT feature_id, cluster, n1, n - n1 AS n2, n, coalesce(k, 0) AS k1, tk - coalesce(k, 0) AS k2, tk AS k, coalesce(s, 0) AS s1, ts - coalesce(s, 0) AS s2, ts,
  coalesce(q, 0) AS q1, tq - coalesce(q, 0) AS q2, tq, coalesce(e, 0) AS e1, te - coalesce(e, 0) AS e2 FROM total CROSS JOIN sizes CROSS JOIN everyone LEFT JOIN part USING (feature_id, cluster)),
stats AS (SELECT *, 2 * (CASE WHEN k1 > 0 THEN k1 * ln(k1 * n / (n1 * k)) ELSE 0 END + CASE WHEN n1 > k1 THEN (n1 - k1) * ln((n1 - k1) * n / (n1 * (n - k))) ELSE 0 END
  + CASE WHEN k2 > 0 THEN k2 * ln(k2 * n / (n2 * k)) ELSE 0 END + CASE WHEN n2 > k2 THEN (n2 - k2) * ln((n2 - k2) * n / (n2 * (n - k))) ELSE 0 END) AS g,
  tq - ts * ts / k AS rss0, CASE WHEN k1 > 0 THEN greatest(q1 - s1 * s1 / k1, 0) ELSE 0 END + CASE WHEN k2 > 0 THEN greatest(q2 - s2 * s2 / k2, 0) ELSE 0 END AS rss1 FROM grid),
tested AS (SELECT cluster, feature_id, least(exp(-(greatest(g, 0) + CASE WHEN k1 > 0 AND k2 > 0 AND k > 2 AND rss0 > 1e-9 AND rss1 > 1e-9 THEN greatest(k * ln(rss0 / rss1), 0) ELSE 0 END) / 2), 1) AS p_val,
  log2(e1 / n1 + 1) - log2(e2 / n2 + 1) AS avg_log2fc, k1 / n1 AS pct_1, k2 / n2 AS pct_2 FROM stats),
dropped AS (SELECT cluster, feature_id, regexp_replace(feature_id, '-[^-]*$', '') AS gene,
  CASE WHEN pct_1 > 0 THEN p_val END AS p_val, CASE WHEN pct_1 > 0 THEN avg_log2fc END AS avg_log2fc FROM tested)
"""
GENE_SQL = TEST_SQL + MERGED_SQL + """,
annotation AS (SELECT CASE WHEN CAST(substr(gene_id, 5) AS BIGINT) % 3 = 0 THEN 'alt' || gene_id ELSE gene_id END AS gene_id, gene_name, exon_number, "start", "end", row_number() OVER (ORDER BY gene_id, "start") AS exon_pos FROM merged),
by_id AS (SELECT gene_id, exon_number AS k, arg_max("start", exon_pos) AS s, arg_max("end", exon_pos) AS e FROM annotation GROUP BY ALL),
by_name AS (SELECT gene_name, exon_number AS k, arg_max("start", exon_pos) AS s, arg_max("end", exon_pos) AS e FROM annotation WHERE gene_name IS NOT NULL GROUP BY ALL),
feats AS (SELECT DISTINCT feature_id, split_part(feature_id, '-', 1) AS gene_id, CAST(split_part(feature_id, '-', 2) AS BIGINT) AS k FROM b7),
named AS (SELECT f.*, CASE WHEN CAST(substr(gene_id, 5) AS BIGINT) % 11 <> 0 THEN 'N' || (CAST(substr(gene_id, 5) AS BIGINT) % 37) END AS gene_name FROM feats f),
placed AS (SELECT feature_id, coalesce(i.s, n.s) AS s, coalesce(i.e, n.e) AS e FROM named f LEFT JOIN by_id i ON f.gene_id = i.gene_id AND f.k = i.k LEFT JOIN by_name n ON f.gene_name = n.gene_name AND f.k = n.k),
lengths AS (SELECT d.*, s, e, CASE WHEN p_val IS NOT NULL THEN e - s + 1 END AS exon_length FROM dropped d LEFT JOIN placed USING (feature_id)),
weights AS (SELECT *, exon_length / sum(exon_length) OVER (PARTITION BY cluster, gene) AS weight FROM lengths)
"""


def marker_rows(t: Tables):
    """B7, read by several steps."""
    return stored(t.b7())


def tested(rows):
    """One-vs-rest tests of ``marker_rows``."""
    x = mk.log_normalize(rows.select("cell_id", "feature_id", "value"))
    return mk.one_vs_rest_markers(x, stored(rows.select("cell_id", "cluster").distinct()))


def gene_rows(rows):
    """Markers with their gene; a feature never seen in the cluster loses its test, as a filtered run has it."""
    seen = F.col("pct_1") > 0
    return tested(rows).select(
        "cluster", "feature_id", mk.feature_to_gene(F.col("feature_id")).alias("gene"),
        F.when(seen, F.col("p_val")).alias("p_val"), F.when(seen, F.col("avg_log2fc")).alias("avg_log2fc"),
    )


def placed(t: Tables):
    """Marker rows with exon places; every third gene is known by its name only."""
    exons, counts = stored(merged(t)), marker_rows(t)
    index = adjacency_index(exons, ["gene_id", "start"]).select("gene_id", "exon_st")
    number = F.substring("gene_id", 5, 20).cast("long")
    annotation = exons.join(index, "gene_id").select(
        F.when(number % 3 == 0, F.concat(F.lit("alt"), "gene_id")).otherwise(F.col("gene_id")).alias("gene_id"), "gene_name", "exon_number", "start", "end",
        (F.col("exon_st") + F.col("exon_number")).alias("exon_pos"),
    )
    features = counts.select("feature_id").distinct().select(
        "feature_id", F.substring_index("feature_id", "-", 1).alias("gene_id"), F.substring_index("feature_id", "-", -1).cast("long").alias("k")
    )
    features = features.withColumn("gene_name", F.when(number % 11 != 0, F.concat(F.lit("N"), (number % 37).cast("string"))))
    return mk.exon_coordinates(stored(gene_rows(counts)), features, annotation)


def weighted(t: Tables):
    return mk.length_weights(placed(t))


@query("log_normalize", with_sql("b7", TEST_SQL + "SELECT cell_id, feature_id, round(value, 6) AS value FROM logged"))
def _log_normalize(t: Tables):
    return mk.log_normalize(t.b7().select("cell_id", "feature_id", "value")).select("cell_id", "feature_id", r6("value").alias("value"))


@query("one_vs_rest_markers", with_sql("b7", TEST_SQL + """SELECT cluster, feature_id, round(p_val, 6) AS p_val, round(avg_log2fc, 6) AS avg_log2fc, round(pct_1, 6) AS pct_1, round(pct_2, 6) AS pct_2, """ + tail_sql("p_val") + """ AS p_tail,
round(least(p_val * (SELECT count(*) FROM total), 1), 6) AS p_val_adj FROM tested"""))
def _markers(t: Tables):
    return tested(marker_rows(t)).select("cluster", "feature_id", tail("p_val").alias("p_tail"), *[r6(c).alias(c) for c in ("p_val", "avg_log2fc", "pct_1", "pct_2", "p_val_adj")])


@query("feature_to_gene", with_sql("b2", """SELECT DISTINCT gene_name || '/' || exon_number || '-a-' || exon_number AS feature_id, gene_name || '_' || exon_number || '-a' AS gene FROM b2
UNION SELECT DISTINCT gene_id, gene_id FROM b2"""))
def _to_gene(t: Tables):
    exon = F.col("exon_number").cast("string")
    names = F.array(F.concat("gene_name", F.lit("/"), exon, F.lit("-a-"), exon), F.col("gene_id"))
    rows = t.b2().select(F.explode(names).alias("feature_id")).distinct()
    return rows.withColumn("gene", mk.feature_to_gene(F.col("feature_id")))


@query("exon_coordinates", with_sql("b7 b1", GENE_SQL + """SELECT cluster, feature_id, gene, s AS "start", e AS "end", exon_length FROM lengths"""))
def _coordinates(t: Tables):
    return placed(t).select("cluster", "feature_id", "gene", "start", "end", "exon_length")


@query("length_weights", with_sql("b7 b1", GENE_SQL + "SELECT cluster, feature_id, gene, round(weight, 6) AS weight FROM weights"))
def _weights(t: Tables):
    return weighted(t).select("cluster", "feature_id", "gene", r6("weight").alias("weight"))


WEIGHTED_SQL = GENE_SQL + f""",
zs AS (SELECT *, {normal_isf_sql('p_val')} AS z FROM weights),
gsum AS (SELECT cluster, gene, count(p_val) AS n_p, count(weight) AS n_w, sum(weight * z) / sqrt(sum(weight * weight)) AS z, count(avg_log2fc) AS n_f, sum(abs(avg_log2fc) * weight) AS v FROM zs GROUP BY cluster, gene),
combined AS (SELECT cluster, gene, CASE WHEN n_p > 0 AND n_p = n_w THEN {normal_sf_sql('z')} END AS stouffer_p, CASE WHEN n_f > 0 AND n_f = n_w THEN v END AS abs_log2fc FROM gsum)
"""


@query("weighted_stouffer", with_sql("b7 b1", WEIGHTED_SQL + "SELECT cluster, gene, round(stouffer_p, 6) AS stouffer_p, " + tail_sql("stouffer_p") + " AS p_tail FROM combined"))
def _weighted_stouffer(t: Tables):
    return mk.weighted_stouffer(weighted(t)).withColumns({"p_tail": tail("stouffer_p"), "stouffer_p": r6("stouffer_p")})


@query("weighted_abs_log2fc", with_sql("b7 b1", WEIGHTED_SQL + "SELECT cluster, gene, round(abs_log2fc, 6) AS abs_log2fc FROM combined"))
def _weighted_fold(t: Tables):
    return mk.weighted_abs_log2fc(weighted(t)).withColumn("abs_log2fc", r6("abs_log2fc"))


PLAIN_SQL = TEST_SQL + f""",
zs AS (SELECT *, {normal_isf_sql('p_val')} AS z FROM dropped),
plain AS (SELECT cluster, gene, CASE WHEN n > 0 THEN {normal_sf_sql('zz')} END AS stouffer_p, fold FROM (
  SELECT cluster, gene, count(p_val) AS n, sum(z) / sqrt(count(p_val)) AS zz, avg(abs(avg_log2fc)) AS fold FROM zs GROUP BY cluster, gene))
"""


@query("stouffer", with_sql("b7", PLAIN_SQL + "SELECT cluster, gene, round(stouffer_p, 6) AS stouffer_p, " + tail_sql("stouffer_p") + " AS p_tail, round(fold, 6) AS mean_abs_log2fc FROM plain"))
def _stouffer(t: Tables):
    return mk.stouffer(gene_rows(marker_rows(t))).withColumns({"p_tail": tail("stouffer_p"), **{c: r6(c) for c in ("stouffer_p", "mean_abs_log2fc")}})


ADJUST_SQL = PLAIN_SQL + """,
given AS (SELECT cluster, gene, stouffer_p AS p, fold, count(*) OVER () AS n, row_number() OVER (ORDER BY stouffer_p, cluster, gene) AS r FROM plain WHERE stouffer_p IS NOT NULL),
adjusted AS (SELECT cluster, gene, p, fold, least(p * n, 1) AS bonf, least(min(p * n / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS bh FROM given)
"""


def adjusted(t: Tables):
    genes = stored(mk.stouffer(gene_rows(marker_rows(t))))
    return mk.adjust_bh(mk.adjust_bonferroni(genes, "stouffer_p"), "stouffer_p", ["cluster", "gene"])


@query("adjust_p", with_sql("b7", ADJUST_SQL + """SELECT cluster, gene, round(bonf, 6) AS p_bonferroni, round(bh, 6) AS p_bh, """ + tail_sql("bonf") + " AS bonferroni_tail, " + tail_sql("bh") + """ AS bh_tail FROM plain LEFT JOIN adjusted USING (cluster, gene)"""))
def _adjust(t: Tables):
    return adjusted(t).select(
        "cluster", "gene", r6("p_bonferroni").alias("p_bonferroni"), r6("p_bh").alias("p_bh"),
        tail("p_bonferroni").alias("bonferroni_tail"), tail("p_bh").alias("bh_tail"),
    )


@query("adjusted_rows", with_sql("b7", ADJUST_SQL + """SELECT cluster, feature_id, gene, round(bonf, 6) AS p_bonferroni FROM dropped LEFT JOIN adjusted USING (cluster, gene)"""))
def _adjusted_rows(t: Tables):
    rows = mk.to_rows(gene_rows(marker_rows(t)), adjusted(t).select("cluster", "gene", "p_bonferroni"))
    return rows.select("cluster", "feature_id", "gene", r6("p_bonferroni").alias("p_bonferroni"))


# thresholds chosen so that both lists have members on the test tables
@query("select_de", with_sql("b7", TEST_SQL + """SELECT cluster, feature_id FROM tested WHERE p_val < 0.05 AND abs(avg_log2fc) > 0.3"""))
def _select(t: Tables):
    return mk.select_de(tested(marker_rows(t)), "p_val", "avg_log2fc", 0.05, 0.3).select("cluster", "feature_id")


@query("compare_de", with_sql("b7", TEST_SQL + """,
de AS (SELECT DISTINCT cluster, gene FROM dropped WHERE p_val < 0.05 AND abs(avg_log2fc) > 0.3),
pairs AS (SELECT a.cluster AS one, b.cluster AS two FROM (SELECT DISTINCT cluster FROM dropped) a JOIN (SELECT DISTINCT cluster FROM dropped) b ON a.cluster < b.cluster),
a AS (SELECT one, two, gene FROM pairs JOIN de ON cluster = one), b AS (SELECT one, two, gene FROM pairs JOIN de ON cluster = two)
SELECT one, two, gene, CASE WHEN b.gene IS NULL THEN 'first' ELSE 'both' END AS side FROM a LEFT JOIN b USING (one, two, gene)
UNION ALL SELECT one, two, gene, 'second' FROM b ANTI JOIN a USING (one, two, gene)"""))
def _compare(t: Tables):
    """Every two clusters."""
    rows = mk.select_de(gene_rows(marker_rows(t)), "p_val", "avg_log2fc", 0.05, 0.3).select("cluster", "gene")
    return mk.compare_de(*both_sides(t, rows), by=["one", "two"])


def both_sides(t: Tables, rows):
    """The rows of the first and of the second cluster of every pair of clusters."""
    # the clusters are an array of a few names, of which each is paired with those after it
    names = t.read("customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("all"))
    firsts = names.select("all", F.posexplode("all").alias("i", "one"))
    pairs = firsts.select("one", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("two"))
    kept = stored(rows)
    return [kept.join(pairs, F.col("cluster") == F.col(c)).drop("cluster") for c in ("one", "two")]


@query("merge_enrichment", with_sql("b7", TEST_SQL + """,
terms AS (SELECT cluster, feature_id AS id, 'Term ' || gene AS name, 'C' || (CAST(substr(gene, 5) AS BIGINT) % 3) AS category, p_val AS q FROM dropped WHERE p_val IS NOT NULL),
pairs AS (SELECT a.cluster AS one, b.cluster AS two FROM (SELECT DISTINCT cluster FROM dropped) a JOIN (SELECT DISTINCT cluster FROM dropped) b ON a.cluster < b.cluster),
a AS (SELECT * FROM pairs JOIN terms ON cluster = one), b AS (SELECT * FROM pairs JOIN terms ON cluster = two)
SELECT one, two, id, coalesce(a.name, b.name) AS name, coalesce(a.category, b.category) AS category, round(coalesce(a.q, 0), 6) AS q_a, round(coalesce(b.q, 0), 6) AS q_b,
round(CASE WHEN a.q > 0 THEN -log10(a.q) END, 6) AS log_q_a, round(CASE WHEN b.q > 0 THEN -log10(b.q) END, 6) AS log_q_b FROM a FULL JOIN b USING (one, two, id)"""))
def _enrichment(t: Tables):
    terms = gene_rows(marker_rows(t)).filter("p_val IS NOT NULL").select(
        "cluster", F.col("feature_id").alias("id"), F.concat(F.lit("Term "), "gene").alias("name"),
        F.concat(F.lit("C"), (F.substring("gene", 5, 20).cast("long") % 3).cast("string")).alias("category"), F.col("p_val").alias("q"),
    )
    merged_terms = mk.merge_enrichment(*both_sides(t, terms), by=["one", "two"])
    return merged_terms.select("one", "two", "id", "name", "category", *[r6(c).alias(c) for c in ("q_a", "q_b", "log_q_a", "log_q_b")])
