"""Queries over PSI values (Q1-Q7)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from introna.functions.columns import r6, tail, tail_sql
from introna.operators import expression, psi
from introna.plans.bindings import Tables, with_sql
from introna.plans.registry import query
from introna.plans.splice_queries import EVENTS, MEAN_SQL, MIN_SQL, psi_rows, sparse_rows
from introna.session import stored


def values(t: Tables, method: str = "mean"):
    return stored(psi_rows(t, method).select(F.col("sample_id").alias("cell_id"), "event_id", "psi"))


@query("psi_matrix", with_sql(EVENTS, MEAN_SQL + """,
named AS (SELECT sample_id // 2 AS cell, sample_id % 2 AS pos, event_id, psi FROM scored),
picked AS (SELECT cell, event_id, arg_min(psi, pos) FILTER (psi IS NOT NULL) AS psi FROM named GROUP BY ALL),
cells AS (SELECT n_nationkey AS cell FROM nation UNION ALL SELECT n_nationkey + 25 FROM nation)
SELECT 'S' || cells.cell AS cell_id, event_id, round(psi, 6) AS psi FROM cells LEFT JOIN picked USING (cell)"""))
def _matrix(t: Tables):
    """Two files per cell (told apart after the dot); the metadata's cells 25-49 are without values."""
    rows = psi_rows(t).withColumns({"pos": F.col("sample_id") % 2, "cell": F.floor(F.col("sample_id") / 2)})
    rows = rows.withColumn("sample_id", F.concat(F.lit("S"), F.col("cell").cast("string"), F.lit("."), F.col("pos").cast("string")))
    numbers = t.read("nation").select(F.explode(F.array("n_nationkey", F.col("n_nationkey") + 25)).alias("n"))
    cells = numbers.select(F.concat(F.lit("S"), F.col("n").cast("string")).alias("cell_id"))
    return psi.psi_matrix(rows, cells, "pos").select("cell_id", "event_id", r6("psi").alias("psi"))


@query("event_gene", """WITH rows AS (SELECT 'e' || l_partkey AS event_id, CASE WHEN l_suppkey % 11 <> 0 THEN 'N' || (l_suppkey % 4) END AS n1, CASE WHEN l_suppkey % 22 <> 0 THEN 'g' || (l_suppkey % 4) END AS g1,
CASE WHEN l_linenumber <> 3 THEN 'N' || (l_linenumber % 3) || ',N' || (l_suppkey % 2) END AS n2, CASE WHEN l_suppkey % 2 = 0 THEN 'h' || (l_suppkey % 2) END AS g2 FROM lineitem),
one AS (SELECT event_id, coalesce(n1, g1) AS name, count(*) AS n FROM rows GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, name NULLS LAST) = 1),
two AS (SELECT event_id, coalesce(n2, g2) AS name, count(*) AS n FROM rows GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, name NULLS LAST) = 1)
SELECT event_id, CASE WHEN one.name IS NULL AND two.name IS NULL THEN 'Empty' ELSE array_to_string(list_sort(list_distinct(string_split(concat_ws(',', one.name, two.name), ','))), ',') END AS gene_name FROM one JOIN two USING (event_id)""")
def _event_gene(t: Tables):
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    text = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    rows = t.read("lineitem").select(
        text("e", F.col("l_partkey")).alias("event_id"), F.when(s % 11 != 0, text("N", s % 4)).alias("isoform1_gene_name"),
        F.when(s % 22 != 0, text("g", s % 4)).alias("isoform1_gene_id"),
        F.when(n != 3, F.concat(text("N", n % 3), text(",N", s % 2))).alias("isoform2_gene_name"), F.when(s % 2 == 0, text("h", s % 2)).alias("isoform2_gene_id"),
    )
    return psi.event_gene(rows)


@query("psi_random_impute", with_sql(EVENTS, MEAN_SQL + """SELECT sample_id AS cell_id, event_id, round(coalesce(psi, CAST('0x' || substr(md5(sample_id || '|' || event_id || '|7'), 1, 8) AS BIGINT) / 4294967296.0), 6) AS psi FROM scored"""))
def _random(t: Tables):
    rows = psi_rows(t).select(F.col("sample_id").alias("cell_id"), "event_id", "psi")
    return psi.psi_random_impute(rows, 7).select("cell_id", "event_id", r6("psi").alias("psi"))


@query("psi_cluster_impute", with_sql(EVENTS, MEAN_SQL + """,
kept AS (SELECT sample_id, event_id, psi FROM scored WHERE event_id IN (SELECT event_id FROM scored GROUP BY event_id HAVING count(psi) >= 10)),
per_cell AS (SELECT sample_id, avg(psi) AS m FROM kept GROUP BY sample_id),
means AS (SELECT sample_id % 5 AS cluster, round_even(avg(m), 3) AS mean FROM per_cell GROUP BY ALL)
SELECT sample_id AS cell_id, event_id, cluster, round(coalesce(psi, mean), 6) AS psi FROM kept JOIN means ON sample_id % 5 = cluster"""))
def _cluster(t: Tables):
    rows = values(t)
    clusters = stored(rows.select("cell_id", (F.col("cell_id") % 5).alias("cluster")).distinct())
    return psi.psi_cluster_impute(rows, clusters).withColumn("psi", r6("psi"))


COMPARE_SQL = MEAN_SQL + MIN_SQL[MIN_SQL.index("scored AS"):].replace("scored AS", ", scored_min AS", 1)


@query("compare_psi", with_sql(EVENTS, COMPARE_SQL + """,
a AS (SELECT sample_id, event_id, psi AS x FROM scored),
b AS (SELECT sample_id, event_id, psi AS y FROM scored_min),
cells AS (SELECT sample_id FROM a INTERSECT SELECT sample_id FROM b), evs AS (SELECT event_id FROM a INTERSECT SELECT event_id FROM b),
both_sides AS (SELECT x, y FROM (SELECT * FROM a WHERE sample_id IN (FROM cells) AND event_id IN (FROM evs)) FULL JOIN (SELECT * FROM b WHERE sample_id IN (FROM cells) AND event_id IN (FROM evs)) USING (sample_id, event_id))
SELECT (SELECT count(*) FROM cells) AS shared_cells, (SELECT count(*) FROM evs) AS shared_events, bool_and(x IS NOT DISTINCT FROM y) AS exact_equal,
round(max(abs(x - y)), 6) AS max_abs_diff, round(avg(abs(x - y)), 6) AS mean_abs_diff, round(corr(x, y), 6) AS pearson FROM both_sides"""))
def _compare(t: Tables):
    """Mean against min scores."""
    table = sparse_rows(t)
    of = lambda method: stored(replace(table, method=method).rows.select(F.col("sample_id").alias("cell_id"), "event_id", "psi"))
    rows = psi.compare_psi(of("mean"), of("min"))
    return rows.withColumns({c: r6(c) for c in ("max_abs_diff", "mean_abs_diff", "pearson")})


from introna.functions.normal import normal_sf_sql  # noqa: E402

RANK_SQL = MEAN_SQL + """,
vals AS (SELECT event_id, sample_id % 5 AS grp, psi FROM scored WHERE psi IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY event_id ORDER BY psi) + (count(*) OVER (PARTITION BY event_id, psi) - 1) / 2 AS r, count(*) OVER (PARTITION BY event_id) AS total FROM vals),
rsums AS (SELECT event_id, grp, count(*) AS n, any_value(total) AS total, sum(r) AS rs FROM ranked GROUP BY event_id, grp),
zs AS (SELECT event_id, grp, n, (rs - n * (total + 1) / 2) / sqrt(n * (total - n) * (total + 1) / 12.0) AS z FROM rsums WHERE total > n)
"""


P_SQL = f"2 * {normal_sf_sql('abs(z)')}"


@query("rank_sum_test", with_sql(EVENTS, RANK_SQL + f"""SELECT event_id, grp AS "group", n, round(z, 6) AS z, round({P_SQL}, 6) AS p_val, {tail_sql(P_SQL)} AS p_tail FROM zs"""))
def _rank_sum(t: Tables):
    rows = values(t)
    groups = stored(rows.select("cell_id", (F.col("cell_id") % 5).alias("group")).distinct())
    return psi.rank_sum_test(rows, groups).withColumns({"p_tail": tail("p_val"), "z": r6("z"), "p_val": r6("p_val")})


# cells 0-59 in five clusters: the last ten have no row at all
FILL_SQL = MEAN_SQL + """,
kept AS (SELECT sample_id, event_id, psi FROM scored WHERE event_id IN (SELECT event_id FROM scored GROUP BY event_id HAVING count(psi) >= 10)),
cells AS (SELECT unnest(range(60)) AS sample_id),
per_cell AS (SELECT sample_id, avg(psi) AS m FROM kept GROUP BY sample_id),
means AS (SELECT sample_id % 5 AS cluster, round_even(avg(m), 3) AS fill FROM per_cell GROUP BY ALL),
grid AS (SELECT e.event_id, c.sample_id, c.sample_id % 5 AS cluster, k.psi, fill FROM (SELECT DISTINCT event_id FROM kept) e CROSS JOIN cells c
  LEFT JOIN kept k ON k.event_id = e.event_id AND k.sample_id = c.sample_id LEFT JOIN means m ON m.cluster = c.sample_id % 5)
"""


def sixty_cells(t: Tables, rows):
    known = rows.select("cell_id").unionByName(t.read("nation").select((F.col("n_nationkey") + 50).alias("cell_id")).filter("cell_id < 60"))
    return known.distinct().select("cell_id", (F.col("cell_id") % 5).alias("cluster"))


@query("psi_cluster_fill", with_sql(EVENTS, FILL_SQL + """SELECT event_id, cluster, fill, count(*) AS missing FROM grid WHERE psi IS NULL GROUP BY ALL"""))
def _cluster_fill(t: Tables):
    rows = values(t)
    return psi.psi_cluster_fill(rows, stored(sixty_cells(t, rows)))


@query("rank_sum_imputed", with_sql(EVENTS, FILL_SQL + RANK_SQL[len(MEAN_SQL):].replace(
    "SELECT event_id, sample_id % 5 AS grp, psi FROM scored WHERE psi IS NOT NULL", "SELECT event_id, cluster AS grp, coalesce(psi, fill) AS psi FROM grid"
) + f"""SELECT event_id, grp AS "group", n, round(z, 6) AS z, {tail_sql(P_SQL)} AS p_tail FROM zs"""))
def _rank_sum_imputed(t: Tables):
    """Rank sums over every cell and kept event, filled entries counted and not written out."""
    rows = values(t)
    clusters = stored(sixty_cells(t, rows))
    held = stored(psi.kept_rows(rows))
    implicit = psi.filled_entries(held, clusters).select("event_id", F.col("cluster").alias("group"), F.col("fill").alias("psi"), F.col("missing").alias("c"))
    found = psi.rank_sum_test(held, clusters.withColumnRenamed("cluster", "group"), implicit=implicit)
    return found.select("event_id", "group", "n", r6("z").alias("z"), tail("p_val").alias("p_tail"))


@query("events_per_cell", with_sql(EVENTS, MEAN_SQL + """,
per AS (SELECT sample_id, count(psi) AS v FROM scored GROUP BY sample_id), span AS (SELECT min(v) AS low, (max(v) - min(v)) / 50 AS width FROM per),
placed AS (SELECT CASE WHEN width = 0 THEN 1 ELSE CAST(least(floor((v - low) / width) + 1, 50) AS BIGINT) END AS bin, low, width FROM per, span)
SELECT bin, round(any_value(low) + (bin - 1) * any_value(width), 6) AS low, round(any_value(low) + bin * any_value(width), 6) AS high, count(*) AS "count" FROM placed GROUP BY bin"""))
def _events_per_cell(t: Tables):
    return expression.histogram(stored(psi.events_per_cell(psi_rows(t).withColumnRenamed("sample_id", "cell_id"))), "n").select("bin", r6("low").alias("low"), r6("high").alias("high"), "count")
