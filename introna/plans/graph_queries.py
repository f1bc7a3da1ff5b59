"""Queries over exon graphs (G1-G8, G14-G18) and expression statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from introna.functions.columns import r6
from introna.operators import expression as ex
from introna.operators import graph
from introna.operators.pca import sparse_principal_components
from introna.operators.reference import adjacency_index
from introna.plans.bindings import Tables, with_sql
from introna.plans.registry import query
from introna.session import stored
from introna.sources import tables

N_TOP = 40  # variable genes kept in the queries

BASE = "b2f b3 exons"
GRAPH_SQL = """,
feats AS (SELECT cell_id, gene_id, exon_number - 1 AS i, "count" AS value FROM b2f WHERE "count" > 0),
active AS (SELECT DISTINCT cell_id, gene_id FROM feats),
support AS (SELECT b3.cell_id, b3.gene_id, "start", "end", sum(uniq) AS "count" FROM b3 SEMI JOIN active USING (cell_id, gene_id) GROUP BY ALL),
located AS (SELECT s.*, n, {start_slot} AS start_slot, {end_slot} AS end_slot FROM support s JOIN genes USING (gene_id) WHERE n > 1),
moved AS (SELECT cell_id, gene_id, n, CAST(floor(start_slot) AS BIGINT) AS i,
  CAST(CASE WHEN end_slot - floor(end_slot) = 0.5 THEN least(ceil(end_slot), n - 1) ELSE floor(end_slot) END AS BIGINT) AS j, "count"
  FROM located WHERE NOT (start_slot = -1 AND end_slot = -1)),
found AS (SELECT cell_id, gene_id, n, i, j, CAST(sum("count") AS DOUBLE) AS support FROM moved WHERE i BETWEEN 0 AND n - 1 AND j BETWEEN 0 AND n - 1 GROUP BY ALL),
chain AS (SELECT cell_id, gene_id, n, unnest(generate_series(0, n - 2)) AS i FROM active JOIN genes USING (gene_id) WHERE n > 1),
missing AS (SELECT c.cell_id, c.gene_id, c.n, c.i, c.i + 1 AS j FROM chain c LEFT JOIN found f ON c.cell_id = f.cell_id AND c.gene_id = f.gene_id AND c.i = f.i AND f.j = c.i + 1 WHERE f.n IS NULL),
filled AS (SELECT DISTINCT cell_id, gene_id FROM missing),
edges AS (SELECT f.cell_id, f.gene_id, n, i, j, support + CASE WHEN x.cell_id IS NULL THEN 0 ELSE 1 END AS weight, false AS added
  FROM found f LEFT JOIN filled x ON f.cell_id = x.cell_id AND f.gene_id = x.gene_id
  UNION ALL SELECT cell_id, gene_id, n, i, j, 1.0, true FROM missing),
on_pairs AS (SELECT cell_id, gene_id, i, lead(i) OVER (PARTITION BY cell_id, gene_id ORDER BY i) AS j FROM feats),
forward AS (SELECT e.cell_id, e.gene_id, e.i, e.j, e.weight FROM edges e JOIN feats a ON e.cell_id = a.cell_id AND e.gene_id = a.gene_id AND e.i = a.i
  JOIN feats b ON e.cell_id = b.cell_id AND e.gene_id = b.gene_id AND e.j = b.i WHERE e.i < e.j),
compressed AS (SELECT * FROM forward UNION ALL SELECT o.cell_id, o.gene_id, o.i, o.j, 1.0 FROM on_pairs o
  LEFT JOIN forward f ON o.cell_id = f.cell_id AND o.gene_id = f.gene_id AND o.i = f.i AND o.j = f.j WHERE o.j IS NOT NULL AND f.cell_id IS NULL),
kept AS (SELECT gene_id, i FROM compressed UNION SELECT gene_id, j FROM compressed UNION SELECT gene_id, i FROM feats),
var AS (SELECT gene_id, i, row_number() OVER (PARTITION BY gene_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY gene_id) AS m FROM kept),
reduced AS (SELECT c.cell_id, c.gene_id, a.m, a.k AS i, b.k AS j, weight FROM compressed c JOIN var a ON c.gene_id = a.gene_id AND c.i = a.i JOIN var b ON c.gene_id = b.gene_id AND c.j = b.i),
offsets AS (SELECT gene_id, m, coalesce(sum(m) OVER (ORDER BY gene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS node_st FROM (SELECT DISTINCT gene_id, m FROM var))
"""


def _slot(p: str) -> str:
    c = f"least(n - 1, CASE WHEN {p} < 100 THEN -1 ELSE {p} // 100 - 1 END)"
    return (
        f"(CASE WHEN {p} < 100 THEN -1.0 WHEN {p} <= 100 * ({c} + 1) + 49 THEN {c}::DOUBLE "
        f"WHEN {c} < n - 2 OR {c} = n - 1 THEN {c} + 0.5 END)"
    )


GRAPH_SQL = GRAPH_SQL.format(start_slot=_slot('"start"'), end_slot=_slot('"end"'))


def features(t: Tables):
    found = graph.exon_features(t.b2(fold_exons=True), t.exons().drop("gene_name"))
    return found.select("cell_id", "gene_id", (F.col("exon_number") - 1).alias("i"), "value")


def junctions(t: Tables):
    return t.b3().select("cell_id", "gene_id", "start", "end", F.col("uniq").alias("count"))


def edges(t: Tables, found=None):
    return graph.build_gene_edges(features(t) if found is None else found, junctions(t), t.exons())


def compressed(t: Tables, found=None):
    """Several steps read the features, so they are stored once."""
    found = stored(features(t)) if found is None else found
    return graph.compress_adjacency(found, edges(t, found))


def reduced(t: Tables, found=None):
    """(edges, var); the features and the compressed edges are read several times, so they are stored once."""
    found = stored(features(t)) if found is None else found
    return graph.reduce_adjacency(found, stored(compressed(t, found)))


@query("exon_features", with_sql("b2f exons", """SELECT cell_id, gene_id, exon_number, exon_pos, round("count", 6) AS value FROM b2f JOIN exons USING (gene_id, exon_number) WHERE "count" > 0"""))
def _features(t: Tables):
    index = adjacency_index(t.exons(), ["line_no"]).select("gene_id", "exon_st")
    exons = t.exons().join(index, "gene_id").select("gene_id", "exon_number", (F.col("exon_st") + F.col("exon_number") - 1).alias("exon_pos"))
    found = graph.exon_features(t.b2(fold_exons=True), exons)
    return found.select("cell_id", "gene_id", "exon_number", "exon_pos", r6("value").alias("value"))


@query("locate_junction_ends", with_sql(BASE, f""",
rows AS (SELECT cell_id, gene_id, "start", "end", uniq FROM b3)
SELECT cell_id, gene_id, "start", "end", n, {_slot('"start"')} AS start_slot, {_slot('"end"')} AS end_slot FROM rows JOIN genes USING (gene_id)"""))
def _locate(t: Tables):
    return graph.locate_junction_ends(junctions(t).drop("count"), graph.gene_exons(t.exons()))


@query("build_gene_edges", with_sql(BASE, GRAPH_SQL + "SELECT cell_id, gene_id, n, i, j, weight, added FROM edges"))
def _edges(t: Tables):
    return edges(t)


@query("graph_matrices", with_sql(BASE, GRAPH_SQL + """,
idx AS (SELECT gene_id, n, coalesce(sum(n * n) OVER w, 0) AS ind_st, coalesce(sum(n) OVER w, 0) AS exon_st FROM genes WINDOW w AS (ORDER BY gene_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT 'feature' AS matrix, cell_id, CAST(exon_st + i AS BIGINT) AS pos, round(value, 6) AS value FROM feats JOIN idx USING (gene_id)
UNION ALL SELECT 'adjacency', cell_id, CAST(ind_st + i * idx.n + j AS BIGINT), weight FROM edges JOIN idx USING (gene_id)"""))
def _matrices(t: Tables):
    found = stored(features(t))
    x, a = graph.graph_matrices(found, edges(t, found), adjacency_index(t.exons(), ["line_no"]))
    x = x.select(F.lit("feature").alias("matrix"), "cell_id", "pos", r6("value").alias("value"))
    return x.unionByName(a.select(F.lit("adjacency").alias("matrix"), "cell_id", F.col("slot").alias("pos"), F.col("weight").alias("value")))


@query("drop_empty_features", with_sql("b2f exons", """,
wide AS (SELECT cell_id, gene_id, exon_number, "count" AS value FROM b2f WHERE "count" > 0),
var AS (SELECT gene_id, exon_number, row_number() OVER (PARTITION BY gene_id ORDER BY exon_number) AS k FROM (SELECT DISTINCT gene_id, exon_number FROM wide))
SELECT cell_id, gene_id, gene_id || '-' || k AS feature_id, exon_number, round(value, 6) AS value FROM wide JOIN var USING (gene_id, exon_number)"""))
def _drop_empty(t: Tables):
    """Between the counted exons stand others, with an entry of zero each, that nobody counts."""
    counted = features(t).select("cell_id", "gene_id", (2 * F.col("i") + 1).alias("i"), "value")
    empty = t.exons().select(F.lit("none").alias("cell_id"), "gene_id", (2 * (F.col("exon_number") - 1)).alias("i"), F.lit(0.0).alias("value"))
    kept = graph.drop_empty_features(counted.unionByName(empty))[0].withColumn("i", F.expr("(i - 1) div 2"))
    return kept.select(
        "cell_id", "gene_id", F.concat("gene_id", F.lit("-"), F.col("k").cast("string")).alias("feature_id"),
        (F.col("i") + 1).alias("exon_number"), r6("value").alias("value"),
    )


@query("compress_adjacency", with_sql(BASE, GRAPH_SQL + "SELECT cell_id, gene_id, i, j, CAST(weight AS DOUBLE) AS weight FROM compressed"))
def _compress(t: Tables):
    return compressed(t)


@query("reduce_adjacency", with_sql(BASE, GRAPH_SQL + "SELECT cell_id, gene_id, m, i, j, i * m + j + 1 AS slot, CAST(weight AS DOUBLE) AS weight FROM reduced"))
def _reduce(t: Tables):
    return reduced(t)[0].withColumn("slot", F.col("i") * F.col("m") + F.col("j") + 1)


# Expression -----------------------------------------------------------------------------------

EXPR_SQL = """,
gm AS (SELECT cell_id, gene_id, sum("count") AS value FROM b2 GROUP BY ALL),
nc AS (SELECT count(DISTINCT cell_id) AS n FROM gm),
common AS (SELECT * FROM gm WHERE gene_id IN (SELECT gene_id FROM gm GROUP BY gene_id HAVING count(*) >= 3)),
totals AS (SELECT cell_id, sum(value) AS total FROM common GROUP BY cell_id),
target AS (SELECT median(total) AS target FROM totals WHERE total > 0),
normed AS (SELECT cell_id, gene_id, value / total * target AS value FROM common JOIN totals USING (cell_id), target),
logged AS (SELECT cell_id, gene_id, ln(1 + value) AS value FROM normed),
mom AS (SELECT gene_id, sum(exp(value) - 1) AS s, sum((exp(value) - 1) * (exp(value) - 1)) AS q FROM logged GROUP BY gene_id),
disp AS (SELECT gene_id, ln(1 + s / n) AS mean, ln(((q - n * (s / n) * (s / n)) / (n - 1)) / (s / n)) AS dispersion FROM mom, nc),
span AS (SELECT min(mean) AS low, (max(mean) - min(mean)) / 20 AS width FROM disp),
binned AS (SELECT *, CAST(least(greatest(ceil((mean - low) / width), 1), 20) AS BIGINT) AS bin FROM disp, span),
bstat AS (SELECT bin, avg(dispersion) AS m, stddev_samp(dispersion) AS sd FROM binned GROUP BY bin),
scored AS (SELECT gene_id, mean, dispersion, bin, (dispersion - CASE WHEN sd IS NULL THEN 0 ELSE m END) / coalesce(sd, m) AS score FROM binned JOIN bstat USING (bin)),
hvg AS (SELECT * FROM scored QUALIFY rank() OVER (ORDER BY score DESC) <= 40)
"""


def genes_x(t: Tables):
    return t.b2().groupBy("cell_id", "gene_id").agg(F.sum("count").alias("value"))


def cells_of(t: Tables):
    return genes_x(t).select("cell_id").distinct()


def normalised(t: Tables):
    return ex.normalize_total(ex.filter_features(genes_x(t), "gene_id"))


def variable_genes(t: Tables):
    return ex.highly_variable(ex.log1p(normalised(t)), "gene_id", ex.n_cells(cells_of(t)), N_TOP)


@query("gene_matrix", with_sql("b2 b1", """,
names AS (SELECT gene_id, arg_max(gene_name, line_no) AS gene_name FROM b1 WHERE gene_name IS NOT NULL GROUP BY gene_id)
SELECT cell_id, CAST(substr(cell_id, 2) AS BIGINT) AS cell_pos, gene_id, coalesce(n.gene_name, gene_id) AS gene_name, round(sum("count"), 6) AS value
FROM b2 LEFT JOIN names n USING (gene_id) GROUP BY ALL"""))
def _gene_matrix(t: Tables):
    from introna.operators.reference import gene_name_map

    cells = cells_of(t).withColumn("cell_pos", F.substring("cell_id", 2, 20).cast("long"))
    return graph.gene_matrix(t.b2(), cells, gene_name_map(t.b1())).withColumn("value", r6("value"))


@query("filter_features", with_sql("b2", """,
x AS (SELECT cell_id, gene_id || '-' || exon_number AS feature_id, "count" AS value FROM b2)
SELECT cell_id, feature_id, round(value, 6) AS value FROM x WHERE feature_id IN (SELECT feature_id FROM x GROUP BY feature_id HAVING count(*) >= 90)"""))
def _filter_features(t: Tables):
    x = t.b7().select("cell_id", "feature_id", "value")
    return ex.filter_features(x, "feature_id", 90).select("cell_id", "feature_id", r6("value").alias("value"))


@query("qc_metrics", with_sql("b2", """,
x AS (SELECT cell_id, gene_id, gene_name, sum("count") AS value FROM b2 GROUP BY ALL)
SELECT cell_id, count(*) AS n_genes, round(sum(value), 6) AS total_counts, round(coalesce(sum(value) FILTER (gene_name LIKE 'MT-%'), 0), 6) AS total_counts_mt,
round(coalesce(sum(value) FILTER (gene_name LIKE 'MT-%'), 0) * 100 / sum(value), 6) AS pct_counts_mt FROM x GROUP BY cell_id"""))
def _qc(t: Tables):
    x = t.b2().groupBy("cell_id", "gene_id", "gene_name").agg(F.sum("count").alias("value"))
    qc = ex.cell_qc(x, "gene_name")
    return qc.select("cell_id", "n_genes", *[r6(c).alias(c) for c in ("total_counts", "total_counts_mt", "pct_counts_mt")])


@query("feature_qc", with_sql("b2", EXPR_SQL + """SELECT gene_id, count(*) AS n_cells, round(sum(value), 6) AS total_counts, round(sum(value) / any_value(n), 6) AS mean_counts FROM gm, nc GROUP BY gene_id"""))
def _feature_qc(t: Tables):
    qc = ex.feature_qc(genes_x(t), "gene_id", ex.n_cells(cells_of(t)))
    return qc.select("gene_id", "n_cells", r6("total_counts").alias("total_counts"), r6("mean_counts").alias("mean_counts"))


@query("normalize_total", with_sql("b2", EXPR_SQL + "SELECT cell_id, gene_id, round(value, 6) AS value FROM normed"))
def _normalize_total(t: Tables):
    return normalised(t).select("cell_id", "gene_id", r6("value").alias("value"))


@query("log1p", with_sql("b2", EXPR_SQL + "SELECT cell_id, gene_id, round(value, 6) AS value FROM logged"))
def _log1p(t: Tables):
    return ex.log1p(normalised(t)).select("cell_id", "gene_id", r6("value").alias("value"))


@query("highly_variable", with_sql("b2", EXPR_SQL + "SELECT gene_id, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, bin, round(score, 6) AS score FROM hvg"))
def _hvg(t: Tables):
    return variable_genes(t).select("gene_id", r6("mean").alias("mean"), r6("dispersion").alias("dispersion"), "bin", r6("score").alias("score"))


@query("feature_hvg", with_sql("b2", EXPR_SQL + """,
etot AS (SELECT cell_id, sum("count") AS total FROM b2 GROUP BY cell_id),
etarget AS (SELECT median(total) AS etarget FROM etot),
scaled AS (SELECT cell_id, gene_id, exon_number, round_even("count" / total * etarget, 0) AS value FROM b2 JOIN etot USING (cell_id), etarget WHERE gene_id IN (SELECT gene_id FROM hvg))
SELECT * FROM scaled WHERE value <> 0"""))
def _feature_hvg(t: Tables):
    exon_x = t.b2().select("cell_id", "gene_id", "exon_number", F.col("count").alias("value"))
    return ex.feature_hvg(exon_x, cells_of(t), variable_genes(t))


HVG_GRAPH = "b2f b2 b3 exons"


@query("adjacency_hvg", with_sql(HVG_GRAPH, GRAPH_SQL + EXPR_SQL + "SELECT cell_id, gene_id, i, j, CAST(weight AS DOUBLE) AS weight FROM reduced WHERE gene_id IN (SELECT gene_id FROM hvg)"))
def _adjacency_hvg(t: Tables):
    return graph.of_genes(reduced(t)[0], variable_genes(t)).drop("m")


@query("edge_normalize", with_sql(BASE, GRAPH_SQL + "SELECT cell_id, gene_id, i, j, round(weight / sum(weight) OVER (PARTITION BY cell_id, gene_id), 6) AS weight FROM reduced"))
def _edge_normalize(t: Tables):
    return graph.edge_normalize(reduced(t)[0]).select("cell_id", "gene_id", "i", "j", r6("weight").alias("weight"))


def indexed(t: Tables, found=None):
    """(normalised edges, raw edges, node offsets, node values), all with global node numbers."""
    found = stored(features(t)) if found is None else found
    pairs, var = (stored(part) for part in reduced(t, found))
    offsets = graph.node_offsets(var)
    raw = graph.edge_index(pairs, offsets)
    scaled = graph.edge_index(graph.edge_normalize(pairs), offsets)
    nodes = found.join(var.select("gene_id", "i", "k"), ["gene_id", "i"]).join(offsets, "gene_id").select(
        "cell_id", (F.col("node_st") + F.col("k")).alias("pos"), "value"
    )
    return scaled, raw, nodes


INDEX_SQL = GRAPH_SQL + """,
scaled AS (SELECT cell_id, CAST(node_st + i AS BIGINT) AS "row", CAST(node_st + j AS BIGINT) AS col, weight / sum(weight) OVER (PARTITION BY cell_id, gene_id) AS w, weight AS raw FROM reduced JOIN offsets USING (gene_id))
"""


@query("edge_index", with_sql(BASE, INDEX_SQL + """SELECT cell_id, "row", col, round(w, 6) AS weight FROM scaled"""))
def _edge_index(t: Tables):
    scaled = indexed(t)[0]
    return scaled.select("cell_id", "row", "col", r6("weight").alias("weight"))


@query("label_encode", with_sql("b6", """,
rows AS (SELECT cell_pos, CASE WHEN nation <> 'NATION_3' THEN nation END AS nation FROM b6),
codes AS (SELECT nation, row_number() OVER (ORDER BY nation) - 1 AS code FROM (SELECT DISTINCT nation FROM rows WHERE nation IS NOT NULL))
SELECT cell_pos, rows.nation, coalesce(code, 0) AS code FROM rows LEFT JOIN codes ON rows.nation = codes.nation"""))
def _label_encode(t: Tables):
    rows = t.b6().select("cell_pos", F.when(F.col("nation") != "NATION_3", F.col("nation")).alias("nation"))
    return graph.label_encode(rows, "nation")


def cell_labels(t: Tables, found):
    cells = t.read("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("cell_id"), F.col("c_mktsegment").alias("label"))
    return graph.label_encode(cells.join(found.select("cell_id").distinct(), "cell_id", "left_semi"), "label")


LABEL_SQL = """,
known AS (SELECT 'C' || c_custkey AS cell_id, c_mktsegment AS label FROM customer WHERE 'C' || c_custkey IN (SELECT cell_id FROM feats)),
labels AS (SELECT cell_id, dense_rank() OVER (ORDER BY label) - 1 AS code FROM known)
"""


@query("cell_graphs", with_sql(BASE, INDEX_SQL + LABEL_SQL + """,
nodes AS (SELECT cell_id, node_st + k AS pos, value FROM feats JOIN var USING (gene_id, i) JOIN offsets USING (gene_id)),
xs AS (SELECT cell_id, count(*) AS n_nodes, round(sum(value), 6) AS sum_x, CAST(min(pos) AS BIGINT) AS first_pos FROM nodes GROUP BY cell_id),
es AS (SELECT cell_id, count(*) AS n_edges, round(sum(w), 6) AS sum_weight, CAST(sum(raw) AS DOUBLE) AS sum_raw, min(p)."row" AS first_row, max(p).col AS last_col FROM (SELECT cell_id, {'row': "row", 'col': col} AS p, w, raw FROM scaled) GROUP BY cell_id)
SELECT cell_id, code AS y, n_nodes, sum_x, first_pos, coalesce(n_edges, 0) AS n_edges, sum_weight, sum_raw, first_row, last_col FROM labels LEFT JOIN xs USING (cell_id) LEFT JOIN es USING (cell_id)"""))
def _cell_graphs(t: Tables):
    """Each cell's graph, told by sizes, sums and border members of its arrays."""
    found = stored(features(t))
    scaled, raw, nodes = indexed(t, found)
    graphs = graph.cell_graphs(nodes, scaled, raw, cell_labels(t, found))
    total = lambda c, f: F.aggregate(F.transform(c, lambda s: s.getField(f)), F.lit(0.0), lambda a, v: a + v)
    return graphs.select(
        "cell_id", "y", F.size("x").cast("long").alias("n_nodes"), r6(total("x", "value")).alias("sum_x"),
        F.get("x", F.lit(0)).getField("pos").alias("first_pos"),
        F.coalesce(F.array_size("edges"), F.lit(0)).cast("long").alias("n_edges"), r6(total("edges", "weight")).alias("sum_weight"),
        total("x_adj", "weight").alias("sum_raw"), F.get("edges", F.lit(0)).getField("row").alias("first_row"),
        F.try_element_at("edges", F.lit(-1)).getField("col").alias("last_col"),
    )


@query("cell_graph_members", with_sql(BASE, INDEX_SQL + LABEL_SQL + """,
nodes AS (SELECT cell_id, CAST(node_st + k AS BIGINT) AS pos, round(value, 6) AS value FROM feats JOIN var USING (gene_id, i) JOIN offsets USING (gene_id))
SELECT cell_id, 'x' AS kind, row_number() OVER (PARTITION BY cell_id ORDER BY pos) - 1 AS place, pos AS a, NULL::BIGINT AS b, value AS w FROM nodes SEMI JOIN labels USING (cell_id)
UNION ALL SELECT cell_id, 'edge', row_number() OVER (PARTITION BY cell_id ORDER BY "row", col) - 1, "row", col, round(w, 6) FROM scaled SEMI JOIN labels USING (cell_id)
UNION ALL SELECT cell_id, 'raw', row_number() OVER (PARTITION BY cell_id ORDER BY "row", col) - 1, "row", col, CAST(raw AS DOUBLE) FROM scaled SEMI JOIN labels USING (cell_id)"""))
def _cell_graph_members(t: Tables):
    """The arrays of every cell's graph, member by member and in their order."""
    found = stored(features(t))
    scaled, raw, nodes = indexed(t, found)
    # the three listings read the arrays, which are made once
    graphs = stored(graph.cell_graphs(nodes, scaled, raw, cell_labels(t, found)))

    def members(kind, array, first, second, weight):
        second = F.col(f"m.{second}").cast("long") if second else F.lit(None).cast("long")
        return graphs.select("cell_id", F.posexplode(array).alias("place", "m")).select(
            "cell_id", F.lit(kind).alias("kind"), F.col("place").cast("long").alias("place"), F.col(f"m.{first}").cast("long").alias("a"), second.alias("b"), r6(f"m.{weight}").alias("w")
        )

    return members("x", "x", "pos", None, "value").unionByName(members("edge", "edges", "row", "col", "weight")).unionByName(members("raw", "x_adj", "row", "col", "weight"))


@query("graph_store_write", with_sql(BASE, INDEX_SQL + """SELECT (SELECT count(DISTINCT cell_id) FROM feats) AS n_cells, count(*) AS n_edges FROM scaled"""))
def _graph_store(t: Tables):
    """Write the per-cell edge store, then read its manifest."""
    from introna.session import shared_path

    found = stored(features(t))
    labels = cell_labels(t, found).select("cell_id", F.col("code").alias("label"))
    folder = shared_path(t.spark, "graphs")
    tables.graph_store_write(tables.graph_store(indexed(t, found)[0], labels), folder)
    return tables.graph_store_manifest(t.spark, folder).select("n_cells", "n_edges")


@query("edge_audit", with_sql(BASE, GRAPH_SQL + """,
gaps AS (SELECT cell_id, gene_id, count(*) FILTER (start_slot - floor(start_slot) = 0.5 OR end_slot - floor(end_slot) = 0.5) AS n_gap_ends FROM located GROUP BY ALL),
final AS (SELECT cell_id, gene_id, n, count(*) AS n_edges, count(*) FILTER (j - i > 1) AS n_spanning FROM edges GROUP BY ALL)
SELECT cell_id, gene_id, n, n_edges, n_spanning, coalesce(n_gap_ends, 0) AS n_gap_ends, n_edges < n - 1 AS too_few FROM final LEFT JOIN gaps USING (cell_id, gene_id)"""))
def _edge_audit(t: Tables):
    support = junctions(t).groupBy("cell_id", "gene_id", "start", "end").agg(F.sum("count").alias("count"))
    located = graph.locate_junction_ends(support, graph.gene_exons(t.exons()))
    return graph.edge_audit(located, edges(t))


@query("exon_junction_listing", with_sql("b2f b3 exons", """SELECT cell_id, 'chr' || (gene_number % 5 + 1) AS chrom, gene_id, "start", "end", "count", 'Exon' AS type FROM b2f JOIN exons USING (gene_id, exon_number)
UNION ALL SELECT cell_id, chrom, gene_id, "start", "end", CAST(uniq AS DOUBLE), 'Junction' FROM b3"""))
def _listing(t: Tables):
    number = F.substring("gene_id", 5, 20).cast("long")
    exons = t.b2(fold_exons=True).drop("gene_name").join(t.exons().drop("gene_name"), ["gene_id", "exon_number"]).select(
        "cell_id", F.concat(F.lit("chr"), (number % 5 + 1).cast("string")).alias("chrom"), "gene_id", "start", "end", "count"
    )
    rows = t.b3().select("cell_id", "chrom", "gene_id", "start", "end", F.col("uniq").cast("double").alias("count"))
    return graph.exon_junction_listing(exons, rows)


# Matrix statistics ------------------------------------------------------------------------------

COV_SQL = EXPR_SQL + """,
cov AS (SELECT cell_id, sum("count") AS t, coalesce(sum("count") FILTER (gene_name LIKE 'MT-%'), 0) * 100 / sum("count") AS m FROM b2 GROUP BY cell_id),
shared AS (SELECT count(*) AS n, avg(t) AS mt, avg(m) AS mm, covar_pop(t, t) AS stt, covar_pop(m, m) AS smm, covar_pop(t, m) AS stm FROM cov),
cross_sums AS (SELECT gene_id, sum(value) / any_value(n) AS my, sum(value * (t - mt)) / any_value(n) AS sty, sum(value * (m - mm)) / any_value(n) AS smy
  FROM logged JOIN cov USING (cell_id), shared GROUP BY gene_id),
slopes AS (SELECT gene_id, my, (sty * smm - smy * stm) / (stt * smm - stm * stm) AS b1, (smy * stt - sty * stm) / (stt * smm - stm * stm) AS b2, mt, mm FROM cross_sums, shared),
fit AS (SELECT gene_id, my - b1 * mt - b2 * mm AS b0, b1, b2 FROM slopes)
"""


def regressed(t: Tables):
    x = t.b2().groupBy("cell_id", "gene_id", "gene_name").agg(F.sum("count").alias("value"))
    return ex.regress_out(ex.log1p(normalised(t)), "gene_id", ex.cell_qc(x, "gene_name"), "total_counts", "pct_counts_mt")


@query("regress_out", with_sql("b2", COV_SQL + """SELECT cell_id, gene_id, round(value - (b0 + b1 * t + fit.b2 * m), 6) AS value FROM logged JOIN cov USING (cell_id) JOIN fit USING (gene_id)"""))
def _regress(t: Tables):
    return regressed(t)[0].select("cell_id", "gene_id", r6("value").alias("value"))


@query("regress_fit", with_sql("b2", COV_SQL + "SELECT gene_id, round(b0, 6) AS b0, round(b1 * 1000, 6) AS b1, round(b2, 6) AS b2 FROM fit"))
def _regress_fit(t: Tables):
    return regressed(t)[1].select("gene_id", r6("b0").alias("b0"), r6(F.col("b1") * 1000).alias("b1"), r6("b2").alias("b2"))


SCALE_SQL = EXPR_SQL + """,
sums AS (SELECT gene_id, sum(value) / any_value(n) AS mean, sqrt((sum(value * value) - any_value(n) * (sum(value) / any_value(n)) * (sum(value) / any_value(n))) / (any_value(n) - 1)) AS sd FROM logged, nc GROUP BY gene_id)
"""


@query("scale", with_sql("b2", SCALE_SQL + """SELECT cell_id, gene_id, round(least((value - mean) / sd, 10), 6) AS value FROM logged JOIN sums USING (gene_id)"""))
def _scale(t: Tables):
    scaled = ex.scale(ex.log1p(normalised(t)), "gene_id", ex.n_cells(cells_of(t)))[0]
    return scaled.select("cell_id", "gene_id", r6("value").alias("value"))


@query("scale_features", with_sql("b2", SCALE_SQL + "SELECT gene_id, round(mean, 6) AS mean, round(sd, 6) AS sd, round(least(-mean / sd, 10), 6) AS zero_value FROM sums"))
def _scale_features(t: Tables):
    var = ex.scale(ex.log1p(normalised(t)), "gene_id", ex.n_cells(cells_of(t)))[1]
    return var.select("gene_id", *[r6(c).alias(c) for c in ("mean", "sd", "zero_value")])


# the axes' signs are free, so the check is on what any full set of components keeps
@query("pca", with_sql("b4", """,
long AS (SELECT cell_id, unnest(x_z)::DOUBLE AS x, unnest(range(len(x_z))) AS i FROM b4),
spread AS (SELECT i, var_samp(x) AS v, count(*) AS n FROM long GROUP BY i),
lengths AS (SELECT cell_id, sum((x - m) * (x - m)) AS s FROM long JOIN (SELECT i, avg(x) AS m FROM long GROUP BY i) USING (i) GROUP BY cell_id)
SELECT 'variance' AS name, NULL::BIGINT AS cell_id, round(sum(v), 5) AS value FROM spread
UNION ALL SELECT 'correlation', NULL, 0.0 UNION ALL SELECT 'descending', NULL, 1.0
UNION ALL SELECT 'length', cell_id, round(s, 5) FROM lengths"""))
def _pca(t: Tables):
    """All components: total variance, largest correlation of two scores, order, squared length of every centred row."""
    width = t.b4().select(F.size("x_z")).first()[0]
    scores = stored(ex.principal_components(t.b4(), "x_z", width))
    long = scores.select("cell_id", F.posexplode("pc").alias("i", "s"))
    stats = long.groupBy("i").agg(F.var_samp("s").alias("v"), F.avg("s").alias("m"))
    total = stats.select(F.lit("variance").alias("name"), F.lit(None).cast("long").alias("cell_id"), F.round(F.sum("v").over(Window.partitionBy()), 5).alias("value")).limit(1)
    pairs = [(i, i + 1) for i in range(width - 1)]
    related = scores.agg(*[F.corr(F.col("pc")[i], F.col("pc")[j]).alias(f"c{i}") for i, j in pairs])
    largest = related.select(F.lit("correlation"), F.lit(None).cast("long"), F.round(F.greatest(*[F.abs(f"c{i}") for i, _ in pairs]), 5) + 0.0)
    order = Window.partitionBy(F.lit(0)).orderBy("i")  # one row per component
    falls = stats.withColumn("next", F.lead("v").over(order)).agg(F.bool_and(F.coalesce(F.col("v") >= F.col("next") - 1e-9, F.lit(True))).alias("falls"))
    falls = falls.select(F.lit("descending"), F.lit(None).cast("long"), F.col("falls").cast("double"))
    lengths = long.join(stats, "i").groupBy("cell_id").agg(F.round(F.sum((F.col("s") - F.col("m")) ** 2), 5).alias("value"))
    return total.union(largest).union(falls).union(lengths.select(F.lit("length"), F.col("cell_id").cast("long"), "value"))


def _top_sql(number: int, matrix: str) -> str:
    """Projection on the largest axis of a small matrix by squaring it, its variance, and what is left of the matrix."""
    p = f"p{number}"
    return f"""
{p} AS (SELECT 0 AS step, i, j, v / (SELECT sum(v) FROM {matrix} WHERE i = j) AS v FROM {matrix}
  UNION ALL SELECT a.step + 1, a.i, b.j, sum(a.v * b.v) / (SELECT sum(c.v * c.v) FROM {p} c) FROM {p} a JOIN {p} b ON a.j = b.i WHERE a.step < 16 GROUP BY a.step, a.i, b.j),
axis{number} AS (SELECT i, v / sqrt((SELECT max(v) FROM {p} WHERE step = 16 AND i = j)) AS v FROM {p}
  WHERE step = 16 AND j = (SELECT i FROM {p} WHERE step = 16 AND i = j ORDER BY v DESC, i LIMIT 1)),
size{number} AS (SELECT sum(c.v * a.v * b.v) AS spread_on FROM {matrix} c JOIN axis{number} a ON a.i = c.i JOIN axis{number} b ON b.i = c.j),
rest{number} AS (SELECT c.i, c.j, c.v - spread_on * a.v * b.v AS v FROM {matrix} c JOIN axis{number} a ON a.i = c.i JOIN axis{number} b ON b.i = c.j, size{number})"""


N_COMPONENTS = 3


# each axis is found by repeated squaring, then taken off the matrix: no start, no block, no rounds in common with the operator
@query("pca_sparse", with_sql("b2", f""",
long AS (SELECT cell_id, exon_number || '-' || CAST(substr(gene_id, 5) AS BIGINT) % 3 AS i, sum("count" / (exon_number * exon_number)) AS value FROM b2 GROUP BY ALL),
total AS (SELECT count(DISTINCT cell_id) AS n FROM b2),
means AS (SELECT i, sum(value) / any_value(n) AS m FROM long, total GROUP BY i),
filled AS (SELECT c.cell_id, m.i, coalesce(value, 0) - m AS d FROM (SELECT DISTINCT cell_id FROM b2) c CROSS JOIN means m LEFT JOIN long l ON l.cell_id = c.cell_id AND l.i = m.i),
spread AS (SELECT a.i, b.i AS j, sum(a.d * b.d) / (any_value(n) - 1) AS v FROM filled a JOIN filled b USING (cell_id), total GROUP BY ALL),
{_top_sql(1, "spread")},{_top_sql(2, "rest1")},{_top_sql(3, "rest2")},
axes AS (SELECT 1 AS component, * FROM axis1 UNION ALL SELECT 2, * FROM axis2 UNION ALL SELECT 3, * FROM axis3)
SELECT component, 'variance' AS kind, NULL::VARCHAR AS name, round(spread_on, 5) AS value
FROM (SELECT 1 AS component, * FROM size1 UNION ALL SELECT 2, * FROM size2 UNION ALL SELECT 3, * FROM size3)
UNION ALL SELECT component, 'loading', i, round(abs(v), 5) FROM axes
UNION ALL SELECT component, 'score', cell_id, round(abs(sum(d * v)), 3) FROM filled JOIN axes USING (i) GROUP BY component, cell_id
""").replace("WITH ", "WITH RECURSIVE ", 1))
def _pca_sparse(t: Tables):
    """Variance, loadings and scores (sizes, as signs are free) of the first components of exon counts, weighted by exon, by exon and kind of gene."""
    feature = F.concat(F.col("exon_number").cast("string"), F.lit("-"), (F.substr("gene_id", F.lit(5)).cast("long") % 3).cast("string"))
    b2 = t.b2()
    x = stored(b2.groupBy("cell_id", feature.alias("feature")).agg(F.sum(F.col("count") / (F.col("exon_number") * F.col("exon_number"))).alias("value")), "pca-entries")
    scores, loadings, variances = sparse_principal_components(x, "feature", x.select("cell_id").distinct(), N_COMPONENTS)
    told = t.spark.range(1).select(F.posexplode(F.lit(variances)).alias("i", "v")).select(
        (F.col("i") + 1).alias("component"), F.lit("variance").alias("kind"), F.lit(None).cast("string").alias("name"), F.round("v", 5).alias("value")
    )
    sized = lambda df, name, values, kind, digits: df.select(F.col(name).alias("name"), F.posexplode(values).alias("i", "v")).select(
        (F.col("i") + 1).alias("component"), F.lit(kind).alias("kind"), "name", F.round(F.abs("v"), digits).alias("value")
    )
    return told.unionByName(sized(loadings, "feature", "loading", "loading", 5)).unionByName(sized(scores, "cell_id", "pc", "score", 3))


@query("adjusted_rand", with_sql("b4", """,
tab AS (SELECT label AS a, cell_id % 7 AS b, count(*) AS n FROM b4 GROUP BY ALL),
ra AS (SELECT sum(s * (s - 1) / 2.0) AS v FROM (SELECT sum(n) AS s FROM tab GROUP BY a)),
rb AS (SELECT sum(s * (s - 1) / 2.0) AS v FROM (SELECT sum(n) AS s FROM tab GROUP BY b)),
rt AS (SELECT sum(n * (n - 1) / 2.0) AS same, sum(n) AS total FROM tab)
SELECT round((same - ra.v * rb.v / (total * (total - 1) / 2.0)) / ((ra.v + rb.v) / 2 - ra.v * rb.v / (total * (total - 1) / 2.0)), 6) AS ari FROM ra, rb, rt"""))
def _ari(t: Tables):
    labels = t.b4().select("label", (F.col("cell_id") % 7).alias("other"))
    return ex.adjusted_rand(labels, "label", "other").select(r6("ari").alias("ari"))


@query("nonzero_histogram", with_sql("b2", """,
per AS (SELECT cell_id, count(*) AS v FROM b2 WHERE "count" > 0 GROUP BY cell_id),
span AS (SELECT min(v) AS low, (max(v) - min(v)) / 50 AS width FROM per),
placed AS (SELECT CAST(least(floor((v - low) / width) + 1, 50) AS BIGINT) AS bin, low, width FROM per, span)
SELECT bin, round(any_value(low) + (bin - 1) * any_value(width), 6) AS low, round(any_value(low) + bin * any_value(width), 6) AS high, count(*) AS "count" FROM placed GROUP BY bin"""))
def _histogram(t: Tables):
    per_cell = ex.features_per_cell(t.b2().withColumnRenamed("count", "value"))
    return ex.histogram(per_cell, "n").select("bin", r6("low").alias("low"), r6("high").alias("high"), "count")


@query("highest_expressed", with_sql("b2", """,
tot AS (SELECT cell_id, sum("count") AS total FROM b2 GROUP BY cell_id),
share AS (SELECT gene_id || '-' || exon_number AS feature_id, sum("count" * 100 / total) / (SELECT count(*) FROM tot) AS mean_percent FROM b2 JOIN tot USING (cell_id) GROUP BY ALL)
SELECT feature_id, round(mean_percent, 6) AS mean_percent FROM share ORDER BY share.mean_percent DESC, feature_id LIMIT 20"""))
def _highest(t: Tables):
    x = t.b7().select("cell_id", "feature_id", "value")
    top = ex.highest_expressed(x, "feature_id", ex.n_cells(cells_of(t)))
    return top.select("feature_id", r6("mean_percent").alias("mean_percent"))
