"""Edge cases of annotation, expression, imputation and worker set-up."""

import os
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from introna.operators import expression, markers, psi
from introna.sources import tables, text

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_get_the_package():
    """Started from another folder, with the package on the driver's path only."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from introna.session import local_session
from introna.operators.neighbors import nearest_neighbours
spark = local_session("elsewhere", "2", "1g")
df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "cell_id long, x_z array<double>")
print("rows", nearest_neighbours(df, 3).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as folder:
        done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 60" in done.stdout, done.stderr[-2000:]


def test_constant_means_and_single_cells(spark):
    one = spark.createDataFrame([(0, "g", 2.0), (1, "g", 2.0)], "cell_id long, gene_id string, value double")
    assert expression.dispersion(one, "gene_id", F.lit(2)).count() == 1
    equal = spark.createDataFrame([(i, g, 1.0) for i in range(3) for g in "ab"], "cell_id long, gene_id string, value double")
    assert {r.bin for r in expression.dispersion(equal, "gene_id", F.lit(3)).collect()} == {1}
    cell = one.filter("cell_id = 0")
    z, var = expression.scale(cell, "gene_id", F.lit(1))
    assert z.first().value == 0.0 and var.first().sd == 1.0
    assert expression.highly_variable(cell, "gene_id", F.lit(1), 1).count() <= 1


def test_first_of_repeated_attributes(spark):
    line = spark.createDataFrame([('gene_id "g"; tag "basic"; tag "CCDS"; note "x"',)], "attribute string")
    assert line.select(text.attribute("tag"), text.attribute("gene_id"), text.attribute("none")).first()[:] == ("basic", "g", None)


@pytest.mark.parametrize("name, cell", [
    ("a/b/x.y:c1", "c1"), ("a/c2.Aligned.sortedByCoord.out.bam", "c2"), ("c3.bam", "c3"), ("d/c4.counts.txt", "c4"), ("c5", "c5"),
])
def test_one_rule_for_cell_ids(spark, name, cell):
    assert tables.cell_id_from_name(name) == cell
    assert spark.range(1).select(tables.cell_id_from_column(F.lit(name))).first()[0] == cell


def test_shards_must_agree(spark, tmp_path):
    obs = spark.createDataFrame([("c",)], "cell_id string")
    x = spark.createDataFrame([("c", "f", 1.0)], "cell_id string, feature_id string, value double")
    for name, features in (("a", "fg"), ("b", "gf"), ("c", "fh")):
        tables.matrix_write(f"{tmp_path}/{name}", obs, spark.createDataFrame([(f,) for f in features], "feature_id string"), x)
    assert tables.matrix_read(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])[2].count() == 2
    with pytest.raises(ValueError, match="other features"):
        tables.matrix_read(spark, [f"{tmp_path}/a", f"{tmp_path}/c"])


def test_fill_of_cells_without_rows(spark):
    rows = spark.createDataFrame([(1, "e", 0.2), (2, "e", 0.4), (1, "f", None), (4, "e", 1.0)], "cell_id long, event_id string, psi double")
    clusters = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "cell_id long, cluster string")
    got = {(r.event_id, r.cluster): (r.fill, r.missing) for r in psi.psi_cluster_fill(rows, clusters, 1).collect()}
    assert got == {("e", "a"): (0.3, 1)}


def test_compare_by_pair(spark):
    a = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "y")], "pair string, gene string")
    b = spark.createDataFrame([("p", "y"), ("q", "z")], "pair string, gene string")
    got = {tuple(r) for r in markers.compare_de(a, b, ["pair"]).collect()}
    assert got == {("p", "x", "first"), ("p", "y", "both"), ("q", "y", "first"), ("q", "z", "second")}


def test_export_by_cell_splits_large_cells(spark, tmp_path):
    from introna.operators.counts import export_by_cell

    rows = spark.createDataFrame([("big", i) for i in range(90)] + [("small", 1)], "cell_id string, count long")
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows are put together again
    spark.conf.set(key, "false")
    try:
        export_by_cell(rows, f"{tmp_path}/cells", rows_per_file=20)
    finally:
        spark.conf.set(key, "true")
    files = {d: len([f for f in os.listdir(f"{tmp_path}/cells/{d}") if f.endswith(".parquet")]) for d in os.listdir(f"{tmp_path}/cells") if d.startswith("cell_id")}
    assert 1 < files["cell_id=big"] <= 5 and files["cell_id=small"] == 1
    assert spark.read.parquet(f"{tmp_path}/cells").count() == 91
