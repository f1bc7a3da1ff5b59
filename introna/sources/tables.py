"""Count tables, metadata, cell lists and the Parquet stores."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from introna.functions.checks import require_empty, require_rows

# Leading annotation columns of the count tables.
COUNT_ANNOTATION = ["Geneid", "Chr", "Start", "End", "Strand", "Length"]
JUNCTION_ANNOTATION = [
    "Gene_SP1", "Gene_SP2", "Transcript", "Status", "Donor", "Acceptor", "Chr_SP1", "Location_SP1", "Strand_SP1",
    "Chr_SP2", "Location_SP2", "Strand_SP2", "NearestExonBoundary_SP1", "NearestExonBoundary_SP2",
]
# Of the last path part: what follows the last colon, or precedes an alignment suffix, or the first dot.
CELL_ID = r"^(?:.*/)?(?:[^/]*:([^/:]*)|([^/:]*?)(?:\.Aligned\.sortedByCoord\.out)?\.bam|([^/:.]*)[^/:]*)$"


def cell_id_from_name(name: str) -> str:
    """Cell id of one column header."""
    return re.sub(CELL_ID, r"\1\2\3", name, count=1)


def count_columns(names: Sequence[str], cells: Sequence[str] | None = None) -> dict[str, int]:
    """Place of every wanted cell among the count columns of a header."""
    places: dict[str, int] = {}
    for place, name in enumerate(names):
        cell = cell_id_from_name(name)
        if cell in places:
            raise ValueError(f"cell {cell!r} is a duplicate: columns {names[places[cell]]} and {name} both name it")
        places[cell] = place
    missing = [c for c in cells or () if c not in places]
    if missing:
        raise ValueError(f"cells without a count column: {missing[:5]}")
    return places if cells is None else {c: places[c] for c in cells}


def _long_counts(rows: DataFrame, annotation: Sequence[str], values: str, places: dict[str, int]) -> DataFrame:
    """Positive counts of the wanted places of an array of texts, named by cell."""
    number = lambda i: F.struct(i.alias("place"), F.get(values, i).try_cast("double").alias("count"))
    held = F.filter(F.transform(F.lit(sorted(places.values())), number), lambda e: e["count"] > 0)
    long = rows.select(*[F.col(f"`{a}`") for a in annotation], F.inline(held))
    # one row per column of the header line
    named = rows.sparkSession.createDataFrame([(p, c) for c, p in places.items()] or [(None, None)], "place int, cell_id string")
    return long.join(F.broadcast(named), "place").select(*[F.col(f"`{a}`") for a in annotation], "cell_id", "count")


def grouped_counts(wide: DataFrame, annotation: Sequence[str], cells: Sequence[str] | None = None) -> DataFrame:
    """Wide count table to long (annotation, cell_id, count); only positive counts stay.

    Column names are the schema, so the cell ids are derived on the driver; the columns of other cells
    are cut and never read from a columnar source.
    """
    names = wide.columns[len(annotation):]
    places = count_columns(names, cells)
    held = F.array(*[F.col(f"`{names[p]}`").cast("string") for p in sorted(places.values())])
    packed = wide.select(*[F.col(f"`{a}`") for a in annotation], held.alias("_values"))
    order = {p: i for i, p in enumerate(sorted(places.values()))}
    return _long_counts(packed, annotation, "_values", {c: order[p] for c, p in places.items()})


def grouped_counts_scan(
    spark: SparkSession, path: str, annotation: Sequence[str] = COUNT_ANNOTATION, cells: Sequence[str] | None = None
) -> DataFrame:
    """Read a wide tab-separated count file (comment lines allowed) as a long table.

    A line is split once and walked by position, so the plan has the same few operators for any number of
    cells. The files of a folder share one header line.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    head = lines.first()
    header = head[0].split("\t") if head is not None else []
    if header[: len(annotation)] != list(annotation):
        raise ValueError(f"no header with the columns {', '.join(annotation)}: {path}")
    places = count_columns(header[len(annotation):], cells)
    fields = F.split("value", "\t", -1)
    split = lines.filter(F.col("value") != head[0]).select(fields.alias("_f"))
    n = len(annotation)
    rows = split.select(*[F.get("_f", F.lit(i)).alias(a) for i, a in enumerate(annotation)], F.slice("_f", n + 1, F.greatest(F.size("_f") - n, F.lit(0))).alias("_values"))
    return _long_counts(rows, annotation, "_values", places)


def per_cell_counts_scan(
    spark: SparkSession, paths: Sequence[str], annotation: Sequence[str] = COUNT_ANNOTATION, cell: Column | None = None
) -> DataFrame:
    """One count file (or folder) per cell to one long table; the file name gives the cell id, or ``cell`` over ``path``."""
    names = [*annotation, "count"]
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.schema(schema).csv(list(paths), sep="\t", comment="#", header=True, quote="", enforceSchema=True)
    rows = rows.select("*", F.col("_metadata.file_path").alias("path"))
    named = F.substring_index(F.element_at(F.split("path", "/"), -1), ".", 1) if cell is None else cell
    counted = rows.select(
        *[F.col(f"`{a}`") for a in annotation], named.alias("cell_id"),
        F.coalesce(F.col("count").try_cast("double"), F.lit(0.0)).alias("count"),
    )
    return counted.filter(F.col("count") > 0)


def cell_id_from_column(name: Column) -> Column:
    return F.regexp_replace(name, CELL_ID, "$1$2$3")


def clean_metadata(rows: DataFrame) -> DataFrame:
    """Require a trimmed, non-empty ``CB``."""
    if "CB" not in rows.columns:
        raise ValueError("metadata needs a CB column")
    trimmed = rows.withColumn("CB", F.trim("CB"))
    return require_empty(trimmed, trimmed.filter("CB IS NULL OR CB = ''"), "metadata has an empty CB value")


def metadata_scan(spark: SparkSession, path: str) -> DataFrame:
    """Metadata file, tab or comma separated by what its header line shows."""
    head = spark.read.text(path).first()
    if head is None or not head[0].strip():
        raise ValueError(f"metadata file is empty: {path}")
    separator = "\t" if "\t" in head[0] else ","
    return clean_metadata(spark.read.csv(path, sep=separator, header=True, inferSchema=True))


def cell_list(lines: DataFrame) -> DataFrame:
    """First tab field of each line; blanks skipped; an empty list is an error."""
    cells = lines.select(F.trim(F.split("value", "\t").getItem(0)).alias("cell_id")).filter("cell_id <> ''")
    return require_rows(cells, cells, "the cell list is empty")


def cell_manifest(cells: DataFrame, order: Sequence[str]) -> DataFrame:
    """Trimmed, non-blank, distinct ids with the place they were first seen at."""
    trimmed = cells.withColumn("cell_id", F.trim("cell_id")).filter("cell_id <> ''")
    return trimmed.groupBy("cell_id").agg(F.min(F.struct(*order)).alias("first_seen"))


def matrix_write(path: str, obs: DataFrame, var: DataFrame, x: DataFrame) -> None:
    """Three Parquet datasets below ``path``."""
    obs.write.mode("overwrite").parquet(f"{path}/obs")
    var.write.mode("overwrite").parquet(f"{path}/var")
    x.write.mode("overwrite").parquet(f"{path}/x")


def matrix_read(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(obs, var, x) of one or more shards: cells stacked; shards of other features are an error."""
    obs = spark.read.parquet(*[f"{p}/obs" for p in paths])
    var = spark.read.parquet(f"{paths[0]}/var")
    for path in paths[1:]:
        other = spark.read.parquet(f"{path}/var").select(*var.columns)
        if not (var.exceptAll(other).isEmpty() and other.exceptAll(var).isEmpty()):
            raise ValueError(f"{path} has other features than {paths[0]}")
    x = spark.read.parquet(*[f"{p}/x" for p in paths])
    return obs, var, x


def graph_store(edges: DataFrame, obs: DataFrame) -> DataFrame:
    """One row per cell: (cell_id, label, edges), edges sorted by (row, col)."""
    # a cell has at most one edge per pair of exons of a gene, so its array is bounded by the annotation
    held = edges.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "weight"))).alias("edges"))
    none = F.array().cast("array<struct<row:bigint,col:bigint,weight:double>>")
    return obs.select("cell_id", "label").join(held, "cell_id", "left").withColumn("edges", F.coalesce("edges", none))


def graph_manifest(store: DataFrame) -> DataFrame:
    return store.agg(
        F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.sum(F.size("edges")), F.lit(0)).cast("long").alias("n_edges")
    )


def graph_store_write(store: DataFrame, path: str, commit: bool = True) -> str:
    """Write a version of the store below ``path``; its manifest, written last, makes it the present one.

    A version is a folder of its own that no later one touches. Until the manifest names it, readers see
    the version before, whole; so a driver lost on the way leaves no mixture.
    """
    version = uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    store.write.parquet(folder)
    if commit:
        graph_store_commit(store.sparkSession, path, version)
    return version


def graph_store_commit(spark: SparkSession, path: str, version: str) -> None:
    made = graph_manifest(spark.read.parquet(f"{path}/versions/{version}"))
    # appended as one file, which shows only when it is whole; the highest number is the present version
    known = _manifests(spark, path)
    number = 0 if known is None else known.agg(F.max("number")).first()[0] + 1
    made.select(F.lit(number).cast("long").alias("number"), F.lit(version).alias("version"), "n_cells", "n_edges").coalesce(1).write.mode("append").json(f"{path}/manifest")


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("number long, version string, n_cells long, n_edges long").json(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def graph_store_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(version, n_cells, n_edges) of the present version; an error if there is none."""
    known = _manifests(spark, path)
    if known is None:
        raise ValueError(f"no graph store at {path}")
    return known.orderBy(F.col("number").desc(), F.col("version").desc()).limit(1).drop("number")


def graph_store_read(spark: SparkSession, path: str) -> DataFrame:
    """The cells of the present version."""
    version = graph_store_manifest(spark, path).first()["version"]
    return spark.read.parquet(f"{path}/versions/{version}")
