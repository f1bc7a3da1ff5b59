"""Principal components of a long sparse matrix by randomised block power iteration.

Entries are ``(cell_id, feature, value)``; absent ones are zeros. The matrix is neither filled nor
centred: a product with the centred matrix is the product with the stored entries minus one shift per
column. A block of ``k + EXTRA`` columns is kept as one array per feature and joined, so nothing that
grows with cells or features reaches the driver; what does is the block's Gram matrix, added up per task
and then over tasks, from which the block is made orthonormal and rotated to its Ritz vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from introna.session import stored

EXTRA = 8  # columns of the block beyond those asked for
ROUNDS = 60
RESIDUAL = 1e-7  # of the largest eigenvalue (rounding hides less); the round after it is reached is the last


def _start(feature: Column, width: int) -> Column:
    """Seeded values in (-1, 1)."""
    return F.array(*(F.pmod(F.xxhash64(feature, F.lit(i)), F.lit(1 << 40)) / float(1 << 39) - 1.0 for i in range(width)))


def _sums(value: Column, array: str, width: int) -> Column:
    return F.array(*(F.sum(value * F.get(array, F.lit(i))) for i in range(width)))


def _block(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """Products of all columns of (mean, w, z), added up over the features."""
    size = 2 * width + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            m = np.hstack([np.asarray(batch.column("mean"), dtype=np.float64)[:, None], _block(batch.column("w"), width), _block(batch.column("z"), width)])
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["g"])

    parts = rows.select("mean", "w", "z").mapInArrow(part, "g array<double>").select(F.posexplode("g").alias("i", "g"))
    total = np.zeros(size * size)
    for row in parts.groupBy("i").agg(F.sum("g").alias("g")).collect():  # (2 l + 1) squared numbers
        total[row["i"]] = row["g"]
    return total.reshape(size, size)


def _turned(rows: DataFrame, feature: str, turn: np.ndarray) -> DataFrame:
    """(feature, mean, w): the block ``z`` times a small matrix."""
    width, kind = turn.shape[0], rows.schema[feature].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _block(batch.column("z"), width) @ turn
            offsets = pa.array(np.arange(len(w) + 1) * turn.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], ["feature", "mean", "w"])

    made = rows.select(feature, "mean", "z").mapInArrow(run, f"feature {kind}, mean double, w array<double>")
    return made.withColumnRenamed("feature", feature)


def _scores(x: DataFrame, cells: DataFrame, block: DataFrame, feature: str, shift: np.ndarray) -> DataFrame:
    """(cell_id, y): rows of the centred matrix times the block, for every cell."""
    width = len(shift)
    sums = x.join(block.select(feature, "w"), feature).groupBy("cell_id").agg(_sums(F.col("value"), "w", width).alias("y"))
    moved = F.array(*(F.coalesce(F.get("y", F.lit(i)), F.lit(0.0)) - float(shift[i]) for i in range(width)))
    return cells.select("cell_id").join(sums, "cell_id", "left").select("cell_id", moved.alias("y"))


def sparse_principal_components(
    x: DataFrame, feature: str, cells: DataFrame, k: int, rounds: int = ROUNDS, extra: int = EXTRA
) -> tuple[DataFrame, DataFrame, list[float]]:
    """((cell_id, pc), (feature, loading), variances) of the first ``k`` components, largest first.

    ``cells`` lists every cell once, also those without entries; ``x`` has at most one entry per cell and
    feature. Of each component the loading that is largest in size is positive. Where fewer than ``k``
    components vary there are as many; fewer than two cells or no entries give none.
    """
    n = cells.count()
    means = stored(x.groupBy(feature).agg((F.sum("value") / F.lit(float(max(n, 1)))).alias("mean")), "pca-means")
    width = min(k + extra, means.count())
    if n < 2 or width == 0:
        return cells.select("cell_id", F.array().cast("array<double>").alias("pc")), means.select(feature, F.array().cast("array<double>").alias("loading")), []
    block = stored(means.withColumn("w", _start(F.col(feature), width)), "pca-start")
    first = block.agg(_sums(F.col("mean"), "w", width).alias("s")).first()["s"]
    shift, last = np.array(first, dtype=np.float64), False
    for number in range(rounds):
        y = _scores(x, cells, block, feature, shift)
        z = x.join(y, "cell_id").groupBy(feature).agg(_sums(F.col("value"), "y", width).alias("z"))
        rows = stored(block.join(z, feature), "pca-block")
        gram = _gram(rows, width)
        ww, wz, zz = gram[1 : width + 1, 1 : width + 1], gram[1 : width + 1, width + 1 :], gram[width + 1 :, width + 1 :]
        if number == 0:  # the start is not orthonormal; its products span the same space
            values, turn = np.ones(width), np.eye(width)
        else:
            values, turn = np.linalg.eigh((wz + wz.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            off = np.diag(turn.T @ zz @ turn) - 2 * values * np.diag(turn.T @ wz @ turn) + values**2 * np.diag(turn.T @ ww @ turn)
            near = np.sqrt(np.maximum(off[:k], 0.0)).max() <= RESIDUAL * max(values[0], 1e-300)
        # symmetric orthonormalisation leaves columns that are orthogonal already as they are
        own = turn.T @ zz @ turn
        size = np.sqrt(np.maximum(np.diag(own), 0.0))
        keep = size > 1e-12 * max(size.max(), 1e-300)
        turn, size = turn[:, keep] / size[keep], size[keep]
        spread, axes = np.linalg.eigh(turn.T @ zz @ turn)
        if number == 0:
            good = spread > 1e-13 * spread.max()
            turn = turn @ (axes[:, good] / np.sqrt(spread[good]))
        else:
            turn = turn @ (axes / np.sqrt(np.maximum(spread, 1e-300))) @ axes.T
        values = values[: turn.shape[1]]
        block, shift, width = _turned(rows, feature, turn), gram[0, width + 1 :] @ turn, turn.shape[1]
        if last or width == 0:
            break
        last = number > 0 and near
    k = min(k, width)
    loadings = stored(block, "pca-loadings")
    signs = loadings.agg(F.array(*(F.max(F.struct(F.abs(F.get("w", F.lit(i))).alias("a"), F.col(feature).alias("f"), F.get("w", F.lit(i)).alias("w"))) for i in range(k))).alias("s")) if k else None
    sign = [-1.0 if s["w"] < 0 else 1.0 for s in signs.first()["s"]] if k else []
    turned = lambda c: F.array(*(F.get(c, F.lit(i)) * sign[i] for i in range(k))) if k else F.array().cast("array<double>")
    scores = _scores(x, cells, loadings, feature, shift).select("cell_id", turned("y").alias("pc"))
    return scores, loadings.select(feature, turned("w").alias("loading")), [float(max(v, 0.0)) / (n - 1) for v in values[:k]]
