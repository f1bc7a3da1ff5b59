"""Nearest vectors by a block matrix join with int8 tiles.

Vectors are dealt into blocks; every block of queries meets every block of candidates in one tile. In a
tile, int8 products give all inner products with an error bound from the quantisation; only pairs whose
upper bound reaches the k-th best lower bound of their query are recomputed from the original vectors in
double precision. Each query keeps a heap of its k best over the tile; the heaps of its tiles are merged
at the end.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors of different lengths are not compared; rows that share a vec_id are one vector, the smallest by its
components in order, and a query is never its own neighbour; ties go to the smaller vec_id; rows without
vec_id take no part; only vec_id and embedding are read, so further columns and their names do not matter;
an empty table, or one without other vectors, gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 4096  # vectors per block
STEP = 1024  # rows and columns of a product at a time


def usable(embedding: Column) -> Column:
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & (F.size(embedding) > 0) & sound & F.exists(embedding, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, the length of what they stand for and of what they miss."""
    scale = np.abs(x).max(axis=1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    codes = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
    stands = codes * scale[:, None]
    return codes, scale, np.linalg.norm(stands, axis=1), np.linalg.norm(x - stands, axis=1)


def products(codes_a: np.ndarray, codes_b: np.ndarray) -> np.ndarray:
    """Integer inner products of int8 rows, exact."""
    kind = np.float32 if codes_a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return codes_a.astype(kind) @ codes_b.astype(kind).T


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _one_each(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per id, in order of the ids; of several vectors the smallest by its components."""
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    first = np.append(True, np.diff(ids) != 0)[: len(ids)]
    return ids[first], x[first]


def _least_copies(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows without repeated ids; of equal vectors the ``keep`` smallest ids, as no more can be among the nearest."""
    ids, x = _one_each(ids, x)
    _, same = np.unique(np.ascontiguousarray(x).view([("", x.dtype)] * x.shape[1]).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    start = np.flatnonzero(np.append(True, np.diff(same[order]) != 0))
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    rows = order[place < keep]
    return ids[rows], x[rows]


def tile_nearest(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, vec, score) of the k nearest candidates of every query of one tile."""
    query_ids, q = _one_each(query_ids, q)
    q = q.astype(np.float64)
    ids, c = _least_copies(ids, c, k + 1)
    c = c.astype(np.float64)
    q_codes, q_scale, q_stands, q_misses = quantised(q)
    c_codes, c_scale, _, c_misses = quantised(c)
    c_length = np.linalg.norm(c, axis=1)
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    for a in range(0, len(query_ids), STEP):
        rows = slice(a, a + STEP)
        floor = np.full(len(query_ids[rows]), -np.inf)  # no candidate below can be among the k nearest
        for b in range(0, len(ids), STEP):
            cols = slice(b, b + STEP)
            about = products(q_codes[rows], c_codes[cols]) * np.outer(q_scale[rows], c_scale[cols])
            # |<q,c> - about| <= |missed of q| |c| + |kept of q| |missed of c|, and rounding
            off = np.outer(q_misses[rows] + 1e-12 * q_stands[rows], c_length[cols]) * (1 + 1e-9) + np.outer(q_stands[rows], c_misses[cols]) * (1 + 1e-9)
            about[query_ids[rows, None] == ids[None, cols]] = -np.inf
            lower = about - off
            if lower.shape[1] > k:
                floor = np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k])
            i, j = np.nonzero((about + off >= floor[:, None]) & np.isfinite(about))
            scores = exact(q[rows][i], c[cols][j])
            for row, vec, score in zip(i.tolist(), ids[cols][j].tolist(), scores.tolist()):
                heap = heaps[a + row]
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
            floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps[a : a + STEP]])
    return [(query, -vec, score) for query, heap in zip(query_ids.tolist(), heaps) for score, vec in heap]


def _tiles(batches):
    """(query ids, queries, candidate ids, candidates) of each tile; rows come sorted by tile."""
    held, tile = [], None

    def done():
        whole = pa.Table.from_batches(held)
        ids, side = np.asarray(whole["vec_id"]), np.asarray(whole["side"])
        flat = np.asarray(pa.chunked_array(whole["embedding"].chunks).combine_chunks().flatten())
        x = flat.reshape(len(ids), -1)
        return ids[side == 0], x[side == 0], ids[side == 1], x[side == 1]

    for batch in batches:
        keys = np.asarray(batch.column("tile"))
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and keys[a] != tile:
                yield done()
                held = []
            tile = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield done()


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query with all other rows."""
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks")).where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    )
    counts = sound.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    n_blocks, n_query_blocks = max(1, -(-counts[0] // CANDIDATE_BLOCK)), max(1, -(-counts[1] // QUERY_BLOCK))
    place = F.xxhash64("vec_id")
    block, query_block = F.pmod(place, F.lit(n_blocks)), F.pmod(place, F.lit(n_query_blocks))
    every, every_query = (F.sequence(F.lit(0), F.lit(n - 1)) for n in (n_blocks, n_query_blocks))
    candidates = sound.select("vec_id", "embedding", F.lit(1).alias("side"), block.alias("b"), F.explode(every_query).alias("a"))
    queries = sound.where("asks").select("vec_id", "embedding", F.lit(0).alias("side"), query_block.alias("a"), F.explode(every).alias("b"))
    rows = candidates.unionByName(queries).select(
        F.xxhash64("a", "b", F.size("embedding")).alias("tile"), "side", "vec_id", "embedding"
    )

    def run(batches):
        for tile in _tiles(batches):
            if len(tile[0]) and len(tile[2]):
                found = tile_nearest(*tile, k)
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64()),
                ], ["query_id", "vec_id", "score"])

    found = rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
