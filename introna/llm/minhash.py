"""Near-duplicate detection with MinHash.

1. One pass over the texts gives every document its number of shingles, a 128-bit key of its whole
   shingle set, and the minima of many universal hash functions, cut into bands.
2. Documents of one set are one class; from here on only the smallest doc_id of a class takes part.
3. Classes that share a band meet in a bucket. Each is first held against the smallest of its bucket,
   by signature, then by full sets; confirmed links give components.
4. In buckets that still hold several components, pairs of different components are compared by
   signature; those that look alike are confirmed on full sets, family by family. Both work in blocks,
   so that neither a bucket nor a family has to fit into one task, and each block hands on a spanning
   forest, never all its pairs. No pair of a bucket is left out unless its two classes are already in
   one component.
5. Large-star and small-star give the final components.

With 40 bands of 7 minima a pair of similarity 0.8 meets in no bucket with probability 8e-5, one of 0.9
with 1e-11. Hashes of shingles have 64 bits.

Blocks are cut by rows and by bytes of what they hold, down to one document against one.

Defined results: a null, empty or wordless text has an empty set and is linked with nothing; a row
without doc_id is linked with nothing and kept; rows that share a doc_id stand each for their own text:
the class of a text has the smallest doc_id that any row with it has; repeated texts are one class; texts
of any length count whole; only doc_id and text are read, and other columns, whatever their names, pass
through `drop_near_duplicates`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from introna.llm.common import stored
from introna.llm.components import components
from introna.llm.shingles import mixed, shingle_sets

BANDS, ROWS = 40, 7
SEED = 17
BLOCK = 256  # classes per side of a block comparison
BLOCK_BYTES = 1 << 24  # and bytes of their full sets, unless a single set is larger
SIGNATURE_SLACK = 12  # percentage points below the threshold that a signature may show
BROADCAST_IDS = 500_000  # so many ids (8 bytes each) may be broadcast


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the functions a * x + b (mod 2^32) over a set."""
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        value = x[at : at + 1024, None] * a
        value += b
        np.minimum(least, value.min(axis=0), out=least)
    return least


SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType()),
])


def sign(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key, bands (one 64-bit key each) and signature (16 bits of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _functions()
        number = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            sizes, keys, bands, signatures = [], [], [], []
            for hashes in shingle_sets(batch.column("text"), width):
                sizes.append(len(hashes))
                if not len(hashes):
                    keys.append(None), bands.append(None), signatures.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                least = signature(hashes, a, b)
                rows = least.reshape(BANDS, ROWS).astype(np.uint64)
                key = number.copy()
                for i in range(ROWS):
                    key = mixed(key ^ rows[:, i]) + number
                bands.append(key.view(np.int64))
                signatures.append((least >> np.uint32(16)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary()),
            ], [f.name for f in SIGNED.fields])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set_key, size (bytes) and the whole set as packed sorted 64-bit hashes."""

    def run(batches):
        for batch in batches:
            packed = [h.tobytes() for h in shingle_sets(batch.column("text"), width)]
            keys = [xxhash.xxh3_128_digest(p) if p else None for p in packed]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array([len(p) for p in packed], pa.int64()), pa.array(packed, pa.binary()),
            ], ["doc_id", "set_key", "size", "load"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_key binary, size long, load binary")


def _blocks(rows: Column, size: Column) -> Column:
    """Blocks for so many rows that hold so many bytes."""
    return F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")


def _signature_matches(percent: int):
    """Which pairs of two lists of signatures may reach the threshold."""

    def match(left: list[bytes], right: list[bytes]) -> np.ndarray:
        a = np.frombuffer(b"".join(left), "<u2").reshape(len(left), -1)
        b = np.frombuffer(b"".join(right), "<u2").reshape(len(right), -1)
        least = (percent - SIGNATURE_SLACK) / 100 * a.shape[1]
        return np.stack([(b == row).sum(axis=1) >= least for row in a])

    return match


def _set_matches(percent: int):
    """Which pairs of two lists of full sets reach the threshold: 100 * intersection >= percent * union."""

    def match(left: list[bytes], right: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint64) for x in (*left, *right)]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[code] > 1
        owner, code = owner[shared], np.cumsum(times > 1)[code[shared]] - 1
        n, m = len(left), len(right)
        both = np.zeros((n, m), np.int64)
        by = np.argsort(code, kind="stable")
        owner, code = owner[by], code[by]
        step = 4096
        top = int(code[-1]) + 1 if len(code) else 0
        for start in range(0, top, step):
            a, b = np.searchsorted(code, [start, start + step])
            dense = np.zeros((n + m, step), np.float32)
            dense[owner[a:b], code[a:b] - start] = 1
            both += (dense[:n] @ dense[n:].T).astype(np.int64)
        union = sizes[:n, None] + sizes[None, n:] - both
        return 100 * both >= percent * union

    return match


def _forest(left, right, comp_left, comp_right, found: np.ndarray) -> list[tuple[int, int]]:
    """Links between different components that are enough to join whatever the matches join."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    kept = []
    for i, j in zip(*np.nonzero(found)):
        if left[i] == right[j]:
            continue
        a, b = top(comp_left[i]), top(comp_right[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((left[i], right[j]))
    return kept


def _all_ends(left, right, comp_left, comp_right, found: np.ndarray) -> list[tuple[int, int]]:
    """Like `_forest` over the nodes themselves: every node of a match between components has a link."""
    found = found & (np.asarray(comp_left)[:, None] != np.asarray(comp_right)[None, :])
    return _forest(left, right, left, right, found)


def compare_blocks(tiles: DataFrame, match, links) -> DataFrame:
    """``u, v`` of the pairs that ``links`` keeps, tile by tile.

    tiles: (tile, side, node, comp, load); side 0 is held against side 1. Rows are dealt by tile and
    sorted, so a task reads one tile after another and holds no more than one.
    """

    def run(batches):
        tile, rows = None, ([], [])

        def done():
            (a, b) = rows
            if a and b:
                return links([x[0] for x in a], [x[0] for x in b], [x[1] for x in a], [x[1] for x in b], match([x[2] for x in a], [x[2] for x in b]))
            return []

        out: list[tuple[int, int]] = []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("tile", "side", "node", "comp", "load")]
            for t, side, node, comp, load in zip(*columns):
                if t != tile:
                    out += done()
                    tile, rows = t, ([], [])
                rows[side].append((node, comp, load))
            if len(out) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])
                out = []
        out += done()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])

    dealt = tiles.repartition("tile").sortWithinPartitions("tile", "side", "node")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def tiles_of(members: DataFrame, loads: DataFrame) -> DataFrame:
    """Blocks of each group in which all pairs of different components meet.

    members: (group, node, comp). The largest component of a group need not be held against itself: side 0
    has the blocks of all other members, side 1 those of all members; of two blocks of others, one order is
    enough, and the forests of both orders agree.
    """
    sized = members.join(loads.select("node", "size"), "node")
    sizes = sized.groupBy("group", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    groups = sizes.groupBy("group").agg(F.sum("n").alias("all"), F.sum("size").alias("bytes"), F.max(F.struct("n", "comp", "size")).alias("main"))
    groups = groups.where("all > main.n").select(
        "group", F.col("main.comp").alias("main"), _blocks(F.col("all"), F.col("bytes")).alias("blocks"),
        _blocks(F.col("all") - F.col("main.n"), F.col("bytes") - F.col("main.size")).alias("others"),
    )
    placed = members.join(groups, "group").withColumn("place", F.xxhash64("node"))
    block = F.pmod("place", F.col("blocks")).cast("int")
    other = F.pmod("place", F.col("others")).cast("int")
    sides = placed.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).where("side = 1 or comp <> main")
    against = F.when(F.col("side") == 0, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(other.alias("a"), i.alias("b"))))
    against = against.otherwise(F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.struct(i.alias("a"), block.alias("b"))))
    tiles = sides.select("group", "node", "comp", "side", F.explode(against).alias("t")).select(
        F.xxhash64("group", "t.a", "t.b").alias("tile"), "side", "node", "comp"
    )
    return tiles.join(loads.select("node", "load"), "node")


def star_tiles(pairs: DataFrame, loads: DataFrame) -> DataFrame:
    """Blocks of (leader, member) pairs: the leader on side 0 of each of its blocks, members on side 1."""
    sized = pairs.join(loads.select("node", "size"), "node")
    blocks = sized.groupBy("leader").agg(_blocks(F.count("*"), F.sum("size")).alias("blocks"))
    members = pairs.join(blocks, "leader").select(
        F.xxhash64("leader", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).alias("tile"), F.lit(1).alias("side"), "node"
    )
    leaders = blocks.select(
        F.col("leader").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")
    ).select(F.xxhash64("node", "i").alias("tile"), F.lit(0).alias("side"), "node")
    return leaders.union(members).withColumn("comp", F.col("node")).join(loads.select("node", "load"), "node").select("tile", "side", "node", "comp", "load")


def only(rows: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows whose ``column`` is (not) among the ids; few ids (counted) are broadcast, more are shuffled."""
    ids = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, column, how)


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, set_key."""
    signed = stored(sign(docs, width), "signed")
    firsts = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("first"))
    firsts = stored(firsts, "set-firsts")
    # a class is named by its smallest doc_id, or, where several sets have the same, by a number of its own below all ids in use
    shared = firsts.groupBy("first").count().where("count > 1").select("first", F.lit(True).alias("shared"))
    own = F.xxhash64("set_key").bitwiseOR(F.lit(-(1 << 63)))
    sets = firsts.join(shared, "first", "left").select("set_key", "first", F.when(F.col("shared"), own).otherwise(F.col("first")).alias("node"))
    sets = stored(sets, "sets")
    known = signed.withColumnRenamed("doc_id", "first").join(sets, ["first", "set_key"]).dropDuplicates(["node"])
    slim = known.select("node", "n_shingles", "bands", F.col("signature").alias("load"), F.lit(2 * BANDS * ROWS).cast("long").alias("size"))
    slim = stored(slim, "classes")

    keyed = slim.select("node", "n_shingles", F.explode("bands").alias("group"))
    shared = keyed.groupBy("group").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stored(keyed.join(shared, "group"), "buckets")

    # every class against the smallest of each of its buckets
    other = slim.select(F.col("node").alias("leader"), F.col("n_shingles").alias("size"), F.col("load").alias("lead"))
    pairs = members.where("node <> leader").select("leader", "node", "n_shingles").distinct().join(other, "leader")
    pairs = pairs.where(100 * F.least("size", "n_shingles") >= percent * F.greatest("size", "n_shingles"))
    pairs = pairs.join(slim.select("node", "load"), "node").select("leader", "node", "lead", "load")
    pairs = stored(_look_alike(pairs, percent), "star-pairs")
    wanted = stored(only(sets, members.select("node"), "node").select("first", "set_key", "node"), "wanted-sets")
    texts = only(docs.where("doc_id is not null"), wanted.select("first"), "doc_id")
    loads = full_sets(texts, width).withColumnRenamed("doc_id", "first").join(wanted, ["first", "set_key"]).select("node", "size", "load")
    loads = stored(loads.dropDuplicates(["node"]), "full-sets")
    first = stored(compare_blocks(star_tiles(pairs, loads), _set_matches(percent), _forest), "links")
    labels = stored(components(first), "labels")

    # pairs of different components that share a bucket
    labelled = members.select("group", "node").join(labels, "node", "left").select("group", "node", F.coalesce("component", "node").alias("comp"))
    mixed_groups = labelled.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("group")
    live = stored(labelled.join(mixed_groups, "group", "left_semi"), "live-buckets")
    alike = stored(compare_blocks(tiles_of(live, slim.select("node", "size", "load")), _signature_matches(percent), _all_ends), "alike")
    families = components(alike)
    members = families.withColumnRenamed("component", "group").join(labels, "node", "left").select("group", "node", F.coalesce("component", "node").alias("comp"))
    second = compare_blocks(tiles_of(stored(members, "families"), loads), _set_matches(percent), _forest)
    stars = labels.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    final = components(stars.union(second)).withColumnRenamed("node", "class_id")

    named = sets.withColumnRenamed("node", "class_id").join(final, "class_id", "left").select("set_key", "first", F.coalesce("component", "class_id").alias("component"))
    # components named by a number of their own get the smallest doc_id in them
    numbers = sets.where("node <> first").select(F.col("node").alias("component"))
    least = named.join(numbers, "component", "left_semi").groupBy("component").agg(F.min("first").alias("least"))
    named = named.join(least, "component", "left").select("set_key", F.coalesce("least", "component").alias("component_id"))
    joined = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), "set_key").select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "set_key"
    )


def _look_alike(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures may reach the threshold."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), "<u2").reshape(batch.num_rows, -1) for n in ("lead", "load"))
            keep = (a == b).mean(axis=1) >= (percent - SIGNATURE_SLACK) / 100
            yield batch.select(["leader", "node"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "leader long, node long")


def with_set_key(rows: DataFrame, width: int) -> DataFrame:
    """(row, text, set_key) of (row, text)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("set_key", T.BinaryType())])

    def run(batches):
        for batch in batches:
            keys = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "set_key"])

    return rows.mapInArrow(run, schema)


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays; columns as given.

    A row goes only if a near-copy of its own text stays. Of rows with one doc_id and one set of shingles
    the one with the smallest text stays; those without words stay all.
    """
    found = stored(classes(docs, width, percent), "near-duplicates")
    repeated = stored(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    gone = found.where("not kept").select("doc_id")
    single = only(only(docs, repeated, "doc_id", "left_anti"), gone, "doc_id", "left_anti").select(*docs.columns)
    # rows of a repeated doc_id are told apart by their sets
    several = only(docs, repeated, "doc_id").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    keyed = with_set_key(several, width)
    kept = found.where("kept and set_key is not null").select(F.col("doc_id").alias("id"), F.col("set_key").alias("key")).distinct()
    sure = keyed.join(kept, (F.col("row.doc_id") == F.col("id")) & (F.col("set_key") == F.col("key")))
    one_each = sure.groupBy("id", "key").agg(F.min_by("row", "text").alias("row")).select("row.*")
    return single.unionByName(one_each).unionByName(keyed.where("set_key is null").select("row.*"))
