"""Mix sources to target weights by capped water-filling.

Every source gets a share of the mix in proportion to its weight; a source whose share exceeds
``max_epochs`` times its size is clamped there, and the excess goes to the others in proportion to
their weights until no target is above its clamp. Documents are then repeated a whole number of
times, and a seeded part of them once more, so that the words taken meet the target.

Defined results: a null or empty text has size 0, so whatever copies of it the mix holds take no words; a
null source is a source of its own, last in order; repeated rows count one by one; texts of any length
count whole; further columns pass through `mix` and, whatever their names, are not read; an empty table
gives an empty result. The windows over sources hold one row of some 100 bytes per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introna.llm.common import hashed, n_words, stored

SEED = "mix"


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def cyclic_weights(sources: DataFrame, cycle=(3, 1, 2)) -> DataFrame:
    """Weights that repeat over the sources in code-point order, null last (one row per source)."""
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    steps = F.array(*(F.lit(float(w)) for w in cycle))
    return sources.withColumn("weight", F.get(steps, (position - 1) % len(cycle)))


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Add ``target``: ``share`` of all sizes, split by ``weight`` and clamped at ``max_epochs`` sizes.

    With the sources in order of clamp per weight, the water level after clamping the first k is
    (total - their clamps) / (weights left); the first level below the next clamp is the one. The
    windows hold one row per source, never documents.
    """
    order = Window.orderBy(F.col("per_weight"), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = (
        sources.withColumn("clamp", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("per_weight", F.col("clamp") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("clamped", F.coalesce(F.sum("clamp").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("clamped")) / F.sum("weight").over(onward))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("per_weight"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("level") < F.col("per_weight"), F.col("level") * F.col("weight")).otherwise(F.col("clamp"))
    return filled.select("source", "source_size", target.alias("target"))


def _key(source: Column) -> list[Column]:
    return [source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source_key")]


def repetitions(sized: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per source: ``whole`` repetitions of every document, and ``last``, up to which they are taken once more.

    Documents of a source come in hashed order; those whose middle lies within what is left of the
    target after the whole repetitions are taken once more, so a source misses its target by less
    than one document. The last of them is found by sums: 1,024 stretches of the order, 1,024 parts
    of the stretch where the target is met, then the documents of that one part. No task holds a
    source, and a hot source is dealt over all its parts.
    """
    source = ["no_source", "source_key"]
    stretch, part = [*source, "stretch"], [*source, "stretch", "part"]
    placed = sized.withColumn("place", hashed(seed, F.col("doc_id"))).select(
        "place", "doc_id", "size", *_key(F.col("source")), F.shiftright("place", 50).alias("stretch"),
        F.shiftright("place", 40).bitwiseAND(F.lit(1023)).alias("part"),
    )
    parts = placed.groupBy(*part).agg(F.sum("size").alias("words"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = targets.select(*_key(F.col("source")), "source_size", "target", whole.cast("long").alias("whole"))
    goals = goals.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))

    def before(keys, *order):
        return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def met(pieces, keys, place):
        """The piece of each key in which the running sum passes ``extra``."""
        carry = F.col("carry") + F.coalesce(F.sum("words").over(before(keys, place)), F.lit(0))
        return pieces.withColumn("carry", carry).where("carry <= extra and extra < carry + words").drop("words")

    start = goals.select(*source, "extra", F.lit(0).cast("long").alias("carry"))
    at_stretch = met(parts.groupBy(*stretch).agg(F.sum("words").alias("words")).join(start, source), source, "stretch")
    at_part = met(parts.join(at_stretch, stretch), stretch, "part")
    running = F.col("carry") + F.sum("size").over(
        Window.partitionBy(*part).orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    )
    taken = placed.join(at_part, part).withColumn("running", running).where("2 * running - size <= 2 * extra")
    last = taken.groupBy(*source).agg(F.max(F.struct("place", "doc_id", "size")).alias("last"))
    # where the first document of that part is not taken, the parts before it still are
    floor = at_part.select(*source, F.shiftleft("stretch", 50).bitwiseOR(F.shiftleft("part", 40)).alias("floor"))
    return goals.drop("extra").join(floor, source, "left").join(last, source, "left")


SMALL_SOURCES = 100_000  # rows of a table of sources (some 100 bytes each) that may be broadcast
SALTS = 64


def with_copies(rows: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """Add source_size, target and ``copies`` to rows of ``doc_id, source, size`` and others.

    A plan of few sources (checked) is broadcast; a larger one is joined with salted keys, so that a
    hot source is split.
    """
    place = hashed(seed, F.col("doc_id"))
    keyed = rows.select("*", *_key(F.col("source")), place.alias("place"))
    keys = ["no_source", "source_key"]
    if plan.count() <= SMALL_SOURCES:
        joined = keyed.join(F.broadcast(plan), keys, "left")
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")
    once_more = F.coalesce(F.struct("place", "doc_id", "size") <= F.col("last"), F.lit(False)) | F.coalesce(F.col("place") < F.col("floor"), F.lit(False))
    return joined.withColumn("copies", F.col("whole") + once_more.cast("long")).drop(*keys, "place", "whole", "floor", "last")


def plan_of(sized: DataFrame, cycle=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: str = SEED) -> DataFrame:
    targets = water_fill(cyclic_weights(source_sizes(sized), cycle), share, max_epochs)
    return stored(repetitions(sized, targets, seed), "mix-plan")


def mix_plan(docs: DataFrame, cycle=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    found = with_copies(sized, plan_of(sized, cycle, share, max_epochs, seed), seed)
    return found.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, cycle=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as its source's target asks for, in the given columns.

    Texts are never shuffled: the plan of each source goes to the documents.
    """
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    plan = plan_of(sized, cycle, share, max_epochs, seed)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    copied = with_copies(rows, plan, seed).where("copies > 0")
    return copied.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
