"""Preference formatting of conversation pairs.

The turns of both conversations of a pair meet in one row; their longest common turn prefix is rendered
once as the prompt, and what follows on either side as two completions. A mask names the spans of a
completion that count in training: the assistant's texts with their end marks.

Defined results: turns come in the order of their number, repeated numbers by role and text; turns
without number come first; a null role reads ``unknown``, a null text is empty; marks inside a text or
a role are broken up and lines of a role joined, so that neither can forge a turn; texts of any length are
rendered whole; only the four columns are read, whatever further ones are named; a pair of which one conversation does not exist gives no
row; a pair is usable if both completions hold an assistant turn, so equal conversations are not; empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def neighbours_by_id(conversations: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected)."""
    ids = conversations.where("conv_id is not null").select("conv_id").distinct()
    pair = F.floor(F.col("conv_id") / 2)
    sides = ids.groupBy(pair.alias("pair_id")).agg(
        F.max(F.when(F.pmod("conv_id", F.lit(2)) == 0, F.col("conv_id"))).alias("chosen_id"),
        F.max(F.when(F.pmod("conv_id", F.lit(2)) == 1, F.col("conv_id"))).alias("rejected_id"),
    )
    return sides.where("chosen_id is not null and rejected_id is not null")


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: t["line"]))


def mask(turns: Column) -> Column:
    """``from:to`` in characters of the rendered turns, for each span that is trained on."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        end = state["at"] + F.length(t["line"])
        span = F.concat_ws(":", end - t["trained"], end)
        return F.struct(end.alias("at"), F.when(t["trained"] > 0, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step, lambda s: F.concat_ws(";", s["spans"]))


def preferences(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask, usable."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("conv_id"))))
    wanted = pairs.select("pair_id", sides.alias("s")).select("pair_id", "s.side", "s.conv_id")
    role = F.replace(F.replace(F.coalesce("role", F.lit("unknown")), F.lit("<|"), F.lit("< |")), F.lit("\n"), F.lit(" "))
    text = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")), F.lit(END))
    line = F.concat(F.lit(START), role, F.lit("\n"), text)
    trained = F.when(F.col("role") == TRAINED, F.length(text)).otherwise(0)
    turns = conversations.select("conv_id", F.struct("turn", "role", "text", line.alias("line"), trained.alias("trained")).alias("t"))

    def of(side: int) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("t"))))

    met = turns.join(wanted, "conv_id").groupBy("pair_id").agg(of(0).alias("a"), of(1).alias("b"))
    met = met.where((F.size("a") > 0) & (F.size("b") > 0))
    same = F.zip_with(F.slice("a", 1, F.least(F.size("a"), F.size("b"))), F.slice("b", 1, F.least(F.size("a"), F.size("b"))), lambda x, y: x["line"] == y["line"])
    met = met.withColumn("same", same)
    differs = F.array_position("same", False)
    met = met.withColumn("n_common", F.when(differs > 0, differs - 1).otherwise(F.size("same")).cast("int"))
    rest_a, rest_b = (F.slice(c, F.col("n_common") + 1, F.size(c) - F.col("n_common")) for c in ("a", "b"))
    met = met.select("pair_id", "n_common", F.slice("a", F.lit(1), F.col("n_common")).alias("common"), rest_a.alias("a"), rest_b.alias("b"))
    trains = [F.exists(c, lambda t: t["trained"] > 0) for c in ("a", "b")]
    return met.select(
        "pair_id", "n_common", render(F.col("common")).alias("prompt"), render(F.col("a")).alias("chosen"), render(F.col("b")).alias("rejected"),
        mask(F.col("a")).alias("chosen_mask"), mask(F.col("b")).alias("rejected_mask"), (trains[0] & trains[1]).alias("usable"),
    )
