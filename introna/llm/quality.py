"""Quality rules by weak supervision.

Each rule votes good (1), votes bad (-1) or abstains (0). Documents are counted by vote pattern, and
expectation-maximisation over the patterns estimates how often each rule is right on good and on bad
documents and how common good ones are; the posterior of a document's pattern decides. A rule that is
seldom wrong on good documents so outweighs many that bad documents pass. Hard base rules (too few words, mostly
repeated text) come first and are never overruled.

Defined results: a null, empty or wordless text has zero counts, fails the base rules and is not kept;
repeated rows are judged row by row alike; texts of any length are measured whole; further columns pass
through `keep_good` and, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from introna.llm.common import WORD, stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ROUNDS = 12
START_ON_GOOD, START_ON_BAD, START_PRIOR = 0.98, 0.3, 0.8

#: name: (bad if, good if), over the counts of `measure`; neither: the rule abstains
RULES = {
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "upper": ("5 * n_upper > word_chars", "10 * n_upper <= word_chars"),
    "shouting": ("5 * n_marks > n_words", "20 * n_marks <= n_words"),
    "letters": ("5 * n_letters < 4 * word_chars", "10 * n_letters >= 9 * word_chars"),
    "runs": ("5 * n_runs > n_words", "20 * n_runs <= n_words"),
    "cells": ("10 * n_bars > n_words", "50 * n_bars <= n_words"),
    "repeats": ("5 * n_repeat_words > n_words", "10 * n_repeat_words <= n_words"),
    "lines": ("3 * n_dup_lines > n_lines", "5 * n_dup_lines <= n_lines"),
    "variety": ("5 * n_distinct_words < 2 * n_words", "2 * n_distinct_words >= n_words"),
    "word_length": ("word_chars < 3 * n_words or word_chars > 9 * n_words", "word_chars >= 4 * n_words and word_chars <= 8 * n_words"),
}


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text.

    Words in repeated windows: the windows are hashed to 64 bits (two windows of one text meet by chance
    once in 10^12 texts of a thousand words); where a hash occurs twice, windows are sorted by hash and
    those equal to a neighbour are laid out by position, and the words they cover are counted once each.
    """
    space = r"[\x20\x09-\x0D]+"
    text = F.coalesce(F.col("text"), F.lit(""))
    length = F.length
    counted = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    counted = counted.select(
        "doc_id", F.col("words"), F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        length(F.regexp_replace("text", space, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\|")).cast("long").alias("n_bars"),
        F.regexp_count("text", F.lit(r"!")).cast("long").alias("n_marks"),
        length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit(r"[\p{P}\p{S}]{2,}")).cast("long").alias("n_runs"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
    )
    last = F.size("words") - 3
    windows = F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    ))
    found = counted.withColumn("windows", windows).drop("words")
    again = F.size("windows") > F.size(F.array_distinct("windows"))
    found = found.withColumn("sorted", F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.transform("sorted", lambda x, k: F.when(
        (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"]), x["i"]
    ))
    found = found.withColumn("at", F.sort_array(F.array_compact(same))).drop("windows", "sorted")
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def votes(measured: DataFrame, rules=None) -> DataFrame:
    """Add one column ``vote_<rule>`` per rule and ``base_failed``."""
    rules = rules or RULES
    cast = {f"vote_{name}": F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for name, (bad, good) in rules.items()}
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumns(cast).withColumn("base_failed", failed)


def posterior(names: list[str], right: dict[str, tuple[float, float]], prior: float) -> Column:
    """Probability that a document is good, given its votes and how often each rule is right on (good, bad) ones."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for name in names:
        good, bad = right[name]
        vote = F.col(f"vote_{name}")
        odds = odds + F.when(vote == 1, math.log(good / (1 - bad))).when(vote == -1, math.log((1 - good) / bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(voted: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[dict[str, tuple[float, float]], float]:
    """How often each rule is right on good and bad documents, and the share of good ones.

    The E-step needs only the counts of vote patterns (3 to the number of rules at most); each round is
    one aggregate over them that returns a single row. Estimates are smoothed by one right and one wrong
    vote and rounded to 9 decimals, so that any order of summation gives the same.
    """
    patterns = stored(voted.groupBy(*(f"vote_{n}" for n in names)).agg(F.count("*").alias("docs")), "vote-patterns").coalesce(1)
    right, prior = dict.fromkeys(names, (START_ON_GOOD, START_ON_BAD)), START_PRIOR
    for _ in range(rounds):
        good, bad = (F.col("docs") * p for p in (F.col("good"), 1 - F.col("good")))
        sums = [F.sum("docs").alias("docs"), F.sum(good).alias("good")]
        for name in names:
            vote = F.col(f"vote_{name}")
            for kind, mass, hit in (("good", good, 1), ("bad", bad, -1)):
                sums.append(F.sum(F.when(vote != 0, mass)).alias(f"cast_{kind}_{name}"))
                sums.append(F.sum(F.when(vote == hit, mass)).alias(f"right_{kind}_{name}"))
        row = patterns.withColumn("good", posterior(names, right, prior)).agg(*sums).first()
        if not row["docs"]:
            break
        share = {(n, k): ((row[f"right_{k}_{n}"] or 0.0) + 1) / ((row[f"cast_{k}_{n}"] or 0.0) + 2) for n in names for k in ("good", "bad")}
        prior = round((row["good"] + 1) / (row["docs"] + 2), 9)
        right = {n: (round(share[n, "good"], 9), round(share[n, "bad"], 9)) for n in names}
    return right, prior


def judge(docs: DataFrame, rules=None, threshold: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, votes, base_failed, posterior and kept."""
    rules = rules or RULES
    names = list(rules)
    voted = stored(votes(measure(docs), rules), "quality-votes")
    # documents that fail the base rules are decided; the rules are weighed on the others
    right, prior = estimate(voted.where(~F.col("base_failed")), names, rounds)
    scored = voted.withColumn("posterior", posterior(names, right, prior))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, rules=None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, in the given columns.

    Rows are stored beside their votes, so that texts are measured once and need not be shuffled to meet
    their verdicts.
    """
    rules = rules or RULES
    names = list(rules)
    ballots = [f"vote_{n}" for n in names]
    whole = docs.select(F.struct("*").alias("row"), "text")
    voted = votes(measure(whole.select(F.col("row").alias("doc_id"), "text")), rules)
    voted = stored(voted.select(F.col("doc_id").alias("row"), "base_failed", *ballots), "quality-rows")
    sound = voted.where(~F.col("base_failed"))
    right, prior = estimate(sound.select(*ballots), names)
    return sound.where(posterior(names, right, prior) >= threshold).select("row.*")
