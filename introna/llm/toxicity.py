"""Toxicity scores from class-conditional Kneser-Ney models.

One model is trained on toxic documents and one on ordinary documents. A word's probability in a class
comes from its discounted count; what the discounts free goes to the word's head (first letters), whose
probability comes from the number of different words with that head in the class, and from there to the
counts of heads shared by both classes. A word seen once in all has only what its head gives it.

A document's evidence are length-normalised log-likelihood ratios: the mean over its words, with some
neutral words added; tempered means that give strong expressions more say; and the means over its 1, 3
and 6 most telling words. A logistic curve turns them into a probability. It is fitted on documents that
the model behind their evidence has not seen (each half of the training rows by the other's model).

Bounds: models and curve come from at most ``SAMPLE_CHARS`` characters and ``SAMPLE_DOCS`` documents of
each class, single documents in hashed order, so that the model may be broadcast: all of them, whole,
where they fit; else no text counts more than 1/64 of ``SAMPLE_CHARS``, and a longer one gives pieces from
all over it, chosen by their hash. Equal rows count once.

Defined results: a null, empty or wordless text has only neutral evidence; rows of one doc_id are scored
each by its text; a doc_id without label, or with a null label, trains nothing; of several labels of one
doc_id the largest counts; a row without doc_id is not held out; where a class has no labelled rows,
every score is the smoothed share of toxic labels; texts of any length are scored whole; only doc_id and
text of the documents are read, so further columns and their names do not matter; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introna.llm.common import hashed, stored

SAMPLE_CHARS, SAMPLE_DOCS = 1 << 24, 1 << 14  # of labelled text, per class
SHARES = 64  # where a class exceeds its bounds, one document uses at most this part of the characters
PIECE = r"(?s).{1,512}\S*"  # piece of a text of which a part counts; words stay whole
HEAD = 5  # letters of a word's head
TEMPERS, TOPS, NEUTRAL = (0.4, 0.7, 1.0), (1, 3, 6), 20
PRIOR = 1.0  # weight of the prior that keeps the curve's coefficients small


def fold(doc_id: Column) -> Column:
    """0, 1 or 2; rows of fold 1 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)).cast("int")


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (letters, lower case) of the texts, the codes of all words, and where each text begins."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(pc.utf8_trim(pc.replace_substring_regex(lower, r"[^\pL]+", " "), " "))
    coded = lists.flatten().dictionary_encode()
    offsets = np.asarray(lists.offsets)
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), offsets - offsets[0]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, group, n) of ``text`` by ``group``, counted batch by batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, codes, at = _words(batch.column("text"))
            groups = np.repeat(np.asarray(batch.column("group")), np.diff(at))
            pair, n = np.unique(groups.astype(np.int64) * max(len(words), 1) + codes, return_counts=True)
            group, code = np.divmod(pair, max(len(words), 1))
            named = [words[i] for i in code.tolist()]
            keep = np.array([bool(w) for w in named], bool)
            out = pa.RecordBatch.from_arrays([pa.array(named, pa.string()), pa.array(group, pa.int64()), pa.array(n, pa.int64())], ["word", "group", "n"])
            yield out.filter(pa.array(keep))

    counted = texts.select("text", F.col("group").cast("long").alias("group")).mapInArrow(run, "word string, group long, n long")
    return counted.groupBy("word", "group").agg(F.sum("n").alias("n"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic, fold of the training rows within the bound, and ``weight``: rows of the class per row taken."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 1")
    # lengths meet the labels first, then the texts of the rows taken; no text is shuffled before
    digest = F.xxhash64("text").alias("digest")
    lengths = docs.select("doc_id", digest, F.coalesce(F.length("text"), F.lit(0)).alias("chars")).distinct()
    place = hashed("toxicity", F.col("doc_id"), F.col("digest"))
    sized = stored(lengths.join(known, "doc_id").withColumn("place", place), "label-lengths")
    totals = sized.groupBy("toxic").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars")).collect()  # one row a class
    whole = [r["toxic"] for r in totals if r["docs"] <= SAMPLE_DOCS and r["chars"] <= SAMPLE_CHARS]
    used = F.when(F.col("toxic").isin(whole), F.col("chars")).otherwise(F.least("chars", F.lit(max(SAMPLE_CHARS // SHARES, 1))))
    taken = _within(sized.withColumn("chars", used))
    share = sized.groupBy("toxic").agg(F.count("*").alias("all")).join(taken.groupBy("toxic").agg(F.count("*").alias("some")), "toxic")
    share = share.select("toxic", (F.col("all") / F.col("some")).alias("weight"))
    chosen = stored(taken.join(F.broadcast(share), "toxic").select(  # a row per class
"doc_id", "digest", "toxic", "fold", "chars", "weight"), "label-sample")  # SAMPLE_DOCS rows per class at most
    found = docs.select("doc_id", "text", digest).join(F.broadcast(chosen), ["doc_id", "digest"])
    found = found.groupBy("doc_id", "digest", "toxic", "fold", "weight", "chars").agg(F.first("text").alias("text"))
    lot = lambda i: F.pmod(F.xxhash64("digest", i), F.lit(1_000_003)) * F.length("text") < F.col("chars") * 1_000_003
    part = F.array_join(F.filter(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)), lambda _, i: lot(i)), "")
    found = found.withColumn("text", F.when(F.length("text") > F.col("chars"), part).otherwise(F.col("text"))).drop("chars")
    return stored(found.drop("digest"), "labelled")


def _within(sized: DataFrame) -> DataFrame:
    """The documents of each class, in hashed order, as far as they fit the bounds.

    The last of them is found by sums: 4,096 stretches of the order, 4,096 parts of the stretch where a
    bound is met, then the documents of that one part.
    """
    stretch, part = ["toxic", "stretch"], ["toxic", "stretch", "part"]
    placed = sized.withColumn("docs", F.lit(1)).withColumn("stretch", F.shiftright("place", 48)).withColumn("part", F.shiftright("place", 36).bitwiseAND(F.lit(4095)))
    names = ("docs", "chars")
    parts = placed.groupBy(*part).agg(*(F.sum(c).alias(c) for c in names))
    start = [F.lit(0).cast("long").alias(f"{c}_before") for c in names]

    def split(pieces: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
        """The pieces that fit whole, and the first of each class that does not, with what was taken before it."""
        window = Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        pieces = pieces.withColumns({f"{c}_upto": F.col(f"{c}_before") + F.sum(c).over(window) for c in names})
        fits = (F.col("docs_upto") <= SAMPLE_DOCS) & (F.col("chars_upto") <= SAMPLE_CHARS)
        began = (F.col("docs_upto") - F.col("docs") <= SAMPLE_DOCS) & (F.col("chars_upto") - F.col("chars") <= SAMPLE_CHARS)
        return pieces.where(fits), pieces.where(~fits & began).withColumns({f"{c}_before": F.col(f"{c}_upto") - F.col(c) for c in names})

    before = [f"{c}_before" for c in names]
    stretches, at_stretch = split(parts.groupBy(*stretch).agg(*(F.sum(c).alias(c) for c in names)).select("*", *start), "stretch")
    fitting, at_part = split(parts.join(at_stretch.select(*stretch, *before), stretch), "part")
    single, _ = split(placed.join(at_part.select(*part, *before), part), "place", "doc_id", "digest")
    kept = [placed.join(stretches.select(*stretch), stretch), placed.join(fitting.select(*part), part), single]
    taken = kept[0].select(*sized.columns)
    for more in kept[1:]:
        taken = taken.unionByName(more.select(*sized.columns))
    return stored(taken, "label-taken")


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of items seen 1 to 4 times."""
    if not (n1 and n2 and n3 and n4):
        return [0.75, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _level(counts: DataFrame, column: str) -> tuple[float, list[float], float]:
    """Total, discounts and the share they free, of one column of counts."""
    c = F.col(column)
    row = counts.agg(F.sum(c), *(F.count(F.when(c == k, 1)) for k in (1, 2, 3, 4)), F.count(F.when(c >= 3, 1))).first()
    total = float(row[0] or 0)
    cuts = _discounts(*row[1:5])
    return total, cuts, (row[1] * cuts[0] + row[2] * cuts[1] + row[5] * cuts[2]) / total if total else 0.0


def _left(column: str, cuts: list[float]) -> Column:
    """A count after its discount."""
    c = F.col(column)
    return F.when(c >= 3, c - cuts[2]).when(c == 2, c - cuts[1]).when(c == 1, c - cuts[0]).otherwise(F.lit(0.0))


class Model:
    """Log likelihood ratios of words and heads, and of what is in neither."""

    def __init__(self, words: dict[str, float], heads: dict[str, float], unknown: float):
        self.words, self.heads, self.unknown = words, heads, unknown

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """One row of length-normalised evidence per text."""
        words, codes, at = _words(texts)
        heads, unknown, known = self.heads, self.unknown, self.words
        ratios = np.array([known[w] if w in known else heads.get(w[:HEAD], unknown) for w in words])
        filled = np.array([bool(w) for w in words], bool)
        rows = np.zeros((len(texts), len(TEMPERS) + len(TOPS) + 2))
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            mine = codes[a:b]
            if len(mine) and not (filled[mine[0]] and filled[mine[-1]]):
                mine = mine[filled[mine]]
            r = ratios[mine] if len(mine) else np.zeros(0)
            n = len(r) + NEUTRAL
            top = -np.sort(np.partition(-r, TOPS[-1])[: TOPS[-1]]) if len(r) > TOPS[-1] else np.sort(r)[::-1]
            tempered = [np.log((np.exp(t * r).sum() + NEUTRAL) / n) for t in TEMPERS]
            rows[i] = [*tempered, *(top[:k].sum() / k for k in TOPS), r.sum() / n, np.log(n)]
        return rows


def train(rows: DataFrame) -> Model | None:
    """The two models of (text, toxic), as ratios; None where a class has no words."""
    counts = word_counts(rows.withColumnRenamed("toxic", "group")).groupBy("word").agg(
        F.sum(F.when(F.col("group") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("group") == 0, F.col("n")).otherwise(0)).alias("o")
    ).withColumn("head", F.substring("word", 1, HEAD))
    counts = stored(counts, "word-counts")
    levels = {c: _level(counts, c) for c in ("t", "o")}
    if not (levels["t"][0] and levels["o"][0]):
        return None
    heads = stored(counts.groupBy("head").agg(
        F.count(F.when(F.col("t") > 0, 1)).alias("t"), F.count(F.when(F.col("o") > 0, 1)).alias("o"), F.count("*").alias("shared")
    ), "head-counts")
    head_levels = {c: _level(heads, c) for c in ("t", "o")}
    everything = heads.agg(F.sum("shared")).first()[0]

    def backed(c: str) -> Column:
        total, cuts, freed = head_levels[c]
        return (_left(c, cuts) / total + F.lit(freed) * F.col("shared") / everything).alias(f"head_{c}")

    heads = heads.select("head", "shared", backed("t"), backed("o"))
    lift = {c: levels[c][2] for c in levels}
    ratio = F.log(F.lit(lift["t"]) * F.col("head_t")) - F.log(F.lit(lift["o"]) * F.col("head_o"))
    of_heads = dict(heads.select("head", ratio).toPandas().itertuples(index=False, name=None))

    def of(c: str) -> Column:
        total, cuts, freed = levels[c]
        return _left(c, cuts) / total + F.lit(freed) * F.col(f"head_{c}") / F.col("shared")

    repeated = counts.where("t + o > 1").join(heads, "head").select("word", F.log(of("t")) - F.log(of("o")))
    of_words = dict(repeated.toPandas().itertuples(index=False, name=None))
    unknown = math.log(lift["t"] * head_levels["t"][2]) - math.log(lift["o"] * head_levels["o"][2])
    return Model(of_words, of_heads, unknown)


class Curve:
    """Logistic curve over the evidence, fitted by Newton's method with a weak prior."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.middle, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        design = self._design(x)
        beta = np.zeros(design.shape[1])

        def loss(at: np.ndarray) -> float:
            z = design @ at
            return float((weight * (np.logaddexp(0, z) - y * z)).sum() + PRIOR / 2 * at @ at)

        now = loss(beta)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            gradient = design.T @ (weight * (y - p)) - PRIOR * beta
            curvature = design.T @ (design * (weight * p * (1 - p))[:, None]) + PRIOR * np.eye(len(beta))
            step = np.linalg.solve(curvature, gradient)
            while (then := loss(beta + step)) > now and np.abs(step).max() > 1e-9:
                step /= 2
            if now - then < 1e-9 * abs(now):
                break
            beta, now = beta + step, then
        self.beta = beta

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.middle) / self.spread, np.ones((len(x), 1))], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.beta, -30, 30)))


def with_evidence(df: DataFrame, model: Model, curve: Curve | None = None) -> DataFrame:
    """Replace ``text`` by its evidence, ``x``, or by its ``score`` on a curve."""
    shared = df.sparkSession.sparkContext.broadcast((model, curve))
    kept = [c for c in df.columns if c != "text"]
    name, kind = ("x", pa.list_(pa.float64())) if curve is None else ("score", pa.float64())

    def run(batches):
        behind, on = shared.value
        for batch in batches:
            x = behind.evidence(batch.column("text"))
            made = pa.array(list(x) if on is None else on(x), kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], [*kept, name])

    made = F.array(F.lit(0.0)) if curve is None else F.lit(0.0)
    return df.mapInArrow(run, df.select(*kept, made.alias(name)).schema)


def _fit_curve(rows: DataFrame, halves: dict[int, Model | None]) -> Curve | None:
    """The curve over the training rows, each half's evidence from the other half's model."""
    seen = [
        with_evidence(rows.where(F.col("fold") == other).select("text", "toxic", "weight"), model)
        for other, model in ((2, halves[0]), (0, halves[2])) if model
    ]
    found = [r for part in seen for r in part.collect()]  # SAMPLE_DOCS rows per class at most
    if not found:
        return None
    return Curve(np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found], float), np.array([r["weight"] for r in found]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    rows = labelled(docs, labels)
    texts = docs.select("doc_id", "text")
    model = train(rows.select("text", "toxic"))
    curve = _fit_curve(rows, {f: train(rows.where(F.col("fold") == f).select("text", "toxic")) for f in (0, 2)}) if model else None
    if curve:
        found = with_evidence(texts, model, curve)
    else:
        counts = rows.agg(F.count("*"), F.sum("toxic")).first()
        found = texts.select("doc_id", F.lit(((counts[1] or 0) + 1) / (counts[0] + 2)).alias("score"))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
