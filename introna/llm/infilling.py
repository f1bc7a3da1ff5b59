"""Fill-in-the-middle transformation of whole texts.

A text is cut after two unit numbers drawn from its id. The bytes of a text are dealt into fixed blocks;
a Fenwick tree over the blocks holds how many units end in each and how many code points start there.
Binary lifting down the tree finds the block of a cut, and the boundary is then looked up inside that
block alone, so a cut in a very long text costs a logarithm and one block.

Defined results: a null or empty text has no units, stays plain and gives the empty text; a text that
holds one of the marks stays plain; a null id draws like an empty one; repeated rows give equal
results; texts of any length are cut whole; columns named like an output column are replaced, all other
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4096  # bytes of a text block
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = T.StructType([
    T.StructField("n_units", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
])


def _starts(data: np.ndarray) -> np.ndarray:
    """Where a code point starts: every byte that does not continue one."""
    return (data & 0xC0) != 0x80


def line_ends(data: np.ndarray) -> np.ndarray:
    """Where a line ends: at each newline, and at the last byte."""
    ends = data == 0x0A
    if len(ends):
        ends[-1] = True
    return ends


def character_ends(data: np.ndarray) -> np.ndarray:
    """Where a code point ends."""
    return np.append(_starts(data)[1:], True)[: len(data)]


UNITS = {"line": line_ends, "character": character_ends}


class BlockTree:
    """Fenwick tree over the blocks of one text: ends of units and starts of code points."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, block: int = BLOCK):
        self.ends, self.starts, self.block = ends, _starts(data), block
        at = np.arange(0, len(data), block)
        counts = np.stack([np.add.reduceat(x, at, dtype=np.int64) for x in (self.ends, self.starts)]) if len(at) else np.zeros((2, 0), np.int64)
        sums = np.zeros((2, len(at) + 1), np.int64)
        np.cumsum(counts, axis=1, out=sums[:, 1:])
        i = np.arange(len(at) + 1)
        self.tree = (sums - sums[:, i - (i & -i)]).tolist()
        self.n_blocks, self.n_units, self.n_points = len(at), int(sums[0, -1]), int(sums[1, -1])

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points before the end of the ``k``-th unit."""
        if k == 0:
            return 0, 0
        units, points = self.tree
        at, left, before = 0, k, 0
        for level in reversed(range(self.n_blocks.bit_length())):
            nxt = at + (1 << level)
            if nxt <= self.n_blocks and units[nxt] < left:
                at, left, before = nxt, left - units[nxt], before + points[nxt]
        first = at * self.block
        inside = int(np.flatnonzero(self.ends[first : first + self.block])[left - 1]) + 1
        return first + inside, before + int(np.count_nonzero(self.starts[first : first + inside]))


def draws(seed: int, doc_id) -> list[int]:
    """Four 32-bit numbers from the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _checked(marks: tuple[str, str, str]) -> list[bytes]:
    """Marks that cannot arise where a mark meets a text that holds none."""
    coded = [m.encode() for m in marks]
    overlaps = any(a[-i:] == b[:i] for a in coded for b in coded for i in range(1, min(len(a), len(b))))
    if overlaps or len(set(coded)) < 3 or not all(coded) or any(a in b for a in coded for b in coded if a is not b):
        raise ValueError("marks must be different and must not overlap each other")
    return coded


def transform(
    docs: DataFrame, seed: int = 7, rate: int = 100, suffix_first: int = 50, unit: str = "line", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """Add n_units, form (``plain``, ``psm`` or ``spm``), prefix_chars, middle_chars and output.

    ``rate`` is the percentage of texts that are rearranged, ``suffix_first`` that of ``spm`` among them.
    The prefix ends after the smaller and the middle after the larger of two drawn unit numbers.
    """
    prefix_mark, suffix_mark, middle_mark = coded = _checked(marks)
    kept = [f for f in docs.schema.fields if f.name.lower() not in ADDED.names]
    if not {"doc_id", "text"} <= {f.name for f in kept}:
        raise ValueError("documents need the columns doc_id and text")
    ends_of = UNITS[unit]

    def one(doc_id, text: bytes) -> tuple[int, str, int | None, int | None, bytes]:
        data = np.frombuffer(text, np.uint8)
        tree = BlockTree(data, ends_of(data))
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not text or h3 % 100 >= rate or any(m in text for m in coded):
            return tree.n_units, "plain", None, None, text
        low, high = sorted((h1 % (tree.n_units + 1), h2 % (tree.n_units + 1)))
        (a, a_chars), (b, b_chars) = tree.cut(low), tree.cut(high)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < suffix_first:
            form, parts = "spm", (suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle)
        else:
            form, parts = "psm", (prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle)
        return tree.n_units, form, a_chars, b_chars - a_chars, b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.string()).cast(pa.binary()).to_pylist()
            rows = [one(i, t or b"") for i, t in zip(batch.column("doc_id").to_pylist(), texts)]
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            added = [pa.array(c, k) for c, k in zip(columns, kinds)]
            added[-1] = added[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *added], [*(f.name for f in kept), *ADDED.names])

    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, T.StructType([*kept, *ADDED.fields]))


def restore(rows: DataFrame, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Add ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    _checked(marks)
    part = F.split("output", "|".join(rf"\Q{m}\E" for m in marks))
    first, second, third = (F.get(part, F.lit(i)) for i in (1, 2, 3))
    whole = F.when(F.col("form") == "psm", F.concat(first, third, second)).when(F.col("form") == "spm", F.concat(second, third, first))
    return rows.withColumn("restored", F.coalesce(whole, F.col("output")))
