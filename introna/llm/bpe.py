"""Byte-pair encoding and decoding with a pair occurrence index.

White space is never part of a token here, so a text is a sequence of chunks between white space, and
a batch of a partition needs each distinct chunk once. The distinct words of a batch are laid out in one
array of symbols; an index maps every mergeable pair to all its positions; the active ranks are applied
in ascending order, each at all its positions at once, and the pairs beside every merge move to their
new lists.

Defined results: a null or empty text encodes to no ids and decodes to the empty text; a chunk of any
length is one word list like any other; rows keep their own columns (a column named ``ids``,
``n_tokens`` or ``decoded`` is replaced); repeated rows give equal results; an empty table gives an
empty result. Ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BY_WORD_PIECES = ["NFC", "Replace", "Lowercase"]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """Vocabulary, merges and text rules of a tokenizer file (kind: word ends, lower case)."""

    def __init__(self, content: bytes):
        import regex

        spec = json.loads(content)
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        model = spec["model"]
        if steps != BY_WORD_PIECES or not split["invert"] or level["use_regex"] or model["type"] != "BPE" or spec["decoder"]:
            raise ValueError("not a tokenizer file of the supported kind")
        vocab: dict[str, int] = model["vocab"]
        end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.mark_start = os.path.commonprefix(list(self.special))
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        # letters and digits that only the newer tables of the regex library know are none: other characters stand in
        named = regex.compile(r"[\p{L}\p{N}]")
        newer = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and named.match(c)]
        self.newer = regex.compile("[" + "".join(newer) + "]") if newer else None
        self.hide = {ord(c): 0xF0000 + i for i, c in enumerate(newer)}
        self.show = {v: k for k, v in self.hide.items()}
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + end] for s in symbols], np.int32)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int64)
        self.left, self.right, self.made = (pairs[:, i].astype(np.int32) for i in range(3))
        self.base = len(vocab)
        keys = pairs[:, 0] * self.base + pairs[:, 1]
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        # the lowest rank of the pairs each symbol is in: a merge whose symbol is in a lower pair must let that one go first
        lowest = np.full(self.base, len(pairs), np.int64)
        np.minimum.at(lowest, pairs[:, 0], np.arange(len(pairs)))
        np.minimum.at(lowest, pairs[:, 1], np.arange(len(pairs)))
        self.yields = lowest[self.made] < np.arange(len(pairs))

    def words(self, chunk: str) -> list[str]:
        """Words of one chunk after the text rules; special tokens stay as they are."""
        if chunk.isascii():
            lower = chunk.lower()
            if lower.isalpha():
                return [lower]
            if lower[:-1].isalpha() and lower[-1:] in ".,;:!?|)":
                return [lower[:-1], lower[-1]]
        found: list[str] = []
        for piece in self.marks.split(chunk) if self.mark_start in chunk else (chunk,):
            if piece in self.special:
                found.append(piece)
            elif piece:
                # one character at a time: no special form of a final sigma
                lower = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                if lower.isalpha():
                    found.append(lower)
                elif self.newer is not None and not lower.isascii() and self.newer.search(lower):
                    found += [w.translate(self.show) for w in self.pattern.findall(lower.translate(self.hide))]
                else:
                    found += self.pattern.findall(lower)
        return found

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where none."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and where each begins (one more at the end)."""
        raw = np.frombuffer("\n".join(words).encode("utf-8"), np.uint8)
        gaps = np.flatnonzero(raw == 10)  # no word holds a line feed
        ends = np.append(gaps, len(raw)) - np.arange(len(gaps) + 1) if words else np.empty(0, np.int64)
        raw = np.delete(raw, gaps)
        starts = np.append(0, ends)
        ids = self.first[raw]
        ids[ends - 1] = self.last[raw[ends - 1]]
        n = len(ids)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[starts[:-1]] = -1
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(left: np.ndarray) -> None:
            """Enter the pairs that begin at these places into the index."""
            rank = self.ranks(ids[left], ids[after[left]])
            known = rank >= 0
            left, rank = left[known], rank[known]
            if not len(left):
                return
            by = np.argsort(rank, kind="stable")
            left, rank = left[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, a, b in zip(rank[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(rank)]):
                if r in places:
                    places[r].append(left[a:b])
                else:
                    places[r] = [left[a:b]]
                    heapq.heappush(active, r)

        note(np.flatnonzero(after >= 0).astype(np.int32))
        while active:
            rank = heapq.heappop(active)
            found = places.pop(rank)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            next_ = after[at]
            # a neighbour may have been merged away since the pair was entered
            at = at[(ids[at] == self.left[rank]) & (next_ >= 0) & (ids[next_] == self.right[rank])]
            if self.left[rank] == self.right[rank] and len(at) > 1:
                # of overlapping pairs every other one, from the left
                chained = np.append(False, after[at[:-1]] == at[1:])
                begun = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begun) % 2 == 0]
            if self.yields[rank] and len(at) > 1:
                # a lower rank may become active: one merge in each word, the rest waits
                word = np.searchsorted(starts, at, side="right")
                one = np.append(True, word[1:] != word[:-1])
                if not one.all():
                    places[rank] = [at[~one]]
                    heapq.heappush(active, rank)
                    at = at[one]
            if not len(at):
                continue
            gone = after[at]
            ids[at], ids[gone] = self.made[rank], -1
            then = after[gone]
            after[at] = then
            has = then >= 0
            before[then[has]] = at[has]
            prior = before[at]
            note(np.unique(np.concatenate([at[has], prior[prior >= 0]])))
        alive = ids >= 0
        return ids[alive], np.append(0, np.cumsum(alive))[starts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text begins (one more at the end)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        of_text = np.asarray(lists.offsets) - (lists.offsets[0].as_py() if len(lists) else 0)
        number: dict[str, int] = {}
        chunk_words: list[int] = []
        chunk_ends = [0]
        for chunk in coded.dictionary.to_pylist():
            chunk_words += [number.setdefault(w, len(number)) for w in self.words(chunk)]
            chunk_ends.append(len(chunk_words))
        plain = [w for w in number if w not in self.special]
        flat, begins = self.merge(plain)
        if len(plain) < len(number):  # special tokens: a word of one id each
            at = np.array([i for i, w in enumerate(number) if w in self.special])
            lengths = np.ones(len(number), np.int64)
            normal = np.ones(len(number), bool)
            normal[at] = False
            lengths[normal] = np.diff(begins)
            begins = np.append(0, np.cumsum(lengths))
            whole = np.empty(begins[-1], np.int32)
            whole[np.repeat(normal, lengths)] = flat
            whole[begins[at]] = [self.special[w] for w in number if w in self.special]
            flat = whole
        chunk_ids, chunk_at = _gather(flat, begins, np.array(chunk_words, np.int64))
        chunk_at = chunk_at[np.array(chunk_ends)]
        ids, at = _gather(chunk_ids, chunk_at, np.asarray(coded.indices).astype(np.int64))
        return ids, at[of_text]


def _gather(values: np.ndarray, begins: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` of (values, begins), one after another, and where each begins (one more at the end)."""
    lengths = (begins[1:] - begins[:-1])[which]
    at = np.append(0, np.cumsum(lengths))
    return values[np.repeat(begins[:-1][which] - at[:-1], lengths) + np.arange(at[-1])], at


BATCH_CHARS = 1 << 22  # texts of a batch are merged together up to so many characters


def _parts(texts: pa.Array):
    """Slices of a batch, each of a bounded number of characters (a longer text is one slice)."""
    sizes = np.nan_to_num(np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), float))
    part = (np.cumsum(sizes) // BATCH_CHARS).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts.slice(a, b - a)


def token_names(content: bytes) -> list[str | None]:
    """Name of each id of a tokenizer file."""
    spec = json.loads(content)
    names = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [names.get(i) for i in range(max(names) + 1)]


_loaded: dict[int, Tokenizer] = {}


def _tokenizer(content: bytes) -> Tokenizer:
    """One per worker process and file."""
    key = hash(content)
    if key not in _loaded:
        _loaded[key] = Tokenizer(content)
    return _loaded[key]


def _shared(df: DataFrame, path: str):
    """The tokenizer file (a few MB, fixed) for every worker."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _set(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns.values()], [*names, *columns])


def _schema(df: DataFrame, **added: T.DataType) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name not in added]
    return T.StructType([*kept, *(T.StructField(n, t) for n, t in added.items())])


def encode(df: DataFrame, path: str, column: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every whole text."""
    content = _shared(df, path)

    def run(batches):
        for batch in batches:
            counts, ids = [], []
            for part in _parts(batch.column(column)):
                flat, at = _tokenizer(content.value).encode(part)
                raw = flat.astype("<u4").tobytes()
                counts += np.diff(at).tolist()
                ids += [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            out = _set(batch, {"n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(ids, pa.binary())})
            yield out if keep_text else out.drop_columns([column])

    schema = _schema(df, n_tokens=T.LongType(), ids=T.BinaryType())
    if not keep_text:
        schema = T.StructType([f for f in schema.fields if f.name != column])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """Add ``decoded``: the names of the tokens, separated by spaces."""
    content = _shared(df, path)

    def run(batches):
        names = token_names(content.value)
        top = len(names)

        def text(ids: bytes | None) -> str:
            known = (names[i] for i in np.frombuffer(ids or b"", "<u4").tolist() if i < top)
            return " ".join(x for x in known if x is not None)

        for batch in batches:
            yield _set(batch, {"decoded": pa.array((text(x.as_py()) for x in batch.column(column)), pa.string())})

    return df.mapInArrow(run, _schema(df, decoded=T.StringType()))


def token_counts(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Replace the text by its encoded length, ``n_tokens``."""
    content = _shared(df, path)

    def run(batches):
        for batch in batches:
            lengths = [n for part in _parts(batch.column(column)) for n in np.diff(_tokenizer(content.value).encode(part)[1]).tolist()]
            yield _set(batch, {"n_tokens": pa.array(lengths, pa.int64())}).drop_columns([column])

    schema = _schema(df, n_tokens=T.LongType())
    return df.mapInArrow(run, T.StructType([f for f in schema.fields if f.name != column]))
