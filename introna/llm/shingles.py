"""Word shingles of whole texts as hashed sets, by Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_A = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes.

    Words are runs of anything but ASCII white space, A-Z in lower case. A text of fewer words than
    ``width`` has its whole sequence as one shingle; one without words has none.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    offsets = np.asarray(words.offsets)
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    filled = np.fromiter((bool(w) for w in names), bool, len(names))
    codes = np.asarray(coded.indices)
    offsets = offsets - offsets[0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        mine = codes[a:b]
        if len(mine) and not (filled[mine[0]] and filled[mine[-1]]):  # white space at an end leaves an empty piece
            mine = mine[filled[mine]]
        h = hashes[mine]
        take = min(width, len(h))
        if not take:
            yield h
            continue
        rolled = np.full(len(h) - take + 1, take, np.uint64)
        for i in range(take):
            rolled = rolled * _A + h[i : len(h) - take + 1 + i]
        yield np.unique(mixed(rolled))
