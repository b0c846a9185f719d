"""Words of Arrow text batches as 64-bit hashes, for operators that work on them with numpy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes worked on at once; longer texts come alone.
SLICE_BYTES = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts add up to about SLICE_BYTES."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each uint64 over the whole word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of each text's words). A-Z are lower-cased; null texts have no words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    codes = flat.dictionary_encode()
    names = codes.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))
    index = codes.indices.to_numpy(zero_copy_only=False)
    if "" in names:  # texts that begin or end with white space
        full = index != names.index("")
        before = np.concatenate(([0], np.cumsum(full)))
        return hashes[index[full]], before[offsets]
    return hashes[index], offsets


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; a text of fewer words has one of all its words."""
    words, offsets = word_hashes(texts)
    rolled = words.copy()
    for j in range(1, k):
        rolled[: len(words) - j] = rolled[: len(words) - j] * _ODD + words[j:]
    rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = mix(whole * _ODD + words[i : i + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out
