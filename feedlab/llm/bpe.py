"""Byte-level BPE: encoding by ranked merges, decoding by concatenating pieces.

Texts are split into words by the splitting pattern in Spark. In each task the distinct words of a slice of texts are
merged together: a fold over their byte arrays joins, in every word at once, the leftmost adjacent pair of lowest rank
until no pair has a rank. The rank map is of the vocabulary's size and is broadcast; nothing is shuffled, so a lost task
is just run again. Decoding is a lookup of each id's piece in a literal and one concatenation, in Spark.

A first version made the fold with Spark's higher-order functions over a table of the corpus's distinct words; README has
its figures and why it was given up.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of more bytes are merged one by one with a heap, as each merge of the common fold looks at every pair.
LONG_WORD = 400
_NONE = np.int64(2**31 - 1)
#: Words whose ids a Python worker remembers from one slice to the next.
REMEMBERED = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a rank file (base64 piece, blank, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


class Merger:
    """Rank map of a vocabulary as sorted pairs, and the fold over words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.width = max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)  # every single byte has a rank
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, which is also the id of the joined piece; _NONE for pairs that have none."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], _NONE)

    def _long(self, word: bytes) -> list[int]:
        ids = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        piece: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        rank = lambda i, j: self.ranks.get(piece[i] + piece[j])
        heap = [(r, i, i + 1, 2) for i in range(len(word) - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j, size = heapq.heappop(heap)
            if piece[i] is None or piece[j] is None or after[i] != j or len(piece[i]) + len(piece[j]) != size:
                continue
            piece[i], ids[i], piece[j] = piece[i] + piece[j], r, None
            after[i] = after[j]
            if after[i] < len(word):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(word) and (n := rank(a, b)) is not None:
                    heapq.heappush(heap, (n, a, b, len(piece[a]) + len(piece[b])))
        return [x for x, p in zip(ids, piece, strict=True) if p is not None]

    def fold(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word: of the whole word if it has a rank, else of what the ranked merges leave."""
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        rest = []
        for i, word in enumerate(words):
            if (whole := self.ranks.get(word)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(word) > LONG_WORD:
                out[i] = np.array(self._long(word), np.int32)
            else:
                rest.append(i)
        sizes = np.array([len(words[i]) for i in rest], np.int64)
        ids = self.bytes[np.frombuffer(b"".join(words[i] for i in rest), np.uint8)]
        active = np.array(rest, np.int64)
        while len(active):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            rank = np.append(self._rank(ids[:-1], ids[1:]), _NONE)
            rank[ends - 1] = _NONE  # a pair lies within one word
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            if done.any():
                for i, a, b in zip(active[done], starts[done], ends[done], strict=True):
                    out[i] = ids[a:b].astype(np.int32)
                stays = np.repeat(~done, sizes)
                ids, rank, active, sizes, least = ids[stays], rank[stays], active[~done], sizes[~done], least[~done]
                if not len(active):
                    break
                ends = np.cumsum(sizes)
                starts = ends - sizes
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            word = np.searchsorted(ends, hits, "right")
            first = hits[np.append(True, word[1:] != word[:-1])]  # the leftmost one of each word
            ids[first] = least
            ids = np.delete(ids, first + 1)
            sizes = sizes - 1
        return out


def split_words(text: Column, pattern: str) -> Column:
    """Matches of the splitting pattern in order; white space is that of Unicode."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start+1, .. of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of each text, whole, without special tokens.

    Null and empty texts have no ids; repeated rows get equal ids; an empty table stays empty; a column named
    ``ids_col`` is replaced. Every single byte must have a rank.
    """
    df = df.drop(ids_col, "_words")
    rest = df.columns
    shared = df.sparkSession.sparkContext.broadcast(Merger(ranks))  # of the vocabulary's size
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = shared.value
        memory: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                lists = part.column("_words")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                codes = lists.flatten().dictionary_encode()
                names = codes.dictionary.cast(pa.binary()).to_pylist()
                new = [x for x in names if x not in memory]
                fresh = dict(zip(new, merger.fold(new), strict=True))
                found = [fresh[x] if x in fresh else memory[x] for x in names]
                for x in new[: max(0, REMEMBERED - len(memory))]:
                    memory[x] = fresh[x]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.concatenate(found) if found else np.empty(0, np.int32)
                starts = np.cumsum(sizes) - sizes
                each = codes.indices.to_numpy(zero_copy_only=False)
                bounds = np.concatenate(([0], np.cumsum(sizes[each])))[offsets - offsets[0]]
                ids = flat[_ranges(starts[each], sizes[each])]
                out = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], out], names=[*rest, ids_col])

    return df.withColumn("_words", split_words(F.col(text), pattern)).mapInArrow(run, f"{schema}{ids_col} array<int>")


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that token ids stand for: their pieces, concatenated. Unknown ids stand for nothing."""
    names = [""] * (max(ranks.values(), default=0) + 1)
    for piece, rank in ranks.items():
        names[rank] = piece.hex().upper()
    pieces = F.split(F.lit(",".join(names)), ",")  # folded into one literal
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))
