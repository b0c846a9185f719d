"""Exact n-gram Jaccard join by universe partitioning and the pigeonhole principle, and its connected components.

Two sets of sizes r <= s with similarity of at least p/q differ in at most h = (q-p)(r+s)/(q+p) elements. Sizes fall into
bands, so that similar sets lie in one band or in neighbouring ones, and each band has its own partition of the hash
universe into h+1 segments for its largest h: two similar sets agree in at least one segment. A set is indexed by the
hash of each of its segments, under the partition of its own band and of the one below.

Cost-based allocation. With one error fewer than segments, going round the segments from some point the errors of the
first l are at most l - 1, for every l. So similar sets have a segment without errors before one with at most one, and
at most two in the one after that too. An empty segment would cost a list in which all sets meet that leave it empty.
There the next segment is allocated one error: its subset and one-deletion neighbourhood take the place of the list.
Where the index shows that such a list is still long (the next segment may be all but empty), two errors are allocated
in the segment after that, and the list is split by the neighbourhood of its subset.

Lists. Sets of a short list are compared pair by pair: first by parity sketches (a bit for each of some hash buckets, set
where the set has an odd number of elements there; two sets differ in at least as many elements as their sketches in bits),
which a list brings together, so that only pairs that pass are rows, then exactly. Long lists that have sets in common make up a group. Its sets are compared with one of them, its leader, only. Two
sets that are both connected with the leader are connected already. Where one is not, two sets that are similar to each
other share differences from the centre of the group, what most of its sets have; the leader is the set closest to it.
Lists by (group, shared difference) are the next round's lists. No long list is expanded into pairs, and pairs and lists
of sets that edges found so far connect are left out.

Texts with equal shingle sets are one node from the start, so copies cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, stored
from .hashed import mix, shingle_sets, slices

_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of the map of wanted set ids: 4 MB, whatever the input.
MAP_BITS = 1 << 25
#: Lists of up to SHORT sets are compared pair by pair; those of up to LONGEST too where they have few pairs for each set in all. Longer ones never are.
SHORT, PAIRS_A_SET, LONGEST = 64, 512, 256
#: Pairs of sketches that a task compares at once.
AT_ONCE = 1 << 18
#: Pairs (two 64-bit ids each) that are broadcast at most; more are joined by shuffling.
BROADCAST_PAIRS = 1_000_000
#: Sets from which the centre of a group is made, at least.
CENTRE = 32


def bands(p: int, q: int, up_to: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest size of each band, number of segments of its partition), for sizes up to ``up_to`` and one band more."""
    starts = [1]
    while starts[-1] <= up_to:
        starts.append(starts[-1] * q // p + 1)
    starts.append(starts[-1] * q // p + 1)
    largest = [s - 1 for s in starts[1:]]
    return np.array(starts[:-1]), np.array([(q - p) * (r + r * q // p) // (q + p) + 1 for r in largest])


class Segments:
    """One sorted set under the partition of ``band`` into ``m`` segments: the keys under which it is indexed."""

    def __init__(self, elems: np.ndarray, band: int, m: int) -> None:
        segment = ((elems >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        self.m, self.salt = m, np.uint64((band << 32) & 0xFFFFFFFFFFFFFFFF)
        self.full, self.at, self.size = np.unique(segment, return_index=True, return_counts=True)
        self.spread = mix(elems + np.uint64(0x51ED2701))
        self.sums = np.add.reduceat(self.spread, self.at)
        self.plain = self._key(self.full, self.sums)

    def _key(self, segment: np.ndarray, content: np.ndarray) -> np.ndarray:
        return mix(content ^ mix(segment.astype(np.uint64) + self.salt))

    def _subset(self, segment: int) -> np.ndarray:
        """Spread elements of the subset in a segment (counted round the ring)."""
        place = np.searchsorted(self.full, segment % self.m)
        there = place < len(self.full) and self.full[place] == segment % self.m
        return self.spread[self.at[place] : self.at[place] + self.size[place]] if there else self.spread[:0]

    def _gaps(self) -> tuple[np.ndarray, np.ndarray]:
        """(entries, empty segment of each): an empty segment with the subset in the next one, whole and less each element."""
        empty = np.setdiff1d(np.arange(self.m, dtype=np.uint64), self.full, assume_unique=True)
        if not len(empty):
            return empty, empty
        place = np.zeros(self.m, np.int64)
        place[self.full.astype(np.int64)] = np.arange(1, len(self.full) + 1)
        after = place[(empty.astype(np.int64) + 1) % self.m] - 1  # -1: empty too
        whole = np.where(after >= 0, self.sums[after], np.uint64(0))
        n = np.where(after >= 0, self.size[after], 0)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        less = np.repeat(whole, n) - self.spread[np.repeat(self.at[after], n) + nth]
        own = self._key(empty, np.full(len(empty), 7, np.uint64))
        return _with(np.concatenate((own, np.repeat(own, n))), np.concatenate((whole, less))), np.concatenate((empty, np.repeat(empty, n)))

    def entries(self) -> np.ndarray:
        """Index entries: the subset of each segment; of an empty one, the neighbourhood of that in the next."""
        return np.concatenate((self.plain, self._gaps()[0]))

    def refined(self, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries of empty segments that are in ``long``, the entries in their place)."""
        keys, of = self._gaps()
        hit = np.isin(keys, long) if self.m > 2 else np.zeros(len(keys), bool)
        out = [keys[:0]]
        for key, segment in zip(keys[hit], of[hit], strict=True):
            e = self._subset(int(segment) + 2)
            i, j = np.triu_indices(len(e), 1)
            total = e.sum(dtype=np.uint64)
            out.append(_with(np.full(1 + len(e) + len(i), key), np.concatenate(([total], total - e, total - e[i] - e[j]))))
        return keys[hit], np.concatenate(out)


def _with(key: np.ndarray, subset: np.ndarray) -> np.ndarray:
    """Keys combined with the sums of subsets."""
    return mix(key + _NEXT * mix(subset + _NEXT))


def entries(elems: np.ndarray, band: int, m: int) -> np.ndarray:
    """Index entries (uint64) of one sorted set under the partition of ``band`` into ``m`` segments."""
    return Segments(elems, band, m).entries()


def _own_bands(size: int, starts: np.ndarray, parts: np.ndarray) -> list[tuple[int, int]]:
    """(band, segments) under which a set of this size is indexed; with one segment, only equal sets are similar."""
    own = int(np.searchsorted(starts, size, "right")) - 1
    return [(band, int(parts[band])) for band in (own, own - 1) if band >= 0 and parts[band] > 1]


def _nodes(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, n (set size) and node (hash of the set; null for texts without words)."""
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), k)
                node = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(map(len, sets), pa.int64()), pa.array(node, pa.int64())], names=["key", "n", "node"])

    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, n long, node long")


def _entry_rows(df: DataFrame, text: str, k: int, p: int, q: int) -> DataFrame:
    """(entry, node) of all sets; a task sends the entries of equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        starts, parts = bands(p, q, 1 << 16)
        for whole in batches:
            for batch in slices(whole, "text"):
                got, nodes = [], []
                for s in shingle_sets(batch.column("text"), k):
                    if not len(s):
                        continue
                    node = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                    if node in seen:
                        continue
                    if len(seen) < 1 << 20:
                        seen.add(node)
                    if len(s) >= starts[-1]:
                        starts, parts = bands(p, q, 2 * len(s))
                    for band, m in _own_bands(len(s), starts, parts):
                        got.append(entries(s, band, m))
                        nodes.append(np.full(len(got[-1]), node, np.int64))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64)), pa.array(np.concatenate(nodes))], names=["entry", "node"])

    return df.select(F.col(text).alias("text")).mapInArrow(run, "entry long, node long")


def _refined(long: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """(list, node) that take the place of the long lists (list, node): those of empty segments are split, others stay."""
    by_node = long.groupBy("node").agg(F.collect_set("list").alias("long")).join(sets.select("node", "elems"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, parts = bands(p, q, 1 << 16)
        for batch in batches:
            got, nodes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for node, long_, elems in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                mine = long_.values.to_numpy(zero_copy_only=False).view(np.uint64)
                s = elems.values.to_numpy(zero_copy_only=False).view(np.uint64)
                if len(s) >= starts[-1]:
                    starts, parts = bands(p, q, 2 * len(s))
                each = [Segments(s, band, m).refined(mine) for band, m in _own_bands(len(s), starts, parts)]
                out = np.concatenate([np.setdiff1d(mine, np.concatenate([old for old, _ in each])), *[new for _, new in each]]) if each else mine
                got.append(out)
                nodes.append(np.full(len(out), node, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64)), pa.array(np.concatenate(nodes))], names=["list", "node"])

    return by_node.select("node", "long", "elems").mapInArrow(run, "list long, node long").distinct()


def _sketch(elems: np.ndarray) -> np.ndarray:
    """Parities of the elements' hash buckets as int64 words: 64 buckets or the next power of two above the set's size."""
    n_words = max(1, 1 << max(0, (len(elems) - 1).bit_length() - 6))
    at = (elems * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    odd = np.bincount((at % np.uint64(n_words * 64)).astype(np.int64), minlength=n_words * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wanted_sets(df: DataFrame, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """(node, n, sketch, elems) of the nodes in ``wanted``, once each.

    A bitmap of fixed size, broadcast, keeps nearly all other texts out of the shuffle; the semi-join is exact.
    """
    at = F.pmod(F.col("node"), F.lit(MAP_BITS))
    words = wanted.groupBy((at / 64).cast("long").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(node, {MAP_BITS}) % 64 AS INT))")).alias("b")).toPandas()
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    shared = df.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "text"):
                nodes, sets = [], []
                for s in shingle_sets(batch.column("text"), k):
                    if len(s):
                        node = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                        i = node % MAP_BITS
                        if (int(shared.value[i >> 6]) >> (i & 63)) & 1 and node not in seen:
                            if len(seen) < 1 << 20:
                                seen.add(node)
                            nodes.append(node)
                            sets.append(s)
                if nodes:
                    lists = pa.list_(pa.int64())
                    columns = [pa.array(nodes, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([_sketch(s) for s in sets], lists), pa.array([s.view(np.int64) for s in sets], lists)]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "sketch", "elems"])

    sets = df.select(F.col(text).alias("text")).mapInArrow(run, "node long, n long, sketch array<long>, elems array<long>")
    return sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("elems").alias("elems"))


def _fold(sketch: Column, words: Column) -> Column:
    """A sketch of twice as many words or as many, as one of ``words``: its halves xor-ed."""
    half = F.zip_with(F.slice(sketch, 1, words), F.slice(sketch, words + 1, words), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(sketch) > words, half).otherwise(sketch)


def _with_elems(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """leader, node, and their elements as a and b. Where the pairs are few enough to broadcast, only their sets are shuffled."""
    pairs = pairs.select("leader", "node")
    mine = sets.select("node", F.col("elems").alias("b"))
    theirs = sets.select(F.col("node").alias("leader"), F.col("elems").alias("a"))
    if pairs.count() <= BROADCAST_PAIRS:
        return theirs.join(F.broadcast(pairs.select("leader").distinct()), "leader", "left_semi").join(mine.join(F.broadcast(pairs), "node"), "leader")
    return pairs.join(mine, "node").join(theirs, "leader")


def _near(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (leader, node) that sizes and sketches don't rule out."""
    mine = sets.select("node", F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    theirs = sets.select(F.col("node").alias("leader"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    both = pairs.join(mine, "node").join(theirs, "leader").where((q * F.col("na") >= p * F.col("nb")) & (q * F.col("nb") >= p * F.col("na")))
    words = F.least(F.size("sa"), F.size("sb"))
    differ = F.aggregate(F.zip_with(_fold(F.col("sa"), words), _fold(F.col("sb"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return both.where((q + p) * differ <= (q - p) * (F.col("na") + F.col("nb"))).select("leader", "node")


def _similar(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Edges (a, b): the pairs that are similar, by counting common elements."""
    common = F.size(F.array_intersect("a", "b"))
    return _with_elems(pairs, sets).where(q * common >= p * (F.size("a") + F.size("b") - common)).select(F.col("leader").alias("a"), F.col("node").alias("b"))


def _labelled(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """(leader, node, linked): whether edges found so far connect them."""
    one = label.select("node", F.col("component").alias("_m"))
    two = label.select(F.col("node").alias("leader"), F.col("component").alias("_l"))
    return pairs.join(one, "node", "left").join(two, "leader", "left").select("leader", "node", (F.coalesce("_m", "node") == F.coalesce("_l", "leader")).alias("linked"))


def _grouped(lists: DataFrame, merge: bool) -> DataFrame:
    """(group, node) of the long lists (list, node). Merged lists that have sets in common are one group where they can be, so that a set is in few groups."""
    if not merge:
        same = F.struct(F.count(F.lit(1)).over(Window.partitionBy("list")), F.bit_xor(F.xxhash64("node")).over(Window.partitionBy("list")))
        return lists.select(F.xxhash64(same).alias("group"), "node").distinct()  # lists of the same sets are one
    w, own = Window.partitionBy("list"), Window.partitionBy("node")
    rows = lists.select("list", "node").withColumn("group", F.struct(F.count(F.lit(1)).over(own).alias("many"), "node"))
    for _ in range(4):
        rows = rows.withColumn("group", F.max("group").over(w)).withColumn("group", F.max("group").over(own))
    return rows.withColumn("group", F.max("group").over(w)["node"]).select("group", "node").distinct()


def _differences(groups: DataFrame, sets: DataFrame, p: int, q: int, work: Scratch) -> DataFrame:
    """(group, node, n, differ, far): what each set has more and less than the centre of its group, and how far it is from it.

    The centre has the elements that over half of a sample of the group's sets have; it is only what sets are compared
    with, so that sampling changes no result. ``differ`` has them, lost ones with the bits inverted, in one order for the
    whole group: first those that no two sets of the sample differ in, then the others, the most frequent last.
    ``far`` is (q+p)(differences) - (q-p)(size): two sets that are similar have at least half of both, over q+p, in common.
    """
    size = groups.groupBy("group").agg(F.count(F.lit(1)).alias("sets"), F.min("node").alias("first"))
    picked = groups.join(size, "group").where((F.pmod(F.xxhash64("group", "node"), F.greatest(F.floor(F.col("sets") / CENTRE), F.lit(1))) == 0) | (F.col("node") == F.col("first")))
    picked = work.stored(picked.select("group", "node"), "picked")
    held = picked.join(sets.select("node", "elems"), "node").select("group", F.explode("elems").alias("elem")).groupBy("group", "elem").agg(F.count(F.lit(1)).alias("held"))
    held = held.join(picked.groupBy("group").agg(F.count(F.lit(1)).alias("all")), "group").withColumn("own", F.col("held") * 2 > F.col("all"))
    place = F.struct(F.when(F.col("own"), F.col("all") - F.col("held")).otherwise(F.col("held")).alias("often"), F.when(F.col("own"), F.bitwise_not("elem")).otherwise(F.col("elem")).alias("elem"))
    centre = held.where("own OR held > 1").groupBy("group").agg(F.collect_list(F.when(F.col("own"), F.col("elem"))).alias("c"), F.array_sort(F.collect_list(place))["elem"].alias("last"))
    none = F.array().cast("array<long>")
    both = groups.join(sets.select("node", "n", "elems"), "node").join(centre, "group", "left").withColumns({"c": F.coalesce("c", none), "last": F.coalesce("last", none)})
    differ = F.concat(F.array_except("elems", "c"), F.transform(F.array_except("c", "elems"), F.bitwise_not))
    rows = both.select("group", "node", "n", "last", differ.alias("differ"))
    far = (q + p) * F.size("differ") - (q - p) * F.col("n")
    ordered = F.concat(F.array_except("differ", "last"), F.array_intersect("last", "differ"))
    out = work.stored(rows.select("group", "node", "n", ordered.alias("differ"), far.alias("far")), "differences")
    work.drop(picked)
    return out


def _apart(lists: DataFrame, label: DataFrame) -> DataFrame:
    """x: (node, component) of each list (list, node) that edges found so far don't connect, ordered; lists of the same sets once."""
    known = lists.join(label.select("node", "component"), "node", "left").select("list", F.struct("node", F.coalesce("component", "node").alias("component")).alias("x"))
    return known.groupBy("list").agg(F.array_sort(F.collect_list("x")).alias("x")).where("array_min(x.component) < array_max(x.component)").select("x").distinct()


def _unlinked_pairs(lists: DataFrame, label: DataFrame) -> DataFrame:
    """(leader, node): the pairs of sets of each list (list, node) that edges found so far don't connect."""
    others = lambda a, i: F.filter(F.slice(F.col("x"), i + 2, F.size("x")), lambda b: b["component"] != a["component"])
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(others(a, i), lambda b: F.struct(a["node"].alias("leader"), b["node"].alias("node")))))
    return _apart(lists, label).select(F.inline(pairs)).distinct()


def _runs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all pairs within lists of these sizes that stand one after the other, about AT_ONCE at a time."""
    own = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    after = np.repeat(sizes, sizes) - own - 1  # places behind each in its list
    ends = np.cumsum(after)
    start = 0
    while start < len(after):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
        n = after[start:stop]
        a = np.repeat(np.arange(start, stop), n)
        yield a, a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = stop


def _near_in_lists(lists: DataFrame, label: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The ``_unlinked_pairs`` that sizes and sketches don't rule out: they are compared where a list's sketches meet, so that only those left are rows."""
    each = _apart(lists, label).select(F.xxhash64("x.node").alias("list"), F.explode("x").alias("x")).select("list", "x.node", "x.component").distinct()
    slim = each.join(sets.select("node", "n", "sketch"), "node").groupBy("list").agg(F.collect_list(F.struct("node", "component", "n", "sketch")).alias("x")).select("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, x = batch.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), batch.column(0).flatten()
            node, component, n = (x.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            sketch = x.field(3)
            words, flat = sketch.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), sketch.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(words) - words
            for a, b in _runs(held):
                total = n[a] + n[b]
                may = (component[a] != component[b]) & (q * n[a] >= p * n[b]) & (q * n[b] >= p * n[a])
                a, b, most = a[may], b[may], ((q - p) * total[may]) // (q + p)
                least, near = np.minimum(words[a], words[b]), np.zeros(len(a), bool)
                for w in np.unique(least):
                    at = np.flatnonzero(least == w)
                    folded = []
                    for side in (a[at], b[at]):
                        place = starts[side][:, None] + np.arange(w)
                        twice = words[side] > w
                        bits = flat[place]
                        bits[twice] ^= flat[place[twice] + w]
                        folded.append(bits)
                    near[at] = np.bitwise_count((folded[0] ^ folded[1]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= most[at]
                one, two = node[a[near]], node[b[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["leader", "node"])

    return slim.mapInArrow(run, "leader long, node long").distinct()


def _shared_differences(rows: DataFrame, leaders: DataFrame, label: DataFrame, p: int, q: int) -> DataFrame:
    """(list, node) of the next round, of groups whose sets are not all connected.

    Let R not be connected with the leader, so not similar to it, and be similar to S. The leader is the set with the
    smallest ``far``. R's is above the leader's with the sign changed, as their distance is at most that of both from the
    centre; S's is at least the leader's. So the sum of both is positive: R and S have a difference from the centre in
    common, and at least half of the sum over q+p. All but (q-p)(size)/p of a set's differences are common too, as it has
    no more than that many elements that a similar set lacks, or the other way round. Nodes are listed under their
    differences: of ``x`` of them of which ``shared`` must be common, the first x - shared + 1 will do in any order that
    all sets of a group keep. A node with fewer can't be similar to any R. A list whose nodes are all connected is left out.
    """
    one = label.select("node", F.col("component").alias("_m"))
    two = label.select(F.col("node").alias("leader"), F.col("component").alias("_l"))
    known = rows.join(leaders, "group").join(one, "node", "left").join(two, "leader", "left")
    known = known.withColumn("component", F.coalesce("_m", "node")).withColumn("linked", F.col("component") == F.coalesce("_l", "leader"))
    group = known.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.when(~F.col("linked"), F.col("far"))).alias("apart"))
    known = known.join(group, "group").where("low < high")
    least = F.ceil((F.col("far") + F.when(F.col("linked"), F.col("apart")).otherwise(F.col("nearest"))) / (2 * (q + p)))
    shared = F.greatest(least, F.size("differ") - F.floor((q - p) * F.col("n") / p), F.lit(1)).cast("int")
    prefix = F.slice("differ", F.lit(1), F.greatest(F.size("differ") - shared + 1, F.lit(0)))
    each = known.select("group", "node", "component", F.explode(prefix).alias("elem"))
    w = Window.partitionBy("group", "elem")
    counted = each.withColumns({"often": F.count(F.lit(1)).over(w), "any": F.min("component").over(w) < F.max("component").over(w)})
    return counted.where("often > 1 AND any").select(F.xxhash64("group", "elem").alias("list"), "node").distinct()


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(node, component): the smallest node that ``edges`` (a, b) reach. Labels spread and jump until none changes."""
    both = work.stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "both")
    step = work.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        label, before = step.select("node", "component"), step
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jumped = spread.join(label.select(F.col("node").alias("new"), F.col("component").alias("further")), "new", "left").select("node", "old", F.least("new", F.coalesce("further", "new")).alias("component"))
        step = work.stored(jumped, "labels")
        work.drop(before)
        if step.where("old <> component").isEmpty():
            work.drop(both)
            return step


def _bound(pairs_left: float, n_sets: int) -> int:
    """Size up to which lists are expanded pair by pair in one row: a constant, however large the corpus is."""
    return SHORT if pairs_left > PAIRS_A_SET * n_sets else max(SHORT, LONGEST)


def connected(df: DataFrame, text: str, k: int, p: int, q: int) -> DataFrame:
    """(node, component) of the nodes that similar pairs connect with others.

    Elements are sent for few pairs only: first for one near pair of each node, then for the near pairs that those don't
    connect. All tables of a round are deleted when it is over.
    """
    spark, w = df.sparkSession, Window.partitionBy("list")
    with Scratch(spark, "jaccard") as work:
        rows = _entry_rows(df, text, k, p, q).withColumnRenamed("entry", "list")
        rows = rows.withColumns({"low": F.min("node").over(w), "high": F.max("node").over(w)}).where("low < high")
        lists = work.stored(rows.select("list", "node").distinct(), "lists")
        work.sweep()
        sets = work.stored(_wanted_sets(df, text, k, lists.select("node").distinct()), "sets")
        work.sweep()
        n_sets, first, merge, n_rows = sets.count(), True, True, None
        edges, label = None, spark.createDataFrame([], "node long, component long")
        while True:
            sized = work.stored(lists.withColumn("size", F.count(F.lit(1)).over(w)).where("size > 1"), "sized")
            work.drop(lists)
            if first:  # long lists of empty segments are split
                above = F.col("size") > SHORT
                split = work.stored(sized.where(~above).select("list", "node").union(_refined(sized.where(above), sets, p, q)), "refined")
                work.drop(sized)
                sized, first = work.stored(split.withColumn("size", F.count(F.lit(1)).over(w)).where("size > 1"), "sized"), False
                work.drop(split)
            pairs_left = sized.where(F.col("size").between(SHORT + 1, LONGEST)).agg(F.sum((F.col("size") - 1) / 2)).first()[0] or 0
            bound = _bound(pairs_left, n_sets)
            groups = work.stored(_grouped(sized.where(F.col("size") > bound), merge), "groups")
            n_before, n_rows = n_rows, groups.count()
            if n_before is not None and merge and 10 * n_rows > 9 * n_before:  # each list has fewer sets than the group it is from, but merged ones may be all of it again
                merge = False
            few = F.pmod(F.xxhash64("list"), F.lit(8)) == 0  # what an eighth of the lists connects is left out of the others
            of_lists, rows, leaders = [lambda part=part: _near_in_lists(sized.where((F.col("size") <= bound) & part), label, sets, p, q) for part in (few, ~few)], None, None  # noqa: B023
            if n_rows:
                rows = _differences(groups, sets, p, q, work)
                leaders = work.stored(rows.groupBy("group").agg(F.min_by("node", F.struct("far", "node")).alias("leader"), F.min("far").alias("nearest")), "leaders")
                long = rows.select("group", "node").join(leaders, "group").where("node <> leader").select("leader", "node").distinct()
                of_lists.insert(0, lambda: _near(long, sets, p, q))  # noqa: B023
            work.drop(groups)
            for pairs in of_lists:
                near = work.stored(pairs(), "near")
                if near.isEmpty():
                    work.drop(near)
                    continue
                for which in (near.groupBy("node").agg(F.min("leader").alias("leader")).select("leader", "node"), near):
                    asked = work.stored(_labelled(which, label).where("NOT linked"), "asked")
                    found = work.stored(_similar(asked, sets, p, q), "edges")
                    work.drop(asked)
                    if not found.isEmpty():
                        edges = found if edges is None else edges.union(found)
                        old, label = label, components(edges, work)
                        work.drop(old)
                work.drop(near)
                work.sweep()
            work.drop(sized)
            if rows is None:
                return stored(label.select("node", "component"), "jaccard-components")
            lists = work.stored(_shared_differences(rows, leaders, label, p, q), "lists")
            work.drop(rows, leaders)
            if lists.isEmpty():
                return stored(label.select("node", "component"), "jaccard-components")
            work.sweep()


def cluster(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, p: int = 85, q: int = 100) -> DataFrame:
    """key, n_shingles and component_id (the smallest key that links reach, itself included) of every row.

    Two texts link if q * (common shingles) >= p * (all shingles of both). Rows without words have no shingles and link
    with nothing; rows with equal texts are always linked; repeated rows are returned as often as they come. An empty
    table gives no rows. Of a component, rows with a null key are never the smallest unless all keys are null.
    """
    nodes = stored(_nodes(df, key, text, k), "jaccard-nodes")
    label = connected(df, text, k, p, q)
    by_node = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("least")).join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_component = by_node.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = by_node.select("node", "component").join(by_component, "component").select("node", "component_id")
    out = nodes.join(ids, "node", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """Rows of ``df`` whose key is the smallest of its component; rows without words all stay, rows with equal keys stay or go together."""
    keep = cluster(df, key, text, k, p, q).where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_keep")).distinct()
    return df.join(keep, df[key].eqNullSafe(keep["_keep"]), "left_semi")
