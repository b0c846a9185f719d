"""Conversation prefix trie: shared beginnings of conversations, found with vertical bitmaps.

Conversations are dealt out to shards of consecutive ids. In a shard, each (position, turn) has a posting: the set of the
conversations with that turn there, as the bits of an integer. From the root on, depth first, the set of a node meets the
postings of the next position; what they share are the children, its bit count their members. Nodes of all shards with equal
paths are one node: members add up, the smallest conversation is the least of the shards'. Sums over subtrees add up in the
shards as well, once each node is counted in the shard of its smallest member alone.

A shard reads its conversations in blocks of positions and carries the nodes at the end of a block over to the next, so
that memory is bounded by the shard's conversations, however long one is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turns of a shard: conversations go to the shard of their first turn, so that it has no more conversations either.
SHARD_TURNS = 8192
#: Positions that a shard holds at once.
BLOCK = 64
_ROOT = bytes(16)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``nth``, the place of each row from 1 on. Ranges are sorted apart and start where those before them end."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    local = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("nth", F.col("_nth") + F.col("_before")).drop("_part", "_nth", "_before")


def turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, said, bytes): narrow rows; ``said`` stands for role and text, null ones being empty. Rows without a conversation go."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    said = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary")))
    return df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), said.alias("said"), F.octet_length(t).cast("long").alias("bytes"))


def rebuilt(rows: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """(shard, conv, pos, said, bytes, length): the turns of rebuilt conversations, and a row of position 0 for each conversation.

    A conversation takes the first ``head`` (at most ``most``) turns of the conversation ``base`` and then its own after as
    many. Turns are placed by their rank over all rows, so no conversation is sorted in one piece.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("said")]
    ranked = stored(numbered(rows, order, "trie-ranges").drop("turn"), "trie-ranks")
    own = ranked.groupBy("conv").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"))
    own = own.select("conv", "first", "n", F.floor((F.col("first") - 1) / SHARD_TURNS).alias("shard"), base.alias("base"), head.cast("long").alias("head"))
    whole = own.join(own.select(F.col("conv").alias("_b"), F.col("n").alias("_n")), F.col("base") == F.col("_b"), "left")
    whole = whole.withColumn("take", F.least("head", F.coalesce("_n", F.lit(0)))).withColumn("length", F.col("take") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    whole = stored(whole.select("conv", "first", "shard", "base", "head", "take", "length"), "trie-conversations")
    placed = ranked.join(whole, "conv").withColumn("pos", F.col("nth") - F.col("first") + 1)
    tail = placed.where(F.col("pos") > F.col("head")).select("shard", "conv", (F.col("pos") - F.col("head") + F.col("take")).alias("pos"), "said", "bytes")
    firsts = placed.where(F.col("pos") <= most).select(F.col("conv").alias("_from"), "pos", "said", "bytes")
    lent = firsts.join(whole.select("conv", "shard", "base", "head"), (F.col("_from") == F.col("base")) & (F.col("pos") <= F.col("head"))).select("shard", "conv", "pos", "said", "bytes")
    tops = whole.select("shard", "conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("said"), F.lit(0).cast("long").alias("bytes"), "length")
    return tops.unionByName(tail.unionByName(lent), allowMissingColumns=True)


class Shard:
    """The conversations of one shard, block by block."""

    def __init__(self, number: int) -> None:
        self.number, self.convs, self.place, self.ends, self.open = number, [], {}, {}, None

    def block(self, rows: list[tuple]) -> Iterator[dict]:
        """Nodes that end in the block of ``rows`` (conv, pos, said, bytes, length), sorted by (conv, pos)."""
        postings: dict[tuple, int] = {}
        said: dict[tuple, tuple] = {}
        on: dict[int, int] = {}
        for conv, pos, key, size, length in rows:
            if pos == 0:
                self.place[conv] = len(self.convs)
                self.ends[length] = self.ends.get(length, 0) | 1 << len(self.convs)
                self.convs.append(conv)
                continue
            bit = 1 << self.place[conv]
            postings[pos, key] = postings.get((pos, key), 0) | bit
            on[pos] = on.get(pos, 0) | bit
            said[self.place[conv], pos] = (key, size)
        stack = self.open
        if stack is None:
            stack = [((1 << len(self.convs)) - 1, _ROOT, 0)]
            yield self.node(stack[0][0], _ROOT, None, 0, 0)
        self.open = []
        while stack:
            members, node, depth = stack.pop()
            left = members & on.get(depth + 1, 0)
            while left:
                key, size = said[(left & -left).bit_length() - 1, depth + 1]
                child = members & postings[depth + 1, key]
                left &= ~child
                path = hashlib.md5(node + key).digest()
                yield self.node(child, path, node, depth + 1, size)
                (self.open if (depth + 1) % BLOCK == BLOCK - 1 else stack).append((child, path, depth + 1))

    def node(self, members: int, path: bytes, parent: bytes | None, depth: int, size: int) -> dict:
        ended, ends = members & self.ends.get(depth, 0), []
        while ended:
            ends.append(self.convs[(ended & -ended).bit_length() - 1])
            ended &= ended - 1
        return {"shard": self.number, "node": path, "parent": parent, "depth": depth, "bytes": size, "n": members.bit_count(), "first": self.convs[(members & -members).bit_length() - 1], "ends": ",".join(map(str, ends)) if ends else None}


_LOCAL = pa.schema([("shard", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("ends", pa.string())])


def _stream(batches: Iterator[pa.RecordBatch], columns: list[str], schema: pa.Schema, handle: Callable[[tuple], Iterator[dict]], end: Callable[[], Iterator[dict]]) -> Iterator[pa.RecordBatch]:
    """Rows through ``handle`` one by one; what it and, after the last row, ``end`` yield, in batches."""
    out: list[dict] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            out.extend(handle(row))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    out.extend(end())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def local_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of each shard's trie: (shard, node, parent, depth, bytes, n, first, ends), from the rows of ``rebuilt``."""
    columns = ["shard", "block", "conv", "pos", "said", "bytes", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, held = None, None, []

        def flush() -> Iterator[dict]:
            nonlocal held
            block, held = held, []
            if block:
                yield from shard.block(block)

        def handle(row: tuple) -> Iterator[dict]:
            nonlocal shard, at
            if row[:2] != at:
                yield from flush()
                if shard is None or shard.number != row[0]:
                    shard = Shard(row[0])
                at = row[:2]
            held.append(row[2:])

        yield from _stream(batches, columns, _LOCAL, handle, flush)

    blocks = rows.withColumn("block", F.floor(F.col("pos") / BLOCK)).select(*columns)
    return blocks.repartition("shard").sortWithinPartitions("shard", "block", "conv", "pos").mapInArrow(run, "shard long, node binary, parent binary, depth long, bytes long, n long, first long, ends string")


_SUMS = pa.schema([("node", pa.binary()), ("leaves", pa.int64()), ("saved", pa.int64())])


def subtree_sums(rows: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) from (shard, node, parent, depth, leaf, saved): each shard adds up from its deepest nodes on.

    The sums of the nodes whose parent is still to come are all that is held: one a conversation of the shard at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, sums = None, {}

        def handle(row: tuple) -> Iterator[dict]:
            nonlocal shard, sums
            number, node, parent, leaf, saved = row
            if number != shard:
                shard, sums = number, {}
            below = sums.pop(node, (0, 0))
            leaf, saved = leaf + below[0], saved + below[1]
            if parent is not None:
                above = sums.get(parent, (0, 0))
                sums[parent] = (above[0] + leaf, above[1] + saved)
            yield {"node": node, "leaves": leaf, "saved": saved}

        yield from _stream(batches, ["shard", "node", "parent", "leaf", "saved"], _SUMS, handle, lambda: iter(()))

    each = rows.repartition("shard").sortWithinPartitions("shard", F.col("depth").desc()).mapInArrow(run, "node binary, leaves long, saved long")
    return each.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


_ENDS = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])


def end_digests(local: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash of the ids of the conversations that end at a node. Shards hold consecutive ids, so their lists follow each other; they pass through the hash one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None

        def end() -> Iterator[dict]:
            if sha is not None:
                yield {"node": at, "ends_sha256": sha.hexdigest()}

        def handle(row: tuple) -> Iterator[dict]:
            nonlocal at, sha
            if sha is None or row[0] != at:
                yield from end()
                at, sha = row[0], hashlib.sha256(row[1].encode())
            else:
                sha.update(b"," + row[1].encode())

        yield from _stream(batches, ["node", "ends"], _ENDS, handle, end)

    return local.where("ends IS NOT NULL").select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard").mapInArrow(run, "node binary, ends_sha256 string")


def trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", base: Column | None = None, head: Column | None = None, most: int = 8) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, null first, those of equal turn by the MD5 of role and text; repeated rows are turns of
    their own. Null roles and texts are empty; rows of a null conversation are left out. Conversations whose rebuilt
    form has no turns are members of the root. Texts are compared whole. An empty table has no root and gives no rows;
    further columns are not looked at.
    """
    base = F.col("conv") - F.col("conv") % 5 if base is None else base
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 9 if head is None else head
    local = stored(local_nodes(rebuilt(turns(df, conv, turn, role, text), base, head, most)), "trie-local")
    nodes = local.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"))
    nodes = stored(nodes, "trie-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_of")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(children, F.col("node") == F.col("_of"), "left").select("node", "parent", "depth", "n_convs", "conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"))
    known = stored(known, "trie-known")
    flags = local.select("shard", "node", "parent", "depth", "bytes", "n", "first").join(known.select("node", "conv_id", "n_children"), "node")
    own = (F.col("first") == F.col("conv_id")).cast("long")
    sums = subtree_sums(flags.select("shard", "node", "parent", "depth", (own * (F.col("n_children") == 0).cast("long")).alias("leaf"), ((F.col("n") - own) * F.col("bytes")).alias("saved")))
    above = known.where("n_children > 0").select(F.col("node").alias("_above"), F.col("conv_id").alias("parent_conv_id"))
    out = known.join(sums, "node").join(end_digests(local), "node", "left").join(above, F.col("parent") == F.col("_above"), "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("conv_id").alias(conv), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
