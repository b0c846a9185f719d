"""Benchmark decontamination with spaced seeds.

Fixed masks pick some of the tokens of a window and ignore the others, so a window still matches where an ignored
token was replaced. The seeds of the benchmark items (at every position) are joined to those of the documents; a hit
fixes how the two token sequences are aligned, and the overlap around it is then compared token by token, allowing
substitutions. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

#: Tokens that each mask reads, counted from the start of a window.
MASKS = ((0, 1, 3, 5, 7), (0, 2, 3, 4, 7), (0, 1, 4, 6, 7))
SPAN = 8
#: Read too where the benchmark has items of 8 or 10 tokens: those masks miss 2 of 8 and 1 of 45 placements of substitutions in them.
EXTRA = (0, 1, 2, 4, 6)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[^\p{L}\p{N}]+"))


def _lost(length: int, subs: int, masks: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Sets of ``subs`` places in a run of ``length`` tokens whose replacement leaves no window of any mask intact."""
    windows = [{i + k for k in mask} for mask in masks for i in range(length - mask[-1])]
    return [s for s in combinations(range(length), subs) if not any(w.isdisjoint(s) for w in windows)]


def masks_for(lengths: list[int], identity: float) -> list[tuple[tuple[int, ...], int | None]]:
    """(mask, item length or None) pairs that find every run of the given lengths with all substitutions that ``identity`` allows.

    Runs of 8 and more tokens share the fixed masks; where those lose a placement, ``EXTRA`` is added, and what that
    loses too gets a mask of its own. Shorter items get masks of all that may be left of them, for items of that length alone.
    """
    out, shared = [], list(MASKS) if any(n >= SPAN for n in lengths) else []
    for n in sorted(lengths):
        subs = n - math.ceil(identity * n)
        if n < SPAN:
            kept = [tuple(k for k in range(n) if k not in s) for s in combinations(range(n), subs)]
            out += [(tuple(k - x[0] for k in x), n) for x in dict.fromkeys(kept)]
        else:
            if EXTRA not in shared and _lost(n, subs, shared):
                shared.append(EXTRA)
            for s in _lost(n, subs, shared):
                kept = [k for k in range(n) if k not in s]
                shared.append(tuple(k - kept[0] for k in kept))
    return [(m, None) for m in dict.fromkeys(shared)] + list(dict.fromkeys(out))


def _seeds(h: Column, masks: list[tuple[tuple[int, ...], int | None]], step: int, own: bool) -> Column:
    """(seed, position) of the masks at every ``step``-th position where they fit; ``own`` leaves out masks for other lengths than that of ``h``."""
    empty = F.array().cast("array<struct<seed:bigint,pos:int>>")

    def at(group: list[tuple[int, tuple[int, ...]]], span: int) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(h) - span, F.lit(step)), lambda i: F.array(*[F.struct(F.xxhash64(F.lit(m), *[F.get(h, i + k) for k in mask]).alias("seed"), i.alias("pos")) for m, mask in group])))

    groups: dict[tuple[int, int | None], list] = {}
    for m, (mask, length) in enumerate(masks):
        groups.setdefault((mask[-1] + 1, length), []).append((m, mask))
    parts = [F.when((F.size(h) >= span) & (F.lit(True) if length is None or not own else F.size(h) == length), at(group, span)).otherwise(empty) for (span, length), group in groups.items()]
    return F.concat(empty, *parts)


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", step: int = 1, run: int = 13, identity: float = 0.8) -> DataFrame:
    """Verified overlaps: key, item key, ``offset`` (document token of the item's first), ``overlap``, ``matched``, ``hits``.

    An item overlaps a document where, in one alignment, some ``run`` consecutive tokens (all of a shorter item) agree in
    at least the share ``identity``; the best alignment of each pair is returned, one row a pair. ``overlap`` counts the
    item's tokens that lie inside the document, ``matched`` those that agree. Documents and items
    are probed at every position, with masks for all substitutions that the rule accepts (a ``step`` over 1 misses some
    documents). Empty items are never found. Null texts have no tokens; rows with equal key and text are one document; empty tables give no rows.
    """
    item = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item"), tokens(F.col(item_text)).alias("it")).where(F.size("it") > 0)
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    masks = masks_for([r[0] for r in item.select(F.least(F.size("it"), F.lit(run)).alias("n")).distinct().orderBy("n").collect()], identity)  # at most ``run`` lengths
    i_seed = let(hashed(F.col("it")), lambda h: _seeds(h, masks, 1, own=True))
    index = stored(item.select("item", F.explode(i_seed).alias("s")).select("item", F.col("s.seed").alias("seed"), F.col("s.pos").alias("ipos")), "decontam-index")
    doc_tokens = tokens(F.col(text))
    text_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    probe = let(hashed(doc_tokens), lambda h: _seeds(h, masks, step, own=False))
    rows = docs.select(F.col(key).alias("k"), text_hash.alias("t"), F.explode(probe).alias("s")).select("k", "t", F.col("s.seed").alias("seed"), F.col("s.pos").alias("pos"))
    aligned = rows.join(index, "seed").groupBy("k", "t", "item", (F.col("pos") - F.col("ipos")).alias("offset")).agg(F.count(F.lit(1)).alias("hits"))
    # Hits are few next to the documents. They are written first, so that Spark knows their size when it plans the way back to the texts.
    hits = stored(aligned, "decontam-hits")
    need = hits.groupBy("k", "t").agg(F.collect_set("item").alias("items"))
    texts = docs.select(F.col(key).alias("k"), text_hash.alias("t"), F.col(text).alias("x"))
    texts = texts.join(need.select(F.col("k").alias("nk"), F.col("t").alias("nt")), texts["k"].eqNullSafe(F.col("nk")) & (F.col("t") == F.col("nt")), "left_semi").dropDuplicates(["k", "t"]).select(F.col("k").alias("xk"), F.col("t").alias("xt"), tokens(F.col("x")).alias("dt"))
    pair = hits.join(texts, hits["k"].eqNullSafe(texts["xk"]) & (hits["t"] == texts["xt"])).join(item, "item")
    same = F.transform("it", lambda x, j: F.coalesce(F.get(F.col("dt"), F.when(j + F.col("offset") >= 0, j + F.col("offset"))) == x, F.lit(False)))
    length = F.least(F.size("it"), F.lit(run))
    best = lambda s: F.array_max(F.transform(F.sequence(F.lit(1), F.size(s) - length + 1), lambda i: F.size(F.filter(F.slice(s, i, length), lambda x: x))))
    inside = F.least(F.size("it"), F.size("dt") - F.col("offset")) - F.greatest(F.lit(0), -F.col("offset"))
    checked = pair.select(F.col("k").alias(key), F.col("item").alias(item_key), F.col("offset").cast("long").alias("offset"), "hits", length.alias("need"), inside.cast("long").alias("overlap"), let(same, lambda s: F.struct(best(s).alias("best"), F.size(F.filter(s, lambda x: x)).cast("long").alias("matched"))).alias("c"))
    good = checked.where(F.col("c.best") >= F.ceil(identity * F.col("need"))).withColumn("matched", F.col("c.matched"))
    top = good.groupBy(key, item_key).agg(F.max(F.struct("matched", "overlap", "hits", "offset")).alias("b"))
    return top.select(key, item_key, "b.offset", "b.overlap", "b.matched", "b.hits")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose key has a verified overlap with an item; rows with a null key are judged together."""
    found = overlaps(docs, items, key, text, **options).select(F.col(key).alias("_bad")).distinct()
    found = stored(found, "decontam-found")
    return docs.join(found, docs[key].eqNullSafe(found["_bad"]), "left_anti")
