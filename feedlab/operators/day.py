"""Reconstruction of whole days: books of every stream rebuilt in time slices, in parallel even within one stream.

What a slice of rows does to a book is small: whether it has a snapshot, and the last size of each price after that. Such
summaries put in sequence give the book at the start of every slice, from which the slice's rows are replayed on their own.
Digests are made the same way: of a slice's books in order, of a stream's slices, and of all streams by a tree.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import books
from .fold import fold_events
from .joins import beside

HOUR_US = 3_600_000_000


def _at() -> Column:
    """Place of a row in its stream, as a value that can be compared."""
    return F.struct(F.col("received_us"), F.col("source_us").isNull(), F.col("source_us"), F.col("_hash"))


def slice_summaries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a stream and slice: what comes before it (seen, received, source, place) and after it (next reset, all slices)."""
    given = F.col("kind").isin("book", "price_change")
    each = rows.groupBy(*keys, "slice").agg(
        F.count_if(given).alias("n"), F.bool_or(F.col("kind") == "book").alias("reset"), F.max("received_us").alias("last_received"), F.max_by("source_us", F.when(F.col("source_us").isNotNull(), _at())).alias("last_source"),
    )
    w = Window.partitionBy(*keys).orderBy("slice")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return each.select(
        *keys, "slice", F.coalesce(F.max("reset").over(before), F.lit(False)).alias("seen"), F.max("last_received").over(before).alias("received_before"), F.last("last_source", ignorenulls=True).over(before).alias("source_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("place"), F.min(F.when(F.col("reset"), F.col("slice"))).over(after).alias("next_reset"), F.collect_list("slice").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("slices"),
    )


def carried_levels(rows: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slice, bids, asks): the book of each stream at the start of each slice, where it has levels."""
    both = [*keys, "slice"]
    level = lambda c, side: F.transform(F.coalesce(c, F.array().cast(f"array<struct<price:{books.PRICE},size:{books.SIZE}>>")), lambda x, i: F.struct(F.lit(side).alias("side"), x["price"].cast(books.PRICE).alias("price"), x["size"].cast(books.SIZE).alias("size"), i.alias("i")))
    one = F.array(F.struct(F.when(F.col("side") == "BUY", "bids").otherwise("asks").alias("side"), F.col("price").cast(books.PRICE).alias("price"), F.col("size").cast(books.SIZE).alias("size"), F.lit(0).alias("i")))
    touched = F.when(F.col("kind") == "book", F.filter(F.concat(level(F.col("bids"), "bids"), level(F.col("asks"), "asks")), lambda x: x["size"] > 0)).when((F.col("kind") == "price_change") & (F.col("size") >= 0), one)
    reset = rows.groupBy(*both).agg(F.max(F.when(F.col("kind") == "book", _at())).alias("_reset"))
    changes = beside(rows.select(*both, _at().alias("_at"), F.explode(touched).alias("x")), reset, both).where(F.col("_reset").isNull() | (F.col("_at") >= F.col("_reset")))
    last = changes.groupBy(*both, "x.side", "x.price").agg(F.max_by("x.size", F.struct("_at", "x.i")).alias("size"))
    changed_again = F.lead("slice").over(Window.partitionBy(*keys, "side", "price").orderBy("slice"))
    held = beside(last.withColumn("_again", changed_again).where("size > 0"), summaries.select(*both, "next_reset", "slices"), both)
    until = F.least("_again", "next_reset")  # the slice that changes or clears it still starts with it
    lived = held.withColumn("_s", F.explode(F.filter("slices", lambda s: (s > F.col("slice")) & (until.isNull() | (s <= until)))))
    side = lambda name: F.collect_list(F.when(F.col("side") == name, F.struct("price", "size"))).alias(name)
    return lived.groupBy(*keys, F.col("_s").alias("slice")).agg(side("bids"), side("asks"))


def _sliced(feed: DataFrame, keys: list[str], slice_us: int) -> DataFrame:
    """Rows of all slices, each slice headed by a row with its start."""
    rows = books.ordered_rows(feed).withColumn("slice", F.floor(F.col("received_us") / slice_us))
    summaries = slice_summaries(rows, keys)
    start = carried_levels(rows, summaries, keys)
    heads = beside(summaries, start, [*keys, "slice"], "left").select(*keys, "slice", F.lit("start").alias("kind"), "bids", "asks", "seen", F.col("received_before").alias("received_us"), F.col("source_before").alias("source_us"), F.col("place").cast("long"), F.lit(0).alias("_first"))
    return rows.withColumn("_first", F.lit(1)).unionByName(heads, allowMissingColumns=True)


def _replay(feed: DataFrame, keys: list[str], slice_us: int, reduce, out: str, finish=None) -> DataFrame:
    order = ["_first", "received_us", F.col("source_us").asc_nulls_last(), "_hash"]
    return fold_events(_sliced(feed, keys, slice_us), [*keys, "slice"], order, reduce, dict, out, finish)


def _begin(row: dict) -> dict:
    side = lambda name: {x["price"]: x["size"] for x in row[name] or ()}
    return {"bids": side("bids"), "asks": side("asks"), "seen": row["seen"], "received": row["received_us"], "source": row["source_us"]}


def rebuild_sliced(feed: DataFrame, keys: list[str], gap_ms: int = 60_000, slice_us: int = HOUR_US) -> DataFrame:
    """The rows of ``books.rebuild_books``, with the slice, from slices that are replayed apart: a stream's rows are spread over tasks."""

    def reduce(state: dict, row: dict) -> tuple[dict, dict | None]:
        if row["kind"] == "start":
            return {"book": _begin(row), "place": row["place"]}, None
        state["book"], given = books.reduce_row(state["book"], row, gap_ms * 1000)
        if given is None:
            return state, None
        state["place"] += 1
        return state, {**given, "seq": state["place"]}

    return _replay(feed, keys, slice_us, reduce, books.BOOK_SCHEMA)


COUNTS = ("states", "snapshots", "deltas", "regressions", "gaps", "missing_initial", "crossed", "non_positive", "duplicated")
_FLAGS = {"missing_initial": "missing_initial_snapshot", "crossed": "crossed_book", "non_positive": "non_positive_size", "duplicated": "duplicate_event"}


def _add(n: dict, sha, row: dict, given: dict) -> None:
    """Counts a state and appends it to its slice's digest."""
    n["states"] += 1
    n["snapshots" if given["kind"] == "book" else "deltas"] += 1
    n["regressions"] += given["regression"]
    n["gaps"] += given["gap"]
    for c, flag in _FLAGS.items():
        n[c] += flag in given["flags"]
    side = lambda name: [[f"{x['price']:f}", f"{x['size']:f}"] for x in given[name]]
    sha.update(json.dumps([given["kind"], row["received_us"], side("bids"), side("asks"), given["flags"]], separators=(",", ":")).encode() + b"\n")


def slice_reports(feed: DataFrame, keys: list[str], gap_ms: int = 60_000, slice_us: int = HOUR_US) -> DataFrame:
    """Per stream and slice: counts of ``COUNTS``, and the SHA-256 of its books in order (flags, prices and sizes of every state)."""

    def reduce(state: dict, row: dict) -> tuple[dict, None]:
        if row["kind"] == "start":
            return {"book": _begin(row), "n": dict.fromkeys(COUNTS, 0), "sha": hashlib.sha256()}, None
        state["book"], given = books.reduce_row(state["book"], row, gap_ms * 1000)
        if given is not None:
            _add(state["n"], state["sha"], row, given)
        return state, None

    return _replay(feed, keys, slice_us, reduce, ", ".join(f"{c} long" for c in COUNTS) + ", digest string", lambda s: {**s["n"], "digest": s["sha"].hexdigest()})


#: Rows of a stream up to which it is replayed from its first row to its last instead of slice by slice.
MOST_ROWS = 100_000
_READ = ("input_events", "semantic_events")


def _whole_reports(feed: DataFrame, keys: list[str], gap_us: int, slice_us: int) -> DataFrame:
    """The rows of ``day_report`` for streams that are short: one shuffle, one pass, a stream's slices one after another.

    Exact repeats follow each other in the order of the pass: the first is applied, the others are counted.
    """
    content = [c for c in feed.columns if c != "event_id"]
    hashed = feed.withColumn("_hash", F.sha2(F.to_json(F.struct(*content)), 256)).withColumns({"received_us": F.unix_micros("received"), "source_us": F.unix_micros("source")}).drop("received", "source")
    order = [F.col("received_us").asc(), F.col("source_us").asc_nulls_last(), F.col("_hash").asc(), F.col("event_id").asc()]
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = hashed.withColumns({"slice": F.floor(F.col("received_us") / slice_us), "repeat": F.coalesce(F.lag("_hash").over(w) == F.col("_hash"), F.lit(False)), "had_duplicates": F.coalesce(F.lead("_hash").over(w) == F.col("_hash"), F.lit(False))})

    def start() -> dict:
        return {"book": {"bids": {}, "asks": {}, "seen": False, "received": None, "source": None}, "n": dict.fromkeys((*_READ, *COUNTS), 0), "slice": (), "sha": None, "all": hashlib.sha256()}

    def close(state: dict) -> None:
        if state["sha"] is not None:
            first = state["n"]["closed"] == 0
            state["n"]["closed"] += 1
            own = [*map(str, (x for x in state["slice"] if x is not None)), state["sha"].hexdigest()]
            state["all"].update((("" if first else ",") + ":".join(own)).encode())

    def reduce(state: dict, row: dict) -> tuple[dict, None]:
        n = state["n"]
        n["input_events"] += 1
        if row["repeat"]:
            return state, None
        n["semantic_events"] += 1
        if state["slice"] != (row["slice"],):
            n.setdefault("closed", 0)
            close(state)
            state["slice"], state["sha"] = (row["slice"],), hashlib.sha256()
        state["book"], given = books.reduce_row(state["book"], row, gap_us)
        if given is not None:
            _add(n, state["sha"], row, given)
        return state, None

    def finish(state: dict) -> dict:
        close(state)
        return {**{c: state["n"][c] for c in (*_READ, *COUNTS)}, "digest": state["all"].hexdigest()}

    used = rows.select(*keys, "event_id", "kind", "bids", "asks", "price", "size", "side", "received_us", "source_us", "_hash", "slice", "repeat", "had_duplicates")
    return fold_events(used, keys, order, reduce, start, ", ".join(f"{c} long" for c in (*_READ, *COUNTS)) + ", digest string", finish, dealt=True)


def day_report(feed: DataFrame, keys: list[str], gap_ms: int = 60_000, slice_us: int = HOUR_US) -> DataFrame:
    """Per stream: input_events, semantic_events (without repeats), the counts of ``COUNTS``, and the digest of its slices in order.

    Streams of more than MOST_ROWS rows are rebuilt in slices that run in parallel; the others, whose slices may have a
    row or two, from their first row to their last. Both give the same.
    """
    sized = feed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = stored(sized.where(F.col("_rows") > MOST_ROWS).select(*keys), "large-streams")
    if large.isEmpty():
        return _whole_reports(feed, keys, gap_ms * 1000, slice_us)
    feed = feed.withColumns({f"_{c}_k": F.col(c) for c in keys})
    both = [F.col(f"_{c}_k").eqNullSafe(F.col(f"_{c}_l")) for c in keys]
    named = large.withColumnsRenamed({c: f"_{c}_l" for c in keys})
    part = lambda how: feed.join(named, reduce(lambda a, b: a & b, both), how).drop(*[f"_{c}_k" for c in keys])
    return _whole_reports(part("left_anti"), keys, gap_ms * 1000, slice_us).union(_sliced_reports(part("left_semi"), keys, gap_ms, slice_us))


def _sliced_reports(feed: DataFrame, keys: list[str], gap_ms: int, slice_us: int) -> DataFrame:
    """The rows of ``day_report`` from slices that are replayed apart."""
    slices = slice_reports(feed, keys, gap_ms, slice_us)
    digests = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slice", "digest"))), lambda s: F.concat_ws(":", s["slice"].cast("string"), s["digest"])), ",")
    markets = slices.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS], F.sha2(digests.cast("binary"), 256).alias("digest"))
    content = [c for c in feed.columns if c != "event_id"]
    once = feed.groupBy(*keys, F.sha2(F.to_json(F.struct(*content)), 256).alias("_hash")).agg(F.count(F.lit(1)).alias("n"))
    read = once.groupBy(*keys).agg(F.sum("n").alias("input_events"), F.count(F.lit(1)).alias("semantic_events"))
    return beside(markets, read, keys).select(*keys, "input_events", "semantic_events", *COUNTS, "digest")


def day_digest(report: DataFrame, keys: list[str]) -> DataFrame:
    """One row: streams, events and a digest of all streams' reports, as a tree of three levels over the hash of the stream."""
    leaf = F.sha2(F.to_json(F.struct(*report.columns)), 256)
    place = F.sha2(F.to_json(F.struct(*keys)), 256)
    rows = report.select(place.alias("at"), leaf.alias("hash"), "input_events", "semantic_events", "states")
    counts = [F.sum(c).alias(c) for c in ("input_events", "semantic_events", "states")]
    n = F.count(F.lit(1)).alias("streams")
    for digits, count in ((3, n), (1, F.sum("streams").alias("streams")), (0, F.sum("streams").alias("streams"))):
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]), "")
        rows = rows.groupBy(F.substring("at", 1, digits).alias("at")).agg(F.sha2(joined.cast("binary"), 256).alias("hash"), count, *counts)
    return rows.select("streams", "input_events", "semantic_events", "states", F.col("hash").alias("day_digest"))
