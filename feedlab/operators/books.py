"""Order books: checks, depth walks, closing books by windows, and the event-by-event rebuild."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold_events


def side_check(levels: DataFrame, keys: list[str], price: str, size: str, tick: Column) -> DataFrame:
    """Per book: levels, whether prices are unique, sizes positive, prices on the tick grid."""
    return levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("levels"), (F.count_distinct(price) == F.count(F.lit(1))).alias("unique_prices"), (F.min(size) > 0).alias("positive"), F.bool_and(F.col(price) % tick == 0).alias("on_grid"))


def snapshot_problems(bids: Column, asks: Column, tick: Column) -> Column:
    """Names of what is wrong with a snapshot's two arrays of (price, size): order, repeats, crossing, sizes, grid."""
    prices = lambda side: F.transform(side, lambda x: x["price"])
    rising = lambda side: prices(side) == F.array_sort(F.array_distinct(prices(side)))
    both = F.concat(bids, asks)
    return F.array_compact(F.array(
        F.when(~rising(F.reverse(bids)), "bids out of order"), F.when(~rising(asks), "asks out of order"),
        F.when(F.get(prices(bids), 0) > F.get(prices(asks), 0), "crossed"),
        F.when(F.exists(both, lambda x: x["size"] <= 0), "size"), F.when(F.exists(both, lambda x: x["price"] % tick != 0), "off grid"),
    ))


def depth_vwap(levels: DataFrame, keys: list[str], order: list, price: str, size: str, quantity: Column) -> DataFrame:
    """Walk levels best first until ``quantity`` is filled: filled quantity, VWAP (exact decimals, 18 places), levels used, status."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    take = F.least(F.greatest(quantity - before, F.lit(0)), F.col(size))
    rows = levels.withColumn("_take", take.cast("decimal(14,4)")).withColumn("_quantity", quantity.cast("decimal(14,4)"))
    out = rows.groupBy(*keys).agg(F.sum("_take").cast("decimal(24,4)").alias("filled"), F.sum(F.col("_take") * F.col(price)).alias("_gross"), F.count_if(F.col("_take") > 0).alias("levels_used"), F.max("_quantity").alias("_q"))
    vwap = (F.col("_gross").cast("decimal(24,8)") / F.col("filled")).cast("decimal(38,18)")
    return out.select(*keys, "filled", F.when(F.col("filled") > 0, vwap).alias("vwap"), "levels_used", F.when(F.col("filled") == F.col("_q"), "filled").otherwise("insufficient").alias("status"))


def closing_levels(feed: DataFrame, keys: list[str], snapshot: Column, side: Column, order: list[str], price: str = "price", size: str = "size") -> DataFrame:
    """Levels of each book after its last event: what its last snapshot set and later rows changed, sizes of zero out.

    ``feed`` has one row for each touched level; rows of a snapshot are marked by ``snapshot`` and share their order key.
    Only aggregates are used, which are made before the shuffle too, so that no book's rows meet in one task.
    """
    rows = feed.withColumns({"_side": side, "_snap": snapshot, "_at": F.struct(*order)}).where("_side IS NOT NULL")
    last = rows.groupBy(*keys).agg(F.max(F.when(F.col("_snap"), F.col("_at"))).alias("_last"))
    kept = rows.join(last, keys).where(F.col("_last").isNull() | (F.col("_at") >= F.col("_last")))
    return kept.groupBy(*keys, F.col("_side").alias("side"), price).agg(F.max_by(size, "_at").alias("size")).where("size > 0")


PRICE, SIZE = "decimal(18,4)", "decimal(18,6)"
BOOK_SCHEMA = f"seq long, event_id long, kind string, bids array<struct<price:{PRICE},size:{SIZE}>>, asks array<struct<price:{PRICE},size:{SIZE}>>, flags array<string>, regression boolean, gap boolean"


def reduce_row(state: dict, row: dict, gap_us: int) -> tuple[dict, dict | None]:
    """One feed row (kind book, price_change or another; bids, asks, price, size, side, received_us, source_us)."""
    flags = {"duplicate_event"} if row.get("had_duplicates") else set()
    regression = state["source"] is not None and row["source_us"] is not None and row["source_us"] < state["source"]
    gap = state["received"] is not None and row["received_us"] - state["received"] > gap_us
    if regression:
        flags.add("out_of_order")
    state["received"] = row["received_us"]
    state["source"] = row["source_us"] if row["source_us"] is not None else state["source"]
    if row["kind"] == "book":
        for name in ("bids", "asks"):
            state[name] = {}
            for level in row[name] if row[name] is not None else ():
                if level["size"] > 0:
                    state[name][level["price"]] = level["size"]
                else:
                    flags.add("non_positive_size")
        state["seen"] = True
    elif row["kind"] == "price_change":
        if not state["seen"]:
            flags.add("missing_initial_snapshot")
        levels = state["bids" if row["side"] == "BUY" else "asks"]
        if row["size"] < 0:
            flags.add("non_positive_size")
        elif row["size"] == 0:
            levels.pop(row["price"], None)
        else:
            levels[row["price"]] = row["size"]
    else:
        return state, None
    if state["bids"] and state["asks"] and max(state["bids"]) >= min(state["asks"]):
        flags.add("crossed_book")
    side = lambda name, best_first: [{"price": p, "size": Decimal(s)} for p, s in sorted(state[name].items(), reverse=best_first)]
    return state, {"event_id": row["event_id"], "kind": row["kind"], "bids": side("bids", True), "asks": side("asks", False), "flags": sorted(flags), "regression": regression, "gap": gap}


def ordered_rows(feed: DataFrame) -> DataFrame:
    """The feed without exact repeats (equal but for event_id), with received_us, source_us, had_duplicates and the content's _hash, by which rows of equal times are ordered."""
    content = [c for c in feed.columns if c != "event_id"]
    hashed = feed.withColumn("_hash", F.sha2(F.to_json(F.struct(*content)), 256))
    w = Window.partitionBy("_hash")
    once = hashed.withColumns({"_nth": F.row_number().over(w.orderBy("event_id")), "had_duplicates": F.count(F.lit(1)).over(w) > 1}).where("_nth = 1").drop("_nth")
    return once.withColumns({"received_us": F.unix_micros("received"), "source_us": F.unix_micros("source")}).drop("received", "source")


def rebuild_books(feed: DataFrame, keys: list[str], gap_ms: int = 60_000) -> DataFrame:
    """A book after each snapshot and delta of every stream in one job, with flags; input order does not matter.

    Exact duplicates (equal but for event_id) are applied once and flagged. Rows are put in the order (receive, source,
    content hash); state is two price maps a stream, and rows stream through the fold, so no stream is held in memory.
    """
    rows = ordered_rows(feed)
    start = lambda: {"bids": {}, "asks": {}, "seen": False, "received": None, "source": None}
    return fold_events(rows, keys, ["received_us", F.col("source_us").asc_nulls_last(), "_hash"], lambda s, r: reduce_row(s, r, gap_ms * 1000), start, BOOK_SCHEMA)
