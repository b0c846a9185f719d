"""Barrier labels over quotes, set-based, and the greedy removal of overlapping ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import first_at_or_after
from .fold import fold_events


def fresh(max_age_us: int) -> Column:
    """Whether a quote is active, two-sided and received within ``max_age_us`` of its source time."""
    return (F.col("state") == "ACTIVE") & F.col("bid").isNotNull() & F.col("ask").isNotNull() & (F.unix_micros("received") - F.unix_micros("source") <= max_age_us)


def usable_quotes(quotes: DataFrame, keys: list[str], max_age_us: int) -> DataFrame:
    """Fresh quotes of receive times at which no quote of the stream is suspended."""
    halted = quotes.where("state = 'SUSPENDED'").select(*keys, "received").distinct()
    return quotes.join(halted, [*keys, "received"], "left_anti").where(fresh(max_age_us))


#: Finest blocks of a horizon in the index of extremes, and how many blocks of one length make one of the next.
FINEST, FAN = 512, 8


def extremes(quotes: DataFrame, keys: list[str], finest_us: int, levels: int) -> DataFrame:
    """(keys, level, block, high, low): largest and smallest bid of each block of time, at block lengths that grow by ``FAN``.

    Longer blocks come from the rows of the shorter ones' sums, which partial aggregation makes before the shuffle.
    """
    at = F.floor(F.unix_micros("received") / finest_us)
    base = quotes.groupBy(*keys, at.alias("_b")).agg(F.max("bid").alias("high"), F.min("bid").alias("low"))
    each = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    block = F.floor(F.col("_b") / F.pow(F.lit(FAN), F.col("level"))).cast("long")
    return each.groupBy(*keys, "level", block.alias("block")).agg(F.max("high").alias("high"), F.min("low").alias("low"))


def _cover(first: Column, last: Column, levels: int) -> Column:
    """(level, block) of as few blocks as make up the finest blocks from ``first`` to ``last``; at most twice FAN a level."""
    kind = "array<struct<level:int,block:bigint>>"
    none = F.array().cast(kind)

    def run(level: int, low: Column, high: Column) -> Column:
        return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda b: F.struct(F.lit(level).alias("level"), b.cast("bigint").alias("block")))).otherwise(none)

    def step(level: int, low: Column, high: Column) -> Column:
        if level == levels - 1:
            return run(level, low, high)
        inner_low, inner_high = F.ceil(low / FAN).cast("bigint"), (F.floor((high + 1) / FAN) - 1).cast("bigint")  # blocks of the next length that are inside
        whole = inner_low <= inner_high
        ends = F.concat(run(level, low, inner_low * FAN - 1), run(level, (inner_high + 1) * FAN, high))
        return F.when(whole, F.concat(ends, F.element_at(F.transform(F.array(F.struct(inner_low.alias("l"), inner_high.alias("h"))), lambda x: step(level + 1, x["l"], x["h"])), 1))).otherwise(run(level, low, high))

    return step(0, first, last)


def touched_quotes(entries: DataFrame, quotes: DataFrame, keys: list[str], horizon_us: int) -> DataFrame:
    """Each entry (anchor_id, entry_at, entry_id, deadline, upper_price, lower_price) with the quotes of the first time at which a bid touches a barrier.

    An index of the bids' extremes over blocks of time is searched instead of the quotes: an entry looks at the few blocks
    that make up its time, takes the first with a bid at a barrier, and goes down to the finest block in it. Quotes are read in
    that block and in the two that entry and deadline cut.
    """
    levels = 1
    while FAN**levels < FINEST:
        levels += 1
    width = max(1, -(-horizon_us // FINEST))
    index = extremes(quotes, keys, width, levels)
    at = lambda c: F.floor(F.unix_micros(c) / width).cast("bigint")
    start, end = at("entry_at"), at("deadline")
    asked = entries.select(*keys, "anchor_id", "upper_price", "lower_price", start.alias("_start"), end.alias("_end"))
    crossed = (F.col("high") >= F.col("upper_price")) | (F.col("low") <= F.col("lower_price"))
    own = [*keys, "anchor_id", "upper_price", "lower_price"]
    span = lambda level: F.pow(F.lit(FAN), level).cast("bigint")

    def first(blocks: DataFrame) -> DataFrame:
        hit = blocks.join(index, [*keys, "level", "block"]).where(crossed)
        return hit.groupBy(*own).agg(F.min(F.struct((F.col("block") * span(F.col("level"))).alias("from"), "level", "block")).alias("b")).select(*own, "b.level", "b.block")

    found = first(asked.select(*own, F.explode(_cover(F.col("_start") + 1, F.col("_end") - 1, levels)).alias("c")).select(*own, "c.level", "c.block"))
    for _ in range(levels - 1):
        inside = F.when(F.col("level") > 0, F.sequence(F.col("block") * FAN, F.col("block") * FAN + FAN - 1)).otherwise(F.array("block"))
        found = first(found.select(*own, F.greatest(F.col("level") - 1, F.lit(0)).alias("level"), F.explode(inside).alias("block")))
    edges = asked.select(*keys, "anchor_id", F.explode(F.array_distinct(F.array("_start", "_end"))).alias("_b"))
    look = edges.unionByName(found.select(*keys, "anchor_id", F.col("block").alias("_b")))
    near = quotes.select(*keys, "received", "quote_id", "bid", at("received").alias("_b"))
    rows = look.join(near, [*keys, "_b"]).join(entries.select("anchor_id", "entry_at", "entry_id", "deadline", "upper_price", "lower_price"), "anchor_id")
    rows = rows.where((F.col("received") >= F.col("entry_at")) & (F.col("received") <= F.col("deadline")))
    later = (F.col("received") > F.col("entry_at")) | (F.col("quote_id") > F.col("entry_id"))
    return rows.where(later).withColumns({"_up": F.col("bid") >= F.col("upper_price"), "_down": F.col("bid") <= F.col("lower_price")}).where("_up OR _down")


def barrier_labels(anchors: DataFrame, quotes: DataFrame, keys: list[str], upper: str, lower: str, horizon_us: int, max_age_us: int, same_time: str = "AMBIGUOUS") -> DataFrame:
    """Each anchor (anchor_id, anchor) with entry, exit and outcome UPPER, LOWER, HORIZON or AMBIGUOUS; NO_ENTRY, NO_EXIT if there is none.

    Entry: the ask of the first usable quote in [anchor, anchor + horizon]. Barriers are on the bid, at entry x (1 + upper)
    and x (1 - lower), tested up to the deadline by groups of equal receive time; at or after the deadline the first usable
    quote is the HORIZON exit. A group that touches both is decided by ``same_time`` (UPPER_FIRST, LOWER_FIRST, AMBIGUOUS).
    """
    good = usable_quotes(quotes, keys, max_age_us).select(*keys, "received", "quote_id", "bid", "ask")
    due = anchors.withColumn("deadline", F.timestamp_micros(F.unix_micros("anchor") + horizon_us))
    entry = first_at_or_after(due, good.select(*keys, F.col("received").alias("entry_at"), F.col("quote_id").alias("entry_id"), F.col("ask").alias("entry_price")), keys, "anchor", "entry_at", ["entry_at", "entry_id", "entry_price"], tie="entry_id")
    inside = F.col("entry_at") <= F.col("deadline")
    entry = entry.withColumns({c: F.when(inside, F.col(c)) for c in ("entry_at", "entry_id", "entry_price")})
    one = F.lit("1").cast("decimal(5,4)")
    high = (F.col("entry_price") * (one + F.lit(upper).cast("decimal(5,4)"))).cast("decimal(24,8)")
    low = (F.col("entry_price") * (one - F.lit(lower).cast("decimal(5,4)"))).cast("decimal(24,8)")
    entry = entry.withColumns({"upper_price": high, "lower_price": low})
    touched = touched_quotes(entry.where("entry_at IS NOT NULL"), good.select(*keys, "received", "quote_id", "bid"), keys, horizon_us)
    group = touched.groupBy("anchor_id", "received").agg(F.bool_or("_up").alias("up"), F.bool_or("_down").alias("down"), F.min(F.when(F.col("_up"), F.struct("quote_id", "bid"))).alias("hit_up"), F.min(F.when(F.col("_down"), F.struct("quote_id", "bid"))).alias("hit_down"))
    first = group.groupBy("anchor_id").agg(F.min(F.struct("received", "up", "down", "hit_up", "hit_down")).alias("t"))
    after = first_at_or_after(entry.where("entry_at IS NOT NULL").withColumn("_after", F.when(F.col("entry_at") == F.col("deadline"), F.col("entry_id"))), good.select(*keys, F.col("received").alias("last_at"), F.col("quote_id").alias("last_id"), F.col("bid").alias("last_bid")), keys, "deadline", "last_at", ["last_at", "last_id", "last_bid"], tie="last_id", point_tie="_after", strict=False)
    # The entry itself may be the quote at the deadline; it cannot be its own exit.
    after = after.select("anchor_id", *[F.when(~((F.col("last_at") == F.col("entry_at")) & (F.col("last_id") == F.col("entry_id"))), F.col(c)).alias(c) for c in ("last_at", "last_id", "last_bid")])
    both = F.col("t.up") & F.col("t.down")
    use_up = F.when(both, F.lit(same_time == "UPPER_FIRST")).otherwise(F.col("t.up"))
    unclear = both & F.lit(same_time == "AMBIGUOUS")
    out = entry.join(first, "anchor_id", "left").join(after, "anchor_id", "left")
    outcome = F.when(F.col("entry_at").isNull(), "NO_ENTRY").when(unclear, "AMBIGUOUS").when(F.col("t").isNotNull(), F.when(use_up, "UPPER").otherwise("LOWER")).when(F.col("last_at").isNotNull(), "HORIZON").otherwise("NO_EXIT")
    hit = F.when(use_up, F.col("t.hit_up")).otherwise(F.col("t.hit_down"))
    exit_at = F.coalesce("t.received", "last_at")
    return out.select(*keys, "anchor_id", "anchor", "entry_at", "entry_id", "entry_price", outcome.alias("outcome"), F.when(outcome.isin("UPPER", "LOWER", "HORIZON", "AMBIGUOUS"), exit_at).alias("exit_at"), F.when(outcome == "HORIZON", F.col("last_id")).when(outcome.isin("UPPER", "LOWER"), hit["quote_id"]).alias("exit_id"), F.when(outcome == "HORIZON", F.col("last_bid")).when(outcome.isin("UPPER", "LOWER"), hit["bid"]).alias("exit_price"))


def drop_overlap(labels: DataFrame, keys: list[str], anchor: str, end: str, purge_us: int, embargo_us: int) -> DataFrame:
    """Keys and anchor_id of the labels kept: an anchor must be after the last kept window's end + purge + embargo. Sequential by key."""
    rows = labels.select(*keys, "anchor_id", F.unix_micros(anchor).alias("a"), F.unix_micros(end).alias("e"))

    def step(state: dict, row: dict) -> tuple[dict, dict | None]:
        if state["end"] is not None and row["a"] <= state["end"] + purge_us + embargo_us:
            return state, None
        return {"end": row["e"]}, {"anchor_id": row["anchor_id"]}

    return fold_events(rows, keys, ["a", "anchor_id"], step, lambda: {"end": None}, "anchor_id long")
