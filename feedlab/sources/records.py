"""Checks and summaries of captured records: pages, trades, candles, fills, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fills_summary(df: DataFrame, by: str, price: str, amount: str, key: str) -> DataFrame:
    """Per group: rows, rows out of domain (price in [0, 1], amount >= 0), keys, summed amount."""
    good = F.col(price).between(0, 1) & (F.col(amount) >= 0)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~good).alias("n_bad"), F.count_distinct(key).alias("n_keys"), F.sum(F.col(amount).cast("decimal(12,2)")).cast("decimal(22,2)").alias("quantity"))


def trade_windows(df: DataFrame, key: str, ts: str, start: Column, end: Column, page_cap: int) -> DataFrame:
    """Per key: rows, rows outside [start, end), whether the page cap was reached."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if((F.col(ts) < start) | (F.col(ts) >= end)).alias("n_outside"), (F.count(F.lit(1)) >= page_cap).alias("page_cap_hit"))


def monotone(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """``df`` with ``not_rising``: the value is not above the one before it in its series."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("not_rising", F.coalesce(F.col(value) <= before, F.lit(False)))


def contiguity(df: DataFrame, keys: list[str], index: str, first: int = 1) -> DataFrame:
    """Per key: rows, and rows whose index is not their place counted from ``first``."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(index)) - 1 + first
    return df.select(*keys, (F.col(index) != nth).alias("bad")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("bad").alias("n_bad"))


def page_chain(df: DataFrame, resource: str, order: str, request: str, response: str) -> DataFrame:
    """Per resource: pages, links where a page's request cursor is not the response cursor before it, and whether the last page ends the chain."""
    w = Window.partitionBy(resource).orderBy(order)
    rows = df.withColumns({"_before": F.lag(response).over(w), "_last": F.lead(order).over(w).isNull(), "_first": F.lag(order).over(w).isNull()})
    return rows.groupBy(resource).agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("_first") & ~F.col(request).eqNullSafe(F.col("_before"))).alias("broken"), F.bool_or(F.col("_last") & (F.coalesce(response, F.lit("")) == "")).alias("complete"))


def verify_segments(df: DataFrame, session: str, ordinal: str, payload64: Column, digest: Column, first: int = 0) -> DataFrame:
    """Per session: records, payloads whose hash is not the recorded one, ordinals that are not contiguous."""
    nth = F.row_number().over(Window.partitionBy(session).orderBy(ordinal)) - 1 + first
    rows = df.select(session, (F.sha2(F.unbase64(payload64), 256) != digest).alias("bad"), (F.col(ordinal) != nth).alias("gap"))
    return rows.groupBy(session).agg(F.count(F.lit(1)).alias("records"), F.count_if("bad").alias("bad_hashes"), F.count_if("gap").alias("bad_ordinals"))


def record_inventory(lines: DataFrame, line: str) -> DataFrame:
    """Per record type (first comma field): records, and the numbers of fields that occur."""
    parts = F.split(F.col(line), ",")
    return lines.select(F.get(parts, 0).alias("type"), F.size(parts).alias("arity")).groupBy("type").agg(F.count(F.lit(1)).alias("records"), F.array_join(F.array_sort(F.collect_set("arity")).cast("array<string>"), ",").alias("arities"))


def flatten_history(pages: DataFrame, page: str, rows: str, ident: str) -> DataFrame:
    """(ident, row, first_page, n_seen, conflict): the rows of all pages once each, by their stable id.

    The first of a row's places (page, then place in it) is kept; ``conflict`` says that its repeats differ. Rows without an
    id are left out. Only aggregates with partial sums are used, so an id that every page repeats makes no large group.
    """
    each = pages.select(F.col(page).alias("_page"), F.posexplode(rows).alias("_pos", "row")).withColumn(ident, F.col(f"row.{ident}")).where(F.col(ident).isNotNull())
    content = F.sha2(F.to_json("row"), 256)
    return each.groupBy(ident).agg(F.min_by("row", F.struct("_page", "_pos")).alias("row"), F.min("_page").alias("first_page"), F.count(F.lit(1)).alias("n_seen"), (F.min(content) != F.max(content)).alias("conflict"))


#: Lengths of candles in minutes.
CANDLE_MINUTES = (1, 60, 1440)


def candle_problems(df: DataFrame, keys: list[str], end_ts: str, minutes: str, start: Column, end: Column) -> DataFrame:
    """``df`` with ``problems``: interval (not a length of candles), off_grid, outside (not in (start, end]), not_rising (its end isn't above the one before)."""
    before = F.lag(end_ts).over(Window.partitionBy(*keys).orderBy(end_ts))
    at = F.col(end_ts)
    wrong = [("interval", ~F.col(minutes).isin(*CANDLE_MINUTES)), ("off_grid", at % (F.col(minutes) * 60) != 0), ("outside", (at <= start) | (at > end)), ("not_rising", at <= before)]
    return df.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(name != "not_rising")), name) for name, bad in wrong])))
