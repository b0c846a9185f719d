"""Windows over play-by-play: running sums, carried context, next-row checks, counters and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], seq: str, sums: dict[str, Column], resets: dict[str, Column] | None = None, reset_by: list[str] | None = None) -> DataFrame:
    """``df`` with cumulative sums by key, and others that restart with each of ``reset_by`` as well."""
    whole = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    part = Window.partitionBy(*keys, *(reset_by or [])).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({**{n: F.sum(c).over(whole) for n, c in sums.items()}, **{n: F.sum(c).over(part) for n, c in (resets or {}).items()}})


def carry_forward(df: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """``df`` with nulls of the columns replaced by the last value before them."""
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def first_per_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in ``order``, which must be total within a group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def next_row_check(df: DataFrame, keys: list[str], seq: str, by: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Per group: rows with a successor, and how often a field equals the successor's ``before`` field."""
    w = Window.partitionBy(*keys).orderBy(seq)
    rows = df.select(by, F.lead(seq).over(w).alias("_s"), *[(F.col(a) == F.lead(b).over(w)).alias(n) for n, (a, b) in fields.items()]).where("_s IS NOT NULL")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(n).alias(n) for n in fields])


def counter_delta(df: DataFrame, keys: list[str], seq: str, counter: str, full: int, reset: Column) -> DataFrame:
    """``df`` with ``delta_class`` of a counter against the row before: first, none, charge, reset or illegal."""
    w = Window.partitionBy(*keys).orderBy(seq)
    d = F.col(counter) - F.lag(counter).over(w)
    kind = F.when(d.isNull(), "first").when(reset & (F.col(counter) == full), "reset").when(d == 0, "none").when(d == -1, "charge").otherwise("illegal")
    return df.withColumn("delta_class", kind)


def native_anomalies(df: DataFrame, keys: list[str], seq: str, period: str, clock: str, possession: str, ended: Column) -> DataFrame:
    """``df`` with the names of anomalies against the row before: clock or possession going back or jumping, play after a period's end."""
    w = Window.partitionBy(*keys).orderBy(seq)
    same = F.lag(period).over(w) == F.col(period)
    step = F.col(possession) - F.lag(possession).over(w)
    over = F.max(ended.cast("int")).over(Window.partitionBy(*keys, period).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    names = F.array(
        F.when(same & (F.col(clock) < F.lag(clock).over(w)), "clock_regression"), F.when(step > 1, "possession_skip"),
        F.when(step < 0, "possession_regression"), F.when(over == 1, "after_period_end"),
    )
    return df.withColumn("anomalies", F.array_compact(names))


def period_offsets(df: DataFrame, keys: list[str], period: str, clock: str) -> DataFrame:
    """(keys, period, offset): the sum over earlier periods of their largest clock + 1."""
    tops = df.groupBy(*keys, period).agg((F.max(clock) + 1).alias("_top"))
    w = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    return tops.select(*keys, period, F.coalesce(F.sum("_top").over(w), F.lit(0)).alias("offset"))


def successor_window(df: DataFrame, keys: list[str], seq: str, marked: Column) -> DataFrame:
    """Per row: the sequence number that ends its window (the first marked row after it) and the window's length; null if none follows."""
    down = Window.partitionBy(*keys).orderBy(F.col(seq).desc()).rowsBetween(Window.unboundedPreceding, -1)
    end = F.last(F.when(marked, F.col(seq)), ignorenulls=True).over(down)
    return df.withColumn("window_end", end).withColumn("window_rows", F.col("window_end") - F.col(seq))


def dismissal_difference(df: DataFrame, key: str, side: Column, player: Column, card: Column) -> DataFrame:
    """Per game: distinct players sent off by side, and home less away."""
    rows = df.select(key, side.alias("_s"), player.alias("_p"), card.alias("_c")).where("_c")
    out = rows.groupBy(key).agg(F.count_distinct(F.when(F.col("_s") == "home", F.col("_p"))).alias("home_off"), F.count_distinct(F.when(F.col("_s") == "away", F.col("_p"))).alias("away_off"))
    return out.withColumn("difference", F.col("home_off") - F.col("away_off"))


def census_outcomes(folded: DataFrame, game: str, season: str, violation: str) -> DataFrame:
    """Per season: games, games that no rule stopped, games that one stopped, distinct categories."""
    per_game = folded.groupBy(season, game).agg(F.max(violation).alias("v"))
    return per_game.groupBy(season).agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("v").isNull()).alias("completed"), F.count_if(F.col("v").isNotNull()).alias("failed"), F.count_distinct("v").alias("categories"))
