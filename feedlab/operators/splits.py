"""Splits and statistics that use strictly earlier games only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_date(df: DataFrame, date: str, *aggs) -> DataFrame:
    """One row a date, small next to the games."""
    return df.groupBy(date).agg(*aggs)


def _ordered(date: str) -> Window:
    return Window.partitionBy(F.lit(0)).orderBy(date)  # over one row a date


def strictly_prior(df: DataFrame, date: str) -> DataFrame:
    """Per date: games strictly before it, and the last date among them."""
    d = _by_date(df, date, F.count(F.lit(1)).alias("_n"))
    w = _ordered(date).rowsBetween(Window.unboundedPreceding, -1)
    return d.select(date, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("prior_games"), F.max(date).over(w).alias("last_prior"))


def whole_group_limit(df: DataFrame, date: str, limit: int) -> DataFrame:
    """Rows of the first dates whose cumulative number does not pass the limit; dates are taken whole."""
    d = _by_date(df, date, F.count(F.lit(1)).alias("_n"))
    fits = d.withColumn("_sum", F.sum("_n").over(_ordered(date).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= limit).select(date)
    return df.join(fits, date, "left_semi")


def date_split(df: DataFrame, date: str) -> DataFrame:
    """``df`` with ``split``: base, calibration and final by half, a quarter and the rest of the distinct dates."""
    d = df.select(date).distinct().withColumn("_k", F.row_number().over(_ordered(date)))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    part = F.when(F.col("_k") <= F.floor(n / 2), "base").when(F.col("_k") <= F.floor(n / 2) + F.floor(n / 4), "calibration").otherwise("final")
    return df.join(d.withColumn("split", part).drop("_k"), date)


def chronology_rank(df: DataFrame, date: str, game: str) -> DataFrame:
    """``df`` with ``place`` in the order of (date, game): dates offset by what is before them, games numbered by date."""
    d = _by_date(df, date, F.count(F.lit(1)).alias("_n"))
    d = d.withColumn("_before", F.coalesce(F.sum("_n").over(_ordered(date).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rows = df.withColumn("_nth", F.row_number().over(Window.partitionBy(date).orderBy(game)))
    return rows.join(d, date).withColumn("place", F.col("_before") + F.col("_nth")).drop("_before", "_nth")


def first_games(df: DataFrame, date: str, game: str, n: int) -> DataFrame:
    """The first n games by (date, game)."""
    return df.orderBy(date, game).limit(n)


def walk_forward_folds(rows: DataFrame, game: str, time: str, least: int) -> DataFrame:
    """Per test game: how many games ended strictly before it began, the last of those ends, and whether they are enough.

    Counting needs no pairs: ends and starts share one timeline of one row an instant.
    """
    span = rows.groupBy(game).agg(F.min(time).alias("start"), F.max(time).alias("end"))
    ends = span.groupBy(F.col("end").alias("t")).agg(F.count(F.lit(1)).alias("_ends"))
    starts = span.select(F.col("start").alias("t")).distinct().withColumn("_ends", F.lit(0))
    line = ends.unionByName(starts).groupBy("t").agg(F.sum("_ends").alias("_ends"), F.max(F.when(F.col("_ends") > 0, F.col("t"))).alias("_end"))
    w = _ordered("t").rowsBetween(Window.unboundedPreceding, -1)
    known = line.select("t", F.coalesce(F.sum("_ends").over(w), F.lit(0)).alias("train_games"), F.max("_end").over(w).alias("last_end"))
    out = span.join(known, span["start"] == known["t"]).drop("t")
    return out.withColumn("usable", F.col("train_games") >= least)


#: Periods of a calendar at most: they are broadcast, and each makes a list of all games before it.
MOST_PERIODS = 10_000


def walk_forward_pairs(rows: DataFrame, tests: DataFrame, game: str, time: str) -> DataFrame:
    """(test, train_game) pairs for periods of test games, given as (test, start): the training lists themselves.

    A list has every game that ended before its period starts. The periods are those of a calendar, so the lists are
    linear in the games; for one list a game, ``walk_forward_membership`` needs no pairs. ValueError for more than
    MOST_PERIODS of them, as they are broadcast.
    """
    if tests.limit(MOST_PERIODS + 1).count() > MOST_PERIODS:
        raise ValueError(f"there are more than {MOST_PERIODS} periods")
    span = rows.groupBy(F.col(game).alias("train_game")).agg(F.max(time).alias("_end"))
    return span.join(F.broadcast(tests.select("test", "start")), F.col("_end") < F.col("start")).select("test", "train_game")


def walk_forward_membership(rows: DataFrame, game: str, time: str) -> DataFrame:
    """Training lists of all games in one row a game: ``bucket`` is the rank of its end, ``trains_upto`` that of the last end before its start.

    Game t trains for game s exactly where t's ``bucket`` is at most s's ``trains_upto``, so no pairs are made.
    """
    span = rows.groupBy(game).agg(F.min(time).alias("start"), F.max(time).alias("end"))
    points = span.select(F.col("end").alias("t"), F.lit(1).alias("_e")).union(span.select("start", F.lit(0)))
    line = points.groupBy("t").agg(F.max("_e").alias("_e"))
    known = line.select("t", F.sum("_e").over(_ordered("t").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), "_e")
    starts = known.select(F.col("t").alias("start"), (F.col("_upto") - F.col("_e")).alias("trains_upto"))
    ends = known.select(F.col("t").alias("end"), F.col("_upto").alias("bucket"))
    return span.join(starts, "start").join(ends, "end").select(game, "bucket", "trains_upto")


def fold_audit(df: DataFrame, cutoffs: DataFrame, date: str, outcome: str) -> DataFrame:
    """Per cutoff date: training games strictly before it, ties left out, wins among the rest."""
    d = _by_date(df, date, F.count(F.lit(1)).alias("_n"), F.count_if(F.col(outcome) == "tie").alias("_t"), F.count_if(F.col(outcome) == "home").alias("_h"))
    both = d.unionByName(cutoffs.select(F.col("cutoff").alias(date)).distinct(), allowMissingColumns=True).groupBy(date).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_n", "_t", "_h")])
    w = _ordered(date).rowsBetween(Window.unboundedPreceding, -1)
    run = both.select(F.col(date).alias("cutoff"), *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, n in (("_n", "train_games"), ("_t", "ties"), ("_h", "home_wins"))])
    return run.join(cutoffs.select("cutoff").distinct(), "cutoff", "left_semi")


def chronology_digest(df: DataFrame, date: str, game: str) -> DataFrame:
    """One row: games, dates, and the SHA-256 of all games in the order of (date, game): of the dates' own hashes, so that dates are hashed apart."""
    days = df.select(date, F.col(game).cast("string").alias("_g")).distinct().groupBy(date).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("_g")), ","), 256).alias("_h"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(date).cast("string").alias("d"), "_h"))), lambda x: F.concat_ws(":", x["d"], x["_h"])), ",")
    return days.agg(F.sum("n").alias("games"), F.count(F.lit(1)).alias("dates"), F.sha2(whole, 256).alias("digest"))
