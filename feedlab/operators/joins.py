"""Joins that reconcile, bind and verify records of different sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beside(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal name, nulls being equal to nulls; the columns come once."""
    b = b.withColumnsRenamed({c: f"_{c}_r" for c in on})
    out = a.join(b, [F.col(c).eqNullSafe(F.col(f"_{c}_r")) for c in on], how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_{c}_r" for c in on])


def exact_key_extract(rows: DataFrame, keys: DataFrame, on: list[str], max_broadcast_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(rows of the listed keys, listed keys that no row has). The list is broadcast only if it is small."""
    wanted = keys.select(*on).distinct()
    small = wanted.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    return rows.join(F.broadcast(wanted) if small else wanted, on, "left_semi"), wanted.join(rows.select(*on), on, "left_anti")


def reconcile(historical: DataFrame, live: DataFrame, key: str, content: list[str]) -> DataFrame:
    """One row an id with ``side``: historical, live, both (equal content) or conflict."""
    h = historical.select(key, F.xxhash64(*content).alias("_h"))
    x = live.select(key, F.xxhash64(*content).alias("_l"))
    both = h.join(x, key, "full_outer")
    side = F.when(F.col("_l").isNull(), "historical").when(F.col("_h").isNull(), "live").when(F.col("_h") == F.col("_l"), "both").otherwise("conflict")
    return both.select(key, side.alias("side"))


def bind_unique(left: DataFrame, right: DataFrame, left_pair: tuple[str, str], right_pair: tuple[str, str], more: list[str], ident: str) -> DataFrame:
    """``left`` with ``matches`` and, where exactly one row of ``right`` has the same unordered pair and ``more``, its ident."""
    low, high = lambda p: F.least(*p), lambda p: F.greatest(*p)
    r = right.groupBy(low(right_pair).alias("_low"), high(right_pair).alias("_high"), *more).agg(F.count(F.lit(1)).alias("_n"), F.min(ident).alias("_id"))
    out = left.withColumns({"_low": low(left_pair), "_high": high(left_pair)}).join(r, ["_low", "_high", *more], "left")
    return out.withColumns({"matches": F.coalesce("_n", F.lit(0)), ident: F.when(F.col("_n") == 1, F.col("_id"))}).drop("_low", "_high", "_n", "_id")


def utc_of_local(local: str, zone: str) -> Column:
    """The instant of a local time: the later of two where the clocks go back, as far after the gap as into it where they go forward."""
    first = F.to_utc_timestamp(local, zone)  # the earlier of two
    day_on = F.timestamp_micros(F.unix_micros(first) + 86_400_000_000)
    second = F.timestamp_micros(F.unix_micros(local) + F.unix_micros(day_on) - F.unix_micros(F.from_utc_timestamp(day_on, zone)))  # by the offset a day on
    return F.when((second > first) & (F.from_utc_timestamp(second, zone) == F.col(local)), second).otherwise(first)


def start_time_delta(df: DataFrame, local: str, zone: str, utc: str, limit_hours: int = 12) -> DataFrame:
    """``df`` with the seconds from the UTC start to the local one (see ``utc_of_local``), and whether they are beyond ``limit_hours``."""
    delta = F.unix_seconds(utc_of_local(local, zone)) - F.unix_seconds(utc)
    return df.withColumns({"delta_s": delta, "anomaly": F.abs(delta) > limit_hours * 3600})


def orientation_mismatch(fills: DataFrame, metadata: DataFrame, key: str, filled: str, listed: str) -> DataFrame:
    """Per key: fills, fills whose label is not the listed one, distinct labels."""
    both = fills.join(metadata.select(key, listed), key)
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("n_fills"), F.count_if(F.col(filled) != F.col(listed)).alias("n_mismatch"), F.count_distinct(filled).alias("n_labels"))


def attach_many_to_one(left: DataFrame, right: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """``left`` with columns of the one row of ``right`` of equal key, in place of its own; ambiguous keys attach nothing."""
    one = right.groupBy(on).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in columns]).where("_n = 1").drop("_n")
    return left.drop(*columns).join(one, on, "left")


def compare_fields(actual: DataFrame, expected: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """(field, comparisons, matches, mismatches, match_ppm, first_mismatch): null equals null; first in ``order``."""
    a = actual.select(*keys, F.struct(*fields).alias("_a"))
    e = expected.select(*keys, F.struct(*fields).alias("_e"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a.{f}").eqNullSafe(F.col(f"_e.{f}")).alias("ok")) for f in fields])
    long = a.join(e, keys).select(F.col(order).alias("_o"), F.inline(each))
    out = long.groupBy("field").agg(F.count(F.lit(1)).alias("comparisons"), F.count_if("ok").alias("matches"), F.count_if(~F.col("ok")).alias("mismatches"), F.min(F.when(~F.col("ok"), F.col("_o"))).alias("first_mismatch"))
    return out.withColumn("match_ppm", F.floor(F.col("matches") * 1_000_000 / F.col("comparisons")).cast("long"))


def review_coverage(pairs: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """(key, problem): pairs without a review, reviews without a pair, pairs reviewed more than once."""
    missing = pairs.join(reviews, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    extra = reviews.join(pairs, key, "left_anti").select(key, F.lit("extra").alias("problem"))
    again = reviews.groupBy(key).count().where("count > 1").select(key, F.lit("repeated").alias("problem"))
    return missing.unionByName(extra).unionByName(again)


def lineage_orphans(events: DataFrame, ident: str, parents: str, raw: Column) -> DataFrame:
    """(ident, problem): parents that do not exist, and rows with both or neither of a raw source and parents."""
    each = events.select(ident, F.explode(parents).alias("_p"))
    ids = events.select(F.col(ident).alias("_p")).distinct()
    orphans = each.join(ids, "_p", "left_anti").select(ident, F.lit("missing parent").alias("problem")).distinct()
    both = events.where(raw == (F.coalesce(F.size(parents), F.lit(0)) > 0)).select(ident, F.lit("raw xor parents").alias("problem"))
    return orphans.unionByName(both)


def zip_explode(df: DataFrame, arrays: list[str], keep: list[str]) -> DataFrame:
    """One row for each place of the zipped arrays."""
    return df.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_z")).select(*keep, "pos", *[F.col(f"_z.{a}").alias(a) for a in arrays])


def score_reconcile(totals: DataFrame, parts: DataFrame, key: str, sides: dict[str, tuple[str, Column]]) -> DataFrame:
    """Per key and side: the declared total, the parts' count, and whether they agree (no parts count as 0)."""
    counts = parts.groupBy(key).agg(*[F.count_if(c).alias(f"n_{s}") for s, (_, c) in sides.items()])
    joined = totals.join(counts, key, "left")
    return joined.select(key, *[x for s, (declared, _) in sides.items() for x in (F.col(declared).alias(f"declared_{s}"), F.coalesce(f"n_{s}", F.lit(0)).alias(f"counted_{s}"), F.col(declared).eqNullSafe(F.coalesce(f"n_{s}", F.lit(0))).alias(f"ok_{s}"))])


def step_chain_check(steps: DataFrame, keys: list[str], seq: str, previous: str, following: str) -> DataFrame:
    """Steps whose previous hash is not the prior step's next hash, or whose number is not one more than the prior."""
    w = Window.partitionBy(*keys).orderBy(seq)
    rows = steps.withColumns({"_f": F.lag(following).over(w), "_s": F.lag(seq).over(w)}).where("_s IS NOT NULL")
    return rows.withColumns({"broken_hash": ~F.col(previous).eqNullSafe(F.col("_f")), "broken_sequence": F.col(seq) != F.col("_s") + 1}).where("broken_hash OR broken_sequence").drop("_f", "_s")


def venue_mapping(df: DataFrame, arrays: list[str], keep: list[str], market: Column, trades: DataFrame, candles: DataFrame, ident: str) -> DataFrame:
    """The zipped places of ``arrays`` with their market id, and how many trades and candles (tables keyed by ``ident``) it has; ``status`` ok or what is missing."""
    rows = zip_explode(df, arrays, keep).withColumn("market", market)
    for table, name in ((trades, "trades"), (candles, "candles")):
        counts = table.groupBy(F.col(ident).alias(f"_{name}")).agg(F.count(F.lit(1)).alias(name))
        rows = rows.join(counts, F.col("market") == F.col(f"_{name}"), "left").withColumn(name, F.coalesce(name, F.lit(0))).drop(f"_{name}")
    none = [F.when(F.col(c) == 0, F.lit(f"no {c}")) for c in ("trades", "candles")]
    return rows.withColumn("status", F.when((F.col("trades") > 0) & (F.col("candles") > 0), "ok").otherwise(F.array_join(F.array_compact(F.array(*none)), ",")))
