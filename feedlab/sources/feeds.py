"""Book feeds: schema, Parquet and JSON readers, canonical typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_levels, parse_utc
from ..operators.quality import reasons

FEED_SCHEMA = """timestamp_received timestamp, timestamp timestamp, market binary, event_type string, asset_id string, bids string, asks string,
price decimal(9,4), size decimal(18,6), side string, best_bid decimal(9,4), best_ask decimal(9,4), fee_rate_bps int, transaction_hash string,
old_tick_size decimal(9,4), new_tick_size decimal(9,4)"""


def read_book_feed(spark: SparkSession, paths: list[str], market: bytes | None = None) -> DataFrame:
    """Hourly Parquet files as one table, columns by name; a market is compared byte for byte, in the scan."""
    df = spark.read.schema(FEED_SCHEMA).parquet(*paths)
    return df if market is None else df.where(F.col("market") == F.lit(market))


def read_book_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(typed events, bad lines with reasons) of line JSON; decimals stay text until they are cast, so none passes through a float."""
    names = "timestamp_received timestamp market asset_id event_type bids asks price size side".split()
    raw = spark.read.schema(", ".join(f"{n} string" for n in [*names, "_bad"])).option("columnNameOfCorruptRecord", "_bad").json(path)
    typed = raw.select(
        parse_utc(F.col("timestamp_received")).alias("received"), parse_utc(F.col("timestamp")).alias("source"), F.trim("market").alias("market"), F.trim("asset_id").alias("asset_id"), F.lower(F.trim("event_type")).alias("kind"),
        parse_levels(F.col("bids")).alias("bids"), parse_levels(F.col("asks")).alias("asks"), F.col("price").try_cast("decimal(9,4)").alias("price"), F.col("size").try_cast("decimal(18,6)").alias("size"), F.upper(F.trim("side")).alias("side"), "_bad",
    )
    book, change = F.col("kind") == "book", F.col("kind") == "price_change"
    rules = {
        "bad line": F.col("_bad").isNotNull(), "received": F.col("received").isNull(), "stream": F.col("market").isNull() | F.col("asset_id").isNull(), "kind": F.col("kind").isNull(),
        "levels": F.coalesce(book, F.lit(False)) & (F.col("bids").isNull() | F.col("asks").isNull()), "change": F.coalesce(change, F.lit(False)) & (F.col("price").isNull() | F.col("size").isNull() | F.col("side").isNull()),
    }
    judged = typed.withColumn("reasons", reasons(rules)).drop("_bad")
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def canonicalize(df: DataFrame, sides: dict[str, str]) -> DataFrame:
    """Text columns event_id, kind, price, size typed: kind lower-cased and trimmed, side from it, decimals exact; ``reasons`` for bad values."""
    kind = F.lower(F.trim("kind"))
    price, size = F.col("price").try_cast("decimal(9,2)"), F.col("size").try_cast("long")
    side = F.element_at(F.create_map(*[F.lit(x) for pair in sides.items() for x in pair]), kind)
    bad = {"price": F.coalesce(price <= 0, F.lit(True)), "size": F.coalesce(size < 1, F.lit(True))}
    return df.select("event_id", kind.alias("kind"), F.when(price > 0, price).alias("price"), size.alias("size"), side.alias("side"), reasons(bad).alias("reasons"))


#: What a canonical event must have, and its decimal fields.
REQUIRED = ("timestamp_received", "timestamp", "market", "event_type", "asset_id")
DECIMALS = ("price", "size", "best_bid", "best_ask", "old_tick_size", "new_tick_size")


def plain_decimal(c: Column) -> Column:
    """Exact decimal text without exponent, sign of zero or trailing zeros; null for text that is no such number."""
    exact = F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.trim(c)).try_cast("decimal(38,18)")
    return F.regexp_replace(F.regexp_replace(exact.cast("string"), r"0+$", ""), r"\.$", "")


def canonical_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical events with their hash, bad ones with reasons) of the sixteen columns of ``FEED_SCHEMA`` as text.

    Times must be UTC with milliseconds at most, names must not be empty, a snapshot must have both sides as lists of
    (price, size), decimals are exact and lose trailing zeros, kinds are lower case and sides upper case. Null optional
    fields stay null. Further columns are kept, not hashed.
    """
    text = lambda c: F.col(c).cast("string")
    when = {c: parse_utc(F.regexp_replace(text(c), r"(\.\d{3})000Z$", "$1Z")) for c in ("timestamp_received", "timestamp")}
    fine = {c: w.isNotNull() & (F.unix_micros(w) % 1000 == 0) for c, w in when.items()}
    names = {c: F.when(F.length(text(c)) > 0, text(c)) for c in ("market", "asset_id")} | {"event_type": F.when(F.length(text("event_type")) > 0, F.lower(text("event_type")))}
    numbers = {c: plain_decimal(text(c)) for c in DECIMALS}
    sides = {c: F.transform(parse_levels(text(c)), lambda x: F.struct(plain_decimal(x["price"].cast("string")).alias("price"), plain_decimal(x["size"].cast("string")).alias("size"))) for c in ("bids", "asks")}
    snapshot = F.coalesce(names["event_type"] == "book", F.lit(False))
    bad = {c: ~F.coalesce(ok, F.lit(False)) for c, ok in fine.items()} | {c: n.isNull() for c, n in names.items()}
    bad |= {c: F.col(c).isNotNull() & n.isNull() for c, n in numbers.items()} | {c: (F.col(c).isNotNull() | snapshot) & s.isNull() for c, s in sides.items()}
    bad["fee_rate_bps"] = F.col("fee_rate_bps").isNotNull() & text("fee_rate_bps").try_cast("int").isNull()
    out = {**{c: F.date_format(w, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") for c, w in when.items()}, **names, **numbers, **sides, "fee_rate_bps": text("fee_rate_bps").try_cast("int"), "side": F.upper(text("side")), "transaction_hash": text("transaction_hash")}
    judged = df.withColumn("reasons", reasons(bad))
    columns = [x.strip().split(" ")[0] for x in FEED_SCHEMA.replace("\n", " ").split(", ")]
    good = judged.where(F.size("reasons") == 0).select(*[c for c in df.columns if c not in columns], *[out[c].alias(c) for c in columns])
    return good.withColumn("event_sha256", F.sha2(F.to_json(F.struct(*sorted(columns))), 256)), judged.where(F.size("reasons") > 0)
