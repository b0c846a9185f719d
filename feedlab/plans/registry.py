"""Names, functions and DuckDB texts of the registered queries, and the stand-in views that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a function (spark, sf_dir) under a name, with its DuckDB text; ``views`` names the views that the text reads."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql, views.split())
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))


def shifted(ts, micros):
    """Timestamp moved by a number of microseconds."""
    return F.timestamp_micros(F.unix_micros(ts) + micros)


def _k():
    return F.get_json_object("props", "$.k").cast("long")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book feed: stream key, receive and source clock, kind, price, size."""
    return events(spark, sf_dir).select(
        "event_id", F.col("user_id").alias("stream"), F.col("ts").alias("received"), shifted(F.col("ts"), -_k() * 900_000_000).alias("source"),
        F.col("event_type").alias("kind"), F.col("value").cast("decimal(9,2)").alias("price"), _k().alias("size"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.col("value").cast("decimal(9,2)")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("quote_id"), F.col("user_id").alias("stream"), F.col("ts").alias("received"), shifted(F.col("ts"), -_k() * 900_000_000).alias("source"),
        F.when(F.col("event_type") == "error", "SUSPENDED").otherwise("ACTIVE").alias("state"),
        (px * F.lit("0.98").cast("decimal(3,2)")).cast("decimal(12,4)").alias("bid"), (px * F.lit("1.02").cast("decimal(3,2)")).cast("decimal(12,4)").alias("ask"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'signup'").select(
        F.col("event_id").alias("rule_id"), F.col("user_id").alias("stream"), F.col("ts").alias("fetched"), shifted(F.col("ts"), _k() * 3_600_000_000).alias("effective"),
        (_k() % 7 != 0).alias("valid"), ((_k() % 10).cast("decimal(9,3)") / F.lit(1000)).cast("decimal(9,3)").alias("fee_rate"),
    )


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ask levels, best (lowest) first by ``level``."""
    rows = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("book"), (F.floor(F.col("l_extendedprice") * 10000 / F.col("l_quantity")).cast("decimal(12,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(14,4)").alias("price"), F.col("l_quantity").cast("decimal(14,4)").alias("size"), "l_linenumber", "l_partkey", "l_suppkey")
    return rows


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("o_orderstatus") == "F", "home").when(F.col("o_orderstatus") == "O", "away").otherwise("tie")
    return orders(spark, sf_dir).select(F.col("o_orderkey").alias("game"), F.to_date("o_orderdate").alias("date"), outcome.alias("outcome"), F.year("o_orderdate").alias("season"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    p = (F.col("n_chars") % 997 + 1).cast("double") / F.lit(999.0)
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), p.alias("p"), F.col("source").alias("cluster"), F.col("lang").alias("season"))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play-by-play: a user is a game, the ISO week a period."""
    from pyspark.sql import Window

    e = events(spark, sf_dir)
    return e.select(F.col("user_id").alias("game"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), F.col("ts"), F.weekofyear("ts").alias("period"), F.col("event_type").alias("kind"), _k().alias("k"), "event_id")


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
VIEWS = {
    "v_feed": f"SELECT event_id, user_id AS stream, ts AS received, ts - to_minutes({_K} * 15) AS source, event_type AS kind, CAST(value AS DECIMAL(9,2)) AS price, {_K} AS size FROM events",
    "v_quotes": f"SELECT event_id AS quote_id, user_id AS stream, ts AS received, ts - to_minutes({_K} * 15) AS source, CASE WHEN event_type = 'error' THEN 'SUSPENDED' ELSE 'ACTIVE' END AS state, CAST(CAST(value AS DECIMAL(9,2)) * CAST(0.98 AS DECIMAL(3,2)) AS DECIMAL(12,4)) AS bid, CAST(CAST(value AS DECIMAL(9,2)) * CAST(1.02 AS DECIMAL(3,2)) AS DECIMAL(12,4)) AS ask FROM events",
    "v_rules": f"SELECT event_id AS rule_id, user_id AS stream, ts AS fetched, ts + to_hours({_K}) AS effective, {_K} % 7 <> 0 AS valid, CAST(({_K} % 10) / 1000.0 AS DECIMAL(9,3)) AS fee_rate FROM events WHERE event_type = 'signup'",
    "v_depth": "SELECT l_orderkey AS book, CAST(CAST(floor(l_extendedprice * 10000 / l_quantity) AS DECIMAL(12,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(14,4)) AS price, CAST(l_quantity AS DECIMAL(14,4)) AS size, l_linenumber, l_partkey, l_suppkey FROM lineitem",
    "v_games": "SELECT o_orderkey AS game, CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'F' THEN 'home' WHEN 'O' THEN 'away' ELSE 'tie' END AS outcome, CAST(year(o_orderdate) AS INTEGER) AS season FROM orders",
    "v_pred": "SELECT doc_id, quality AS y, CAST(n_chars % 997 + 1 AS DOUBLE) / 999.0 AS p, source AS cluster, lang AS season FROM labels JOIN documents USING (doc_id)",
    "v_pbp": f"SELECT user_id AS game, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq, ts, CAST(week(ts) AS INTEGER) AS period, event_type AS kind, {_K} AS k, event_id FROM events",
}


def with_views(sql: str, names: list[str]) -> str:
    """The text with the named views in front of it."""
    body = sql.strip()
    if not names:
        return body
    head = "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"{head}, {body[5:]}" if body[:5].upper() == "WITH " else f"{head} {body}"
