"""Queries of record audits: history pages, candles, recall, seasons, chronology, mappings, snapshots, clocks, envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probability as pr
from ..functions import text as t
from ..operators import books, joins, metrics, review, splits
from ..sources import records
from .registry import depth, events, games, lineitem, predictions, query, table


@query("history_flatten", "SELECT event_id, event_type, CASE WHEN event_id % 100 = 0 AND event_id >= 100 THEN event_id // 100 - 1 ELSE event_id // 100 END AS first_page, CAST(CASE WHEN event_id % 100 = 0 AND event_id >= 100 THEN 2 ELSE 1 END AS BIGINT) AS n_seen, event_id % 700 = 0 AND event_id >= 100 AS conflict FROM events")
def history_flatten(spark, sf):
    """Pages of a hundred events, each ending with the first one of the next page, a seventh of which differ there."""
    e = events(spark, sf).select("event_id", "event_type", F.floor(F.col("event_id") / 100).alias("page"))
    twice = (F.col("event_id") % 100 == 0) & (F.col("event_id") >= 100)
    both = e.withColumn("note", F.lit("")).unionByName(e.where(twice).withColumns({"page": F.col("page") - 1, "note": F.when(F.col("event_id") % 700 == 0, "changed").otherwise("")}))
    pages = both.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "note"))).alias("rows"))
    return records.flatten_history(pages, "page", "rows", "event_id").select("event_id", "row.event_type", "first_page", "n_seen", "conflict")


@query("candle_problems", """
WITH c AS (SELECT DISTINCT stream, CAST(floor(epoch_us(received) / 3600000000.0) AS BIGINT) * 3600 + CASE WHEN stream % 11 = 0 THEN 30 ELSE 0 END AS end_ts, CASE WHEN stream % 7 = 0 THEN 30 ELSE 60 END AS minutes FROM v_feed)
SELECT stream, end_ts, array_to_string(list_filter([CASE WHEN minutes NOT IN (1, 60, 1440) THEN 'interval' END, CASE WHEN end_ts % (minutes * 60) <> 0 THEN 'off_grid' END, CASE WHEN end_ts <= 1704153600 OR end_ts > 1706486400 THEN 'outside' END], lambda x: x IS NOT NULL), ',') AS problems FROM c""", "v_feed")
def candle_problems(spark, sf):
    from .registry import feed

    odd = F.when(F.col("stream") % 11 == 0, 30).otherwise(0)
    c = feed(spark, sf).select("stream", (F.floor(F.unix_micros("received") / 3_600_000_000) * 3600 + odd).alias("end_ts"), F.when(F.col("stream") % 7 == 0, 30).otherwise(60).alias("minutes")).distinct()
    out = records.candle_problems(c, ["stream"], "end_ts", "minutes", F.lit(1704153600), F.lit(1706486400))
    return out.select("stream", "end_ts", F.array_join("problems", ",").alias("problems"))


@query("review_recall", "SELECT source, count(*) FILTER (quality = 1) AS true_rows, count(*) FILTER (quality = 1 AND toxic = 0) AS hits, round(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (quality = 1), 0), 6) AS recall, count(*) FILTER (quality <> 1 AND toxic = 0) AS false_hits FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def review_recall(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return review.recall(rows, F.col("quality") == 1, F.col("toxic") == 0, "source")


@query("season_scores", """
WITH r AS (SELECT season, p, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE y END AS y FROM v_pred), q AS (SELECT *, least(greatest(p, 1e-9), 1 - 1e-9) AS c FROM r),
b AS (SELECT season, least(floor(p * 10), 9) AS b, count(*) AS n, sum((p - y) * (p - y)) AS s, sum(-(y * ln(c) + (1 - y) * ln(1 - c))) AS l, abs(sum(p - y)) AS off FROM q WHERE y IS NOT NULL GROUP BY 1, 2)
SELECT season, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(any_value(ties) AS BIGINT) AS ties, round(sum(s) / sum(n), 6) AS brier, round(sum(l) / sum(n), 6) AS log_loss, round(sum(off) / sum(n), 6) AS ece
FROM (SELECT season, count(*) FILTER (y IS NULL) AS ties FROM r GROUP BY 1) LEFT JOIN b USING (season) GROUP BY season""", "v_pred")
def season_scores(spark, sf):
    rows = predictions(spark, sf).withColumn("y", F.when(F.col("doc_id") % 13 != 0, F.col("y")))
    return metrics.season_scores(rows, "y", "p", "season")


@query("chronology_digest", """
WITH d AS (SELECT date, count(*) AS n, sha256(string_agg(CAST(game AS VARCHAR), ',' ORDER BY CAST(game AS VARCHAR))) AS h FROM v_games GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS games, count(*) AS dates, sha256(string_agg(date || ':' || h, ',' ORDER BY date)) AS digest FROM d""", "v_games")
def chronology_digest(spark, sf):
    return splits.chronology_digest(games(spark, sf), "date", "game")


@query("venue_mapping", """
WITH m AS (SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, string_split(p_name, ' ')[i] AS words, p_partkey * 10 + i - 1 AS market FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)),
t AS (SELECT l_partkey * 10 + l_linenumber % 3 AS market, count(*) AS trades FROM lineitem GROUP BY 1), c AS (SELECT l_partkey * 10 + l_linenumber % 2 AS market, count(*) AS candles FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT p_partkey, pos, words, market, coalesce(trades, 0) AS trades, coalesce(candles, 0) AS candles, CASE WHEN trades > 0 AND candles > 0 THEN 'ok' ELSE concat_ws(',', CASE WHEN trades IS NULL THEN 'no trades' END, CASE WHEN candles IS NULL THEN 'no candles' END) END AS status
FROM m LEFT JOIN t USING (market) LEFT JOIN c USING (market)""")
def venue_mapping(spark, sf):
    p = table(spark, sf, "part").withColumn("words", F.split("p_name", " "))
    lines = lineitem(spark, sf)
    trades = lines.select((F.col("l_partkey") * 10 + F.col("l_linenumber") % 3).alias("market"))
    candles = lines.where("l_quantity > 25").select((F.col("l_partkey") * 10 + F.col("l_linenumber") % 2).alias("market"))
    out = joins.venue_mapping(p, ["words"], ["p_partkey"], F.col("p_partkey") * 10 + F.col("pos"), trades, candles, "market")
    return out.select("p_partkey", "pos", "words", "market", "trades", "candles", "status")


@query("snapshot_problems", """
WITH s AS (SELECT book, coalesce(list(price ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_linenumber % 2 = 1), []) AS b, coalesce(list(price ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_linenumber % 2 = 0), []) AS a, bool_or(size - 2 <= 0) AS small, bool_or(price % 0.05 <> 0) AS off FROM v_depth GROUP BY book)
SELECT book, array_to_string(list_filter([CASE WHEN list_reverse(b) <> list_sort(list_distinct(b)) THEN 'bids out of order' END, CASE WHEN a <> list_sort(list_distinct(a)) THEN 'asks out of order' END, CASE WHEN b[1] > a[1] THEN 'crossed' END, CASE WHEN small THEN 'size' END, CASE WHEN off THEN 'off grid' END], lambda x: x IS NOT NULL), ',') AS problems FROM s""", "v_depth")
def snapshot_problems(spark, sf):
    rows = depth(spark, sf).withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    side = lambda odd: F.transform(F.sort_array(F.collect_list(F.when(F.col("l_linenumber") % 2 == odd, F.struct("at", "price", (F.col("size") - 2).alias("size"))))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))
    snaps = rows.groupBy("book").agg(side(1).alias("bids"), side(0).alias("asks"))
    return snaps.select("book", F.array_join(books.snapshot_problems(F.col("bids"), F.col("asks"), F.lit("0.05").cast("decimal(3,2)")), ",").alias("problems"))


@query("orient_state", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN h THEN l_linenumber ELSE q END AS home_score, CASE WHEN h THEN q ELSE l_linenumber END AS away_score, CASE WHEN h THEN l_linenumber - q ELSE q - l_linenumber END AS home_difference, round(CASE WHEN h THEN l_discount ELSE 1 - l_discount END, 6) AS home_p, h AS home_has_ball FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, l_returnflag = 'A' AS h FROM lineitem)")
def orient_state(spark, sf):
    own = pr.orient_state(F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long"), F.round("l_discount", 6), F.col("l_returnflag") == "A")
    return lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[(F.round(c, 6) if n == "home_p" else c).alias(n) for n, c in own.items()])


@query("soccer_clock", """
WITH e AS (SELECT event_id, CAST(1 + event_id % 6 AS INTEGER) AS period, CAST((event_id * 7919) % 3300000 AS BIGINT) AS ms FROM events), s AS (SELECT *, CASE period WHEN 1 THEN 0 WHEN 2 THEN 45 WHEN 3 THEN 90 WHEN 4 THEN 105 WHEN 5 THEN 120 END AS m FROM e)
SELECT event_id, ms AS period_ms, CAST(ms + m * 60000 AS BIGINT) AS match_ms, CASE WHEN m IS NOT NULL THEN event_id % 5 <> 0 END AS clock_ok FROM s""")
def soccer_clock(spark, sf):
    ms = (F.col("event_id") * 7919) % 3_300_000
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    text = F.concat(F.lit("00:"), two(ms / 60_000), F.lit(":"), two(ms / 1000 % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    period = (1 + F.col("event_id") % 6).cast("int")
    start = F.when(period == 2, 45).when(period == 3, 90).when(period == 4, 105).when(period == 5, 120).otherwise(0)
    minute = F.floor(ms / 60_000) + start + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    own = t.soccer_clock(period, text, minute, F.floor(ms / 1000) % 60)
    return events(spark, sf).select("event_id", *[c.alias(n) for n, c in own.items()])


@query("event_envelope", """
WITH e AS (SELECT event_id, 'evt_' || sha256('{"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '","user_id":"' || user_id || '"}') AS event, sha256(props) AS payload_sha256, event_type AS source, CAST(epoch_us(ts) AS BIGINT) AS occurred_us FROM events)
SELECT *, sha256(event || '|' || payload_sha256 || '|' || source || '|' || occurred_us) AS envelope_sha256 FROM e""")
def event_envelope(spark, sf):
    e = events(spark, sf)
    own = t.envelope(e, ["user_id", "event_type", "props"], "props", F.col("event_type"), F.col("ts"))
    return e.select("event_id", *[c.alias(n) for n, c in own.items()])


_RAW16 = """
WITH e AS (SELECT event_id, user_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
r AS (SELECT *, list_filter([CASE WHEN event_id % 40 = 0 THEN 'timestamp_received' END, CASE WHEN event_id % 60 = 1 THEN 'market' END, CASE WHEN event_id % 50 = 3 THEN 'price' END, CASE WHEN event_type = 'signup' AND event_id % 9 = 0 THEN 'bids' END, CASE WHEN event_id % 70 = 5 THEN 'fee_rate_bps' END], lambda x: x IS NOT NULL) AS reasons FROM e)"""


def _raw16(spark, sf):
    """The events as a feed of sixteen text columns, some of them broken."""
    e = events(spark, sf).withColumn("k", F.get_json_object("props", "$.k"))
    n = F.col("event_id")
    whole = F.date_trunc("second", "ts")
    levels = F.concat(F.lit('[["'), F.col("k"), F.lit('.50", "1.0"]]'))
    snap = F.col("event_type") == "signup"
    return e.select(
        "event_id", F.concat(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss"), F.when(n % 40 == 0, ".123456Z").otherwise(".120Z")).alias("timestamp_received"), F.concat(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp"),
        F.when(n % 60 == 1, "").otherwise(F.concat(F.lit("m"), F.col("user_id").cast("string"))).alias("market"), F.when(snap, "BOOK").otherwise(F.upper("event_type")).alias("event_type"), F.lit("yes").alias("asset_id"),
        F.when(snap & (n % 9 != 0), levels).alias("bids"), F.when(snap, F.lit("[]")).alias("asks"), F.when(n % 50 == 3, "abc").when(~snap, F.concat("k", F.lit(".500"))).alias("price"), F.lit("2.000").alias("size"), F.lit("buy").alias("side"),
        F.concat("k", F.lit(".00")).alias("best_bid"), F.lit(None).cast("string").alias("best_ask"), F.when(n % 70 == 5, "x").otherwise("25").alias("fee_rate_bps"), F.lit(None).cast("string").alias("transaction_hash"), F.lit("0.010").alias("old_tick_size"), F.lit("-0.0").alias("new_tick_size"),
    )


@query("feed_canonical_full", f"""{_RAW16}
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.120Z') AS timestamp_received, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp, 'm' || user_id AS market, CASE WHEN event_type = 'signup' THEN 'book' ELSE lower(event_type) END AS event_type,
  CASE WHEN event_type = 'signup' THEN k || '.5:1' END AS bid, CASE WHEN event_type <> 'signup' THEN k || '.5' END AS price, '2' AS size, 'BUY' AS side, CAST(k AS VARCHAR) AS best_bid, CAST(25 AS INTEGER) AS fee_rate_bps, '0.01' AS old_tick_size, '0' AS new_tick_size FROM r WHERE len(reasons) = 0""")
def feed_canonical_full(spark, sf):
    from ..sources.feeds import canonical_events

    good, _ = canonical_events(_raw16(spark, sf))
    bid = F.when(F.col("bids").isNotNull(), F.concat_ws(":", F.get("bids", 0)["price"], F.get("bids", 0)["size"])).alias("bid")
    return good.select("event_id", "timestamp_received", "timestamp", "market", "event_type", bid, "price", "size", "side", "best_bid", "fee_rate_bps", "old_tick_size", "new_tick_size")


@query("feed_rejected", f"{_RAW16} SELECT event_id, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0")
def feed_rejected(spark, sf):
    from ..sources.feeds import canonical_events

    return canonical_events(_raw16(spark, sf))[1].select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query("book_feed_market", "SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 2 = 1) AS with_ask, CAST(sum(CAST(value AS DECIMAL(9,4))) AS DECIMAL(19,4)) AS price FROM events WHERE user_id = (SELECT min(user_id) FROM events) GROUP BY 1")
def book_feed_market(spark, sf):
    """Hours of a feed with different columns, written in the shared folder, and one market read from all of them."""
    from ..sources.feeds import read_book_feed
    from ..sources.scratch import shared_dir

    path, price = shared_dir(spark, "feed-hours"), F.col("value").cast("decimal(9,4)").alias("price")
    e = events(spark, sf).withColumn("market", F.encode(F.concat(F.lit("m"), F.col("user_id").cast("string")), "utf-8"))
    e.where("event_id % 2 = 0").select(F.col("ts").alias("timestamp_received"), "market", "event_type", price).write.parquet(f"{path}/hour=0")
    e.where("event_id % 2 = 1").select(price, F.col("value").cast("decimal(9,4)").alias("best_ask"), "event_type", "market").write.parquet(f"{path}/hour=1")
    first = e.agg(F.min("user_id")).first()[0]
    got = read_book_feed(spark, [f"{path}/hour=0", f"{path}/hour=1"], f"m{first}".encode())
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("best_ask").alias("with_ask"), F.sum("price").cast("decimal(19,4)").alias("price"))
