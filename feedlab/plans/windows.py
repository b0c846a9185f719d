"""Queries: play-by-play windows, splits, ordering and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plays as p
from ..operators import review, splits
from ..sources import records
from .registry import events, feed, games, lineitem, orders, plays, predictions, query, table


@query("first_per_group", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def first_per_group(spark, sf):
    return p.first_per_group(lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


@query("running_score", "SELECT game, seq, CAST(sum(CASE WHEN kind = 'purchase' THEN k ELSE 0 END) OVER (PARTITION BY game ORDER BY seq) AS BIGINT) AS score, CAST(sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY game, period ORDER BY seq) AS BIGINT) AS fouls FROM v_pbp", "v_pbp")
def running_score(spark, sf):
    out = p.running(plays(spark, sf), ["game"], "seq", {"score": F.when(F.col("kind") == "purchase", F.col("k")).otherwise(0)}, {"fouls": F.when(F.col("kind") == "error", 1).otherwise(0)}, ["period"])
    return out.select("game", "seq", "score", "fouls")


@query("carry_forward", "SELECT game, seq, last_value(CASE WHEN kind <> 'view' THEN k END IGNORE NULLS) OVER (PARTITION BY game ORDER BY seq) AS clock FROM v_pbp", "v_pbp")
def carry_forward(spark, sf):
    rows = plays(spark, sf).select("game", "seq", F.when(F.col("kind") != "view", F.col("k")).alias("clock"))
    return p.carry_forward(rows, ["game"], "seq", ["clock"])


@query("successor_window", "SELECT game, seq, min(CASE WHEN kind = 'purchase' THEN seq END) OVER w AS window_end, min(CASE WHEN kind = 'purchase' THEN seq END) OVER w - seq AS window_rows FROM v_pbp WINDOW w AS (PARTITION BY game ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)", "v_pbp")
def successor_window(spark, sf):
    return p.successor_window(plays(spark, sf).select("game", "seq", "kind"), ["game"], "seq", F.col("kind") == "purchase").select("game", "seq", "window_end", "window_rows")


@query("period_offsets", "SELECT user_id, day, CAST(coalesce(sum(top) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT user_id, CAST(ts AS DATE) AS day, max(hour(ts) * 60 + minute(ts)) + 1 AS top FROM events GROUP BY 1, 2)")
def period_offsets(spark, sf):
    e = events(spark, sf).select("user_id", F.to_date("ts").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("clock"))
    return p.period_offsets(e, ["user_id"], "day", "clock")


@query("first_event_per_user", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def first_event_per_user(spark, sf):
    return p.first_per_group(events(spark, sf).select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("counter_delta_class", """
SELECT delta_class, count(*) AS n FROM (SELECT CASE WHEN d IS NULL THEN 'first' WHEN period <> before AND c = 3 THEN 'reset' WHEN d = 0 THEN 'none' WHEN d = -1 THEN 'charge' ELSE 'illegal' END AS delta_class FROM (SELECT *, c - lag(c) OVER w AS d, lag(period) OVER w AS before FROM (SELECT *, 3 - k % 4 AS c FROM v_pbp) WINDOW w AS (PARTITION BY game ORDER BY seq))) GROUP BY 1""", "v_pbp")
def counter_delta_class(spark, sf):
    from pyspark.sql import Window

    rows = plays(spark, sf).withColumn("c", 3 - F.col("k") % 4)
    reset = F.col("period") != F.lag("period").over(Window.partitionBy("game").orderBy("seq"))
    return p.counter_delta(rows, ["game"], "seq", "c", 3, reset).groupBy("delta_class").agg(F.count(F.lit(1)).alias("n"))


@query("native_anomalies", """
WITH x AS (SELECT *, k - lag(k) OVER w AS step, lag(period) OVER w = period AND ck < lag(ck) OVER w AS back, max(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY game, period ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM (SELECT *, k * 7 % 60 AS ck FROM v_pbp) WINDOW w AS (PARTITION BY game ORDER BY seq))
SELECT game, seq, array_to_string(list_filter([CASE WHEN back THEN 'clock_regression' END, CASE WHEN step > 1 THEN 'possession_skip' END, CASE WHEN step < 0 THEN 'possession_regression' END, CASE WHEN done = 1 THEN 'after_period_end' END], lambda a: a IS NOT NULL), ',') AS anomalies FROM x""", "v_pbp")
def native_anomalies(spark, sf):
    rows = plays(spark, sf).withColumn("ck", F.col("k") * 7 % 60)
    return p.native_anomalies(rows, ["game"], "seq", "period", "ck", "k", F.col("kind") == "signup").select("game", "seq", F.array_join("anomalies", ",").alias("anomalies"))


@query("distinct_pair_diff", "SELECT user_id, count(DISTINCT CASE WHEN event_id % 2 = 0 THEN k END) AS home_off, count(DISTINCT CASE WHEN event_id % 2 = 1 THEN k END) AS away_off, count(DISTINCT CASE WHEN event_id % 2 = 0 THEN k END) - count(DISTINCT CASE WHEN event_id % 2 = 1 THEN k END) AS difference FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type = 'error' GROUP BY 1")
def distinct_pair_diff(spark, sf):
    side = F.when(F.col("event_id") % 2 == 0, "home").otherwise("away")
    return p.dismissal_difference(events(spark, sf), "user_id", side, F.get_json_object("props", "$.k").cast("long"), F.col("event_type") == "error")


@query("contiguity", "SELECT conv_id, count(*) AS n_rows, count(*) FILTER (turn <> n) AS n_bad FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) GROUP BY 1")
def contiguity(spark, sf):
    return records.contiguity(table(spark, sf, "conversations"), ["conv_id"], "turn", 0)


@query("page_chain_complete", """
WITH c AS (SELECT conv_id, turn, 'c' || turn AS req, CASE WHEN turn >= 5 THEN '' ELSE 'c' || (turn + 1) END AS resp FROM conversations),
l AS (SELECT *, lag(resp) OVER w AS before, lag(turn) OVER w IS NULL AS first, lead(turn) OVER w IS NULL AS last FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS pages, count(*) FILTER (NOT first AND req IS DISTINCT FROM before) AS broken, bool_or(last AND resp = '') AS complete FROM l GROUP BY 1""")
def page_chain_complete(spark, sf):
    turn = F.col("turn")
    pages = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("c"), turn.cast("string")).alias("req"), F.when(turn >= 5, "").otherwise(F.concat(F.lit("c"), (turn + 1).cast("string"))).alias("resp"))
    return records.page_chain(pages, "conv_id", "turn", "req", "resp")


@query("raw_segment_verify", "SELECT conv_id, count(*) AS records, count(*) FILTER (sha256(coalesce(text, '')) <> CASE WHEN turn % 4 = 3 THEN 'x' ELSE sha256(coalesce(text, '')) END) AS bad_hashes, count(*) FILTER (turn <> n) AS bad_ordinals FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) GROUP BY 1")
def raw_segment_verify(spark, sf):
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.base64(text).alias("p"), F.when(F.col("turn") % 4 == 3, "x").otherwise(F.sha2(text, 256)).alias("d"))
    return records.verify_segments(rows, "conv_id", "turn", F.col("p"), F.col("d"))


@query("record_type_inventory", "SELECT string_split(line, ',')[1] AS type, count(*) AS records, array_to_string(list_sort(list_distinct(list(len(string_split(line, ','))::VARCHAR))), ',') AS arities FROM (SELECT source || ',' || lang || CASE WHEN doc_id % 3 = 0 THEN ',x' ELSE '' END AS line FROM documents) GROUP BY 1")
def record_type_inventory(spark, sf):
    extra = F.when(F.col("doc_id") % 3 == 0, ",x").otherwise("")
    lines = table(spark, sf, "documents").select(F.concat("source", F.lit(","), "lang", extra).alias("line"))
    return records.record_inventory(lines, "line")


@query("strictly_prior", "SELECT date, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS prior_games, max(date) OVER w AS last_prior FROM (SELECT date, count(*) AS n FROM v_games GROUP BY 1) WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "v_games")
def strictly_prior(spark, sf):
    return splits.strictly_prior(games(spark, sf), "date")


@query("whole_group_limit", "SELECT game FROM v_games WHERE date IN (SELECT date FROM (SELECT date, sum(count(*)) OVER (ORDER BY date) AS s FROM v_games GROUP BY date) WHERE s <= 1000)", "v_games")
def whole_group_limit(spark, sf):
    return splits.whole_group_limit(games(spark, sf), "date", 1000).select("game")


@query("date_split", "SELECT game, CASE WHEN k <= n // 2 THEN 'base' WHEN k <= n // 2 + n // 4 THEN 'calibration' ELSE 'final' END AS split FROM (SELECT game, dense_rank() OVER (ORDER BY date) AS k FROM v_games), (SELECT count(DISTINCT date) AS n FROM v_games)", "v_games")
def date_split(spark, sf):
    return splits.date_split(games(spark, sf), "date").select("game", "split")


@query("chronology_rank", "SELECT game, outcome, row_number() OVER (ORDER BY date, game) AS place FROM v_games", "v_games")
def chronology_rank(spark, sf):
    return splits.chronology_rank(games(spark, sf), "date", "game").select("game", "outcome", "place")


@query("first_games", "SELECT game, date FROM v_games ORDER BY date, game LIMIT 50", "v_games")
def first_games(spark, sf):
    return splits.first_games(games(spark, sf).select("game", "date"), "date", "game", 50)


@query("walk_forward_folds", """
WITH s AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM (SELECT user_id * 100 + day(ts) AS user_id, ts FROM events) GROUP BY 1)
SELECT s.user_id, count(t.user_id) AS train_games, CAST(epoch_us(max(t.b)) AS BIGINT) AS last_end_us, count(t.user_id) >= 20 AS usable FROM s LEFT JOIN s t ON t.b < s.a GROUP BY s.user_id""")
def walk_forward_folds(spark, sf):
    rows = events(spark, sf).select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("user_id"), "ts")
    out = splits.walk_forward_folds(rows, "user_id", "ts", 20)
    return out.select("user_id", "train_games", F.unix_micros("last_end").alias("last_end_us"), "usable")


@query("walk_forward_pairs", """
WITH s AS (SELECT o_custkey AS game, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT y.test, s.game AS train_game FROM s JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS test, date_trunc('year', o_orderdate) AS start FROM orders) y ON s.b < y.start""")
def walk_forward_pairs(spark, sf):
    rows = orders(spark, sf).select(F.col("o_custkey").alias("game"), F.col("o_orderdate").alias("d"))
    years = rows.select(F.year("d").alias("test"), F.date_trunc("year", "d").alias("start")).distinct()
    return splits.walk_forward_pairs(rows, years, "game", "d")


@query("walk_forward_membership", """
WITH s AS (SELECT o_custkey AS game, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1),
e AS (SELECT b, row_number() OVER (ORDER BY b) AS k FROM (SELECT DISTINCT b FROM s))
SELECT s.game, e.k AS bucket, coalesce(p.k, 0) AS trains_upto FROM s JOIN e ON e.b = s.b ASOF LEFT JOIN e p ON s.a > p.b""")
def walk_forward_membership(spark, sf):
    rows = orders(spark, sf).select(F.col("o_custkey").alias("game"), F.col("o_orderdate").alias("d"))
    return splits.walk_forward_membership(rows, "game", "d")


@query("fold_audit", "SELECT c.cutoff, count(*) AS train_games, count(*) FILTER (outcome = 'tie') AS ties, count(*) FILTER (outcome = 'home') AS home_wins FROM (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS cutoff FROM v_games) c JOIN v_games g ON g.date < c.cutoff GROUP BY 1", "v_games")
def fold_audit(spark, sf):
    g = games(spark, sf)
    cutoffs = g.select(F.to_date(F.date_trunc("month", "date")).alias("cutoff")).distinct()
    return splits.fold_audit(g, cutoffs, "date", "outcome").where("train_games > 0")


@query("replay_order_rank", "SELECT event_id, CAST(row_number() OVER (PARTITION BY stream ORDER BY received NULLS LAST, source NULLS LAST, kind NULLS LAST, event_id) AS INTEGER) AS place FROM v_feed", "v_feed")
def replay_order_rank(spark, sf):
    return review.replay_rank(feed(spark, sf), ["stream"], ["received", "source", "kind", "event_id"]).select("event_id", "place")


@query("hash_sample", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY sha256('sample|11|' || o_orderkey || '|' || o_orderpriority) LIMIT 100")
def hash_sample(spark, sf):
    return review.hash_sample(orders(spark, sf).select("o_orderkey", "o_orderpriority"), ["o_orderkey", "o_orderpriority"], "sample", "11", 100)


@query("topk_objects", "SELECT p_partkey, p_size FROM part ORDER BY p_size NULLS LAST, p_retailprice DESC, p_partkey LIMIT 25")
def topk_objects(spark, sf):
    return review.top_objects(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), [F.col("p_size").asc_nulls_last(), F.col("p_retailprice").desc(), F.col("p_partkey")], 25).select("p_partkey", "p_size")


@query("distinct_in_order", "SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us FROM events WHERE event_type <> 'error' GROUP BY 1 ORDER BY min(ts), user_id LIMIT 20")
def distinct_in_order(spark, sf):
    rows = events(spark, sf).where("event_type <> 'error'").select("user_id", F.unix_micros("ts").alias("first_us"))
    return review.distinct_in_order(rows, "user_id", ["first_us"], 20).select("user_id", F.col("first.first_us").alias("first_us"))


@query("review_queue", "SELECT doc_id, row_number() OVER (ORDER BY p, doc_id) AS rank FROM v_pred", "v_pred")
def review_queue(spark, sf):
    return review.review_queue(predictions(spark, sf).select("doc_id", "p"), "p", "doc_id").select("doc_id", "rank")


@query("modal_tag", "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) WHERE tag <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def modal_tag(spark, sf):
    return review.modal_tag(table(spark, sf, "part"), F.split("p_name", " "))


@query("stream_digest", "SELECT user_id, count(*) AS n, sha256('stream|' || count(*) || '|' || string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id)) AS digest FROM events GROUP BY 1")
def stream_digest(spark, sf):
    return review.stream_digest(events(spark, sf), ["user_id"], ["ts"], "event_id")


@query("replay_summary", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, arg_max(value, (ts, event_id)) AS terminal FROM events GROUP BY 1")
def replay_summary(spark, sf):
    return review.replay_summary(events(spark, sf), "event_type", ["ts", "event_id"], "value")
