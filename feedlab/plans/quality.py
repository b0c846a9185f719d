"""Queries: schema, null, domain, duplicate and set checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from .registry import depth, events, feed, games, lineitem, orders, predictions, query, rules, table


@query("null_profile", "SELECT unnest(['event_id','ts','user_id','event_type','value','props']) AS \"column\", unnest([count(*) - count(event_id), count(*) - count(ts), count(*) - count(user_id), count(*) - count(event_type), count(*) - count(value), count(*) - count(props)]) AS nulls FROM events")
def null_profile(spark, sf):
    return q.null_profile(events(spark, sf))


@query("event_type_mix", "SELECT coalesce(event_type, '(null)') AS event_type, count(*) AS n_rows FROM events GROUP BY 1")
def event_type_mix(spark, sf):
    return q.type_mix(events(spark, sf), "event_type")


@query("quarantine_split", """
SELECT l_returnflag, reasons, count(*) AS n_rows FROM (SELECT l_returnflag, array_to_string(list_filter([CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_quantity < 3 THEN 'quantity' END, CASE WHEN l_tax <= 0 THEN 'tax' END], lambda x: x IS NOT NULL), ',') AS reasons FROM lineitem) GROUP BY ALL""")
def quarantine_split(spark, sf):
    good, bad = q.quarantine(lineitem(spark, sf), {"discount": F.col("l_discount") > 0.08, "quantity": F.col("l_quantity") < 3, "tax": F.col("l_tax") <= 0})
    both = good.select("l_returnflag", F.lit("").alias("reasons")).unionByName(bad.select("l_returnflag", F.array_join("reasons", ",").alias("reasons")))
    return both.groupBy("l_returnflag", "reasons").agg(F.count(F.lit(1)).alias("n_rows"))


@query("eligibility_census", "SELECT o_orderpriority, count(*) AS n_rows, count(*) FILTER (o_custkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderstatus IN ('F', 'O') AND o_totalprice > 1000) AS n_eligible FROM orders GROUP BY 1")
def eligibility_census(spark, sf):
    return q.eligibility_census(orders(spark, sf), "o_orderpriority", ["o_custkey", "o_totalprice"], F.col("o_orderstatus").isin("F", "O"), F.col("o_totalprice") > 1000)


@query("pit_violations", "SELECT event_id, array_to_string(list_filter([CASE WHEN received > source + to_hours(12) THEN 'received' END, CASE WHEN effective > source + to_hours(12) THEN 'effective' END], lambda x: x IS NOT NULL), ',') AS late FROM (SELECT *, received - to_hours(size) AS effective FROM v_feed) WHERE received > source + to_hours(12) OR effective > source + to_hours(12)", "v_feed")
def pit_violations(spark, sf):
    rows = feed(spark, sf).withColumns({"cutoff": F.expr("source + INTERVAL 12 HOURS"), "effective": F.timestamp_micros(F.unix_micros("received") - F.col("size") * 3_600_000_000)})
    return q.late_features(rows, "cutoff", ["received", "effective"]).select("event_id", F.array_join("late", ",").alias("late"))


@query("dedupe_exact", "SELECT doc_id, n > 1 AS had_duplicates FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) AS n FROM documents) WHERE nth = 1")
def dedupe_exact(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))  # the window moves hashes, not texts
    return q.dedupe_exact(rows, ["h"], ["doc_id"]).select("doc_id", "had_duplicates")


@query("id_conflicts", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS n_contents, count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice)) > 1 AS conflict FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def id_conflicts(spark, sf):
    return q.id_conflicts(lineitem(spark, sf), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


@query("union_by_name", "SELECT event_type, count(*) AS n_rows, count(value) AS n_values, count(props) AS n_props FROM (SELECT event_id, event_type, value FROM events WHERE event_id % 2 = 0 UNION ALL BY NAME SELECT event_id, event_type, props FROM events WHERE event_id % 2 = 1) GROUP BY 1")
def union_by_name(spark, sf):
    e = events(spark, sf)
    both = q.union_by_name(e.where("event_id % 2 = 0").select("event_id", "event_type", "value"), e.where("event_id % 2 = 1").select("event_id", "event_type", "props"))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.count("props").alias("n_props"))


@query("distinct_keys", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_keys(spark, sf):
    return events(spark, sf).select("user_id", "event_type").distinct()


@query("split_disjoint", """
SELECT 'overlap' AS "check", count(*) AS n FROM (SELECT game FROM v_games WHERE season < 1996 INTERSECT SELECT game FROM v_games WHERE season >= 1996)
UNION ALL SELECT 'left out', count(*) FROM v_games WHERE season IS NULL""", "v_games")
def split_disjoint(spark, sf):
    g = games(spark, sf)
    train, test = g.where("season < 1996"), g.where("season >= 1996")
    both = q.overlap(train, test, ["game"]).agg(F.lit("overlap").alias("check"), F.count(F.lit(1)).alias("n"))
    rest = q.missing_keys(g, train.unionByName(test), ["game"]).agg(F.lit("left out").alias("check"), F.count(F.lit(1)).alias("n"))
    return both.unionByName(rest)


@query("unordered_pairs", "SELECT least(a.n_regionkey, b.r_regionkey) AS low, greatest(a.n_regionkey, b.r_regionkey) AS high, count(*) AS n FROM nation a JOIN region b ON a.n_nationkey % 5 <> b.r_regionkey GROUP BY 1, 2")
def unordered_pairs(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return q.unordered_pairs(n.join(F.broadcast(r), F.col("n_nationkey") % 5 != F.col("r_regionkey")), "n_regionkey", "r_regionkey")


@query("two_run_diff", """
WITH a AS (SELECT event_type, user_id, count(*) AS n, arg_max(event_id, (ts, event_id)) AS l FROM events GROUP BY 1, 2),
b AS (SELECT event_type, user_id, count(*) AS n, arg_max(event_id, (ts, event_id)) AS l FROM events WHERE value >= 3 GROUP BY 1, 2)
SELECT e.event_type, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x WHERE x.event_type = e.event_type) AS only_first, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) y WHERE y.event_type = e.event_type) AS only_second
FROM (SELECT DISTINCT event_type FROM events) e""")
def two_run_diff(spark, sf):
    e = events(spark, sf)
    run = lambda df: df.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last"))
    diff = q.two_run_diff(run(e), run(e.repartition(7, "event_id").where("value >= 3")))  # the second run lost some events
    kinds = e.select("event_type").distinct().join(diff, "event_type", "left")
    return kinds.groupBy("event_type").agg(F.count_if(F.col("run") == "first").alias("only_first"), F.count_if(F.col("run") == "second").alias("only_second"))


@query("constant_in_group", "SELECT l_orderkey, count(DISTINCT coalesce(l_returnflag, '~')) = 1 AS l_returnflag, count(DISTINCT coalesce(l_linestatus, '~')) = 1 AS l_linestatus FROM lineitem GROUP BY 1")
def constant_in_group(spark, sf):
    return q.constant_in_group(lineitem(spark, sf), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("partition_audit", "SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, count(DISTINCT o_orderkey) = count(*) AS unique_keys, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS kinds FROM orders GROUP BY 1")
def partition_audit(spark, sf):
    return q.partition_audit(orders(spark, sf), F.year("o_orderdate"), "o_orderkey", "o_orderstatus")


@query("depth_sorted_check", """
SELECT book, count(*) AS levels, count(DISTINCT price) = count(*) AS unique_prices, min(size) > 0 AS positive, bool_and(price % 0.05 = 0) AS on_grid FROM v_depth GROUP BY book""", "v_depth")
def depth_sorted_check(spark, sf):
    from ..operators.books import side_check

    return side_check(depth(spark, sf), ["book"], "price", "size", F.lit("0.05").cast("decimal(3,2)"))


@query("bitemporal_check", """
SELECT rule_id, array_to_string(list_filter([CASE WHEN effective > fetched + to_hours(48) THEN 'effective too late' END, CASE WHEN NOT valid AND fee_rate > 0 THEN 'invalid with fee' END, CASE WHEN valid AND fee_rate = 0 THEN 'valid without fee' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM v_rules WHERE effective > fetched + to_hours(48) OR (NOT valid AND fee_rate > 0) OR (valid AND fee_rate = 0)""", "v_rules")
def bitemporal_check(spark, sf):
    _, bad = q.quarantine(rules(spark, sf), {"effective too late": F.col("effective") > F.expr("fetched + INTERVAL 48 HOURS"), "invalid with fee": ~F.col("valid") & (F.col("fee_rate") > 0), "valid without fee": F.col("valid") & (F.col("fee_rate") == 0)})
    return bad.select("rule_id", F.array_join("reasons", ",").alias("reasons"))


@query("distribution_check", "SELECT doc_id, q >= 0 AND q <= 1 AND r >= 0 AND r <= 1 AND q + r = 1 AS proper FROM (SELECT doc_id, CAST(round(p, 6) AS DECIMAL(9,6)) AS q, CAST(round(1 - p, 6) AS DECIMAL(9,6)) AS r FROM v_pred)", "v_pred")
def distribution_check(spark, sf):
    from ..functions.probability import is_distribution

    p = predictions(spark, sf)
    probs = F.create_map(F.lit("yes"), F.round("p", 6).cast("decimal(9,6)"), F.lit("no"), F.round(1 - F.col("p"), 6).cast("decimal(9,6)"))
    return p.select("doc_id", is_distribution(probs, ["yes", "no"]).alias("proper"))


@query("cost_identity", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gross = qty * vwap AS gross_ok, total = gross + fee AS total_ok FROM (SELECT *, CAST(l_quantity AS DECIMAL(9,2)) AS qty, CAST(round(l_extendedprice / l_quantity, 4) AS DECIMAL(12,4)) AS vwap, CAST(l_extendedprice AS DECIMAL(18,6)) AS gross, CAST(round(l_extendedprice * l_tax, 4) AS DECIMAL(18,6)) AS fee, CAST(round(l_extendedprice * (1 + l_tax), 4) AS DECIMAL(18,6)) AS total FROM lineitem)""")
def cost_identity(spark, sf):
    rows = lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(9,2)").alias("qty"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 4).cast("decimal(12,4)").alias("vwap"), F.col("l_extendedprice").cast("decimal(18,6)").alias("gross"), F.round(F.col("l_extendedprice") * F.col("l_tax"), 4).cast("decimal(18,6)").alias("fee"), F.round(F.col("l_extendedprice") * (1 + F.col("l_tax")), 4).cast("decimal(18,6)").alias("total"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("gross") == F.col("qty") * F.col("vwap")).alias("gross_ok"), (F.col("total") == F.col("gross") + F.col("fee")).alias("total_ok"))


@query("fills_audit", "SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (NOT (l_discount BETWEEN 0 AND 1 AND l_quantity >= 0)) AS n_bad, count(DISTINCT l_partkey) AS n_keys, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS quantity FROM lineitem GROUP BY 1")
def fills_audit(spark, sf):
    from ..sources.records import fills_summary

    return fills_summary(lineitem(spark, sf), "l_returnflag", "l_discount", "l_quantity", "l_partkey")


@query("trade_window_check", "SELECT l_partkey, count(*) AS n_rows, count(*) FILTER (l_shipdate < TIMESTAMP '1996-01-01' OR l_shipdate >= TIMESTAMP '2000-01-01') AS n_outside, count(*) >= 40 AS page_cap_hit FROM lineitem GROUP BY 1")
def trade_window_check(spark, sf):
    from ..sources.records import trade_windows

    return trade_windows(lineitem(spark, sf), "l_partkey", "l_shipdate", F.lit("1996-01-01").cast("timestamp"), F.lit("2000-01-01").cast("timestamp"), 40)


@query("feed_scan_filter", "SELECT event_id, kind, CAST(epoch_us(received) AS BIGINT) AS received_us, price, size FROM v_feed WHERE stream = 7 AND kind = 'purchase'", "v_feed")
def feed_scan_filter(spark, sf):
    return feed(spark, sf).where("stream = 7 AND kind = 'purchase'").select("event_id", "kind", F.unix_micros("received").alias("received_us"), "price", "size")
