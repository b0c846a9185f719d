"""Queries: point-in-time, interval and reconciling joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, joins
from .registry import depth, events, feed, lineitem, orders, plays, query, quotes, rules, table

_US = "CAST(epoch_us({}) AS BIGINT)"


@query("key_semi_extract", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def key_semi_extract(spark, sf):
    keys = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    found, _ = joins.exact_key_extract(lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), keys, ["l_partkey"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_RULE_SQL = """
c AS (SELECT p.quote_id, p.stream, p.received, count(r.rule_id) AS seen, max(CASE WHEN r.valid AND r.effective <= p.received THEN {'e': r.effective, 'f': r.fetched, 'i': r.rule_id} END) AS pick, max(CASE WHEN NOT r.valid THEN r.fetched END) AS inv
  FROM v_quotes p LEFT JOIN v_rules r ON r.stream = p.stream AND r.fetched <= p.received GROUP BY 1, 2, 3),
s AS (SELECT *, CASE WHEN seen = 0 THEN 'missing' WHEN pick IS NULL AND inv IS NOT NULL THEN 'invalid' WHEN pick IS NULL THEN 'not_effective' WHEN inv >= pick.f THEN 'invalid' WHEN epoch_us(received) - epoch_us(pick.f) > 864000000000 THEN 'stale' ELSE 'ok' END AS status FROM c)"""


@query("asof_rule_lookup", f"WITH {_RULE_SQL} SELECT quote_id, status, CASE WHEN status = 'ok' THEN pick.i END AS rule_id FROM s", "v_quotes v_rules")
def asof_rule_lookup(spark, sf):
    got = asof.asof_rule(quotes(spark, sf), rules(spark, sf), ["stream"], "received", 864_000_000_000)
    return got.select("quote_id", "status", "rule_id")


@query("forward_asof", "SELECT p.quote_id, (SELECT {'r': q.received, 'i': q.quote_id} FROM v_quotes q WHERE q.stream = p.stream AND q.state = 'ACTIVE' AND q.received >= p.received + INTERVAL 1 HOUR ORDER BY q.received, q.quote_id LIMIT 1).i AS found FROM v_quotes p", "v_quotes")
def forward_asof(spark, sf):
    q = quotes(spark, sf)
    points = q.select("stream", "quote_id", F.expr("received + INTERVAL 1 HOUR").alias("at"))
    rows = q.where("state = 'ACTIVE'").select("stream", "received", F.col("quote_id").alias("found"))
    return asof.first_at_or_after(points, rows, ["stream"], "at", "received", ["found"], tie="found").select("quote_id", "found")


@query("prefix_counts", """
SELECT p.event_id, count(*) FILTER (e.event_type = 'purchase') AS purchases, count(*) FILTER (e.event_type = 'error') AS errors
FROM events p JOIN events e ON e.user_id = p.user_id AND e.ts <= p.ts WHERE p.event_type = 'signup' GROUP BY 1""")
def prefix_counts(spark, sf):
    e = events(spark, sf)
    got = asof.prefix_counts(e.where("event_type = 'signup'").select("user_id", "ts", "event_id"), e, ["user_id"], ["ts"], {"purchases": F.col("event_type") == "purchase", "errors": F.col("event_type") == "error"})
    return got.select("event_id", "purchases", "errors")


@query("interval_first_event", """
SELECT p.event_id, coalesce(arg_min(e.event_type, (e.ts, e.event_id)), 'none') AS label, arg_min(e.event_id, (e.ts, e.event_id)) AS found
FROM events p LEFT JOIN events e ON e.user_id = p.user_id AND e.ts > p.ts AND e.ts <= p.ts + INTERVAL 6 HOUR AND e.event_type IN ('purchase', 'error') WHERE p.event_type = 'signup' GROUP BY 1""")
def interval_first_event(spark, sf):
    e = events(spark, sf)
    marks = e.where("event_type IN ('purchase', 'error')").select("user_id", "ts", F.col("event_type").alias("label"), F.col("event_id").alias("found"))
    got = asof.first_in_window(e.where("event_type = 'signup'").select("user_id", "event_id", F.col("ts").alias("at")), marks, ["user_id"], "at", "ts", 6 * 3_600_000_000, ["label", "found"], tie="found")
    return got.select("event_id", "label", "found")


@query("range_join_counts", "SELECT p.quote_id, count(*) AS n FROM v_quotes p JOIN v_feed f ON f.stream = p.stream AND f.received BETWEEN p.received - INTERVAL 2 HOUR AND p.received GROUP BY 1", "v_quotes v_feed")
def range_join_counts(spark, sf):
    p = quotes(spark, sf).select("stream", "quote_id", F.expr("received - INTERVAL 2 HOURS").alias("start"), F.col("received").alias("end"))
    got = asof.range_join(p, feed(spark, sf).select("stream", F.col("received").alias("t")), ["stream"], "start", "end", "t", 2 * 3_600_000_000)
    return got.groupBy("quote_id").agg(F.count(F.lit(1)).alias("n"))


@query("cross_grid", "SELECT n_nationkey, g.minute, s.side FROM nation, (SELECT CAST(unnest(range(0, 45, 5)) AS INTEGER) AS minute) g, (VALUES ('home'), ('away')) s(side)")
def cross_grid(spark, sf):
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(5))).alias("minute")).select("minute", F.explode(F.array(F.lit("home"), F.lit("away"))).alias("side"))
    return asof.cross_grid(table(spark, sf, "nation").select("n_nationkey"), grid)


@query("reconcile_counts", """
WITH h AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), l AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT side, count(*) AS n FROM (SELECT CASE WHEN l.v IS NULL THEN 'historical' WHEN h.v IS NULL THEN 'live' WHEN h.v = l.v THEN 'both' ELSE 'conflict' END AS side FROM h FULL JOIN l USING (o_orderkey)) GROUP BY 1""")
def reconcile_counts(spark, sf):
    o = orders(spark, sf).select("o_orderkey", F.col("o_totalprice").alias("v"))
    live = o.where("o_orderkey % 5 <> 0").withColumn("v", F.col("v") + F.when(F.col("o_orderkey") % 7 == 0, 1.0).otherwise(0.0))
    return joins.reconcile(o.where("o_orderkey % 3 <> 0"), live, "o_orderkey", ["v"]).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("unordered_pair_bind", """
WITH s AS (SELECT s_suppkey, s_nationkey AS a, CAST(s_suppkey % 25 AS INTEGER) AS b FROM supplier), c AS (SELECT least(c_nationkey, CAST(c_custkey % 25 AS INTEGER)) AS lo, greatest(c_nationkey, CAST(c_custkey % 25 AS INTEGER)) AS hi, count(*) AS n, min(c_custkey) AS id FROM customer GROUP BY 1, 2)
SELECT s_suppkey, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN id END AS c_custkey FROM s LEFT JOIN c ON lo = least(a, b) AND hi = greatest(a, b)""")
def unordered_pair_bind(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 25).cast("int").alias("b"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("x"), (F.col("c_custkey") % 25).cast("int").alias("y"))
    return joins.bind_unique(s, c, ("a", "b"), ("x", "y"), [], "c_custkey").select("s_suppkey", "matches", "c_custkey")


@query("start_time_delta", "SELECT o_orderkey, CAST(epoch(timezone('UTC', timezone('America/New_York', o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)))) ) - epoch(o_orderdate) AS BIGINT) AS delta_s, abs(epoch(timezone('UTC', timezone('America/New_York', o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT))))) - epoch(o_orderdate)) > 43200 AS anomaly FROM orders")
def start_time_delta(spark, sf):
    rows = orders(spark, sf).select("o_orderkey", F.col("o_orderdate").alias("utc"), F.timestamp_micros(F.unix_micros("o_orderdate") + F.col("o_orderkey") % 24 * 3_600_000_000).alias("local"))
    return joins.start_time_delta(rows, "local", "America/New_York", "utc").select("o_orderkey", "delta_s", "anomaly")


@query("orientation_mismatch", "SELECT l_partkey, count(*) AS n_fills, count(*) FILTER (CASE l_returnflag WHEN 'A' THEN 'ECONOMY' WHEN 'N' THEN 'STANDARD' ELSE 'PROMO' END <> p_type) AS n_mismatch, count(DISTINCT l_returnflag) AS n_labels FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def orientation_mismatch(spark, sf):
    label = F.when(F.col("l_returnflag") == "A", "ECONOMY").when(F.col("l_returnflag") == "N", "STANDARD").otherwise("PROMO")
    fills = lineitem(spark, sf).select("l_partkey", label.alias("filled"))
    return joins.orientation_mismatch(fills, table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey", "filled", "p_type")


@query("left_attach", "SELECT o_orderkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def left_attach(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return joins.attach_many_to_one(orders(spark, sf).select("o_orderkey", "o_custkey"), c, "o_custkey", ["c_mktsegment", "c_nationkey"]).select("o_orderkey", "c_mktsegment", "c_nationkey")


@query("field_mismatch_audit", """
WITH n AS (SELECT event_id, event_type, user_id, lead(event_type) OVER w AS t2, lead(user_id) OVER w AS u2 FROM events WINDOW w AS (ORDER BY event_id)),
f AS (SELECT 'event_type' AS field, event_id, event_type IS NOT DISTINCT FROM t2 AS ok FROM n UNION ALL SELECT 'user_id', event_id, user_id IS NOT DISTINCT FROM u2 FROM n)
SELECT field, count(*) AS comparisons, count(*) FILTER (ok) AS matches, count(*) FILTER (NOT ok) AS mismatches, min(event_id) FILTER (NOT ok) AS first_mismatch, CAST(floor(count(*) FILTER (ok) * 1000000 / count(*)) AS BIGINT) AS match_ppm FROM f WHERE event_id < (SELECT max(event_id) FROM events) GROUP BY 1""")
def field_mismatch_audit(spark, sf):
    e = events(spark, sf).select("event_id", "event_type", "user_id")  # ids are dense, so the next row is the one of the next id
    following = e.select((F.col("event_id") - 1).alias("event_id"), "event_type", "user_id")
    return joins.compare_fields(e, following, ["event_id"], ["event_type", "user_id"], "event_id")


@query("review_coverage", "SELECT doc_id, 'missing' AS problem FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'extra' FROM labels ANTI JOIN documents USING (doc_id) UNION ALL SELECT doc_id, 'repeated' FROM labels GROUP BY 1 HAVING count(*) > 1")
def review_coverage(spark, sf):
    return joins.review_coverage(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("lineage_orphans", """
WITH e AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn > 0 THEN [conv_id * 100 + turn - 1, conv_id * 100 + turn + 1] ELSE [] END AS parents, turn % 3 = 0 AS raw FROM conversations)
SELECT DISTINCT id, 'missing parent' AS problem FROM (SELECT id, unnest(parents) AS p FROM e) x WHERE p NOT IN (SELECT id FROM e) UNION ALL SELECT id, 'raw xor parents' FROM e WHERE raw = (len(parents) > 0)""")
def lineage_orphans(spark, sf):
    ident = F.col("conv_id") * 100 + F.col("turn")
    e = table(spark, sf, "conversations").select(ident.alias("id"), F.when(F.col("turn") > 0, F.array(ident - 1, ident + 1)).otherwise(F.array().cast("array<long>")).alias("parents"), (F.col("turn") % 3 == 0).alias("raw"))
    return joins.lineage_orphans(e, "id", "parents", F.col("raw"))


@query("zip_explode_map", "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, string_split(p_name, ' ')[i] AS words, substr(string_split(p_name, ' ')[i], 1, 2) AS heads FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def zip_explode_map(spark, sf):
    p = table(spark, sf, "part").withColumn("words", F.split("p_name", " ")).withColumn("heads", F.transform("words", lambda w: F.substring(w, 1, 2)))
    return joins.zip_explode(p, ["words", "heads"], ["p_partkey"])


@query("score_reconcile", """
WITH c AS (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_returnflag = 'A') AS h, count(*) FILTER (l_returnflag = 'R') AS a FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderkey % 3 AS declared_home, coalesce(h, 0) AS counted_home, o_orderkey % 3 = coalesce(h, 0) AS ok_home, o_orderkey % 2 AS declared_away, coalesce(a, 0) AS counted_away, o_orderkey % 2 = coalesce(a, 0) AS ok_away FROM orders LEFT JOIN c USING (o_orderkey)""")
def score_reconcile(spark, sf):
    totals = orders(spark, sf).select("o_orderkey", (F.col("o_orderkey") % 3).alias("h"), (F.col("o_orderkey") % 2).alias("a"))
    parts = lineitem(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return joins.score_reconcile(totals, parts, "o_orderkey", {"home": ("h", F.col("l_returnflag") == "A"), "away": ("a", F.col("l_returnflag") == "R")})


@query("hash_chain", """
WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'x' ELSE sha256(concat(conv_id, '|', turn - 1)) END AS prev, sha256(concat(conv_id, '|', turn)) AS next FROM conversations),
l AS (SELECT *, lag(next) OVER w AS f, lag(turn) OVER w AS t FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, prev IS DISTINCT FROM f AS broken_hash, turn <> t + 1 AS broken_sequence FROM l WHERE t IS NOT NULL AND (prev IS DISTINCT FROM f OR turn <> t + 1)""")
def hash_chain(spark, sf):
    h = lambda t: F.sha2(F.concat(F.col("conv_id").cast("string"), F.lit("|"), t.cast("string")), 256)
    s = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, "x").otherwise(h(F.col("turn") - 1)).alias("prev"), h(F.col("turn")).alias("next"))
    return joins.step_chain_check(s, ["conv_id"], "turn", "prev", "next").select("conv_id", "turn", "broken_hash", "broken_sequence")


@query("four_way_alignment", f"""
WITH m AS (SELECT event_id, stream, received FROM v_feed WHERE kind = 'click'), {_RULE_SQL.replace("c AS (SELECT p.quote_id, p.stream, p.received", "c AS (SELECT p.event_id AS quote_id, p.stream, p.received").replace("FROM v_quotes p", "FROM m p")},
q AS (SELECT m.event_id, arg_max({{'i': v.quote_id, 's': v.state, 'r': v.received}}, (v.received, v.quote_id)) AS q FROM m LEFT JOIN v_quotes v ON v.stream = m.stream AND v.received <= m.received GROUP BY 1),
d AS (SELECT m.event_id, max(v.event_id) AS meta FROM m LEFT JOIN v_feed v ON v.stream = m.stream AND v.kind = 'view' AND v.received <= m.received GROUP BY 1)
SELECT event_id, array_to_string(list_filter([CASE WHEN q.i IS NULL THEN 'no quote' WHEN q.s = 'SUSPENDED' THEN 'suspended' END,
  CASE WHEN rs <> 'ok' THEN 'rule ' || rs END, CASE WHEN meta IS NULL THEN 'no metadata' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT quote_id AS event_id, CASE WHEN status = 'stale' THEN 'ok' ELSE status END AS rs FROM s) JOIN q USING (event_id) JOIN d USING (event_id)""", "v_quotes v_rules v_feed")
def four_way_alignment(spark, sf):
    f = feed(spark, sf)
    models = f.where("kind = 'click'").select("stream", "event_id", F.col("received").alias("cutoff"))
    meta = f.where("kind = 'view'").select("stream", F.col("event_id").alias("meta_id"), F.col("received").alias("captured"))
    got = asof.align_four(models, quotes(spark, sf), rules(spark, sf), meta, ["stream"], "cutoff", 864_000_000_000)
    return got.select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query("lead_compare", "SELECT kind, count(*) AS n, count(*) FILTER (nk = kind) AS same_kind, count(*) FILTER (np = period) AS same_period FROM (SELECT *, lead(kind) OVER w AS nk, lead(period) OVER w AS np FROM v_pbp WINDOW w AS (PARTITION BY game ORDER BY seq)) WHERE nk IS NOT NULL GROUP BY 1", "v_pbp")
def lead_compare(spark, sf):
    from ..operators.plays import next_row_check

    return next_row_check(plays(spark, sf), ["game"], "seq", "kind", {"same_kind": ("kind", "kind"), "same_period": ("period", "period")})


@query("depth_vwap", """
WITH d AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY book ORDER BY price, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v_depth),
t AS (SELECT *, CAST(least(greatest(60 - before, 0), size) AS DECIMAL(14,4)) AS take FROM d)
SELECT book, CAST(sum(take) AS DECIMAL(24,4)) AS filled, CAST((200 * sum(CAST(take * 10000 AS HUGEINT) * CAST(price * 10000 AS HUGEINT)) + sum(CAST(take * 10000 AS HUGEINT))) // (2 * sum(CAST(take * 10000 AS HUGEINT))) AS DOUBLE) / 1000000 AS vwap, count(*) FILTER (take > 0) AS levels_used, CASE WHEN sum(take) = 60 THEN 'filled' ELSE 'insufficient' END AS status FROM t GROUP BY 1""", "v_depth")
def depth_vwap(spark, sf):
    from ..operators.books import depth_vwap as walk

    return walk(depth(spark, sf), ["book"], ["price", "l_linenumber", "l_partkey", "l_suppkey"], "price", "size", F.lit(60).cast("decimal(14,4)")).withColumn("vwap", F.round("vwap", 6).cast("double"))
