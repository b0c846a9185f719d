"""Queries: parsing, normalising, hashing and identity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import quality as q
from .registry import events, feed, lineitem, orders, query, table


@query("feed_canonical", "SELECT event_id, lower(trim(kind)) AS kind, CAST(CASE WHEN price > 0 THEN price END AS DECIMAL(9,2)) AS price, CASE WHEN kind IN ('purchase') THEN 'BUY' WHEN kind = 'view' THEN 'SELL' END AS side, array_to_string(list_filter([CASE WHEN price <= 0 THEN 'price' END, CASE WHEN size < 1 THEN 'size' END], lambda x: x IS NOT NULL), ',') AS reasons FROM v_feed", "v_feed")
def feed_canonical(spark, sf):
    from ..sources.feeds import canonicalize

    raw = feed(spark, sf).select("event_id", F.concat(F.lit(" "), F.upper("kind")).alias("kind"), F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"))
    return canonicalize(raw, {"purchase": "BUY", "view": "SELL"}).select("event_id", "kind", "price", "side", F.array_join("reasons", ",").alias("reasons"))


@query("json_levels_parse", "SELECT event_id, CAST(k AS DECIMAL(9,4)) AS price, CAST(k * 10 AS DECIMAL(18,6)) AS size, 2 AS levels FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def json_levels_parse(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    text = F.format_string('[["%d","%d"],["%d.5","1"]]', k, k * 10, k)
    parsed = events(spark, sf).select("event_id", t.parse_levels(text).alias("x"))
    return parsed.select("event_id", F.get("x", 0)["price"].alias("price"), F.get("x", 0)["size"].alias("size"), F.size("x").alias("levels"))


@query("row_content_hash", """SELECT o_orderkey, 'sha256:' || sha256('{"custkey":"' || o_custkey || '","key":"' || o_orderkey || '","priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS hash FROM orders""")
def row_content_hash(spark, sf):
    return orders(spark, sf).select("o_orderkey", t.canonical_hash({"key": F.col("o_orderkey"), "custkey": F.col("o_custkey"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}).alias("hash"))


@query("event_id_hash", """SELECT event_id, 'evt_' || sha256('{"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '","user_id":"' || user_id || '"}') AS id FROM events""")
def event_id_hash(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", t.event_id(e, ["user_id", "event_type", "props"]).alias("id"))


@query("fixed_point", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN c % 100 = 0 THEN CAST(c // 100 AS VARCHAR) WHEN c % 10 = 0 THEN CAST(c // 10 AS VARCHAR) ELSE CAST(c AS VARCHAR) END AS atoms, CAST(CASE WHEN c % 100 = 0 THEN 0 WHEN c % 10 = 0 THEN 1 ELSE 2 END AS INTEGER) AS scale, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(38,18)) AS back FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS c FROM lineitem)")
def fixed_point(spark, sf):
    rows = lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", t.fixed_point_encode(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("f"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("f.atoms").alias("atoms"), F.col("f.scale").alias("scale"), t.fixed_point_decode(F.col("f.atoms"), F.col("f.scale")).alias("back"))


_PATHS = """
WITH d AS (SELECT event_type, TRY_CAST(props AS JSON) AS j, props FROM events),
v AS (SELECT event_type, '$' AS path, CASE WHEN props IS NULL THEN 'missing' WHEN j IS NULL THEN 'invalid' ELSE json_type(j) END AS t FROM d
  UNION ALL SELECT event_type, '$.' || k, json_type(j, '$.' || k) FROM (SELECT event_type, j, unnest(json_keys(j)) AS k FROM d WHERE j IS NOT NULL)),
n AS (SELECT DISTINCT event_type, path, CASE WHEN t IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'UHUGEINT') THEN 'BIGINT' ELSE t END AS t FROM v)"""


@query("json_schemas", f"""{_PATHS}
SELECT event_type, count(*) AS n, count(*) FILTER (props IS NULL) AS missing, count(*) FILTER (props IS NOT NULL AND j IS NULL) AS invalid, any_value(schema) AS schema, sha256(any_value(schema)) AS fingerprint
FROM d JOIN (SELECT event_type, 'OBJECT<' || string_agg(path[3:] || ': ' || t, ', ' ORDER BY path) || '>' AS schema FROM n WHERE path <> '$' GROUP BY 1) USING (event_type) GROUP BY event_type""")
def json_schemas(spark, sf):
    return q.json_schemas(events(spark, sf), "event_type", "props")


@query("json_schema_agg", f"""{_PATHS}
SELECT event_type, path, string_agg(DISTINCT CASE t WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' ELSE lower(t) END, '|') AS schema FROM n GROUP BY 1, 2""")
def json_schema_agg(spark, sf):
    return q.json_types(events(spark, sf), "event_type", "props").select("event_type", "path", F.array_join("types", "|").alias("schema"))


@query("id_pattern_check", "SELECT c_custkey, regexp_matches('market_' || c_custkey, '^market_[A-Za-z0-9][A-Za-z0-9._:-]*$') AS market_ok, regexp_matches(c_name, '^game_[A-Za-z0-9][A-Za-z0-9._:-]*$') AS game_ok, c_mktsegment IN ('BUILDING', 'MACHINERY') AS segment_ok FROM customer")
def id_pattern_check(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", t.is_id(F.concat(F.lit("market_"), F.col("c_custkey").cast("string")), "market").alias("market_ok"), t.is_id(F.col("c_name"), "game").alias("game_ok"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("segment_ok"))


@query("utc_roundtrip", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS text, CAST(epoch_us(ts) AS BIGINT) AS us, event_id % 2 = 0 AS strict_ok FROM events")
def utc_roundtrip(spark, sf):
    e = events(spark, sf).select("event_id", t.format_utc(F.col("ts")).alias("text"))
    loose = F.when(F.col("event_id") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", "Z$", "+00:00"))
    return e.select("event_id", "text", F.unix_micros(t.parse_utc(F.col("text"))).alias("us"), t.parse_utc(loose).isNotNull().alias("strict_ok"))


@query("frame_flatten", "SELECT event_id, k, CAST(event_id % 2 + 1 AS INTEGER) AS events FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_id % 7 <> 0")
def frame_flatten(spark, sf):
    frame = F.when(F.col("event_id") % 7 == 0, "PONG").when(F.col("event_id") % 2 == 1, F.concat(F.lit("["), F.col("props"), F.lit(","), F.col("props"), F.lit("]"))).otherwise(F.col("props"))
    good, _ = t.flatten_frames(events(spark, sf).select("event_id", frame.alias("frame")), "frame", ["event_id"], "struct<k:bigint>", "k")
    return good.groupBy("event_id", "k").agg(F.count(F.lit(1)).cast("int").alias("events"))


@query("rule_table_case", "SELECT o_orderkey, CAST(CASE WHEN p = 'POST' OR s <= 2016 THEN 900 ELSE 600 END AS INTEGER) AS overtime_s, CAST(CASE WHEN q >= 5 AND p = 'REG' THEN 2 ELSE 3 END AS INTEGER) AS allotment, CAST(CASE WHEN q = 2 THEN 3 WHEN p = 'REG' AND q + 1 = 5 THEN 2 WHEN p = 'POST' AND q + 1 >= 5 AND (q + 1) % 2 = 1 THEN 3 END AS INTEGER) AS reset FROM (SELECT o_orderkey, year(o_orderdate) + 20 AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'REG' ELSE 'POST' END AS p, o_orderkey % 6 + 1 AS q FROM orders)")
def rule_table_case(spark, sf):
    s, p, per = F.year("o_orderdate") + 20, F.when(F.col("o_orderkey") % 2 == 0, "REG").otherwise("POST"), F.col("o_orderkey") % 6 + 1
    return orders(spark, sf).select("o_orderkey", t.overtime_seconds(s, p).alias("overtime_s"), t.timeout_allotment(p, per).alias("allotment"), t.timeout_reset(p, per, per + 1).alias("reset"))


@query("orient_signed", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_returnflag = 'A' THEN l_discount ELSE 1 - l_discount END, 6) AS p_home FROM lineitem")
def orient_signed(spark, sf):
    from ..functions.probability import orient

    return lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(orient(F.col("l_discount"), F.col("l_returnflag") == "A"), 6).alias("p_home"))


@query("label_map", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'touchdown' WHEN 'STANDARD' THEN 'turnover' ELSE 'other' END AS label FROM part")
def label_map(spark, sf):
    native = F.when(F.col("p_type") == "ECONOMY", "  Touchdown ").when(F.col("p_type") == "STANDARD", "Turnover  on\tDowns").otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", t.label_map(native).alias("label"))


@query("text_identity_parse", r"SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CAST(nullif(regexp_extract(url, '/(\d+)(?:\.html|/|$|[?#])', 1), '') AS INTEGER) AS number FROM pages")
def text_identity_parse(spark, sf):
    u = F.col("url")
    number = F.regexp_extract(u, r"/(\d+)(?:\.html|/|$|[?#])", 1)
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(u, "^(https?)://", 1).alias("scheme"), F.regexp_extract(u, r"^https?://([^/?#]+)", 1).alias("host"), F.when(number != "", number.cast("int")).alias("number"))


@query("market_identity", r"""
WITH m AS (SELECT o_orderkey, o_orderstatus AS st, o_orderkey % 5 AS x, CAST(o_orderdate AS DATE) AS d, CASE o_orderpriority WHEN '1-URGENT' THEN 'Owls' WHEN '2-HIGH' THEN 'Foxes' WHEN '3-MEDIUM' THEN 'Hens' ELSE 'Bears' END AS a, CASE o_orderstatus WHEN 'F' THEN 'Wolves' WHEN 'O' THEN 'Hawks' ELSE 'Bears' END AS b FROM orders)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN a = b THEN 'outcomes' END, CASE WHEN a = 'Hens' THEN 'alias' END, CASE WHEN x = 1 THEN 'question' END, CASE WHEN x = 2 THEN 'slug' END, CASE WHEN x = 3 THEN 'date' END, CASE WHEN a = 'Hens' OR a = b THEN 'clause' END], lambda r: r IS NOT NULL), ',') AS reasons,
  CASE WHEN a <> b AND a <> 'Hens' AND x NOT IN (1, 2, 3) THEN d END AS game_date, CASE WHEN a <> b AND a <> 'Hens' AND x NOT IN (1, 2, 3) THEN upper(a[1:3]) || '-' || upper(b[1:3]) END AS clubs FROM m""")
def market_identity(spark, sf):
    from ..functions.adapters import market_identity as parse

    teams = {k: (f"Club {k}", k[:3].upper()) for k in ("Owls", "Foxes", "Bears", "Wolves", "Hawks")}
    p, st, x = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey") % 5
    o = orders(spark, sf).withColumns({"a": F.when(p == "1-URGENT", "Owls").when(p == "2-HIGH", "Foxes").when(p == "3-MEDIUM", "Hens").otherwise("Bears"), "b": F.when(st == "F", "Wolves").when(st == "O", "Hawks").otherwise("Bears")})
    a, b = F.col("a"), F.col("b")
    date = F.when(x == 3, "some day").otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    clause = lambda c: F.concat(F.lit("If the Club "), c, F.lit(' win, this market will resolve to "'), c, F.lit('".\n'))
    texts = o.select(
        "o_orderkey", F.concat(F.lit("NFL Sunday: "), a, F.when(x == 1, " at ").otherwise(" vs. "), b).alias("question"), F.concat(F.lit("nfl-"), F.when(x == 1, "").when(x == 2, "monday").otherwise("sunday"), F.lit("-"), F.lower(a), F.lit("-vs-"), F.lower(b)).alias("slug"),
        F.concat(F.lit("In the upcoming NFL game scheduled for "), date, F.lit(":\n\n"), clause(a), clause(b)).alias("description"), F.to_json(F.array(a, b)).alias("outcomes"), F.to_json(F.array(F.lit("1"), F.lit("2"))).alias("token_ids"),
    )
    return parse(texts, teams).select("o_orderkey", F.array_join("reasons", ",").alias("reasons"), "game_date", F.array_join("clubs", "-").alias("clubs"))


@query("action_details", """
WITH a AS (SELECT event_id, user_id, event_type AS t, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN t IN ('view', 'click', 'purchase') THEN k * 1250 END AS end_x, CASE WHEN t = 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'Goal' ELSE 'Saved' END END AS shot_outcome,
  CASE WHEN t = 'signup' THEN k END AS replacement, CASE WHEN t = 'purchase' AND k % 3 = 0 THEN user_id END AS scores, CASE WHEN t = 'error' AND k % 2 = 0 THEN CASE WHEN k % 4 = 0 THEN 'Yellow Card' ELSE 'Blue Card' END END AS card,
  CASE WHEN t IN ('view', 'click', 'purchase') AND k * 1250 > 120000 THEN 'end_location' WHEN t = 'error' AND k % 4 = 2 THEN 'card' WHEN t = 'signup' AND k < 1 THEN 'replacement' ELSE '' END AS reasons FROM a""")
def action_details(spark, sf):
    from ..functions.adapters import action_details as parse

    t, k = F.col("event_type"), F.col("k")
    action = F.when(t == "view", "Pass").when(t == "click", "Carry").when(t == "purchase", "Shot").when(t == "signup", "Substitution").otherwise("Foul Committed")
    at = F.concat(F.lit('"end_location": ['), (k * 1250 / 1000).cast("decimal(9,3)").cast("string"), F.lit(", 40.5]"))
    body = (
        F.when(t == "view", F.concat(F.lit('{"pass": {'), at, F.lit("}}"))).when(t == "click", F.concat(F.lit('{"carry": {'), at, F.lit("}}")))
        .when(t == "purchase", F.concat(F.lit('{"shot": {"outcome": {"name": "'), F.when(k % 3 == 0, "Goal").otherwise("Saved"), F.lit('"}, "type": {"name": "Open Play"}, '), at, F.lit("}}")))
        .when(t == "signup", F.concat(F.lit('{"substitution": {"replacement": {"id": '), k.cast("string"), F.lit("}}}")))
        .when(k % 2 == 0, F.concat(F.lit('{"foul_committed": {"card": {"name": "'), F.when(k % 4 == 0, "Yellow Card").otherwise("Blue Card"), F.lit('"}}}'))).otherwise("{}")
    )
    d = events(spark, sf).withColumn("k", F.get_json_object("props", "$.k").cast("long")).select("event_id", parse(body, action, F.col("user_id")).alias("d"))
    return d.select("event_id", "d.end_x", "d.shot_outcome", "d.replacement", "d.scores", "d.card", F.array_join("d.reasons", ",").alias("reasons"))


@query("runner_advances", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
m AS (SELECT *, q % 2 = 0 AS on1, q % 3 = 0 AS on2, q % 5 = 0 AS on3, CAST(q % 6 AS INTEGER) AS b, CASE WHEN q % 7 < 5 THEN CAST(q % 7 AS INTEGER) END AS d1 FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST((CASE WHEN least(b, 4) = 4 THEN 1 ELSE 0 END) + (CASE WHEN on1 AND d1 = 4 THEN 1 ELSE 0 END) + (CASE WHEN on3 THEN 1 ELSE 0 END) AS INTEGER) AS runs,
  CAST((CASE WHEN b = 0 THEN 1 ELSE 0 END) + (CASE WHEN on1 AND d1 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS outs,
  CAST(1 + (CASE WHEN on1 AND d1 IS NOT NULL AND d1 <> 1 THEN 1 ELSE 0 END) + (CASE WHEN on3 THEN 1 ELSE 0 END) AS INTEGER) AS moves FROM m""")
def runner_advances(spark, sf):
    from ..functions.adapters import runner_advances as parse

    q = F.col("l_quantity").cast("long")
    on = lambda n, name: F.when(q % n == 0, name)
    bases = F.array(on(2, "r1"), on(3, "r2"), on(5, "r3"))
    to = F.array((q % 6).cast("int"), F.when(q % 7 < 5, (q % 7).cast("int")), F.lit(None).cast("int"), F.lit(4))
    d = lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", parse(F.lit("b"), bases, to, F.lit(0)).alias("d"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "d.runs", "d.outs", F.size("d.moves").alias("moves"))


@query("grid_observation_check", """
WITH o AS (SELECT event_id, user_id, event_type, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS h, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts FROM events),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, h) AS same FROM o)
SELECT event_id, array_to_string(list_filter([CASE WHEN ts < TIMESTAMP '2024-01-02' OR ts >= TIMESTAMP '2024-01-30' THEN 'window' END, CASE WHEN value > k THEN 'crossed' END, CASE WHEN same > 1 THEN 'repeated' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c""")
def grid_observation_check(spark, sf):
    from pyspark.sql import Window

    e = events(spark, sf).withColumn("h", F.floor(F.unix_micros("ts") / 3_600_000_000)).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    e = e.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("user_id", "h")))
    bad = {"window": (F.col("ts") < F.lit("2024-01-02").cast("timestamp")) | (F.col("ts") >= F.lit("2024-01-30").cast("timestamp")), "crossed": F.col("value") > F.col("k"), "repeated": F.col("same") > 1}
    return e.select("event_id", F.array_join(q.reasons(bad), ",").alias("reasons"))


@query("error_code_array", """
SELECT event_id, array_to_string(list_sort(list_filter(['MISSING_RULE_FIELD:rate', CASE WHEN NOT regexp_matches(k, '^[0-4]\\d$') THEN 'INVALID_RULE_FIELD:k' END], lambda x: x IS NOT NULL)), ',') AS errors FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""")
def error_code_array(spark, sf):
    return events(spark, sf).select("event_id", F.array_join(t.rule_errors(F.col("props"), {"k": r"^[0-4]\d$", "rate": r"^\d"}), ",").alias("errors"))
