"""Queries: books, labels, execution cost, trigger studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import books, cost, day, labels, review
from ..operators.fold import chained_fold, fold_events, verify_chain
from .registry import events, feed, lineitem, plays, query, quotes, rules, shifted


@query("fresh_quotes", "SELECT quote_id FROM v_quotes WHERE state = 'ACTIVE' AND epoch_us(received) - epoch_us(source) <= 43200000000", "v_quotes")
def fresh_quotes(spark, sf):
    return quotes(spark, sf).where(labels.fresh(43_200_000_000)).select("quote_id")


_LABELS = """
WITH g AS (SELECT stream, received, quote_id, bid, ask FROM v_quotes WHERE state = 'ACTIVE' AND epoch_us(received) - epoch_us(source) <= 86400000000),
a AS (SELECT rule_id AS anchor_id, stream, fetched AS anchor, fetched + INTERVAL 12 HOUR AS deadline FROM v_rules),
e AS (SELECT a.*, (SELECT arg_min({'i': g.quote_id, 't': g.received, 'p': g.ask}, (g.received, g.quote_id)) FROM g WHERE g.stream = a.stream AND g.received BETWEEN a.anchor AND a.deadline) AS e FROM a),
x AS (SELECT anchor_id, stream, anchor, deadline, e.i AS entry_id, e.t AS entry_at, e.p AS entry_price, CAST(e.p * 1.2 AS DECIMAL(24,8)) AS up, CAST(e.p * 0.8 AS DECIMAL(24,8)) AS down FROM e),
h AS (SELECT x.anchor_id, arg_min({'o': CASE WHEN g.bid >= x.up THEN 'UPPER' ELSE 'LOWER' END, 'i': g.quote_id}, (g.received, g.quote_id)) AS hit FROM x JOIN g ON g.stream = x.stream AND (g.received, g.quote_id) > (x.entry_at, x.entry_id) AND g.received <= x.deadline AND (g.bid >= x.up OR g.bid <= x.down) GROUP BY 1),
z AS (SELECT x.anchor_id, arg_min(g.quote_id, (g.received, g.quote_id)) AS last_id FROM x JOIN g ON g.stream = x.stream AND (g.received, g.quote_id) > (x.entry_at, x.entry_id) AND g.received >= x.deadline GROUP BY 1)"""


@query("barrier_labels", _LABELS + """
SELECT x.anchor_id, entry_id, CASE WHEN entry_id IS NULL THEN 'NO_ENTRY' WHEN hit IS NOT NULL THEN hit.o WHEN last_id IS NOT NULL THEN 'HORIZON' ELSE 'NO_EXIT' END AS outcome, CASE WHEN entry_id IS NULL THEN NULL WHEN hit IS NOT NULL THEN hit.i ELSE last_id END AS exit_id FROM x LEFT JOIN h USING (anchor_id) LEFT JOIN z USING (anchor_id)""", "v_quotes v_rules")
def barrier_labels(spark, sf):
    return _labelled(spark, sf).select("anchor_id", "entry_id", "outcome", "exit_id")


def _labelled(spark, sf):
    anchors = rules(spark, sf).select("stream", F.col("rule_id").alias("anchor_id"), F.col("fetched").alias("anchor"))
    return labels.barrier_labels(anchors, quotes(spark, sf), ["stream"], "0.2", "0.2", 12 * 3_600_000_000, 24 * 3_600_000_000)


@query("drop_overlap")
def drop_overlap(spark, sf):
    done = _labelled(spark, sf).where("exit_at IS NOT NULL")
    return labels.drop_overlap(done, ["stream"], "anchor", "exit_at", 3_600_000_000, 3_600_000_000)


@query("fee_per_order", "SELECT l_orderkey, round(sum(l_quantity * l_tax * (l_discount * (1 - l_discount))), 6) AS fee FROM lineitem GROUP BY 1")
def fee_per_order(spark, sf):
    return lineitem(spark, sf).groupBy("l_orderkey").agg(F.round(F.sum(cost.fee(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"))), 6).alias("fee"))


@query("book_best_levels", """
WITH x AS (SELECT stream, event_id, received, kind, price, size, CASE WHEN kind = 'signup' THEN 'both' WHEN kind = 'purchase' THEN 'bid' WHEN kind = 'view' THEN 'ask' END AS s FROM v_feed WHERE kind IN ('signup', 'purchase', 'view')),
l AS (SELECT stream, event_id, received, kind, 'bid' AS side, CAST(price AS DECIMAL(12,4)) AS price, size FROM x WHERE s IN ('both', 'bid') UNION ALL SELECT stream, event_id, received, kind, 'ask', CAST(CASE WHEN s = 'both' THEN price * 1.02 ELSE price END AS DECIMAL(12,4)), size FROM x WHERE s IN ('both', 'ask')),
k AS (SELECT stream, max((received, event_id)) FILTER (kind = 'signup') AS snap FROM l GROUP BY 1),
c AS (SELECT stream, side, price, arg_max(size, (received, event_id)) AS size FROM l JOIN k USING (stream) WHERE snap IS NULL OR (received, event_id) >= snap GROUP BY 1, 2, 3)
SELECT stream, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask, count(*) AS levels FROM c WHERE size > 0 GROUP BY 1""", "v_feed")
def book_best_levels(spark, sf):
    kind, price = F.col("kind"), F.col("price")
    row = lambda side, p: F.struct(F.lit(side).alias("side"), p.cast("decimal(12,4)").alias("p"))
    touched = F.when(kind == "signup", F.array(row("bid", price), row("ask", price * F.lit("1.02").cast("decimal(3,2)")))).when(kind == "purchase", F.array(row("bid", price))).when(kind == "view", F.array(row("ask", price)))
    levels = feed(spark, sf).where(touched.isNotNull()).select("stream", "received", "event_id", "kind", "size", F.inline(touched)).withColumnRenamed("p", "price")
    closing = books.closing_levels(levels, ["stream"], F.col("kind") == "signup", F.col("side"), ["received", "event_id"])
    return closing.groupBy("stream").agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("best_bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("best_ask"), F.count(F.lit(1)).alias("levels"))


def book_rows(spark, sf):
    """The feed in the form that the book fold reads."""
    kind, price = F.col("kind"), F.col("price").cast("decimal(18,4)")
    size = F.col("size").cast("decimal(18,6)")
    level = lambda p: F.array(F.struct(p.cast("decimal(18,4)").alias("price"), size.alias("size")))
    snap = kind == "signup"
    return feed(spark, sf).select(
        "event_id", "stream", "received", "source", F.when(snap, "book").when(kind.isin("purchase", "view"), "price_change").otherwise("last_trade_price").alias("kind"),
        F.when(snap, level(price)).alias("bids"), F.when(snap, level(price * F.lit("1.02").cast("decimal(3,2)"))).alias("asks"), price.alias("price"), size.alias("size"), F.when(kind == "purchase", "BUY").when(kind == "view", "SELL").alias("side"),
    )


@query("fold_counts")
def fold_counts(spark, sf):
    out = books.rebuild_books(book_rows(spark, sf), ["stream"])
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    rows = out.select("stream", "seq", "event_id", F.col("event_id").cast("string").alias("ident"), flag(F.array_contains("flags", "crossed_book")).alias("crossed"), flag(F.col("regression")).alias("regressions"), flag(F.col("gap")).alias("gaps"))

    def start():
        return {"books": 0, "crossed": 0, "regressions": 0, "gaps": 0}, review.Joined()

    def reduce(state, row):
        counts, joined = state
        joined.add(row["ident"])
        return ({"books": counts["books"] + 1, **{c: counts[c] + row[c] for c in ("crossed", "regressions", "gaps")}}, joined), None

    return fold_events(rows, ["stream"], ["seq", "event_id"], reduce, start, "books long, crossed long, regressions long, gaps long, digest string", lambda state: {**state[0], "digest": state[1].sha.hexdigest()})


@query("day_reconstruction", """
WITH g AS (SELECT stream, received, source, kind, price, size, count(*) AS c FROM v_feed GROUP BY ALL),
o AS (SELECT *, kind IN ('signup', 'purchase', 'view') AS given, lag(source) OVER w AS before, lag(received) OVER w AS prior, coalesce(max(CAST(kind = 'signup' AS INTEGER)) OVER (PARTITION BY stream ORDER BY received, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM g WINDOW w AS (PARTITION BY stream ORDER BY received, source))
SELECT stream, CAST(sum(c) AS BIGINT) AS input_events, count(*) AS semantic_events, count(*) FILTER (given) AS states, count(*) FILTER (kind = 'signup') AS snapshots, count(*) FILTER (given AND kind <> 'signup') AS deltas,
  count(*) FILTER (given AND source < before) AS regressions, count(*) FILTER (given AND epoch_us(received) - epoch_us(prior) > 60000000) AS gaps, count(*) FILTER (kind IN ('purchase', 'view') AND seen = 0) AS missing_initial FROM o GROUP BY stream""", "v_feed")
def day_reconstruction(spark, sf):
    out = day.day_report(book_rows(spark, sf), ["stream"], slice_us=24 * day.HOUR_US)
    return out.select("stream", "input_events", "semantic_events", "states", "snapshots", "deltas", "regressions", "gaps", "missing_initial")


@query("day_digest")
def day_digest(spark, sf):
    return day.day_digest(day.day_report(book_rows(spark, sf), ["stream"], slice_us=24 * day.HOUR_US), ["stream"])


@query("hash_chained_fold", """
WITH x AS (SELECT game, seq, event_id, sum(CASE WHEN kind = 'purchase' THEN k ELSE 0 END) OVER w AS score, seq AS plays FROM v_pbp WINDOW w AS (PARTITION BY game ORDER BY seq)),
h AS (SELECT *, '{"plays":' || plays || ',"score":' || CAST(score AS BIGINT) || '}' AS state FROM x)
SELECT game, CAST(seq AS BIGINT) AS sequence, coalesce(sha256(lag(state) OVER (PARTITION BY game ORDER BY seq)), sha256('{"plays":0,"score":0}')) AS previous_sha256, sha256(state) AS next_sha256, CAST(NULL AS VARCHAR) AS problem FROM h""", "v_pbp")
def hash_chained_fold(spark, sf):
    from ..operators.joins import beside

    def reduce(state, row):
        return {"plays": state["plays"] + 1, "score": state["score"] + (row["k"] if row["kind"] == "purchase" else 0)}

    rows = plays(spark, sf).select("game", F.col("game").alias("own"), "seq", "event_id", "kind", "k")
    steps = chained_fold(rows, ["game"], "own", "seq", "event_id", reduce, lambda: {"plays": 0, "score": 0})
    wrong = verify_chain(steps, ["game"], F.lit('{"plays":0,"score":0}'))
    return beside(steps, wrong, ["game", "sequence"], "left").select("game", "sequence", "previous_sha256", "next_sha256", "problem")


_BOOKS = """
u AS (SELECT *, rule_id % 5 <> 0 AS fees_enabled, CAST(1 + rule_id % 2 AS INTEGER) AS exponent, CAST(fee_rate * 1000 AS HUGEINT) AS rate, CAST(6 + rule_id % 3 AS HUGEINT) AS minimum FROM v_rules),
b AS (SELECT stream, received, quote_id, CAST(500 + 100 * (floor(ask) % 80) AS HUGEINT) AS ask, CAST(500 + 100 * (floor(ask) % 80) - 200 AS HUGEINT) AS bid FROM v_quotes WHERE state = 'ACTIVE')"""


def _asof(points: str, at: str, age: str) -> str:
    """SQL of the rule in force at a time of the rows of ``points``: status ``st`` and the rule's fields in ``pick``."""
    return f"""SELECT *, CASE WHEN seen = 0 THEN 'missing' WHEN pick IS NULL AND inv IS NOT NULL THEN 'invalid' WHEN pick IS NULL THEN 'not_effective' WHEN inv >= pick.f THEN 'invalid' WHEN epoch_us({at}) - epoch_us(pick.f) > {age} THEN 'stale' ELSE 'ok' END AS st
FROM (SELECT p.*, count(r.rule_id) AS seen, max(CASE WHEN r.valid AND r.effective <= p.{at} THEN {{'e': r.effective, 'f': r.fetched, 'i': r.rule_id, 'on': r.fees_enabled, 'rate': r.rate, 'x': r.exponent, 'm': r.minimum}} END) AS pick, max(CASE WHEN NOT r.valid THEN r.fetched END) AS inv
  FROM {points} p LEFT JOIN u r ON r.stream = p.stream AND r.fetched <= p.{at} GROUP BY ALL)"""


def _walked(price: str, step: int, q: str) -> tuple[str, str]:
    """(gross x 10^4, fee base x 10^16) of walking 10 units at a price and 30 at the next one."""
    one, two = f"least({q}, 10)", f"least(greatest({q} - 10, 0), 30)"
    power = lambda p: f"CASE pick.x WHEN 1 THEN ({p}) * (10000 - ({p})) * 100000000 ELSE ({p}) * (10000 - ({p})) * (({p}) * (10000 - ({p}))) END"
    return f"({one} * {price} + {two} * ({price} + {step}))", f"({one} * {power(price)} + {two} * {power(f'{price} + {step}')})"


_G, _GB = _walked("bk.a", 100, "q")
_H, _HB = _walked("mk.a", -100, "q")


def _fees(base: str) -> str:
    """Fee x 10^19."""
    return f"CASE WHEN pick.on THEN pick.rate * {base} ELSE 0 END"


@query("cost_markout", f"""
WITH {_BOOKS.strip()},
o AS (SELECT event_id AS order_id, user_id AS stream, ts AS created, CAST(5 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 40 AS HUGEINT) AS q FROM events WHERE event_type = 'click'),
c AS ({_asof("o", "created", "864000000000")}),
x AS (SELECT c.*, (SELECT arg_min({{'t': b.received, 'a': b.ask}}, b.received) FROM b WHERE b.stream = c.stream AND b.received >= c.created + to_seconds(CASE WHEN st = 'ok' THEN 90 ELSE 30 END)) AS bk FROM c),
y AS (SELECT order_id, stream, q, bk, CASE WHEN st <> 'ok' THEN st WHEN q < pick.m THEN 'below_minimum' WHEN bk IS NULL THEN 'no_book' WHEN q > 40 THEN 'insufficient_depth' ELSE 'ok' END AS status, {_G} AS g, {_fees(_GB)} AS fee FROM x),
h AS (SELECT y.*, s.h, (SELECT arg_min({{'t': b.received, 'a': b.bid}}, b.received) FROM b WHERE b.stream = y.stream AND b.received >= y.bk.t + to_seconds(s.h)) AS mk FROM y, (VALUES (600), (3600)) s(h) WHERE status = 'ok'),
k AS (SELECT *, mk.t AS marked FROM h),
e AS ({_asof("k", "marked", "864000000000")}),
m AS (SELECT order_id, h, CASE WHEN mk IS NULL THEN 'no_book' WHEN st <> 'ok' THEN st WHEN q < pick.m THEN 'below_minimum' ELSE 'ok' END AS ms, CAST({_H} AS HUGEINT) * 1000000000000000 - ({_fees(_HB)}) - CAST(g AS HUGEINT) * 1000000000000000 - fee AS n, q FROM e),
r AS (SELECT order_id, h, ms, CASE WHEN ms = 'ok' THEN sign(n) * ((2 * abs(n) + q * 10000000000000) // (2 * q * 10000000000000)) END AS net FROM m)
SELECT order_id, status, CAST(CASE WHEN status = 'ok' THEN g END AS BIGINT) AS gross_e4, CAST(CASE WHEN status = 'ok' THEN (fee + 5000000000) // 10000000000 END AS BIGINT) AS fee_e9,
  m1.ms AS status_600s, CAST(m1.net AS BIGINT) AS net_600s_e6, m2.ms AS status_3600s, CAST(m2.net AS BIGINT) AS net_3600s_e6
FROM y LEFT JOIN r m1 USING (order_id) LEFT JOIN r m2 USING (order_id) WHERE m1.h IS NOT DISTINCT FROM CASE WHEN status = 'ok' THEN 600 END AND m2.h IS NOT DISTINCT FROM CASE WHEN status = 'ok' THEN 3600 END""", "v_quotes v_rules")
def cost_markout(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    orders = events(spark, sf).where("event_type = 'click'").select(F.col("event_id").alias("order_id"), F.col("user_id").alias("stream"), F.col("ts").alias("created"), (5 + k % 40).alias("quantity"))
    out = cost.cost_and_markout(orders, _priced_books(spark, sf), _priced_rules(spark, sf), ["stream"], 30_000_000, [600_000_000, 3_600_000_000], 864_000_000_000)
    whole = lambda c, n: F.round(F.col(c) * F.lit(10**n), 0).cast("long")
    return out.select("order_id", "status", whole("gross", 4).alias("gross_e4"), whole("fee", 9).alias("fee_e9"), F.col("mark_600s.status").alias("status_600s"), whole("mark_600s.net", 6).alias("net_600s_e6"), F.col("mark_3600s.status").alias("status_3600s"), whole("mark_3600s.net", 6).alias("net_3600s_e6"))


def _priced_rules(spark, sf):
    return rules(spark, sf).withColumns({"delay_us": F.lit(60_000_000).cast("long"), "minimum": (6 + F.col("rule_id") % 3), "fees_enabled": F.col("rule_id") % 5 != 0, "exponent": (1 + F.col("rule_id") % 2).cast("int")})


def _priced_books(spark, sf):
    """Quotes as books of two levels a side, with prices in (0, 1)."""
    hundredths = 5 + F.floor("ask").cast("int") % 80
    level = lambda p, s: F.struct((p / 100).cast("decimal(5,4)").alias("price"), F.lit(s).cast("decimal(12,2)").alias("size"))
    return quotes(spark, sf).select("stream", F.col("received").alias("time"), F.array(level(hundredths - 2, 10), level(hundredths - 3, 30)).alias("bids"), F.array(level(hundredths, 10), level(hundredths + 1, 30)).alias("asks"), (F.col("state") == "SUSPENDED").alias("suspended"))


@query("trigger_pnl", f"""
WITH {_BOOKS.strip()},
t AS (SELECT event_id, stream, received + INTERVAL 5 SECOND AS signal FROM v_feed WHERE kind = 'purchase'),
c AS ({_asof("t", "signal", "4611686018427387904")}),
x AS (SELECT c.*, (SELECT arg_min({{'t': b.received, 'a': b.ask}}, b.received) FROM b WHERE b.stream = c.stream AND b.received >= c.signal + to_seconds(CASE WHEN st = 'ok' THEN 60 ELSE 0 END)) AS bk FROM c),
y AS (SELECT x.*, (SELECT arg_min({{'t': b.received, 'a': b.bid}}, b.received) FROM b WHERE b.stream = x.stream AND b.received >= x.bk.t + INTERVAL 2 HOUR) AS mk FROM x),
z AS (SELECT *, CAST((bk.a + 50) * (9950 - bk.a) AS HUGEINT) AS x, CASE WHEN st <> 'ok' THEN st WHEN 20 < pick.m THEN 'below_minimum' WHEN bk IS NULL THEN 'no_book' WHEN mk IS NULL THEN 'no_mark' ELSE 'ok' END AS status FROM y),
n AS (SELECT *, CASE WHEN status = 'ok' THEN CAST(20 * mk.a - 20 * bk.a - 2000 AS HUGEINT) * 1000000000000000 - CASE WHEN pick.on THEN 20 * pick.rate * CASE pick.x WHEN 1 THEN x * 100000000 ELSE x * x END ELSE 0 END END AS n FROM z)
SELECT event_id, status, CAST(epoch_us(bk.t) AS BIGINT) AS bought_us, CAST(epoch_us(mk.t) AS BIGINT) AS marked_us, CAST(sign(n) * ((2 * abs(n) + 100000000000000) // 200000000000000) AS DOUBLE) / 100000 AS pnl FROM n""", "v_feed v_quotes v_rules")
def trigger_pnl(spark, sf):
    t = feed(spark, sf).where("kind = 'purchase'").select("event_id", "stream", F.col("received").alias("trigger"))
    out = cost.trigger_study(t, _priced_books(spark, sf), _priced_rules(spark, sf), ["stream"], "20", "100", 5_000_000, 0, 7_200_000_000)
    return out.select("event_id", "status", F.unix_micros("bought").alias("bought_us"), F.unix_micros("marked").alias("marked_us"), F.round("pnl", 5).cast("double").alias("pnl"))


@query("training_rows", """
WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'),
n AS (SELECT p.event_id, count(*) FILTER (e.event_type = 'purchase') AS goals, count(*) FILTER (e.event_type = 'error') AS cards FROM p JOIN events e ON e.user_id = p.user_id AND e.ts <= p.ts GROUP BY 1),
l AS (SELECT p.event_id, coalesce(arg_min(e.event_type, (e.ts, e.event_id)), 'no_goal') AS label FROM p LEFT JOIN events e ON e.user_id = p.user_id AND e.ts > p.ts AND e.ts <= p.ts + INTERVAL 24 HOUR AND e.event_type = 'purchase' GROUP BY 1)
SELECT event_id, side, CASE side WHEN 'home' THEN goals - cards ELSE cards - goals END AS own_difference, label FROM n JOIN l USING (event_id), (VALUES ('home'), ('away')) s(side)""")
def training_rows(spark, sf):
    from ..operators import asof

    e = events(spark, sf)
    points = e.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    known = asof.prefix_counts(points, e, ["user_id"], ["ts"], {"goals": F.col("event_type") == "purchase", "cards": F.col("event_type") == "error"})
    marks = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_type").alias("label"), F.col("event_id").alias("mark"))
    got = asof.first_in_window(known, marks, ["user_id"], "ts", "at", 24 * 3_600_000_000, ["label", "mark"], tie="mark", none="no_goal")
    sides = spark.range(1).select(F.explode(F.array(F.lit("home"), F.lit("away"))).alias("side"))
    both = asof.cross_grid(got, sides)
    d = F.col("goals") - F.col("cards")
    return both.select("event_id", "side", F.when(F.col("side") == "home", d).otherwise(-d).alias("own_difference"), "label")


@query("census_outcomes", """
WITH x AS (SELECT game, min(CASE WHEN k = 0 AND kind = 'error' THEN 'zero_foul' WHEN k = 99 AND kind = 'purchase' THEN 'large_score' END) FILTER ((k = 0 AND kind = 'error') OR (k = 99 AND kind = 'purchase')) AS any, arg_min(CASE WHEN kind = 'error' THEN 'zero_foul' ELSE 'large_score' END, seq) FILTER ((k = 0 AND kind = 'error') OR (k = 99 AND kind = 'purchase')) AS v FROM v_pbp GROUP BY 1)
SELECT game % 4 AS season, count(*) AS games, count(*) FILTER (v IS NULL) AS completed, count(*) FILTER (v IS NOT NULL) AS failed, count(DISTINCT v) AS categories FROM x GROUP BY 1""", "v_pbp")
def census_outcomes(spark, sf):
    from ..operators.fold import RuleBroken, checked_fold
    from ..operators.plays import census_outcomes as census

    def reduce(state, row):
        if row["kind"] == "error" and row["k"] == 0:
            raise RuleBroken("zero_foul")
        if row["kind"] == "purchase" and row["k"] == 99:
            raise RuleBroken("large_score")
        return state, {"n": row["seq"]}

    folded = checked_fold(plays(spark, sf).select("game", "seq", "kind", "k"), ["game"], ["seq"], reduce, dict, "n int")
    return census(folded.withColumn("season", F.col("game") % 4), "game", "season", "violation")
