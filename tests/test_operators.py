"""Hand-made cases for operators that queries don't cover, order independence, leakage."""

import hashlib
import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from feedlab.functions import probability, text
from feedlab.operators import asof, books, cost, labels, metrics, plays, quality, review, splits
from feedlab.sources import feeds
from feedlab.sports import rules

T0 = datetime(2026, 6, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def feed_row(market, received_ms, lag_ms, event_type, **rest):
    stamp = lambda ms: at(ms / 1000).isoformat(timespec="milliseconds") + "Z"
    return {"market": market, "asset_id": f"{market}-yes", "event_type": event_type, "timestamp_received": stamp(received_ms), "timestamp": stamp(received_ms - lag_ms), **rest}


def snapshot(market, received_ms, lag_ms, bids, asks):
    return feed_row(market, received_ms, lag_ms, "book", bids=json.dumps(bids), asks=json.dumps(asks))


FEED = [
    snapshot("rain", 4_000, 9, [["0.31", "7"], ["0.28", "12.5"]], [["0.34", "5"]]),
    feed_row("rain", 6_250, 31, "price_change", price="0.34", size="0", side="SELL"),
    snapshot("snow", 5_100, 2, [["0.02", "900"]], [["0.03", "41"], ["0.07", "6"]]),
    feed_row("snow", 8_040, 3, "price_change", price="0.05", size="18", side="SELL"),
    snapshot("snow", 5_100, 2, [["0.02", "900"]], [["0.03", "41"], ["0.07", "6"]]),
    feed_row("rain", 9_900, 12, "price_change", price="0.29", size="3.25", side="BUY"),
]


def read_feed(spark, folder, order):
    path = folder / f"feed-{'-'.join(map(str, order))}.jsonl"
    path.write_text("\n".join(json.dumps(FEED[i]) for i in order) + "\nnot json\n")
    good, bad = feeds.read_book_jsonl(spark, f"file://{path}")
    assert bad.count() == 1
    return good.withColumn("event_id", F.monotonically_increasing_id())


def test_books_do_not_depend_on_input_order(spark, tmp_path):
    found = []
    for order in ([0, 1, 2, 3, 4, 5], [5, 3, 4, 0, 2, 1]):
        out = books.rebuild_books(read_feed(spark, tmp_path, order), ["market", "asset_id"]).drop("event_id").orderBy("market", "seq").collect()
        found.append([r.asDict(recursive=True) for r in out])
    assert found[0] == found[1]
    assert [(r["market"], len(r["bids"]), len(r["asks"]), r["flags"]) for r in found[0]] == [("rain", 2, 1, []), ("rain", 2, 0, []), ("rain", 3, 0, []), ("snow", 1, 2, ["duplicate_event"]), ("snow", 1, 3, [])]


def test_book_anomalies(spark):
    lv = lambda p, s: [{"price": Decimal(p), "size": Decimal(s)}]
    rows = [(1, "m", "a", at(1), at(1), "price_change", None, None, Decimal("0.5"), Decimal("-1"), "BUY"), (2, "m", "a", at(2), at(2), "book", lv("0.60", "1"), lv("0.55", "1") + lv("0.7", "0"), None, None, None)]
    level = "array<struct<price:decimal(18,4),size:decimal(18,6)>>"
    df = spark.createDataFrame(rows, f"event_id long, market string, asset_id string, received timestamp, source timestamp, kind string, bids {level}, asks {level}, price decimal(18,4), size decimal(18,6), side string")
    flags = [r.flags for r in books.rebuild_books(df, ["market", "asset_id"]).orderBy("seq").collect()]
    assert flags == [["missing_initial_snapshot", "non_positive_size"], ["crossed_book", "non_positive_size"]]


def test_future_rules_are_never_used(spark):
    rule = spark.createDataFrame([("s", 1, at(10), at(0), True), ("s", 2, at(30), at(20), True), ("s", 3, at(40), at(20), False)], "k string, rule_id int, fetched timestamp, effective timestamp, valid boolean")
    points = spark.createDataFrame([("s", i, at(t)) for i, t in enumerate((5, 10, 29, 30, 45))], "k string, id int, t timestamp")
    got = {r.id: (r.status, r.rule_id) for r in asof.asof_rule(points, rule, ["k"], "t", 15_000_000).collect()}
    assert got == {0: ("missing", None), 1: ("ok", 1), 2: ("stale", None), 3: ("ok", 2), 4: ("invalid", None)}


def test_barriers_suspension_and_deadline(spark):
    d = Decimal
    q = [("a", at(1), at(1), "ACTIVE", d(10), d(10)), ("b", at(2), at(2), "SUSPENDED", d(50), d(50)), ("c", at(2), at(2), "ACTIVE", d(50), d(50)), ("d", at(3), at(3), "ACTIVE", d(12), d(13)), ("e", at(9), at(9), "ACTIVE", d(10), d(11))]
    quotes = spark.createDataFrame([("s", *x) for x in q], "k string, quote_id string, received timestamp, source timestamp, state string, bid decimal(12,4), ask decimal(12,4)")
    anchors = spark.createDataFrame([("s", 1, at(0)), ("s", 2, at(4)), ("s", 3, at(20))], "k string, anchor_id int, anchor timestamp")
    got = {r.anchor_id: (r.outcome, r.entry_id, r.exit_id) for r in labels.barrier_labels(anchors, quotes, ["k"], "0.2", "0.2", 5_000_000, 60_000_000).collect()}
    assert got == {1: ("UPPER", "a", "d"), 2: ("NO_EXIT", "e", None), 3: ("NO_ENTRY", None, None)}


LEVELS = "array<struct<price:decimal(5,4),size:decimal(12,2)>>"
RULES = "k string, rule_id int, fetched timestamp, effective timestamp, valid boolean, fees_enabled boolean, fee_rate decimal(6,4), exponent int, delay_us long, minimum decimal(12,2)"


def ladder(*levels):
    return [{"price": Decimal(p), "size": Decimal(s)} for p, s in levels]


def ladders(spark):
    rows = [("s", at(1), ladder(("0.40", "10")), ladder(("0.50", "10")), False), ("s", at(6), ladder(("0.45", "10")), ladder(("0.60", "4"), ("0.70", "10")), False), ("s", at(20), ladder(("0.80", "3"), ("0.75", "9")), ladder(("0.90", "9")), False)]
    return spark.createDataFrame(rows, f"k string, time timestamp, bids {LEVELS}, asks {LEVELS}, suspended boolean")


def test_cost_fees_by_fill_and_exit_rule(spark):
    d = Decimal
    rule = spark.createDataFrame([("s", 1, at(0), at(0), True, True, d("0.02"), 1, 3_000_000, d(1)), ("s", 2, at(15), at(15), True, True, d("0.05"), 2, 0, d(2))], RULES)
    orders = spark.createDataFrame([("s", 1, at(1), 5), ("s", 2, at(1), 50), ("s", 3, at(1), 0), ("s", 4, at(30), 2), ("s", 5, at(1), 1)], "k string, order_id int, created timestamp, quantity int")
    got = {r.order_id: r for r in cost.cost_and_markout(orders, ladders(spark), rule, ["k"], 1_000_000, [1_000_000, 10_000_000, 60_000_000], 10**12).collect()}
    assert [got[i].status for i in range(1, 6)] == ["ok", "insufficient_depth", "below_minimum", "no_book", "ok"]
    fee = d("0.02") * (4 * d("0.6") * d("0.4") + d("0.7") * d("0.3"))
    assert got[1].executed == at(6) and got[1].gross == d("3.1") and got[1].fee == fee and got[1].levels_used == 2
    exit_fee = d("0.05") * (3 * (d("0.8") * d("0.2")) ** 2 + 2 * (d("0.75") * d("0.25")) ** 2)  # the rule of the mark's time, not of the order's
    mark = got[1].mark_10s
    assert (mark.status, mark.time, mark.gross, mark.fee) == ("ok", at(20), d("3.9"), exit_fee)
    assert abs(mark.net - (d("3.9") - exit_fee - d("3.1") - fee) / 5) < d("1e-15")
    assert got[1].mark_60s.status == "no_book" and got[1].mark_1s.time == at(20)
    assert got[5].mark_10s.status == "below_minimum" and got[5].mark_10s.net is None and got[2].mark_10s is None
    free = rule.withColumns({"fees_enabled": F.lit(False), "exponent": F.lit(7)})
    assert [r.fee for r in cost.cost_and_markout(orders.where("order_id = 1"), ladders(spark), free, ["k"], 1_000_000, [1], 10**12).collect()] == [0]
    odd = rule.withColumn("exponent", F.lit(3))
    assert [r.status for r in cost.cost_and_markout(orders.where("order_id = 1"), ladders(spark), odd, ["k"], 1_000_000, [1], 10**12).collect()] == ["unsupported_exponent"]


def test_trigger_study_pays_the_fee_of_the_whole_order(spark):
    d = Decimal
    rule = spark.createDataFrame([("s", 1, at(0), at(0), True, True, d("0.02"), 1, 0, d(1))], RULES)
    triggers = spark.createDataFrame([("s", 1, at(0)), ("s", 2, at(30)), ("s", 3, at(10))], "k string, id int, trigger timestamp")
    run = lambda q, most="100": {r.id: r for r in cost.trigger_study(triggers, ladders(spark), rule, ["k"], q, most, 5_000_000, 0, 10_000_000).collect()}
    got = run("5")
    v = d("0.62")
    fee = 5 * d("0.02") * v * (1 - v)
    assert (got[1].status, got[1].bought, got[1].marked) == ("ok", at(6), at(20)) and got[1].fee == fee and got[1].pnl == d("3.9") - d("3.1") - fee
    assert got[2].status == "no_book" and got[2].marked is None and got[3].status == "no_mark" and got[3].pnl is None
    assert run("13")[1].status == "insufficient_bids" and run("15")[1].status == "insufficient_depth" and run("5", "4")[1].status == "above_limit"


def test_text_functions(spark):
    df = spark.createDataFrame([("-0.500",), ("000",), ("1e3",), ("12",), (None,)], "x string")
    got = [tuple(r.f) if r.f else None for r in df.select(text.fixed_point_encode(F.col("x")).alias("f")).collect()]
    assert got == [("-5", 1), ("0", 0), None, ("12", 0), None]
    row = spark.range(1).select(text.clock_ms(F.lit("00:01:02.500")).alias("a"), text.quarter_seconds(F.lit("14:59")).alias("b"), text.parse_utc(F.lit("2026-06-01 00:00:00Z")).alias("c"), text.lifecycle_action(F.lit("COMMENT"), F.lit("The game has resumed. x")).alias("d")).first()
    assert tuple(row) == (62_500, 899, None, "resume")


def test_quality_and_scores(spark):
    from pyspark.sql.types import StructType

    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert {tuple(r)[:2] for r in quality.schema_diff(df, StructType.fromDDL("i long, t string")).collect()} == {("i", "wrong type"), ("t", "missing"), ("s", "unexpected")}
    with pytest.raises(quality.UncleanRows):
        quality.require_clean(quality.quarantine(df, {"null": F.col("s").isNull()})[1])
    p = spark.createDataFrame([(1, 0.75, "x"), (0, 0.25, "x"), (1, 0.5, "y"), (0, 1.0, "y")], "y int, p double, c string")
    bins = {r.bin: (r.n, r.mean_p) for r in metrics.calibration_bins(p, "y", "p", [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    assert bins == {0: (0, None), 1: (1, 0.25), 2: (1, 0.5), 3: (2, 0.875)}
    assert review.precision(p, F.col("y") == 1, "c").where("gate").count() == 0
    shares = probability.apportion(spark.createDataFrame([("g", 1, 1.0), ("g", 2, 1.0), ("g", 3, 1.0)], "g string, i int, w double"), ["g"], F.col("w"), ["i"], 2)
    assert [r.atoms for r in shares.orderBy("i").collect()] == [34, 33, 33]


def test_folds(spark):
    nba = [("g", 1, "score", 1, 700, 0, 2), ("g", 2, "foul", 1, 600, 1, None), ("g", 3, "period", 2, 720_000, None, None), ("g", 4, "score", 2, 800_000, 0, 2), ("g", 5, "score", 2, 10, 0, 2), ("h", 1, "score", 1, 5, 1, 3)]
    df = spark.createDataFrame(nba, "game_id string, sequence int, kind string, period int, clock_ms int, side int, points int")
    got = [(r.game_id, r.seq, r.home_score, r.away_fouls, r.violation) for r in rules.season_states(df, "nba").orderBy("game_id", "seq").collect()]
    assert got == [("g", 1, 2, 0, None), ("g", 2, 2, 1, None), ("g", 3, 2, 0, None), ("g", 4, None, None, "clock_rose"), ("h", 1, 0, 0, None)]
    mlb = [("m", 1, 1, False, 0, 0, 0, "b1", [1, None, None, None], 0), ("m", 2, 1, False, 0, 0, 0, "b2", [4, 4, None, None], 0), ("m", 3, 1, False, 0, 2, 0, "b3", [0, None, None, None], 1), ("m", 4, 1, True, 0, 2, 0, "b4", [0, None, None, None], 1)]
    df = spark.createDataFrame(mlb, "game_id string, sequence int, inning int, batting_home boolean, outs_before int, away_score int, home_score int, batter_id string, destinations array<int>, outs_on_play int")
    assert [(r.away_score, r.violation) for r in rules.season_states(df, "mlb").orderBy("seq").collect()] == [(0, None), (2, None), (2, None), (None, "half_inning")]
    nfl = [("n", 1, 1, 900, 0, 0, 3, 3, "none", False), ("n", 2, 1, 880, 7, 0, 3, 3, "none", False), ("n", 3, 1, 870, 7, 0, 2, 3, "none", False), ("n", 4, 1, 860, 6, 0, 2, 3, "none", False)]
    df = spark.createDataFrame([(*x[:2], x[2], x[3], x[4], x[5], x[6], x[7], 2020, "REG", x[8], x[9]) for x in nfl], "game_id string, sequence int, period int, clock_s int, home_score int, away_score int, home_timeouts int, away_timeouts int, season int, season_type string, action string, correction boolean")
    assert [r.violation for r in rules.season_states(df, "nfl").orderBy("seq").collect()] == [None, None, None, "score_fell"]


def test_windows(spark):
    df = spark.createDataFrame([("g", 1, 5, None), ("g", 2, None, None), ("g", 3, 7, "x")], "g string, seq int, clock int, team string")
    assert [r.clock for r in plays.carry_forward(df, ["g"], "seq", ["clock"]).orderBy("seq").collect()] == [5, 5, 7]
    assert [r.window_end for r in plays.successor_window(df, ["g"], "seq", F.col("team").isNotNull()).orderBy("seq").collect()] == [3, 3, None]


def test_json_types_come_from_the_values(spark):
    texts = ['{"k": 1, "a": {"b": [1, "x", {"c": null}]}}', '{"k": "1"}', '{"k": 2.5, "d": true}', "{", None]
    df = spark.createDataFrame([("e", t) for t in texts] + [(None, "[]")], "event_type string, props string")
    got = {(r.event_type, r.path): r.types for r in quality.json_types(df, "event_type", "props").collect()}
    assert got == {
        ("e", "$"): ["invalid", "missing", "object"], ("e", "$.k"): ["integer", "number", "string"], ("e", "$.a"): ["object"], ("e", "$.a.b"): ["array"],
        ("e", "$.a.b[]"): ["integer", "object", "string"], ("e", "$.a.b[].c"): ["null"], ("e", "$.d"): ["boolean"], (None, "$"): ["array"],
    }


def test_stream_digest_gathers_no_stream(spark):
    rows = [("a", i % 7, i) for i in range(50)] + [(None, 1, 2), ("b", None, 4), ("b", 1, None), ("b", 1, 3)]
    df = spark.createDataFrame(rows, "k string, t int, id long").repartition(3)
    out = review.stream_digest(df, ["k"], ["t"], "id")
    want = {}
    for k in ("a", None, "b"):
        own = sorted(((t is not None, t or 0, i is not None, i or 0) for x, t, i in rows if x == k))
        ids = ",".join(str(x[3]) for x in own if x[2])
        want[k] = (len(own), hashlib.sha256(f"stream|{len(own)}|{ids}".encode()).hexdigest())
    assert {r.k: (r.n, r.digest) for r in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_walk_forward_membership_equals_pairs(spark):
    rows = [(g, (g * 7) % 23 + k * (g % 5)) for g in range(40) for k in range(2)]
    df = spark.createDataFrame(rows, "game long, d int")
    span = {g: (min(d for x, d in rows if x == g), max(d for x, d in rows if x == g)) for g, _ in rows}
    out = splits.walk_forward_membership(df, "game", "d").collect()
    got = {(s.game, t.game) for s in out for t in out if t.bucket <= s.trains_upto}
    assert got == {(s, t) for s in span for t in span if span[t][1] < span[s][0]} and len(out) == 40


def test_overlapping_labels_go_greedily(spark):
    import random

    rng = random.Random(4)
    rows = [(k, i, at(t), at(t + rng.randrange(0, 90))) for k in "ab" for i, t in enumerate(sorted(rng.sample(range(2_000), 60)))] + [("c", 0, at(5), at(5)), ("c", 1, at(5), at(9))]
    df = spark.createDataFrame(rows, "k string, anchor_id int, anchor timestamp, end timestamp").repartition(3)
    got = {(r.k, r.anchor_id) for r in labels.drop_overlap(df, ["k"], "anchor", "end", 7_000_000, 3_000_000).collect()}
    want, last = set(), {}
    for k, i, a, e in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if k not in last or a > last[k] + timedelta(seconds=10):
            want.add((k, i))
            last[k] = e
    assert got == want and 0 < len(want) < len(rows)


def test_exact_quantiles_by_buckets(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"few": [1.0], "ties": [2.0] * 50 + [3.0] * 7, "wide": [*rng.normal(0, 1, 300), 1e9], "even": [float(x) for x in range(10)]}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    from feedlab.operators import clock

    ps = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r.g: list(r)[1:] for r in clock.quantiles(df, F.col("x"), ps, ["g"], at_once=8).collect()}
    assert set(got) == {*groups, None} and got[None] == [4.0] * 5
    assert all(got[g] == pytest.approx(list(np.quantile(xs, ps))) for g, xs in groups.items())
    ranks = {r.g: list(r)[1:] for r in clock.quantiles(df, F.col("x"), ps, ["g"], nearest=True, at_once=8).collect()}
    assert all(ranks[g] == pytest.approx(list(np.quantile(xs, ps, method="inverted_cdf"))) for g, xs in groups.items())
    assert list(clock.quantiles(df, F.col("x"), [0.5]).first()) == pytest.approx([float(np.median([x for _, x in rows if x is not None]))])


def test_grids_are_small(spark):
    df = spark.range(3)
    assert asof.cross_grid(df, spark.range(4).toDF("g")).count() == 12
    with pytest.raises(ValueError):
        asof.cross_grid(df, spark.range(asof.MOST_GRID_ROWS + 1).toDF("g"))
