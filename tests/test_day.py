"""Days rebuilt in slices give the books of the one-pass rebuild; chained folds say which row was changed."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from feedlab.operators import books, day, fold

T0 = datetime(2026, 6, 1)
LEVEL = "array<struct<price:decimal(18,4),size:decimal(18,6)>>"
FEED = f"event_id long, market string, received timestamp, source timestamp, kind string, bids {LEVEL}, asks {LEVEL}, price decimal(18,4), size decimal(18,6), side string"


def random_feed(seed, n):
    rng = random.Random(seed)
    d = lambda x: Decimal(x).quantize(Decimal("0.01"))
    rows = []
    for i in range(n):
        market = rng.choice(["hot"] * 8 + ["cold", None])
        at = T0 + timedelta(seconds=rng.randrange(0, 6 * 3600), milliseconds=rng.randrange(1000))
        source = None if rng.random() < 0.1 else at - timedelta(milliseconds=rng.randrange(-50, 900))
        level = lambda lo, hi: [{"price": d(rng.randrange(lo, hi) / 100), "size": Decimal(rng.choice([0, 1, 5]))} for _ in range(rng.randrange(0, 4))]
        kind = rng.choice(["book", *["price_change"] * 12, "last_trade_price"])
        if kind == "book":
            rows.append((i, market, at, source, kind, level(40, 50), level(50, 60), None, None, None))
        else:
            side = rng.choice(["BUY", "SELL"])
            rows.append((i, market, at, source, kind, None, None, d(rng.randrange(*((40, 52) if side == "BUY" else (49, 60))) / 100), Decimal(rng.choice([-1, 0, 0, 2, 3, 9])), side))
    return rows + [(n, *rows[0][1:]), (n + 1, *rows[7][1:])]  # exact repeats


@pytest.fixture(scope="module")
def feed(spark):
    return spark.createDataFrame(random_feed(6, 900), FEED)


def test_slices_give_the_same_books(spark, feed):
    want = {(r["market"], r["seq"]): r.asDict(True) for r in books.rebuild_books(feed, ["market"]).collect()}
    for hours in (0.1, 1, 50):
        out = day.rebuild_sliced(feed, ["market"], slice_us=int(hours * day.HOUR_US))
        got = {(r["market"], r["seq"]): {c: v for c, v in r.asDict(True).items() if c != "slice"} for r in out.collect()}
        assert got == want, hours
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = day.rebuild_sliced(feed, ["market"], slice_us=day.HOUR_US // 4).where("market = 'hot'").groupBy(F.spark_partition_id()).count().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread > 1  # one market's rows are in several tasks


def test_reports_count_states_and_digests_see_every_change(spark, feed):
    report = day.day_report(feed, ["market"])
    got = {r["market"]: r for r in report.collect()}
    states = books.rebuild_books(feed, ["market"]).collect()
    for m, r in got.items():
        own = [s for s in states if s["market"] == m]
        assert (r["states"], r["snapshots"], r["gaps"], r["regressions"]) == (len(own), sum(s["kind"] == "book" for s in own), sum(s["gap"] for s in own), sum(s["regression"] for s in own))
        assert [r[c] for c in ("missing_initial", "crossed", "non_positive", "duplicated")] == [sum(f in s["flags"] for s in own) for f in ("missing_initial_snapshot", "crossed_book", "non_positive_size", "duplicate_event")]
    assert sum(r["input_events"] for r in got.values()) == 902 and sum(r["semantic_events"] for r in got.values()) == 900
    one = day.day_digest(report, ["market"]).collect()
    assert len(one) == 1 and one[0]["streams"] == 3 and one[0]["input_events"] == 902
    assert day.day_digest(day.day_report(feed.repartition(7), ["market"]), ["market"]).collect() == one
    other = feed.withColumn("size", F.when(F.col("event_id") == 500, F.lit(4)).otherwise(F.col("size")).cast("decimal(18,6)"))
    assert day.day_digest(day.day_report(other, ["market"]), ["market"]).first()["day_digest"] != one[0]["day_digest"]
    assert day.day_report(feed.where("false"), ["market"]).count() == 0


PLAYS = "stream string, game string, seq long, event_id string, points int"


def chain(df):
    def add(state, row):
        if row["points"] < 0:
            raise fold.RuleBroken("negative_points")
        return {"score": state["score"] + row["points"], "plays": state["plays"] + 1}

    return fold.chained_fold(df, ["stream"], "game", "seq", "event_id", add, lambda: {"score": 0, "plays": 0})


START = '{"plays":0,"score":0}'


def test_chains_name_violations_and_locate_changes(spark):
    rows = [("a", "a", i, f"a{i}", i % 3) for i in range(1, 30)] + [("b", "b", 1, "b1", 2), ("b", "x", 2, "b2", 2)] + [("c", "c", 5, "c5", 1), ("c", "c", 7, "c7", 1)] + [("d", "d", 1, "d1", 1), ("d", "d", 2, "d2", -1), ("d", "d", 3, "d3", 1)]
    df = spark.createDataFrame(rows, PLAYS).repartition(3)
    steps = chain(df)
    assert {(r["stream"], r["violation"]) for r in steps.where("violation IS NOT NULL").collect()} == {("b", "game_mismatch"), ("c", "sequence_break"), ("d", "negative_points")}
    assert {r["stream"]: r["n"] for r in steps.where("violation IS NULL").groupBy("stream").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": 29, "b": 1, "c": 1, "d": 1}
    assert fold.verify_chain(steps, ["stream"], F.lit(START)).count() == 0

    def problems(changed):
        return {(r["stream"], r["sequence"], r["problem"]) for r in fold.verify_chain(changed, ["stream"], F.lit(START)).collect()}

    at = (F.col("stream") == "a") & (F.col("sequence") == 11)
    swap = lambda c, v: steps.withColumn(c, F.when(at, F.lit(v)).otherwise(F.col(c)))
    assert problems(swap("state", START)) == {("a", 11, "state")}
    assert problems(swap("event_sha256", "0" * 64)) == {("a", 11, "trace")}
    assert problems(swap("next_sha256", "0" * 64)) == {("a", 11, "state"), ("a", 11, "trace"), ("a", 12, "link")}
    assert problems(steps.where(~at)) == {("a", 12, "link"), ("a", 12, "number")}
    again = chain(df.withColumn("points", F.when((F.col("stream") == "a") & (F.col("seq") == 11), 9).otherwise(F.col("points"))))
    differs = steps.alias("x").join(again.alias("y"), ["stream", "sequence"]).where("x.trace_sha256 <> y.trace_sha256").agg(F.min("sequence"), F.count(F.lit(1))).first()
    assert tuple(differs) == (11, 19)  # the changed row and all that follow


def test_short_and_long_streams_are_reported_alike(spark, feed, monkeypatch):
    reports = []
    for most in (0, 150, 10**6):  # all in slices, some, none
        monkeypatch.setattr(day, "MOST_ROWS", most)
        called, inner = [], day._sliced_reports
        monkeypatch.setattr(day, "_sliced_reports", lambda f, *a: called.append(f.count()) or inner(f, *a))
        reports.append(sorted((tuple(r) for r in day.day_report(feed, ["market"], slice_us=day.HOUR_US // 2).collect()), key=str))
        assert (sum(called) == 902, bool(called)) == (most == 0, most < 10**6)
        monkeypatch.setattr(day, "_sliced_reports", inner)
    assert reports[0] == reports[1] == reports[2] and len(reports[0]) == 3
