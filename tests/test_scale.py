"""Operators that must neither gather a group nor a table: exact ranks under skew, bootstrap draws."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlab.operators import clock, metrics


def cont(values, p):
    return float(np.quantile(np.array(values, float), p, method="linear"))


def nearest(values, p):
    s = sorted(values)
    return s[max(1, -(-len(s) * round(p * 1000) // 1000)) - 1]


def test_quantiles_are_exact_with_a_far_outlier(spark):
    rng = random.Random(4)
    lags = {"a": [rng.randint(1, 4000) for _ in range(3000)] + [219 * 10**9, -(10**10)], "b": [7] * 500, None: [1, 2], "c": list(range(900)) + [5] * 400}
    rows = [(g, v) for g, vs in lags.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    ps = [0.01, 0.5, 0.95, 1.0]
    for at_once in (None, 40):  # one task may rank a group, and five rounds of cutting
        got = {r["g"]: r for r in clock.quantiles(df, F.col("v"), ps, ["g"], at_once=at_once).collect()}
        assert set(got) == set(lags)
        assert all(got[g][f"q{i}"] == pytest.approx(cont(vs, p)) for g, vs in lags.items() for i, p in enumerate(ps))
        ranks = {r["g"]: r for r in clock.quantiles(df, F.col("v"), ps, ["g"], nearest=True, at_once=at_once).collect()}
        assert all(ranks[g][f"q{i}"] == nearest(vs, p) for g, vs in lags.items() for i, p in enumerate(ps))
    assert clock.quantiles(df.where("false"), F.col("v"), ps, ["g"]).count() == 0
    assert clock.quantiles(df.where("g = 'b'"), F.col("v"), [0.5], at_once=40).first()["q0"] == 7.0


def test_no_range_of_a_cut_group_is_much_larger_than_the_others(spark, monkeypatch):
    """With one value of ten million times the median, the ranges that a sketch cuts hold about as many values each."""
    df = spark.range(200_000).select(F.when(F.col("id") == 7, F.lit(219 * 10**9)).otherwise(F.col("id")).alias("v"))
    cuts = df.agg(F.array_distinct(F.percentile_approx("v", [i / clock.RANGES for i in range(1, clock.RANGES)], 10_000)).alias("c"))
    sizes = [r["n"] for r in df.join(F.broadcast(cuts), F.lit(True)).groupBy(F.size(F.filter("c", lambda c: c <= F.col("v")))).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == clock.RANGES and max(sizes) < 2 * 200_000 / clock.RANGES
    seen = []
    plain = clock.Window.partitionBy
    monkeypatch.setattr(clock.Window, "partitionBy", staticmethod(lambda *c: seen.append(c) or plain(*c)))
    got = clock.quantiles(df, F.col("v"), [0.5], at_once=5000).first()["q0"]
    assert got == cont([219 * 10**9 if i == 7 else i for i in range(200_000)], 0.5)
    assert all("_slot" in c for c in seen)  # no window over a whole group


def test_bootstrap_draws_are_multinomial():
    sizes, k, r = [3, 0, 5, 2, 7], 17, 4000
    counts = np.concatenate([metrics.bootstrap_counts(11, sizes, b, r) for b in range(len(sizes)) if sizes[b]], axis=1)
    assert counts.shape == (r, k) and (counts.sum(1) == k).all()
    assert np.allclose(counts.mean(0), 1, atol=0.08)
    assert np.allclose(np.cov(counts[:, 0], counts[:, 16])[0, 1], -1 / k, atol=0.06)
    assert np.allclose(counts.var(0), 1 - 1 / k, atol=0.12)


def test_bootstrap_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(metrics, "CLUSTERS_AT_ONCE", 8)
    rows = spark.range(3000).select((F.col("id") % 101).alias("cluster"), (F.hash("id") % 2 == 0).cast("int").alias("y"), ((F.col("id") % 89 + 1) / 91).alias("p"))
    sums = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    each = metrics.replicate_sums(sums, "cluster", ["n"], 50, 3)
    got = each.collect()
    assert len(got) == 50 and {r["draws"] for r in got} == {101}
    assert abs(sum(r["n"] for r in got) / 50 - 3000) < 150 and len({r["n"] for r in got}) > 5
    assert sorted(metrics.replicate_sums(sums.repartition(7), "cluster", ["n"], 50, 3).collect()) == sorted(got)
    plan = metrics.cluster_bootstrap(rows, "y", "p", "cluster")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    ci = metrics.cluster_bootstrap(rows, "y", "p", "cluster").first()
    point = rows.agg(F.avg((F.col("y") - F.col("p")) ** 2)).first()[0]
    assert ci["brier_low"] < point < ci["brier_high"] and ci["replicates"] == 200


def test_bootstrap_needs_both_classes(spark):
    rows = spark.range(100).select((F.col("id") % 9).alias("cluster"), F.lit(1).alias("y"), F.lit(0.4).alias("p"))
    assert metrics.cluster_bootstrap(rows, "y", "p", "cluster").count() == 0
    assert metrics.cluster_bootstrap(rows.where("false"), "y", "p", "cluster").count() == 0


def test_asof_of_a_hot_key_is_read_in_parts(spark):
    """One key holds nine tenths of the rows; parts of its timeline are read apart and give what one sorted pass gives."""
    from datetime import datetime, timedelta

    from feedlab.operators import asof

    rng, t0 = random.Random(9), datetime(2026, 1, 1)
    hour = 3_600_000_000
    key = lambda: "hot" if rng.random() < 0.9 else rng.choice(["a", "b"])
    at = lambda: t0 + timedelta(minutes=rng.randrange(0, 3000))
    rows = [(key(), at(), i) for i in range(400)]
    points = [(key(), at(), i) for i in range(300)] + [("hot", None, 900), ("none", t0, 901)]
    r = spark.createDataFrame(rows, "k string, rt timestamp, rid int")
    p = spark.createDataFrame(points, "k string, at timestamp, pid int")
    for part in (hour, asof.PART_US):
        for strict in (False, True):
            got = {x["pid"]: x["rid"] for x in asof.first_at_or_after(p, r, ["k"], "at", "rt", ["rid"], tie="rid", strict=strict, part=part).collect()}
            for k, t, i in points:
                later = [(rt, rid) for rk, rt, rid in rows if t is not None and rk == k and (rt > t if strict else rt >= t)]
                assert got[i] == (min(later)[1] if later else None)
        got = {x["pid"]: x["rid"] for x in asof.last_at_or_before(p, r, ["k"], "at", "rt", ["rid"], tie="rid", part=part).collect()}
        for k, t, i in points:
            before = [(rt, rid) for rk, rt, rid in rows if t is not None and rk == k and rt <= t]
            assert got[i] == (max(before)[1] if before else None)
    rules = r.select("k", F.col("rid").alias("rule_id"), F.col("rt").alias("fetched"), (F.col("rt") + F.make_interval(hours=F.col("rid") % 30)).alias("effective"), (F.col("rid") % 7 != 0).alias("valid"))
    one, cut = (sorted(map(tuple, asof.asof_rule(p.dropna(), rules, ["k"], "at", 40 * hour, part=x).collect()), key=str) for x in (10**18, hour))
    assert one == cut and len({x[-2] for x in one}) >= 3
    plan = asof.last_at_or_before(p, r, ["k"], "at", "rt", ["rid"], part=hour)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line]
    assert len(windows) == 2 and "_part" in windows[0].rsplit("[", 2)[1]  # the rows' window is by key and part; the other reads a row a part


def test_barriers_are_found_through_the_index(spark):
    from datetime import datetime, timedelta
    from decimal import Decimal

    from feedlab.operators import labels

    rng, t0 = random.Random(12), datetime(2026, 1, 1)
    quotes, price = [], {"x": 100.0, "y": 50.0}
    for i in range(1500):
        k = "x" if rng.random() < 0.8 else "y"
        price[k] *= 1 + rng.uniform(-0.004, 0.004)
        quotes.append((k, t0 + timedelta(seconds=rng.randrange(0, 20_000) if i % 3 else i * 13), i, Decimal(f"{price[k]:.2f}")))
    entries = []
    for i in range(200):
        k, e, n = rng.choice("xy"), t0 + timedelta(seconds=rng.randrange(0, 20_000)), rng.randrange(1500)
        mid = 100 if k == "x" else 50
        entries.append((k, i, e, n, e + timedelta(seconds=rng.choice([0, 5, 600, 4000, 7200])), Decimal(f"{mid * (1 + rng.uniform(0, 0.05)):.8f}"), Decimal(f"{mid * (1 - rng.uniform(0, 0.05)):.8f}")))
    q = spark.createDataFrame(quotes, "k string, received timestamp, quote_id long, bid decimal(12,2)")
    e = spark.createDataFrame(entries, "k string, anchor_id long, entry_at timestamp, entry_id long, deadline timestamp, upper_price decimal(24,8), lower_price decimal(24,8)")
    out = labels.touched_quotes(e, q, ["k"], 7200 * 1_000_000)
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()
    first = {}
    for r in out.collect():
        first.setdefault(r["anchor_id"], []).append((r["received"], r["quote_id"]))
    for k, i, at, n, end, up, low in entries:
        want = sorted((t, j) for qk, t, j, b in quotes if qk == k and at <= t <= end and (t > at or j > n) and (b >= up or b <= low))
        got = sorted(first.get(i, []))
        assert bool(got) == bool(want)
        if want:
            at_first = [x for x in want if x[0] == want[0][0]]
            assert [x for x in got if x[0] == got[0][0]] == at_first


def test_calibration_slope_finds_a_planted_line(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.6 * x - 0.4)))).astype(int)
    df = spark.createDataFrame([(int(b), float(1 / (1 + np.exp(-a)))) for a, b in zip(x, y, strict=True)], "y int, p double")
    got = metrics.calibration_slope(df, "y", "p").first()
    p = 1 / (1 + np.exp(-(got["slope"] * x + got["intercept"])))
    assert abs((y - p).sum()) < 1e-2 and abs(((y - p) * x).sum()) < 1e-2 and abs(got["slope"] - 0.6) < 0.1
    assert tuple(metrics.calibration_slope(df.where("false"), "y", "p").first()) == (None, None)


def test_fits_of_spark_ml_are_at_their_optimum(spark):
    """Slopes of the penalised likelihoods vanish at what the model steps return; held-out rows don't train."""
    from feedlab.operators import models

    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (600, 2))
    off = rng.normal(0, 0.2, 600)
    y = rng.poisson(np.exp(0.2 + 0.5 * x[:, 0] - 0.3 * x[:, 1] + off))
    df = spark.createDataFrame([(int(c), float(a), float(b), float(o)) for (a, b), c, o in zip(x, y, off, strict=True)], "goals int, a double, b double, o double")
    for l2 in (0.0, 0.05):
        beta = {r["term"]: r["coefficient"] for r in models.fit_poisson_offset(df, "goals", ["a", "b"], "o", l2).collect()}
        mu = np.exp(beta["intercept"] + x @ np.array([beta["a"], beta["b"]]) + off)
        assert abs((y - mu).sum()) < 1e-3
        assert np.allclose(x.T @ (y - mu) / mu.sum(), l2 * np.array([beta["a"], beta["b"]]), atol=1e-4)
    twice = df.withColumn("c", 2 * F.col("a"))
    with pytest.raises(ValueError, match="rank"):
        models.fit_poisson_offset(twice, "goals", ["a", "c"], "o", 0.0)
    won = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] - 0.5)))).astype(int)
    rows = spark.createDataFrame([(i, int(w), float(a), float(b)) for i, (w, (a, b)) in enumerate(zip(won, x, strict=True))], "k int, won int, a double, b double")
    p = np.array([r["p"] for r in models.score_frame(rows, models.fit_outcome(rows, ["a", "b"], "won"), "k").orderBy("k").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    coef = np.linalg.lstsq(np.column_stack([np.ones(600), z]), np.log(p / (1 - p)), rcond=None)[0]
    assert abs((won - p).mean()) < 1e-4 and np.allclose(z.T @ (won - p) / 600, 0.01 * coef[1:], atol=1e-4)
    classes = rows.withColumn("t", F.when(F.col("won") == 1, "w").when(F.col("b") > 0, "d").otherwise("l"))
    train, test = classes.where("k < 500"), classes.where("k >= 500")
    got = {r["k"]: r["probabilities"] for r in models.fit_classes(train, ["a", "b"], "t", "k", test).collect()}
    assert set(got) == set(range(500, 600)) and all(set(v) == {"d", "l", "w"} and abs(sum(v.values()) - 1) < 1e-9 for v in got.values())
    flipped = test.withColumn("t", F.lit("d"))
    assert got == {r["k"]: r["probabilities"] for r in models.fit_classes(train, ["a", "b"], "t", "k", flipped).collect()}
    hits = sum(max(got[r["k"]], key=got[r["k"]].get) == r["t"] for r in test.collect())
    assert hits > 50
    probs = classes.select(F.when(F.col("k") % 4 != 0, 0).otherwise(1).alias("y"), F.array(F.lit(0.9), F.lit(0.1)).alias("q"), (F.col("k") % 3).alias("c"))
    assert models.fit_temperature(probs, "y", "q", "c") == pytest.approx(2.0, abs=0.05)  # 9 : 1 becomes 3 : 1


def test_ids_are_dealt_out_by_their_number(spark, monkeypatch):
    from feedlab.operators import quality

    monkeypatch.setattr(quality, "ROWS_A_TASK", 10)
    rows = [(i % 90, i % 30, None if i % 2 else i % 3) for i in range(200)] + [(None, 1, 1), (None, 1, 1), (500, 1, 1)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    got = quality.id_conflicts(df, ["a"], ["b", "c"])
    assert got.rdd.getNumPartitions() == 21
    want = {}
    for a, b, c in rows:
        want.setdefault(a, []).append((b, c))
    assert {tuple(r) for r in got.collect()} == {(a, len(x), len(set(x)), len(set(x)) > 1) for a, x in want.items() if len(x) > 1}
