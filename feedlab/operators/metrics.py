"""Scoring of probability models: points, calibration, clustered intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clock import quantiles

#: How far probabilities are kept from 0 and 1 before taking logarithms.
CLIP_BINARY, CLIP_MULTI = 1e-9, 1e-15


def _clip(p: Column, by: float) -> Column:
    return F.least(F.greatest(p, F.lit(by)), F.lit(1 - by))


def brier(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def log_loss(y: Column, p: Column) -> Column:
    q = _clip(p, CLIP_BINARY)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def binary_scores(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Rows, Brier score, log loss, mean probability and observed rate."""
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(brier(F.col(y), F.col(p))), 6).alias("brier"), F.round(F.avg(log_loss(F.col(y), F.col(p))), 6).alias("log_loss"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("rate"))


def scores_rollup(df: DataFrame, y: str, p: str, by: str) -> DataFrame:
    """Scores of each group and of all rows (``by`` null) in one pass."""
    sets = df.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(brier(F.col(y), F.col(p))), 6).alias("brier"), F.round(F.avg(log_loss(F.col(y), F.col(p))), 6).alias("log_loss"), F.grouping(by).cast("int").alias("overall"))
    return sets


def multiclass_scores(df: DataFrame, target: str, probs: str, by: list[str] | None = None) -> DataFrame:
    """Mean over rows of the squared error summed over classes, and of the observed class's log loss; probs is a map."""
    wrong = F.aggregate(F.map_entries(probs), F.lit(0.0), lambda a, e: a + F.pow(e["value"] - F.when(e["key"] == F.col(target), 1.0).otherwise(0.0), 2))
    own = F.element_at(F.col(probs), F.col(target))
    loss = -F.log(F.least(F.greatest(own, F.lit(CLIP_MULTI)), F.lit(1.0)))
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(wrong), 6).alias("brier"), F.round(F.avg(loss), 6).alias("log_loss"))


def calibration_bins(df: DataFrame, y: str, p: str, edges: list[float]) -> DataFrame:
    """One row a bin [low, high), the last closed: rows, mean probability, observed rate; empty bins stay, with nulls."""
    spark = df.sparkSession
    table = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(len(edges) - 1)], "bin int, low double, high double")
    last = len(edges) - 2
    cases = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        top = F.col(p) <= edges[i + 1] if i == last else F.col(p) < edges[i + 1]
        cases = F.when((F.col(p) >= edges[i]) & top, i).otherwise(cases)
    counts = df.groupBy(cases.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("rate"))
    return table.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """Mean distance of a bin's mean probability from its rate, weighted by rows."""
    return bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n"), 6).alias("ece"))


def macro_scores(df: DataFrame, y: str, p: str, cluster: str) -> DataFrame:
    """Mean over clusters of each cluster's mean scores."""
    each = df.groupBy(cluster).agg(F.avg(brier(F.col(y), F.col(p))).alias("b"), F.avg(log_loss(F.col(y), F.col(p))).alias("l"))
    return each.agg(F.count(F.lit(1)).alias("clusters"), F.round(F.avg("b"), 6).alias("brier"), F.round(F.avg("l"), 6).alias("log_loss"))


def paired_delta(df: DataFrame, y: str, p: str, prior: str, by: list[str] | None = None) -> DataFrame:
    """Model minus prior: mean difference of Brier score and log loss."""
    d = lambda f: F.round(F.avg(f(F.col(y), F.col(p)) - f(F.col(y), F.col(prior))), 6)
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), d(brier).alias("brier_delta"), d(log_loss).alias("log_loss_delta"))


def abs_delta(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean, median, 95th percentile and largest of |a - b|, and rows that lack either."""
    x = F.abs(F.col(a) - F.col(b))
    whole = df.agg(F.count(x).alias("n"), F.count_if(x.isNull()).alias("n_missing"), F.round(F.avg(x), 6).alias("mean"), F.round(F.max(x), 6).alias("largest"))
    ranks = quantiles(df, x, [0.5, 0.95]).select(F.round("q0", 6).alias("p50"), F.round("q1", 6).alias("p95"))
    return whole.join(F.broadcast(ranks), F.lit(True), "left").select("n", "n_missing", "mean", "p50", "p95", "largest")


#: Clusters that one task draws from at a time.
CLUSTERS_AT_ONCE = 1024


def bootstrap_counts(seed: int, sizes: list[int], bucket: int, replicates: int) -> np.ndarray:
    """How often each cluster of a bucket is drawn in each replicate (replicates x clusters), of draws from all buckets' clusters.

    The draws of all clusters are split in two down a binary tree over the buckets, left and right by a binomial of
    their shares, and at the bucket among its clusters: jointly that is the multinomial of drawing with replacement. A
    node's generator is seeded by its place, so every bucket below it sees the same splits.
    """
    ends = np.cumsum(sizes)
    low, high = 0, len(sizes)
    draws = np.full(replicates, int(ends[-1]), dtype=np.int64)
    count = lambda a, b: int(ends[b - 1] - (ends[a - 1] if a else 0)) if b > a else 0
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([seed, low, high]).binomial(draws, count(low, middle) / count(low, high))
        draws, low, high = (left, low, middle) if bucket < middle else (draws - left, middle, high)
    own = sizes[bucket]
    return np.random.default_rng([seed, low, high, 1]).multinomial(draws, np.full(own, 1 / own))


def replicate_sums(sums: DataFrame, cluster: str, values: list[str], replicates: int, seed: int) -> DataFrame:
    """(replicate, draws, values): per replicate, how many clusters were drawn (as many as there are) and the sums over them.

    Clusters are dealt to buckets by hash; a bucket draws for all replicates and gives out a row for each of them, so
    that neither clusters nor draws meet in one task.
    """
    k = sums.count()
    n_buckets = max(1, -(-k // CLUSTERS_AT_ONCE))
    dealt = sums.select(F.pmod(F.xxhash64(cluster), F.lit(n_buckets)).cast("int").alias("_bucket"), F.xxhash64(F.lit(1), F.col(cluster)).alias("_place"), F.col(cluster).alias("_c"), *[F.col(v).cast("double").alias(v) for v in values])
    held = dict(dealt.groupBy("_bucket").agg(F.count(F.lit(1))).collect())  # a row for a thousand clusters
    sizes = [held.get(b, 0) for b in range(n_buckets)]
    schema = pa.schema([("replicate", pa.int32()), ("draws", pa.float64()), *[(v, pa.float64()) for v in values]])

    def draw(part: pa.Table) -> pa.Table:
        part = part.sort_by([("_place", "ascending"), ("_c", "ascending")])
        counts = bootstrap_counts(seed, sizes, part["_bucket"][0].as_py(), replicates)
        got = [pa.array(counts @ part[v].to_numpy()) for v in values]
        return pa.Table.from_arrays([pa.array(np.arange(1, replicates + 1, dtype=np.int32)), pa.array(counts.sum(1).astype(float)), *got], schema=schema)

    each = dealt.groupBy("_bucket").applyInArrow(draw, "replicate int, draws double, " + ", ".join(f"{v} double" for v in values))
    return each.groupBy("replicate").agg(F.sum("draws").cast("long").alias("draws"), *[F.sum(v).alias(v) for v in values])


def cluster_bootstrap(df: DataFrame, y: str, p: str, cluster: str, replicates: int = 200, level: float = 0.95, prior: str | None = None, seed: int = 7, min_valid: int = 50) -> DataFrame:
    """Percentile intervals of the Brier score and log loss from resampling whole clusters, as many as were observed.

    Each cluster is summed first; see ``replicate_sums`` for the draws. Replicates without both classes are left out.
    With ``prior`` the scores are differences (model minus prior). No row where under ``min_valid`` replicates are valid.
    """
    b, lo = brier(F.col(y), F.col(p)), log_loss(F.col(y), F.col(p))
    if prior:
        b, lo = b - brier(F.col(y), F.col(prior)), lo - log_loss(F.col(y), F.col(prior))
    sums = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(b).alias("b"), F.sum(lo).alias("l"), F.sum(y).alias("ones"))
    each = replicate_sums(sums, cluster, ["n", "b", "l", "ones"], replicates, seed)
    valid = each.where("ones > 0 AND ones < n").select((F.col("b") / F.col("n")).alias("b"), (F.col("l") / F.col("n")).alias("l"))
    a = (1 - level) / 2
    return valid.agg(F.count(F.lit(1)).alias("replicates"), *[F.round(F.percentile(c, q), 6).alias(f"{name}_{side}") for c, name in (("b", "brier"), ("l", "log_loss")) for q, side in ((a, "low"), (1 - a, "high"))]).where(F.col("replicates") >= min_valid)


def calibration_slope(df: DataFrame, y: str, p: str, rounds: int = 20, longest: float = 5.0) -> DataFrame:
    """(slope, intercept) of the logistic regression of y on logit(p), unpenalised: Newton steps from five summed moments.

    No step moves a log odds by more than ``longest``, so that the steps don't run away. Null where there is nothing to fit.
    """
    q = _clip(F.col(p), CLIP_BINARY)
    rows = df.select(F.col(y).cast("double").alias("y"), F.log(q / (1 - q)).alias("x"))
    slope, intercept, found = 0.0, 0.0, False
    for _ in range(rounds):
        m = 1 / (1 + F.exp(-(F.lit(slope) * F.col("x") + F.lit(intercept))))
        w, r = m * (1 - m), F.col("y") - m
        g0, g1, h00, h01, h11, reach = rows.agg(F.sum(r), F.sum(r * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x")), F.max(F.abs("x"))).first()
        if g0 is None or (det := h00 * h11 - h01 * h01) == 0:
            break
        found = True
        step = ((h00 * g1 - h01 * g0) / det, (h11 * g0 - h01 * g1) / det)
        cut = min(1.0, longest / max(abs(step[1]) + abs(step[0]) * reach, 1e-12))
        slope, intercept = slope + cut * step[0], intercept + cut * step[1]
        if max(map(abs, step)) < 1e-10:
            break
    return df.sparkSession.createDataFrame([(round(slope, 6), round(intercept, 6)) if found else (None, None)], "slope double, intercept double")


def liquidity_census(df: DataFrame, by: list[str], market: str, trading: Column, pit: Column, spread: Column, depth: Column, ts: str) -> DataFrame:
    """Per group and in all (grouping sets): markets, hours in play, median spread and depth, pause share, rows without PIT data.

    Medians are over trading rows with PIT data and exact (``clock.quantiles``); the pause share is over all rows with PIT data.
    """
    live = trading & pit
    rows = df.select(*by, F.col(market).alias("_m"), live.alias("_live"), pit.alias("_pit"), F.when(live, spread).alias("_s"), F.when(live, depth).alias("_d"))
    whole = rows.rollup(*by).agg(F.count_distinct("_m").alias("markets"), F.count_if("_live").alias("live_rows"), F.round(F.count_if(F.col("_pit") & ~F.col("_live")) / F.count_if("_pit"), 6).alias("pause_share"), F.count_if(~F.col("_pit")).alias("pit_missing"), F.grouping_id().cast("int").alias("level"))
    n = len(by)
    levels = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n))))  # how many of the columns a level groups by
    levels = levels.select(*[F.when(F.col("_i") > i, F.col(c)).alias(c) for i, c in enumerate(by)], (F.call_function("shiftleft", F.lit(1), F.lit(n) - F.col("_i")) - 1).cast("int").alias("level"), "_s", "_d")
    out = whole
    for value, name in (("_s", "median_spread"), ("_d", "median_depth")):
        found = quantiles(levels, F.col(value), [0.5], [*by, "level"]).withColumnsRenamed({**{c: f"_r{i}" for i, c in enumerate(by)}, "level": "_l", "q0": name})
        out = out.join(found.withColumn(name, F.round(name, 6)), [out["level"] == found["_l"], *[out[c].eqNullSafe(found[f"_r{i}"]) for i, c in enumerate(by)]], "left").drop("_l", *[f"_r{i}" for i in range(n)])
    return out.select(*by, "markets", "live_rows", "median_spread", "median_depth", "pause_share", "pit_missing", "level")


def season_scores(df: DataFrame, y: str, p: str, season: str, bins: int = 10) -> DataFrame:
    """Per season: scored rows, ties (a null outcome, which isn't scored), Brier score, log loss and expected calibration error."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    scored = F.col(y).isNotNull()
    by_bin = df.groupBy(season, F.when(scored, b).alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.sum(brier(F.col(y), F.col(p))).alias("b"), F.sum(log_loss(F.col(y), F.col(p))).alias("l"), F.abs(F.sum(F.col(p) - F.col(y))).alias("off"))
    n = F.sum(F.when(F.col("_b").isNotNull(), F.col("n")).otherwise(0))
    mean = lambda c: F.round(F.try_divide(F.sum(F.when(F.col("_b").isNotNull(), F.col(c))), n), 6)
    return by_bin.groupBy(season).agg(n.alias("n"), F.sum(F.when(F.col("_b").isNull(), F.col("n")).otherwise(0)).alias("ties"), mean("b").alias("brier"), mean("l").alias("log_loss"), mean("off").alias("ece"))
