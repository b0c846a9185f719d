"""Queries: probability scores, calibration, apportioning and score models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probability as pr
from ..operators import metrics as m
from ..operators import review
from .forward import _steps
from .registry import events, games, lineitem, orders, predictions, query, table

_CLIP = "least(greatest(p, 1e-9), 1 - 1e-9)"
_LOSS = f"-(y * ln({_CLIP}) + (1 - y) * ln(1 - {_CLIP}))"


@query("binary_scores", f"SELECT count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg({_LOSS}), 6) AS log_loss, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM v_pred", "v_pred")
def binary_scores(spark, sf):
    return m.binary_scores(predictions(spark, sf), "y", "p")


@query("scores_rollup", f"SELECT season, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg({_LOSS}), 6) AS log_loss, CAST(grouping(season) AS INTEGER) AS overall FROM v_pred GROUP BY GROUPING SETS ((season), ())", "v_pred")
def scores_rollup(spark, sf):
    return m.scores_rollup(predictions(spark, sf), "y", "p", "season")


@query("multiclass_scores", """
WITH c AS (SELECT season, CASE WHEN y = 1 THEN 'a' WHEN doc_id % 2 = 0 THEN 'b' ELSE 'c' END AS t, p * 0.8 AS a, p * 0.2 AS b, 1 - p AS c FROM v_pred)
SELECT season, count(*) AS n, round(avg(pow(a - (t = 'a')::INT, 2) + pow(b - (t = 'b')::INT, 2) + pow(c - (t = 'c')::INT, 2)), 6) AS brier, round(avg(-ln(least(greatest(CASE t WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END, 1e-15), 1))), 6) AS log_loss FROM c GROUP BY 1""", "v_pred")
def multiclass_scores(spark, sf):
    p = predictions(spark, sf)
    t = F.when(F.col("y") == 1, "a").when(F.col("doc_id") % 2 == 0, "b").otherwise("c")
    probs = F.create_map(F.lit("a"), F.col("p") * 0.8, F.lit("b"), F.col("p") * 0.2, F.lit("c"), 1 - F.col("p"))
    return m.multiclass_scores(p.withColumns({"t": t, "probs": probs}), "t", "probs", ["season"])


@query("calibration_bins", """
WITH e(bin, low, high) AS (VALUES (0, 0.0::DOUBLE, 0.25::DOUBLE), (1, 0.25, 0.5), (2, 0.5, 0.75), (3, 0.75, 1.0))
SELECT CAST(bin AS INTEGER) AS bin, low, high, count(p) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM e LEFT JOIN v_pred ON p >= low AND (p < high OR (bin = 3 AND p <= high)) GROUP BY 1, 2, 3""", "v_pred")
def calibration_bins(spark, sf):
    return m.calibration_bins(predictions(spark, sf), "y", "p", [0.0, 0.25, 0.5, 0.75, 1.0])


@query("calibration_error", "SELECT round(sum(n * abs(mp - r)) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, round(avg(p), 6) AS mp, round(avg(y), 6) AS r FROM v_pred GROUP BY least(floor(p * 10), 9))", "v_pred")
def calibration_error(spark, sf):
    return m.expected_calibration_error(m.calibration_bins(predictions(spark, sf), "y", "p", [i / 10 for i in range(11)]))


@query("macro_scores", f"SELECT count(*) AS clusters, round(avg(b), 6) AS brier, round(avg(l), 6) AS log_loss FROM (SELECT avg((p - y) * (p - y)) AS b, avg({_LOSS}) AS l FROM v_pred GROUP BY cluster)", "v_pred")
def macro_scores(spark, sf):
    return m.macro_scores(predictions(spark, sf), "y", "p", "cluster")


_PRIOR = "(0.5 + (p - 0.5) / 2)"


@query("paired_delta", f"SELECT season, count(*) AS n, round(avg((p - y) * (p - y) - ({_PRIOR} - y) * ({_PRIOR} - y)), 6) AS brier_delta, round(avg({_LOSS} + (y * ln({_PRIOR}) + (1 - y) * ln(1 - {_PRIOR}))), 6) AS log_loss_delta FROM v_pred GROUP BY 1", "v_pred")
def paired_delta(spark, sf):
    return m.paired_delta(predictions(spark, sf).withColumn("prior", 0.5 + (F.col("p") - 0.5) / 2), "y", "p", "prior", ["season"])


@query("abs_delta", f"SELECT count(d) AS n, count(*) - count(d) AS n_missing, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS largest FROM (SELECT abs(p - CASE WHEN doc_id % 9 <> 0 THEN {_PRIOR} END) AS d FROM v_pred)", "v_pred")
def abs_delta(spark, sf):
    prior = F.when(F.col("doc_id") % 9 != 0, 0.5 + (F.col("p") - 0.5) / 2)
    return m.abs_delta(predictions(spark, sf).withColumn("q", prior), "p", "q")


@query("calibration_slope", f"""
WITH s AS (SELECT 1 AS k, ln(p / (1 - p)) AS x, 1 AS n, y AS w FROM v_pred), i0 AS (SELECT k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, max(abs(x)) AS r FROM s GROUP BY k),
{_steps(14, l2=0.0)}
SELECT round(b, 6) AS slope, round(a, 6) AS intercept FROM i14""", "v_pred")
def calibration_slope(spark, sf):
    return m.calibration_slope(predictions(spark, sf), "y", "p")


@query("cluster_bootstrap")
def cluster_bootstrap(spark, sf):
    return m.cluster_bootstrap(predictions(spark, sf), "y", "p", "cluster")


@query("paired_delta_ci")
def paired_delta_ci(spark, sf):
    return m.cluster_bootstrap(predictions(spark, sf).withColumn("prior", F.lit(0.5)), "y", "p", "cluster", prior="prior")


@query("temperature_scale", """
SELECT doc_id, round(exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS p_yes FROM (SELECT doc_id, ln(greatest(p, 1e-15)) / 1.7 AS a, ln(greatest(1 - p, 1e-15)) / 1.7 AS b FROM v_pred)""", "v_pred")
def temperature_scale(spark, sf):
    p = predictions(spark, sf)
    return p.select("doc_id", F.round(F.get(pr.temperature_scale(F.array(F.col("p"), 1 - F.col("p")), F.lit(1.7)), 0), 6).alias("p_yes"))


@query("temperature_grid", """
WITH g AS (SELECT doc_id, cluster, y, t, greatest(p, 1e-15) AS a, greatest(1 - p, 1e-15) AS b FROM v_pred, (SELECT unnest([0.5, 1.0, 1.5, 2.0, 3.0]::DOUBLE[]) AS t)),
s AS (SELECT t, cluster, avg(-ln(CASE WHEN y = 1 THEN pow(a, 1 / t) ELSE pow(b, 1 / t) END / (pow(a, 1 / t) + pow(b, 1 / t)))) AS l FROM g GROUP BY 1, 2)
SELECT t, round(avg(l), 6) AS loss FROM s GROUP BY 1""", "v_pred")
def temperature_grid(spark, sf):
    from ..operators.models import temperature_losses

    rows = predictions(spark, sf).select("cluster", F.when(F.col("y") == 1, 0).otherwise(1).alias("target"), F.array(F.col("p"), 1 - F.col("p")).alias("probs"))
    return temperature_losses(rows, "target", "probs", "cluster", [0.5, 1.0, 1.5, 2.0, 3.0])


@query("largest_remainder", """
WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(CAST(l_quantity AS DECIMAL(18,2)) * 1000000 AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS DECIMAL(28,10)) AS x FROM lineitem),
f AS (SELECT *, CAST(floor(x) AS BIGINT) AS f FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY x - f DESC, l_linenumber, l_partkey, l_suppkey) AS nth, 1000000 - sum(f) OVER (PARTITION BY l_orderkey) AS short FROM f)
SELECT l_orderkey, count(*) AS parts, CAST(sum(f + CASE WHEN nth <= short THEN 1 ELSE 0 END) AS BIGINT) AS atoms FROM n GROUP BY 1""")
def largest_remainder(spark, sf):
    rows = lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    out = pr.apportion(rows, ["l_orderkey"], F.col("q"), ["l_linenumber", "l_partkey", "l_suppkey"], 6)
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("parts"), F.sum("atoms").alias("atoms"))


@query("terminal_winner", "SELECT doc_id, CAST(CASE WHEN a >= 0.999 AND 1 - a <= 0.001 THEN 0 WHEN a <= 0.001 AND 1 - a >= 0.999 THEN 1 WHEN a = 0.5 THEN -1 END AS INTEGER) AS winner FROM (SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0.5 ELSE round(p, 3) END AS DECIMAL(6,3)) AS a FROM v_pred)", "v_pred")
def terminal_winner(spark, sf):
    a = F.when(F.col("doc_id") % 4 == 0, F.lit(1.0)).when(F.col("doc_id") % 4 == 1, F.lit(0.0)).when(F.col("doc_id") % 4 == 2, F.lit(0.5)).otherwise(F.round("p", 3)).cast("decimal(6,3)")
    p = predictions(spark, sf).withColumn("a", a)
    return p.select("doc_id", pr.terminal_winner(F.array(F.col("a"), (1 - F.col("a")).cast("decimal(6,3)"))).alias("winner"))


@query("score_grid_outcome", """
WITH r AS (SELECT n_nationkey, 0.8 + n_nationkey / 20.0::DOUBLE AS h, 1.9 - n_nationkey / 25.0::DOUBLE AS a FROM nation), g AS (SELECT n_nationkey, h, a, i, j FROM r, (SELECT unnest(range(0, 11)) AS i), (SELECT unnest(range(0, 11)) AS j)),
c AS (SELECT n_nationkey, i, j, exp(-h) * pow(h, i) / factorial(CAST(i AS INTEGER)) * exp(-a) * pow(a, j) / factorial(CAST(j AS INTEGER)) * CASE WHEN i = 0 AND j = 0 THEN 1 - h * a * -0.05 WHEN i = 0 AND j = 1 THEN 1 + h * -0.05 WHEN i = 1 AND j = 0 THEN 1 + a * -0.05 WHEN i = 1 AND j = 1 THEN 1.05 ELSE 1 END AS p FROM g)
SELECT n_nationkey, round(sum(p) FILTER (i > j) / sum(p), 6) AS p_home, round(sum(p) FILTER (i = j) / sum(p), 6) AS p_draw, round(sum(p) FILTER (i < j) / sum(p), 6) AS p_away FROM c GROUP BY 1""")
def score_grid_outcome(spark, sf):
    n = F.col("n_nationkey")
    rates = table(spark, sf, "nation").select("n_nationkey", (0.8 + n / 20.0).alias("h"), (1.9 - n / 25.0).alias("a"))
    return pr.score_grid_outcome(rates, "h", "a", -0.05, ["n_nationkey"])


@query("competing_poisson", """
WITH r AS (SELECT o_orderkey, 1.4 * 300 / 5400 * exp(0.1 * (o_orderkey % 2) - 0.05 * (o_custkey % 5) + 0.2 * (o_custkey % 2)) AS lh, 1.1 * 300 / 5400 * exp(0.1 * (o_orderkey % 2) + 0.05 * (o_custkey % 5) - 0.2 * (o_custkey % 2)) AS la FROM orders)
SELECT o_orderkey, round((1 - exp(-(lh + la))) * lh / (lh + la), 6) AS p_home, round(exp(-(lh + la)), 6) AS p_none FROM r""")
def competing_poisson(spark, sf):
    half, lead, off = (F.col("o_orderkey") % 2).cast("double"), (F.col("o_custkey") % 5).cast("double"), (F.col("o_custkey") % 2).cast("double")
    out = pr.competing_poisson(F.lit(1.4), F.lit(1.1), [half, lead, off], [half, -lead, -off], [0.1, -0.05, 0.2])
    return orders(spark, sf).select("o_orderkey", out.alias("p")).select("o_orderkey", F.round("p.p_home", 6).alias("p_home"), F.round("p.p_none", 6).alias("p_none"))


@query("feature_projection", """
WITH r AS (SELECT o_orderkey, o_orderkey % 21 - 10 AS diff, o_custkey % 3601 AS s, o_orderkey % 4 + 1 AS q, o_custkey % 901 AS qs, o_orderkey % 3 = 0 AS ball, o_custkey % 2 = 0 AS opened FROM orders)
SELECT o_orderkey, round((3600 - s) / 3600, 6) AS elapsed_share, round(diff / exp(-4 * ((3600 - s) / 3600)), 6) AS diff_time_ratio, CAST(q <= 2 AND ball = (NOT opened) AS DOUBLE) AS receives_second_half, qs + CASE WHEN q IN (1, 3) THEN 900 ELSE 0 END AS half_seconds FROM r""")
def feature_projection(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    f = pr.win_prob_features(k % 21 - 10, c % 3601, k % 4 + 1, c % 901, k % 3 == 0, c % 2 == 0)
    return orders(spark, sf).select("o_orderkey", F.round(f["elapsed_share"], 6).alias("elapsed_share"), F.round(f["diff_time_ratio"], 6).alias("diff_time_ratio"), f["receives_second_half"].alias("receives_second_half"), f["half_seconds"].alias("half_seconds"))


@query("review_precision", "SELECT source, count(*) AS reviewed, count(*) FILTER (quality = 1) AS correct, round(avg(CAST(quality = 1 AS DOUBLE)), 6) AS precision, count(*) = 50 AND count(*) FILTER (quality = 1) >= 45 AS gate FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def review_precision(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return review.precision(rows, F.col("quality") == 1, "source")


@query("liquidity_census", """
WITH r AS (SELECT event_type, user_id, event_type <> 'error' AS trading, k % 10 <> 0 AS pit, value, k FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
SELECT event_type, count(DISTINCT user_id) AS markets, count(*) FILTER (trading AND pit) AS live_rows, round(quantile_cont(value, 0.5) FILTER (trading AND pit), 6) AS median_spread, round(quantile_cont(k, 0.5) FILTER (trading AND pit), 6) AS median_depth, round(count(*) FILTER (pit AND NOT trading) / count(*) FILTER (pit), 6) AS pause_share, count(*) FILTER (NOT pit) AS pit_missing, CAST(grouping(event_type) AS INTEGER) AS level FROM r GROUP BY GROUPING SETS ((event_type), ())""")
def liquidity_census(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return m.liquidity_census(events(spark, sf), ["event_type"], "user_id", F.col("event_type") != "error", k % 10 != 0, F.col("value"), k, "ts")


@query("logit_scores")
def logit_scores(spark, sf):
    from ..operators.models import fit_outcome, score_frame

    rows = predictions(spark, sf).select("doc_id", "y", "p", F.length("season").cast("double").alias("s"))
    return score_frame(rows, fit_outcome(rows, ["p", "s"], "y"), "doc_id")


@query("poisson_fit")
def poisson_fit(spark, sf):
    from ..operators.models import fit_poisson_offset

    o = orders(spark, sf).select((F.col("o_orderkey") % 4).cast("double").alias("goals"), (F.col("o_custkey") % 7).cast("double").alias("x"), F.log(F.col("o_totalprice")).alias("log_offset"))
    return fit_poisson_offset(o, "goals", ["x"], "log_offset", 0.01)


@query("team_strengths")
def team_strengths(spark, sf):
    from ..operators.models import fit_team_strengths

    g = games(spark, sf).select((F.col("game") % 12).cast("string").alias("team"), (F.col("game") % 11).cast("string").alias("opponent"), (F.col("game") % 2).cast("double").alias("home"), (F.col("game") % 5).cast("double").alias("goals"))
    return fit_team_strengths(g, "team", "opponent", "home", "goals")


@query("transition_model")
def transition_model(spark, sf):
    from ..operators.models import fit_classes

    rows = predictions(spark, sf).select("doc_id", (F.col("doc_id") % 3).cast("string").alias("label"), "p", F.col("y").cast("double").alias("yy"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = fit_classes(rows.where(~held_out), ["p", "yy"], "label", "doc_id", rows)
    return scored.withColumn("held_out", held_out)
