"""Queries of the walk-forward models; their DuckDB texts repeat Newton's steps as one common table each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forward
from .registry import games, orders, query


def _steps(rounds: int, l2: float = 1.0, longest: float = 5.0) -> str:
    """Newton steps from ``i0 (k, a, b, r)`` on sums ``s (k, x, n, w)``, as common tables i1, i2, .."""
    out = []
    for i in range(rounds):
        out.append(f"m{i} AS (SELECT k, a, b, r, sum(n * p - w) AS g, sum(x * (n * p - w)) + {l2} * b AS h, sum(n * p * (1 - p)) AS u, sum(x * n * p * (1 - p)) AS v, sum(x * x * n * p * (1 - p)) + {l2} AS q FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS p FROM s JOIN i{i} USING (k)) GROUP BY k, a, b, r)")
        out.append(f"e{i} AS (SELECT *, (q * g - v * h) / (u * q - v * v) AS da, (u * h - v * g) / (u * q - v * v) AS db FROM m{i})")
        out.append(f"i{i + 1} AS (SELECT k, a - c * da AS a, b - c * db AS b, r FROM (SELECT *, least(1.0, {longest} / greatest(abs(da) + abs(db) * r, 1e-12)) AS c FROM e{i}))")
    return ",\n".join(out)


_LINES = "SELECT o_orderkey AS game, CAST(o_orderdate AS DATE) AS date, (o_custkey % 41 - 20) / 2.0::DOUBLE AS x, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS y FROM orders"


def _lines(spark, sf):
    g = games(spark, sf).select("game", "date", F.when(F.col("outcome") == "home", 1).when(F.col("outcome") == "away", 0).alias("y"))
    return g.join(orders(spark, sf).select(F.col("o_orderkey").alias("game"), ((F.col("o_custkey") % 41 - 20) / 2.0).alias("x")), "game")


@query("pit_prior", f"""
WITH g AS ({_LINES}),
s AS (SELECT d.date AS k, x, count(*) AS n, sum(y) AS w, max(g.date) AS last FROM (SELECT DISTINCT date FROM g) d JOIN g ON g.date < d.date WHERE y IS NOT NULL GROUP BY 1, 2),
t AS (SELECT k, sum(n) AS n, sum(w) AS w, max(abs(x)) AS r, max(last) AS last FROM s GROUP BY k),
i0 AS (SELECT k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, r FROM t WHERE n >= 32 AND w > 0 AND w < n),
{_steps(12)}
SELECT game, date, CAST(coalesce(n, 0) AS BIGINT) AS prior_games, last AS last_prior, round(1 / (1 + exp(-(a + b * x))), 6) AS prior FROM g LEFT JOIN t ON t.k = date LEFT JOIN i12 ON i12.k = date""")
def pit_prior(spark, sf):
    out = forward.pit_prior(_lines(spark, sf), "game", "date", "x", "y", 32)
    return out.select("game", "date", "prior_games", "last_prior", F.round("prior", 6).alias("prior"))


def _priced(spark, sf):
    """Games with their month as the cutoff, the price as the feature."""
    o = orders(spark, sf)
    return o.select(F.col("o_orderkey").alias("game"), F.to_date("o_orderdate").alias("date"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("cutoff"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("won"))


_PRICED = """
WITH g AS (SELECT o_orderkey AS game, CAST(o_orderdate AS DATE) AS date, CAST(date_trunc('month', o_orderdate) AS DATE) AS cutoff, CAST(o_totalprice AS DOUBLE) AS price, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS won FROM orders),
f AS (SELECT c.cutoff AS k, count(*) AS n, sum(won) AS w, max(date) AS last, avg(price) AS m, stddev_pop(price) AS d FROM (SELECT DISTINCT cutoff FROM g) c JOIN g ON g.date < c.cutoff WHERE won IS NOT NULL GROUP BY 1),
u AS (SELECT * FROM f WHERE n >= 50 AND w > 0 AND w < n)"""


@query("walk_forward_scores", f"""{_PRICED},
s AS (SELECT k, (price - m) / d AS x, 1 AS n, won AS w FROM u JOIN g ON g.date < k WHERE won IS NOT NULL),
i0 AS (SELECT k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 5.0::DOUBLE AS r FROM u),
{_steps(10)}
SELECT game, cutoff, round(1 / (1 + exp(-(a + b * (price - m) / d))), 6) AS p FROM g LEFT JOIN u ON u.k = cutoff LEFT JOIN i10 ON i10.k = cutoff""")
def walk_forward_scores(spark, sf):
    out, _ = forward.walk_forward(_priced(spark, sf), "cutoff", "date", ["price"], "won", 50)
    return out.select("game", "cutoff", F.round("p", 6).alias("p"))


@query("walk_forward_audit", f"""{_PRICED}
SELECT c.cutoff, CAST(coalesce(f.n, 0) AS BIGINT) AS train_rows, CAST(coalesce(f.w, 0) AS BIGINT) AS positives, f.last AS last_train, u.k IS NOT NULL AS usable FROM (SELECT DISTINCT cutoff FROM g) c LEFT JOIN f ON f.k = c.cutoff LEFT JOIN u ON u.k = c.cutoff""")
def walk_forward_audit(spark, sf):
    return forward.walk_forward(_priced(spark, sf), "cutoff", "date", ["price"], "won", 50)[1]


@query("team_strength_fit")
def team_strength_fit(spark, sf):
    from ..operators.strengths import fit_strengths

    k = F.col("o_custkey")
    matches = orders(spark, sf).select((k % 16).alias("home"), ((k * 7 + 5) % 16).alias("away"), (F.col("o_orderkey") % 7 % 4).alias("x"), (F.floor(F.col("o_totalprice")) % 5 % 3).alias("y")).where("home <> away")
    return fit_strengths(matches, "home", "away", "x", "y").withColumn("value", F.round("value", 3))
