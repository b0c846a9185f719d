"""Probability arithmetic in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_distribution(probs: Column, classes: list[str]) -> Column:
    """Whether a map of decimals has exactly the declared classes, each in [0, 1], summing to exactly 1."""
    declared = F.array(*[F.lit(c) for c in sorted(classes)])
    values = F.map_values(probs)
    total = F.aggregate(values, F.lit(0).cast("decimal(38,18)"), lambda a, x: (a + x).cast("decimal(38,18)"))
    return (F.array_sort(F.map_keys(probs)) == declared) & F.forall(values, lambda x: (x >= 0) & (x <= 1)) & (total == 1)


def temperature_scale(probs: Column, t: Column) -> Column:
    """softmax(log p / t) of an array of probabilities."""
    logs = F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(1e-15))) / t)
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def poisson(rate: Column, k: Column) -> Column:
    return F.exp(-rate) * F.pow(rate, k) / F.factorial(k)


def score_grid_outcome(df: DataFrame, home: str, away: str, rho: float, keys: list[str], top: int = 10) -> DataFrame:
    """(keys, p_home, p_draw, p_away): two Poisson rates with the low-score correction, summed over a goal grid and normalised.

    Goals are uncorrected but for four scores, so that a fold over the goals with running sums of both sides gives the sums
    over the grid, and the corrections are added: one expression a row, without a shuffle.
    """
    h, a = F.col(home), F.col(away)
    zero = F.lit(0.0)

    def add(t: Column, k: Column) -> Column:
        x, y = poisson(h, k), poisson(a, k)
        return F.struct((t["home"] + x * t["y"]).alias("home"), (t["draw"] + x * y).alias("draw"), (t["away"] + y * t["x"]).alias("away"), (t["x"] + x).alias("x"), (t["y"] + y).alias("y"))

    grid = F.aggregate(F.sequence(F.lit(0), F.lit(top)), F.struct(*[zero.alias(c) for c in ("home", "draw", "away", "x", "y")]), add)
    both = lambda i, j: poisson(h, F.lit(i)) * poisson(a, F.lit(j))
    rows = df.withColumn("_g", grid)
    sums = {"_h": F.col("_g.home") + a * rho * both(1, 0), "_d": F.col("_g.draw") - h * a * rho * both(0, 0) - rho * both(1, 1), "_a": F.col("_g.away") + h * rho * both(0, 1)}
    mass = F.col("_h") + F.col("_d") + F.col("_a")
    return rows.withColumns(sums).select(*keys, *[F.round(F.col(c) / mass, 6).alias(n) for c, n in (("_h", "p_home"), ("_d", "p_draw"), ("_a", "p_away"))])


def competing_poisson(base_home: Column, base_away: Column, x_home: list[Column], x_away: list[Column], beta: list[float], horizon_s: float = 300, match_s: float = 5400) -> Column:
    """struct(p_home, p_away, p_none): which side scores first within the horizon."""
    rate = lambda base, xs: base * (horizon_s / match_s) * F.exp(sum((b * x for b, x in zip(beta, xs, strict=True)), F.lit(0.0)))
    lh, la = rate(base_home, x_home), rate(base_away, x_away)
    none = F.exp(-(lh + la))
    home = (1 - none) * lh / (lh + la)
    return F.struct(home.alias("p_home"), (1 - none - home).alias("p_away"), none.alias("p_none"))


def apportion(df: DataFrame, keys: list[str], weight: Column, order: list[str], scale: int) -> DataFrame:
    """``df`` with ``atoms``: shares of 10^scale by largest remainder; they sum exactly to it in each group.

    Each share is floored and the rest is handed out one by one, by remainder falling and then ``order``.
    """
    g = Window.partitionBy(*keys)
    units = F.lit(10**scale).cast("decimal(20,0)")
    rows = df.withColumn("_w", weight)
    exact = (F.col("_w").cast("decimal(18,2)") * units / F.sum("_w").over(g).cast("decimal(18,2)")).cast("decimal(28,10)")
    rows = rows.withColumn("_x", exact).withColumn("_f", F.floor("_x").cast("long"))
    rows = rows.withColumn("_nth", F.row_number().over(g.orderBy((F.col("_x") - F.col("_f")).desc(), *order))).withColumn("_short", F.lit(10**scale) - F.sum("_f").over(g))
    return rows.withColumn("atoms", F.col("_f") + F.when(F.col("_nth") <= F.col("_short"), 1).otherwise(0)).drop("_w", "_x", "_f", "_nth", "_short")


def terminal_winner(prices: Column) -> Column:
    """Index of the outcome at >= 0.999 with all others <= 0.001; -1 for an exact 0.5 : 0.5; null otherwise."""
    high = F.filter(F.transform(prices, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["p"] >= 0.999)
    low = F.size(F.filter(prices, lambda p: p <= 0.001))
    even = (F.size(prices) == 2) & F.forall(prices, lambda p: p == 0.5)
    return F.when((F.size(high) == 1) & (low == F.size(prices) - 1), F.get(high, 0)["i"]).when(even, F.lit(-1))


def win_prob_features(diff: Column, game_seconds: Column, period: Column, period_seconds: Column, home_has_ball: Column, home_opened: Column) -> dict[str, Column]:
    """Win-probability features: elapsed share, time-weighted difference, second-half receiver, half seconds."""
    elapsed = (3600 - game_seconds) / 3600
    receives = (period <= 2) & (home_has_ball == ~home_opened)
    return {"elapsed_share": elapsed, "diff_time_ratio": diff / F.exp(-4 * elapsed), "receives_second_half": receives.cast("double"), "half_seconds": period_seconds + F.when(period.isin(1, 3), 900).otherwise(0)}


def orient(p: Column, is_home: Column) -> Column:
    """A probability of the team with the ball as one of the home team."""
    return F.when(is_home, p).otherwise(1 - p)


def orient_state(own_score: Column, other_score: Column, own_p: Column, own_is_home: Column) -> dict[str, Column]:
    """A row told from the view of the team with the ball, told from the home team's: scores, difference, probability, who has the ball."""
    home, away = F.when(own_is_home, own_score).otherwise(other_score), F.when(own_is_home, other_score).otherwise(own_score)
    return {"home_score": home, "away_score": away, "home_difference": home - away, "home_p": orient(own_p, own_is_home), "home_has_ball": own_is_home}
