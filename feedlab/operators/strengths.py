"""Team strengths from scores: Poisson goals with a correction of low scores, fitted by distributed L-BFGS."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch

#: Most teams: their strengths pass through the driver, matches don't.
MOST_TEAMS = 1_000_000
_GLOBAL = 3  # base, home and rho stand before the attacks and defences


def score_gradient(theta: np.ndarray, teams: int, home: np.ndarray, away: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Minus the log likelihood of weighted matches (factorials left out) and its gradient; infinite where the correction isn't positive.

    Goals have the rates l = exp(base + home + attack[h] - defence[a]) and m = exp(base + attack[a] - defence[h]). Scores of at
    most one goal a side are corrected: 0-0 by 1 - l m rho, 0-1 by 1 + l rho, 1-0 by 1 + m rho, 1-1 by 1 - rho.
    """
    base, at_home, rho = theta[:_GLOBAL]
    attack, defence = theta[_GLOBAL : _GLOBAL + teams], theta[_GLOBAL + teams :]
    log_l, log_m = base + at_home + attack[home] - defence[away], base + attack[away] - defence[home]
    lam, mu = np.exp(np.clip(log_l, -50, 50)), np.exp(np.clip(log_m, -50, 50))
    nil, one = np.where(x == 0, 1.0, 0.0), np.where(x == 1, 1.0, 0.0)
    nil_y, one_y = np.where(y == 0, 1.0, 0.0), np.where(y == 1, 1.0, 0.0)
    tau = 1 + rho * (-lam * mu * nil * nil_y + lam * nil * one_y + mu * one * nil_y - one * one_y)
    if (tau <= 0).any():
        return np.inf, np.zeros_like(theta)
    loss = -(w * (np.log(tau) + x * log_l - lam + y * log_m - mu)).sum()
    d_rho = (-lam * mu * nil * nil_y + lam * nil * one_y + mu * one * nil_y - one * one_y) / tau
    d_l = x - lam + rho * (-lam * mu * nil * nil_y + lam * nil * one_y) / tau
    d_m = y - mu + rho * (-lam * mu * nil * nil_y + mu * one * nil_y) / tau
    g = np.zeros_like(theta)
    g[0], g[1], g[2] = (w * (d_l + d_m)).sum(), (w * d_l).sum(), (w * d_rho).sum()
    np.add.at(g, _GLOBAL + home, w * d_l)
    np.add.at(g, _GLOBAL + away, w * d_m)
    np.add.at(g, _GLOBAL + teams + away, -w * d_l)
    np.add.at(g, _GLOBAL + teams + home, -w * d_m)
    return loss, -g


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, memory: int = 8, tolerance: float = 1e-6, most: int = 200) -> tuple[np.ndarray, int]:
    """L-BFGS with backtracking: (minimum, evaluations). Stops where no slope is steeper than ``tolerance`` times the larger of 1 and the loss."""
    x, steps, calls = start, [], 1
    loss, slope = evaluate(x)
    while calls < most and np.abs(slope).max() > tolerance * max(1.0, abs(loss)):
        q, alphas = slope.copy(), []
        for s, y in reversed(steps):
            alphas.append(s @ q / (y @ s))
            q -= alphas[-1] * y
        q *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(slope).sum())
        for (s, y), a in zip(steps, reversed(alphas), strict=True):
            q += (a - y @ q / (y @ s)) * s
        rate = 1.0
        while True:
            new, calls = x - rate * q, calls + 1
            there, there_slope = evaluate(new)
            if there <= loss - 1e-4 * rate * (slope @ q):
                break
            rate /= 2
            if rate < 1e-8 or calls >= most:
                return x, calls
        if (new - x) @ (there_slope - slope) > 1e-12:
            steps = [*steps[-memory + 1 :], (new - x, there_slope - slope)]
        x, loss, slope = new, there, there_slope
    return x, calls


def fit_strengths(matches: DataFrame, home: str, away: str, home_goals: str, away_goals: str, l2: float = 1.0, weight: str | None = None, tolerance: float = 1e-7) -> DataFrame:
    """(kind, team, value): base, home and rho, and attack and defence of each team; see ``score_gradient`` for the likelihood.

    ``l2``/2 times their squares keeps attacks and defences near zero, which also fixes their common level. Equal matches
    are summed first; each evaluation is one pass in which tasks add up their matches' gradients. Rows with a null are left out.
    """
    spark = matches.sparkSession
    names = [r[0] for r in matches.select(F.explode(F.array(F.col(home).cast("string"), F.col(away).cast("string"))).alias("t")).where("t IS NOT NULL").distinct().orderBy("t").limit(MOST_TEAMS + 1).collect()]
    if len(names) > MOST_TEAMS:
        raise ValueError(f"more than {MOST_TEAMS} teams")
    teams = len(names)
    place = spark.createDataFrame(list(enumerate(names)), "i int, t string")
    rows = matches.select(F.col(home).cast("string").alias("h"), F.col(away).cast("string").alias("a"), F.col(home_goals).cast("double").alias("x"), F.col(away_goals).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).dropna()
    rows = rows.join(F.broadcast(place.withColumnsRenamed({"i": "hi", "t": "h"})), "h").join(F.broadcast(place.withColumnsRenamed({"i": "ai", "t": "a"})), "a")
    with scratch(spark, "strengths") as keep:
        rows = keep(rows.groupBy("hi", "ai", "x", "y").agg(F.sum("w").alias("w")), "scores")

        def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(len(theta) + 1)
                for b in batches:
                    c = [b.column(n).to_numpy(zero_copy_only=False) for n in ("hi", "ai", "x", "y", "w")]
                    loss, slope = score_gradient(theta, teams, *c)
                    total += np.r_[loss, slope]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "value"])

            got = rows.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
            sums = np.zeros(len(theta) + 1)
            sums[got["cell"].to_numpy()] = got["value"].to_numpy()
            own = np.r_[np.zeros(_GLOBAL), theta[_GLOBAL:]]
            return sums[0] + 0.5 * l2 * own @ own, sums[1:] + l2 * own

        theta, _ = minimise(evaluate, np.zeros(_GLOBAL + 2 * teams), tolerance=tolerance)
    found = [(k, None, float(v)) for k, v in zip(("base", "home", "rho"), theta, strict=False)]
    found += [(k, n, float(theta[_GLOBAL + o + i])) for k, o in (("attack", 0), ("defence", teams)) for i, n in enumerate(names)]
    return spark.createDataFrame(found if teams else [], "kind string, team string, value double")
