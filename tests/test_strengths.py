"""Strengths of teams: the gradient, and planted values that are found again."""

import numpy as np
import pytest

from feedlab.operators import strengths


def planted(seed, teams, n, rho=-0.12):
    rng = np.random.default_rng(seed)
    theta = np.r_[0.1, 0.3, rho, rng.normal(0, 0.25, teams), rng.normal(0, 0.25, teams)]
    attack, defence = theta[3 : 3 + teams], theta[3 + teams :]
    out = []
    while len(out) < n:
        h, a = rng.choice(teams, 2, replace=False)
        lam, mu = np.exp(theta[0] + theta[1] + attack[h] - defence[a]), np.exp(theta[0] + attack[a] - defence[h])
        x, y = rng.poisson(lam), rng.poisson(mu)
        tau = {(0, 0): 1 - lam * mu * rho, (0, 1): 1 + lam * rho, (1, 0): 1 + mu * rho, (1, 1): 1 - rho}.get((x, y), 1.0)
        if rng.random() < tau / 1.6:
            out.append((int(h), int(a), int(x), int(y)))
    return theta, out


def test_gradient_equals_differences():
    theta, rows = planted(1, 5, 300)
    h, a, x, y = (np.array(c) for c in zip(*rows, strict=True))
    args = (5, h, a, x.astype(float), y.astype(float), np.linspace(0.5, 1.5, 300))
    _, slope = strengths.score_gradient(theta, *args)
    for i in range(len(theta)):
        up, down = theta.copy(), theta.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert slope[i] == pytest.approx((strengths.score_gradient(up, *args)[0] - strengths.score_gradient(down, *args)[0]) / 2e-6, rel=1e-4, abs=1e-4)
    theta[2] = 5.0
    assert strengths.score_gradient(theta, *args)[0] == np.inf


def test_minimise_finds_the_bottom_of_a_valley():
    def rosenbrock(v):
        x, y = v
        return (1 - x) ** 2 + 100 * (y - x * x) ** 2, np.array([-2 * (1 - x) - 400 * x * (y - x * x), 200 * (y - x * x)])

    at, calls = strengths.minimise(rosenbrock, np.array([-1.2, 1.0]), tolerance=1e-9)
    assert np.allclose(at, 1, atol=1e-6) and calls < 150


def test_planted_strengths_are_found(spark):
    theta, rows = planted(7, 8, 6000)
    df = spark.createDataFrame([(f"t{h}", f"t{a}", x, y) for h, a, x, y in rows] + [(None, "t1", 1, 1), ("t1", "t2", None, 0)], "h string, a string, x int, y int")
    got = {(r["kind"], r["team"]): r["value"] for r in strengths.fit_strengths(df, "h", "a", "x", "y", l2=0.1).collect()}
    assert len(got) == 19
    centre = lambda v: v - v.mean()
    attack = np.array([got["attack", f"t{i}"] for i in range(8)])
    defence = np.array([got["defence", f"t{i}"] for i in range(8)])
    assert np.abs(centre(attack) - centre(theta[3:11])).max() < 0.09 and np.abs(centre(defence) - centre(theta[11:])).max() < 0.09
    assert got["rho", None] == pytest.approx(-0.12, abs=0.05) and got["home", None] == pytest.approx(0.3, abs=0.06)
    plain = {(r["kind"], r["team"]): r["value"] for r in strengths.fit_strengths(df.repartition(5), "h", "a", "x", "y", l2=0.1).collect()}
    assert all(abs(plain[k] - v) < 1e-4 for k, v in got.items())
    assert strengths.fit_strengths(df.where("false"), "h", "a", "x", "y").count() == 0
