"""Walk-forward models against one plain fit for each cutoff or date."""

import datetime as dt

import numpy as np
import pytest

from feedlab.operators import forward

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def plain_fit(x, y, l2=1.0, scaled=True):
    """Intercept and coefficients for raw features, by long Newton iteration with step halving."""
    m, s = (x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)) if scaled else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack([np.ones(len(x)), (x - m) / s])
    pen = np.r_[0.0, np.full(x.shape[1], l2)]
    loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + 0.5 * (pen * w * w).sum()
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        d = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (p - y) + pen * w)
        t = 1.0
        while loss(w - t * d) > loss(w) + 1e-12 and t > 1e-6:
            t /= 2
        w = w - t * d
    return np.r_[w[0] - (w[1:] / s) @ m, w[1:] / s]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = 400
    x = np.column_stack([rng.normal(1e6, 5, n), rng.normal(0, 0.01, n), np.full(n, 3.0)])
    y = rng.random(n) < 1 / (1 + np.exp(-((x[:, 0] - 1e6) / 2 + 80 * x[:, 1])))
    out = [(i, day(int(d)), day(int(d) // 10 * 10), *map(float, x[i]), None if i % 17 == 0 else int(y[i])) for i, d in enumerate(rng.integers(0, 60, n))]
    return [*out, (1000, day(55), day(50), None, 0.0, 3.0, 1), (1001, None, day(50), 1e6, 0.0, 3.0, 1), (1002, day(5), None, 1e6, 0.0, 3.0, None)]


SCHEMA = "id long, date date, cutoff date, a double, b double, c double, y int"


def test_all_cutoffs_equal_single_fits(spark, rows):
    scored, audit = forward.walk_forward(spark.createDataFrame(rows, SCHEMA), "cutoff", "date", ["a", "b", "c"], "y", 40)
    got, told = {r["id"]: r["p"] for r in scored.collect()}, {r["cutoff"]: r for r in audit.collect()}
    assert len(got) == len(rows) and set(told) == {day(10 * i) for i in range(6)}
    for cutoff, note in told.items():
        train = [r for r in rows if r[1] is not None and r[1] < cutoff and r[6] is not None and None not in r[3:6]]
        assert (note["train_rows"], note["last_train"]) == (len(train), max((r[1] for r in train), default=None))
        assert note["usable"] == (len(train) >= 40)
        for r in (r for r in rows if r[2] == cutoff):
            if not note["usable"] or None in r[3:6]:
                assert got[r[0]] is None
                continue
            w = plain_fit(np.array([t[3:6] for t in train]), np.array([t[6] for t in train]))
            assert got[r[0]] == pytest.approx(1 / (1 + np.exp(-(w[0] + w[1:] @ np.array(r[3:6])))), abs=1e-6)
            break
    assert got[1002] is None


def test_later_rows_change_nothing_earlier(spark, rows):
    def scores(data):
        return {r["id"]: r["p"] for r in forward.walk_forward(spark.createDataFrame(data, SCHEMA), "cutoff", "date", ["a", "b"], "y", 40)[0].collect()}

    flipped = [(*r[:6], 1 - r[6]) if r[1] is not None and r[1] >= day(30) and r[6] is not None else r for r in rows]
    before, after = scores(rows), scores(flipped)
    early = [r[0] for r in rows if r[2] is not None and r[2] <= day(30)]
    assert all(before[i] == pytest.approx(after[i], abs=1e-9) for i in early if before[i] is not None)
    assert any(abs(before[r[0]] - after[r[0]]) > 1e-3 for r in rows if r[2] == day(50) and before[r[0]] is not None)


def test_separable_rows_and_many_cutoffs(spark):
    data = [(i, day(i), day(i), float(i % 7), 0.0, 0.0, int(i % 7 > 3)) for i in range(150)]
    fits = forward.fit_cutoffs(spark.createDataFrame(data, SCHEMA), [day(i) for i in range(151)], "date", ["a"], "y", 30, scaled=False)
    assert [t is not None for t in fits.terms] == [i >= 30 for i in range(151)]
    for j in (30, 77, 150):
        w = plain_fit(np.array([[r[3]] for r in data[:j]]), np.array([r[6] for r in data[:j]]), scaled=False)
        assert np.allclose(fits.terms[j], w, atol=1e-6)


def test_no_rows_and_too_many_numbers(spark, monkeypatch):
    none = spark.createDataFrame([], SCHEMA)
    scored, audit = forward.walk_forward(none, "cutoff", "date", ["a"], "y", 1)
    assert scored.count() == 0 and audit.count() == 0
    monkeypatch.setattr(forward, "MOST_CELLS", 10)
    with pytest.raises(ValueError, match="numbers"):
        forward.fit_cutoffs(none, [day(i) for i in range(9)], "date", ["a"], "y", 1)


def test_pit_prior_equals_single_fits(spark):
    rng = np.random.default_rng(2)
    n = 160
    games = [(i, day(int(d)), float(x), None if i % 13 == 0 else int(rng.random() < 1 / (1 + np.exp(-x / 3)))) for i, (d, x) in enumerate(zip(rng.integers(0, 40, n), rng.integers(-14, 15, n) / 2, strict=True))]
    games += [(900, day(20), None, 1), (901, None, 1.0, 1), games[3]]  # no line, no date, listed twice
    got = {r["game"]: r for r in forward.pit_prior(spark.createDataFrame(games, "game long, date date, line double, won int"), "game", "date", "line", "won", 25).collect()}
    assert len(got) == n + 2
    for g, d, x, _ in games:
        train = [] if d is None else [r for r in dict((r[0], r) for r in games).values() if r[1] is not None and r[1] < d and r[2] is not None and r[3] is not None]
        assert got[g]["prior_games"] == len(train) and got[g]["last_prior"] == max((r[1] for r in train), default=None)
        if len(train) < 25 or len({r[3] for r in train}) < 2 or x is None:
            assert got[g]["prior"] is None
        else:
            w = plain_fit(np.array([[r[2]] for r in train]), np.array([r[3] for r in train]), scaled=False)
            assert got[g]["prior"] == pytest.approx(1 / (1 + np.exp(-(w[0] + w[1] * x))), abs=1e-8)


def test_pit_prior_waits_for_both_outcomes(spark):
    games = [(i, day(i), 1.0, 1 if i < 5 else 0) for i in range(8)]
    got = {r["game"]: r["prior"] for r in forward.pit_prior(spark.createDataFrame(games, "game long, date date, line double, won int"), "game", "date", "line", "won", 2).collect()}
    assert [got[i] is None for i in range(8)] == [True] * 6 + [False] * 2
