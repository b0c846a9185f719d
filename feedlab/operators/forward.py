"""Walk-forward models: every cutoff has a model of strictly earlier rows, and all cutoffs are fitted in the same passes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch

#: Most numbers of all cutoffs' coefficients and curvatures together: they pass through the driver, rows don't.
MOST_CELLS = 20_000_000


@dataclass
class Fits:
    """Models by cutoff; ``terms`` are the intercept and a coefficient for each feature, in the features' own units (None: not fitted)."""

    cutoffs: list
    features: list[str]
    terms: list[list[float] | None]
    audit: list[tuple]
    passes: int

    def table(self, spark, cutoff_type: str) -> DataFrame:
        """(cutoff, train_rows, positives, last_train, usable, terms), one row a cutoff."""
        rows = [(c, *a, t is not None, t) for c, a, t in zip(self.cutoffs, self.audit, self.terms, strict=True)]
        return spark.createDataFrame(rows, f"cutoff {cutoff_type}, train_rows long, positives long, last_train {cutoff_type}, usable boolean, terms array<double>")


def _moments(rows: DataFrame, n_features: int, k: int) -> tuple[np.ndarray, ...]:
    """Rows, positives, means and variances of what each cutoff trains on, and the last date: one aggregate by interval of cutoffs, then running merges."""
    x = [f"x{i}" for i in range(n_features)]
    got = {r["at"]: r for r in rows.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), F.max("date").alias("last"), *[F.avg(c).alias(f"m_{c}") for c in x], *[F.var_pop(c).alias(f"v_{c}") for c in x]).collect()}  # a row a cutoff
    n, ones, last = np.zeros(k), np.zeros(k), [None] * k
    mean, square = np.zeros((k, n_features)), np.zeros((k, n_features))
    count, total, seen, m, s = 0.0, 0.0, None, np.zeros(n_features), np.zeros(n_features)
    for j in range(k):
        if r := got.get(j):
            own, sq = np.array([r[f"m_{c}"] for c in x], float), np.array([r[f"v_{c}"] for c in x], float) * r["n"]
            both = count + r["n"]
            s = s + sq + (own - m) ** 2 * count * r["n"] / both
            m = m + (own - m) * r["n"] / both
            count, total, seen = both, total + r["ones"], r["last"] if seen is None else max(seen, r["last"])
        n[j], ones[j], last[j], mean[j], square[j] = count, total, seen, m, s
    return n, ones, last, mean, np.sqrt(square / np.maximum(n, 1)[:, None])


def _gradients(rows: DataFrame, n_features: int, theta: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of every cutoff's log loss at its own coefficients: one pass over the rows.

    A task adds up what its rows give to each cutoff that trains on them; the sums of the tasks are added by Spark.
    """
    k, p = theta.shape
    pairs = [(a, b) for a in range(p) for b in range(a, p)]
    width = 1 + p + len(pairs)
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    step = max(1, 2_000_000 // k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, width))
        for batch in batches:
            whole = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(n_features)]) - center if n_features else np.zeros((batch.num_rows, 0))
            ys, ats = batch.column("y").to_numpy(zero_copy_only=False).astype(float), batch.column("at").to_numpy(zero_copy_only=False)
            for start in range(0, len(ys), step):
                x = np.column_stack([np.ones(len(ys[start : start + step])), whole[start : start + step]])
                y, at = ys[start : start + step, None], ats[start : start + step, None]
                on = at <= np.arange(k)[None, :]
                z = x @ theta.T
                prob = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                sums[:, 0] += np.where(on, np.logaddexp(0, z) - y * z, 0).sum(0)
                sums[:, 1 : 1 + p] += np.where(on, prob - y, 0).T @ x
                sums[:, 1 + p :] += np.where(on, prob * (1 - prob), 0).T @ (x[:, left] * x[:, right])
        full = np.flatnonzero(sums.ravel())
        for start in range(0, len(full), 100_000):
            part = full[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(sums.ravel()[part])], ["cell", "value"])

    got = rows.select("at", "y", *[f"x{i}" for i in range(n_features)]).mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    sums = np.zeros(k * width)
    sums[got["cell"].to_numpy()] = got["value"].to_numpy()
    sums = sums.reshape(k, width)
    curve = np.zeros((k, p, p))
    for i, (a, b) in enumerate(pairs):
        curve[:, a, b] = curve[:, b, a] = sums[:, 1 + p + i]
    return sums[:, 0], sums[:, 1 : 1 + p], curve


def fit_cutoffs(rows: DataFrame, cutoffs: list, date: str, features: list[str], target: str, least: int, l2: float = 1.0, scaled: bool = True, tolerance: float = 1e-10, most_passes: int = 60) -> Fits:
    """A logistic regression for each cutoff, of the rows dated strictly before it, with penalty l2/2 on the squared coefficients.

    Features are scaled by the mean and deviation of the cutoff's own training rows (with ``scaled``); the intercept is
    not penalised. All cutoffs take their Newton steps together, halved where the loss would rise. Rows with a null
    target, date or feature don't train. A cutoff with fewer than ``least`` rows, or of one class, has no model.
    """
    cutoffs, f = sorted(cutoffs), len(features)
    k, p = len(cutoffs), len(features) + 1
    if k * (1 + p + p * (p + 1) // 2) > MOST_CELLS:
        raise ValueError(f"{k} cutoffs of {f} features are more than {MOST_CELLS} numbers")
    if not k:
        return Fits([], features, [], [], 0)
    train = rows.where(F.col(date).isNotNull() & F.col(target).isNotNull()).select(_interval(cutoffs, F.col(date)).alias("at"), F.col(date).alias("date"), F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    with scratch(rows.sparkSession, "forward") as keep:
        train = keep(train.dropna().where(F.col("at") < k), "train")
        n, ones, last, mean, dev = _moments(train, f, k)
        usable = (n >= least) & (ones > 0) & (ones < n)
        center = mean[-1]
        scale = np.where(dev > 0, dev, 1.0) if scaled else np.ones_like(dev)
        shift = (mean if scaled else np.zeros_like(mean)) - center
        # z = A (1, x - center): what the penalty sees, from what the rows have
        a = np.zeros((k, p, p))
        a[:, 0, 0] = 1
        for i in range(f):
            a[:, 1 + i, 1 + i] = 1 / scale[:, i]
            a[:, 1 + i, 0] = -shift[:, i] / scale[:, i]
        w, before, loss = np.zeros((k, p)), np.zeros((k, p)), np.full(k, np.inf)
        done, passes = ~usable, 0
        weight = np.r_[0.0, np.full(f, l2)]
        while not done.all() and passes < most_passes:
            passes += 1
            value, grad, curve = _gradients(train, f, np.einsum("kj,kji->ki", w, a), center)
            value = value + 0.5 * (weight * w**2).sum(1)
            worse = ~done & (value > loss + 1e-9 * np.abs(value))
            grad, curve = np.einsum("kij,kj->ki", a, grad) + weight * w, np.einsum("kij,kjl,kml->kim", a, curve, a) + np.diag(weight)
            curve[done | worse] = np.eye(p)
            step = np.linalg.solve(curve + 1e-12 * np.eye(p), grad[:, :, None])[:, :, 0]
            good = ~done & ~worse
            before[good], loss[good] = w[good], value[good]
            w[good] -= step[good]
            w[worse] = (w[worse] + before[worse]) / 2
            done |= good & (np.abs(step).max(1) < tolerance)
    raw = np.einsum("kj,kji->ki", w, a)
    raw[:, 0] -= raw[:, 1:] @ center
    terms = [list(map(float, raw[j])) if usable[j] else None for j in range(k)]
    return Fits(cutoffs, features, terms, [(int(n[j]), int(ones[j]), last[j]) for j in range(k)], passes)


def _interval(cutoffs: list, date: Column) -> Column:
    """How many cutoffs are not after the date, by halving: nested conditions as deep as the logarithm of their number."""

    def half(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(date >= F.lit(cutoffs[middle]), half(middle + 1, high)).otherwise(half(low, middle))

    return half(0, len(cutoffs))


def walk_forward(rows: DataFrame, cutoff: str, date: str, features: list[str], target: str, least: int, **options) -> tuple[DataFrame, DataFrame]:
    """(rows with ``p``, audit of the cutoffs): each row is scored by its cutoff's model, which knows strictly earlier dates only.

    ``p`` is null where the cutoff has no model or a feature is null. The audit has train_rows, positives, last_train and
    usable by cutoff.
    """
    kind = dict(rows.dtypes)[cutoff]
    cutoffs = [r[0] for r in rows.where(F.col(cutoff).isNotNull()).select(cutoff).distinct().limit(MOST_CELLS).collect()]
    models = fit_cutoffs(rows, cutoffs, date, features, target, least, **options).table(rows.sparkSession, kind)
    linear = sum((F.get("_terms", F.lit(i + 1)) * F.col(c).cast("double") for i, c in enumerate(features)), F.get("_terms", F.lit(0)))
    out = rows.join(F.broadcast(models.select(F.col("cutoff").alias("_cutoff"), F.col("terms").alias("_terms"))), F.col(cutoff) == F.col("_cutoff"), "left")
    return out.withColumn("p", 1 / (1 + F.exp(-linear))).drop("_cutoff", "_terms"), models.drop("terms")


def pit_prior(games: DataFrame, game: str, date: str, line: str, won: str, least: int, l2: float = 1.0, rounds: int = 12) -> DataFrame:
    """(game, date, prior_games, last_prior, prior): each game's win probability from its line, by a regression on strictly earlier dates.

    ``won`` is 1, 0 or null (a tie, which is left out). The games before a date are summed by distinct line, and running
    sums over the dates, apart for each line, give all that its logistic regression (intercept free, slope with penalty
    l2/2) needs: Newton steps in column expressions, a date a row. ``prior`` is null before ``least`` games, before both
    outcomes were seen, and for null lines; a game that is listed twice counts once.
    """
    rows = games.select(F.col(game).alias("game"), F.col(date).alias("date"), F.col(line).cast("double").alias("x"), F.col(won).cast("double").alias("y")).distinct()
    sums = rows.where("y IS NOT NULL AND x IS NOT NULL AND date IS NOT NULL").groupBy("x", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("w"))
    # each line's sums change where it has games: those of a date are the last before it, found on one timeline a line
    dates = rows.where("date IS NOT NULL").select("date").distinct()
    lines = sums.groupBy("x").agg(F.min("date").alias("since"))
    grid = lines.join(F.broadcast(dates.groupBy().agg(F.sort_array(F.collect_set("date")).alias("all"))), F.lit(True)).select("x", F.explode(F.filter("all", lambda d: d > F.col("since"))).alias("date"))
    steps = grid.withColumn("asked", F.lit(True)).unionByName(sums, allowMissingColumns=True).groupBy("x", "date").agg(F.max("asked").alias("asked"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    before = Window.partitionBy("x").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    known = steps.select("x", "date", "asked", F.sum("n").over(before).alias("n"), F.sum("w").over(before).alias("w"), F.max(F.when(F.col("n") > 0, F.col("date"))).over(before).alias("last")).where("asked")
    by_date = known.groupBy("date").agg(F.sum("n").alias("prior_games"), F.sum("w").alias("wins"), F.max("last").alias("last_prior"), F.max(F.abs("x")).alias("reach"), F.sort_array(F.collect_list(F.struct("x", "n", "w"))).alias("s"))
    fits = by_date.withColumn("fit", F.when((F.col("prior_games") >= least) & (F.col("wins") > 0) & (F.col("wins") < F.col("prior_games")), _newton(F.col("s"), F.col("reach"), l2, rounds)))
    out = rows.join(fits.select("date", "prior_games", "last_prior", "fit"), "date", "left")
    prior = 1 / (1 + F.exp(-(F.col("fit.a") + F.col("fit.b") * F.col("x"))))
    return out.select(F.col("game").alias(game), F.col("date").alias(date), F.coalesce("prior_games", F.lit(0)).alias("prior_games"), "last_prior", prior.alias("prior"))


#: Longest change of a log odds in one Newton step of ``pit_prior``.
LONGEST_STEP = 5.0


def _newton(stats: Column, reach: Column, l2: float, rounds: int) -> Column:
    """(a, b) of the regression on summed rows (x, n, w): Newton steps, none of which moves a log odds by more than LONGEST_STEP."""
    zero = F.lit(0.0)

    def step(state: Column, _: Column) -> Column:
        def add(t: Column, s: Column) -> Column:
            p = 1 / (1 + F.exp(-(state["a"] + state["b"] * s["x"])))
            r, v = s["n"] * p - s["w"], s["n"] * p * (1 - p)
            return F.struct((t["g"] + r).alias("g"), (t["h"] + r * s["x"]).alias("h"), (t["u"] + v).alias("u"), (t["v"] + v * s["x"]).alias("v"), (t["w"] + v * s["x"] * s["x"]).alias("w"))

        def move(t: Column) -> Column:
            g, h, u, v, w = t["g"], t["h"] + l2 * state["b"], t["u"], t["v"], t["w"] + l2
            det = u * w - v * v
            da, db = (w * g - v * h) / det, (u * h - v * g) / det
            cut = F.least(F.lit(1.0), F.lit(LONGEST_STEP) / F.greatest(F.abs(da) + F.abs(db) * reach, F.lit(1e-12)))
            return F.struct((state["a"] - cut * da).alias("a"), (state["b"] - cut * db).alias("b"))

        return F.aggregate(stats, F.struct(*[zero.alias(c) for c in "ghuvw"]), add, move)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(zero.alias("a"), zero.alias("b")), step)
