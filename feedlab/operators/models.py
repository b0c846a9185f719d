"""Model steps as Spark jobs: logistic, boosted, multinomial and Poisson fits, temperature. Walk-forward runs are in ``forward``."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_outcome(train: DataFrame, features: list[str], target: str, boosted: bool = False) -> PipelineModel:
    """Scaled logistic regression, or boosted trees, of a 0/1 target."""
    last = GBTClassifier(featuresCol="_x", labelCol=target, maxIter=20, seed=7) if boosted else LogisticRegression(featuresCol="_x", labelCol=target, regParam=0.01)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), last]).fit(train)


def score_frame(df: DataFrame, model: PipelineModel, key: str) -> DataFrame:
    """(key, p): probability of class 1 of each row."""
    return model.transform(df).select(key, F.get(vector_to_array("probability"), 1).alias("p"))


def fit_classes(train: DataFrame, features: list[str], target: str, key: str, rows: DataFrame) -> DataFrame:
    """(key, probabilities by class name) of ``rows``: multinomial logistic regression, fitted on ``train`` alone."""
    index = StringIndexer(inputCol=target, outputCol="_t", stringOrderType="alphabetAsc").fit(train)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_t", family="multinomial", regParam=0.01)]).fit(index.transform(train))
    names = F.array(*[F.lit(x) for x in index.labels])
    return model.transform(rows).select(key, F.map_from_arrays(names, vector_to_array("probability")).alias("probabilities"))


def fit_poisson_offset(rows: DataFrame, target: str, features: list[str], offset: str, l2: float) -> DataFrame:
    """(term, coefficient) of a Poisson regression with log offset and L2 penalty; ValueError where features depend on each other and nothing is penalised."""
    if l2 == 0:
        cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
        sums = rows.agg(*[F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]]).first()  # a row of the features' products
        gram, it = np.zeros((len(cols), len(cols))), iter(sums)
        for i in range(len(cols)):
            for j in range(i, len(cols)):
                gram[i, j] = gram[j, i] = next(it) or 0.0
        scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
        if np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-9) < len(cols):
            raise ValueError("the rank of the features is lower than their number")
    x = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
    m = GeneralizedLinearRegression(family="poisson", featuresCol="_x", labelCol=target, offsetCol=offset, regParam=l2).fit(x)
    found = [("intercept", float(m.intercept)), *zip(features, map(float, m.coefficients), strict=True)]
    return rows.sparkSession.createDataFrame(found, "term string, coefficient double")


def fit_team_strengths(rows: DataFrame, team: str, opponent: str, home: str, goals: str, l2: float = 0.1) -> DataFrame:
    """(kind, team, rate): attack and defence of each team and the home advantage, by a Poisson regression on long rows."""
    t, o = StringIndexer(inputCol=team, outputCol="_ti", stringOrderType="alphabetAsc").fit(rows), StringIndexer(inputCol=opponent, outputCol="_oi", stringOrderType="alphabetAsc").fit(rows)
    x = o.transform(t.transform(rows))
    x = OneHotEncoder(inputCols=["_ti", "_oi"], outputCols=["_tv", "_ov"], dropLast=False).fit(x).transform(x)
    x = VectorAssembler(inputCols=["_tv", "_ov", home], outputCol="_x").transform(x)
    m = GeneralizedLinearRegression(family="poisson", featuresCol="_x", labelCol=goals, regParam=l2).fit(x)
    c = list(map(float, m.coefficients))
    found = [("attack", n, v) for n, v in zip(t.labels, c, strict=False)] + [("defence", n, v) for n, v in zip(o.labels, c[len(t.labels) :], strict=False)] + [("home", None, c[-1])]
    return rows.sparkSession.createDataFrame(found, "kind string, team string, rate double")


def temperature_losses(rows: DataFrame, target: str, probs: str, cluster: str, grid: list[float]) -> DataFrame:
    """(t, loss): log loss of the observed class after scaling by each temperature, clusters weighted alike. ``target`` is an index."""
    from ..functions.probability import temperature_scale

    each = rows.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    loss = -F.log(F.get(temperature_scale(F.col(probs), F.col("t")), F.col(target)))
    return each.groupBy("t", cluster).agg(F.avg(loss).alias("l")).groupBy("t").agg(F.round(F.avg("l"), 6).alias("loss"))


def fit_temperature(rows: DataFrame, target: str, probs: str, cluster: str, low: float = 0.1, high: float = 10.0, points: int = 15, rounds: int = 3) -> float:
    """Temperature of least loss: a grid, narrowed around its best point ``rounds`` times."""
    best = 1.0
    for _ in range(rounds):
        grid = [low * (high / low) ** (i / (points - 1)) for i in range(points)]
        got = temperature_losses(rows, target, probs, cluster, grid).orderBy("loss", "t").first()
        if got is None:
            break
        best = got["t"]
        step = (high / low) ** (1 / (points - 1))
        low, high = best / step, best * step
    return best

