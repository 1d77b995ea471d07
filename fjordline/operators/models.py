"""Classifiers over the direction panel.

Many small fits (one a fold) run as grouped maps with a short Newton solver, tree ensembles and tuned windows in ``grid``; fits over a whole panel use Spark ML. Kernel machines and
networks of other libraries have stand-ins here (random features with a linear machine, a perceptron): they are approximations and carry names of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTION = "fold long, model string, instrument string, dt date, y int, forward_r double, p0 double, p1 double, pred int"


def balanced(y: np.ndarray) -> np.ndarray:
    n = np.bincount(y, minlength=2).astype(float)
    return len(y) / (np.count_nonzero(n) * n[y])


def prepare(train: np.ndarray, rest: np.ndarray, variance: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Training medians, population scaling and, with ``variance``, the leading components that keep that share."""
    with np.errstate(all="ignore"):
        known = ~np.isnan(train).all(0)
    train, rest = train[:, known], rest[:, known]
    med = np.nanmedian(train, 0)
    train, rest = np.where(np.isnan(train), med, train), np.where(np.isnan(rest), med, rest)
    mu, sd = train.mean(0), train.std(0)
    sd[sd == 0] = 1
    train, rest = (train - mu) / sd, (rest - mu) / sd
    if variance is None:
        return train, rest
    _, s, v = np.linalg.svd(train, full_matrices=False)
    share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
    k = int(np.searchsorted(share, variance - 1e-12)) + 1
    v = v[:k] * np.sign(np.take_along_axis(v[:k], np.abs(v[:k]).argmax(1)[:, None], 1))
    return train @ v.T, rest @ v.T


def components(train: np.ndarray, rest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Imputed and scaled columns turned into min(k, columns, rows - 2) principal components, scaled again, and the share of variance they keep."""
    train, rest = prepare(train, rest)
    _, s, v = np.linalg.svd(train, full_matrices=False)
    k = max(1, min(k, train.shape[1], max(1, len(train) - 2), len(s)))
    v = v[:k] * np.sign(np.take_along_axis(v[:k], np.abs(v[:k]).argmax(1)[:, None], 1))
    share = float((s[:k] ** 2).sum() / max((s**2).sum(), 1e-300))
    a, b = train @ v.T, rest @ v.T
    sd = a.std(0)
    sd[sd == 0] = 1
    return a / sd, b / sd, share


def few_components(rows: int, columns: int) -> int:
    """Components for the unpenalised models where no global reduction is on."""
    return min(40, columns, max(8, rows // 4))


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Newton for 0.5 |w|^2 + C sum(weight * loss), intercept free, balanced weights."""
    x, weight = np.hstack([np.ones((len(x), 1)), x]), c * balanced(y)
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1])
    keep[0, 0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + keep, x.T @ (weight * (p - y)) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -35, 35)))


def unpenalised(x: np.ndarray, y: np.ndarray, link: str = "logit", rounds: int = 100) -> tuple[np.ndarray, float]:
    """(coefficients with the intercept first, McFadden's pseudo R2) of a binary model by Fisher scoring; ``link`` is logit or probit."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p, slope = _linked(x @ w, link)
        weight = slope**2 / (p * (1 - p))
        step = np.linalg.lstsq(x.T @ (x * weight[:, None]) + 1e-9 * np.eye(x.shape[1]), x.T @ (slope * (y - p) / (p * (1 - p))), rcond=None)[0]
        w += step
        if np.abs(step).max() < 1e-9 or np.abs(w).max() > 1e3:
            break
    p, base = _linked(x @ w, link)[0], np.clip(y.mean(), 1e-12, 1 - 1e-12)
    ll = lambda q: float((y * np.log(q) + (1 - y) * np.log(1 - q)).sum())
    return w, 1 - ll(p) / ll(np.full(len(y), base))


def _linked(z: np.ndarray, link: str) -> tuple[np.ndarray, np.ndarray]:
    """(probability, its slope) at the linear predictor."""
    if link == "probit":
        z = np.clip(z, -7, 7)
        p = np.array([0.5 * math.erfc(-t / math.sqrt(2)) for t in z])
        return np.clip(p, 1e-12, 1 - 1e-12), np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return np.clip(p, 1e-12, 1 - 1e-12), p * (1 - p)


def _by_logistic(a, y, b, k):
    x, z, share = components(a, b, k)
    return chance(z, logistic(x, y)), {"explained_variance": share, "k": float(x.shape[1])}


def _by_link(link: str):
    def fit(a, y, b, k):
        x, z, share = components(a, b, k or few_components(*a.shape))
        w, pseudo = unpenalised(x, y, link)
        return _linked(np.hstack([np.ones((len(z), 1)), z]) @ w, link)[0], {"pseudo_r2": pseudo, "explained_variance": share, "k": float(x.shape[1])}

    return fit


def _by_variance(a, y, b, k):
    x, z = prepare(a, b, 0.95)
    return chance(z, logistic(x, y)), {"k": float(x.shape[1])}


#: Small models that are fitted once a group, by name: (training columns, labels, test columns, components of a global reduction or 0) to (p1, figures).
FITS = {"Global PCA + logistic": lambda a, y, b, k: _by_logistic(a, y, b, k or a.shape[1]), "PCA + logistic": _by_variance, "Logit": _by_link("logit"), "Probit": _by_link("probit")}
#: Models that forecast class 1 at a probability of exactly one half.
HALF_IS_UP = ("Logit", "Probit")
FITTED = PREDICTION + ", is_test boolean, status string, figures map<string,double>"


def included(names: list[str] | None) -> list[str]:
    """The models of ``FITS`` that are asked for: all of them for none, else those whose names are listed, blanks around them aside."""
    wanted = {n.strip() for n in names or () if n and n.strip()}
    return [n for n in FITS if not wanted or n in wanted]


def fit_models(rows: DataFrame, features: list[str], names: list[str] | None = None, k: int = 0, keys: tuple[str, ...] = ("instrument", "fold")) -> DataFrame:
    """Predictions of every included model for training and test rows of each group, with a status: a group that can't be fitted, or no model by these names, gives one row that says so."""
    chosen = included(names)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["is_test", "dt"])
        train, first = pdf[~pdf.is_test], pdf.iloc[[0]]
        out = []
        say = lambda model, status: out.append(pd.DataFrame({"fold": first.fold, "model": model, "instrument": first.instrument, "status": status}))
        if not chosen:
            say(None, "No models (check models_include)")
        for name in chosen:
            if train.y.nunique() < 2 or len(train) == len(pdf):
                say(name, "one class or no test rows")
                continue
            try:
                p, figures = FITS[name](train[features].to_numpy(float), train.y.to_numpy(float if name in HALF_IS_UP else int), pdf[features].to_numpy(float), k)
            except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
                say(name, f"{type(e).__name__}: {e}")
                continue
            made = pdf[["fold", "instrument", "dt", "y", "forward_r", "is_test"]].assign(model=name, p0=1 - p, p1=p, pred=(p >= 0.5 if name in HALF_IS_UP else p > 0.5).astype(int), status="ok")
            out.append(made.assign(figures=[figures] * len(made)))
        made = pd.concat(out).reindex(columns=[c.split()[0] for c in FITTED.replace("map<string,double>", "map").split(", ")]).astype(object)
        return made.where(made.notna(), None)

    return rows.select("instrument", "fold", "is_test", "dt", "y", "forward_r", *features).groupBy(*keys).applyInPandas(work, FITTED)


def fit_folds(rows: DataFrame, features: list[str], name: str, c: float = 1.0, variance: float | None = None, keys: tuple[str, ...] = ("instrument", "fold")) -> DataFrame:
    """One logistic fit a (instrument, fold) of walk-forward rows; folds whose training labels have one class give no rows."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        train, test = pdf[~pdf.is_test], pdf[pdf.is_test]
        if train.y.nunique() < 2 or test.empty:
            return pd.DataFrame(columns=["fold", "model", "instrument", "dt", "y", "forward_r", "p0", "p1", "pred"])
        a, b = prepare(train[features].to_numpy(float), test[features].to_numpy(float), variance)
        p = chance(b, logistic(a, train.y.to_numpy(int), c))
        return pd.DataFrame({"fold": test.fold, "model": name, "instrument": test.instrument, "dt": test.dt, "y": test.y, "forward_r": test.forward_r, "p0": 1 - p, "p1": p, "pred": (p > 0.5).astype(int)})

    return rows.select("instrument", "fold", "is_test", "dt", "y", "forward_r", *features).groupBy(*keys).applyInPandas(work, PREDICTION)


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def weighted(train: DataFrame) -> DataFrame:
    """Balanced class weights as a column, from one aggregation."""
    n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    total = sum(n.values())
    value = F.lit(1.0)
    for y, k in n.items():
        value = F.when(F.col("y") == y, total / (len(n) * k)).otherwise(value)
    return train.withColumn("weight", value)


#: Published sizes of the larger models.
FULL = {"trees": 300, "depth": 12, "rounds": 200, "fine_depth": 6, "layers": (128, 64), "epochs": 400}


def fit_panel(train: DataFrame, test: DataFrame, features: list[str], kind: str, seed: int = 42, size: dict | None = None) -> DataFrame:
    """Fit one Spark ML classifier on ``train`` and predict ``test`` (binary labels ``y``); ``size`` is ``FULL`` or less."""
    size = {**FULL, **(size or {})}
    train, test = weighted(_vectors(train, features)), _vectors(test, features)
    common = {"labelCol": "y", "featuresCol": "features"}
    if kind == "logit":
        model = LogisticRegression(regParam=0.0, maxIter=100, **common).fit(train)
    elif kind == "logistic_balanced":
        n = train.count()
        model = LogisticRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=100, **common).fit(train)
    elif kind == "random_forest":
        model = RandomForestClassifier(numTrees=size["trees"], maxDepth=size["depth"], seed=seed, weightCol="weight", **common).fit(train)
    elif kind == "boosted_trees":
        model = GBTClassifier(maxIter=size["rounds"], maxDepth=3, seed=seed, weightCol="weight", **common).fit(train)
    elif kind == "boosted_trees_fine":
        model = GBTClassifier(maxIter=size["rounds"], maxDepth=size["fine_depth"], maxBins=255, stepSize=0.1, seed=seed, weightCol="weight", **common).fit(train)
    elif kind == "perceptron":
        model = MultilayerPerceptronClassifier(layers=[len(features), *size["layers"], 2], maxIter=size["epochs"], seed=seed, **common).fit(train)
    elif kind == "probit":
        model = GeneralizedLinearRegression(family="binomial", link="probit", maxIter=100, **common).fit(train)
        out = model.transform(test).withColumn("p1", F.col("prediction"))
        return out.select("instrument", "dt", "y", (1 - F.col("p1")).alias("p0"), "p1", (F.col("p1") >= 0.5).cast("int").alias("pred"))
    else:
        raise ValueError(f"unknown model {kind!r}")
    out = model.transform(test).withColumn("p", vector_to_array("probability"))
    return out.select("instrument", "dt", "y", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"), F.col("prediction").cast("int").alias("pred"))


def random_features(df: DataFrame, features: list[str], count: int = 64, gamma: float = 0.5, seed: int = 42) -> DataFrame:
    """Append ``features``: random Fourier features of a radial kernel over the given columns, computed in Arrow batches."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (len(features), count)), rng.uniform(0, 2 * np.pi, count)

    @F.pandas_udf("array<double>")
    def turn(x: pd.Series) -> pd.Series:
        z = np.array(x.tolist(), float).reshape(-1, len(features))
        return pd.Series(list(np.sqrt(2 / count) * np.cos(z @ w + b)))

    return df.withColumn("features", array_to_vector(turn(F.array(*(F.col(f).cast("double") for f in features)))))


def fit_radial_machine(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """Approximates a radial-kernel machine: random features, a linear machine, and a logistic curve over its margin."""
    stats = train.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features)).first()
    scaled = lambda df: df.withColumns({f: (F.col(f) - float(stats[f"m_{f}"] or 0)) / float(stats[f"s_{f}"] or 1) for f in features})
    a, b = weighted(random_features(scaled(train), features)), random_features(scaled(test), features)
    model = LinearSVC(labelCol="y", featuresCol="features", weightCol="weight", regParam=0.01, maxIter=60).fit(a)
    curve = VectorAssembler(inputCols=["margin"], outputCol="mv")
    margins = lambda df: curve.transform(model.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("prediction", "rawPrediction"))
    platt = LogisticRegression(labelCol="y", featuresCol="mv").fit(margins(a))
    out = platt.transform(margins(b)).withColumn("p", vector_to_array("probability"))
    return out.select("instrument", "dt", "y", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"), F.col("prediction").cast("int").alias("pred"))
