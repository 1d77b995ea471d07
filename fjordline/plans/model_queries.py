"""Queries that fit models; their numbers depend on solvers, so they have no SQL twin and are tested by invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, features, folds, grid, metrics, models, moments, targets, tune
from ..operators.panel import by_instrument
from . import tables as T
from .panel_queries import r6
from .registry import query

FEATURES = ["ret1", "ret2", "ret3", "vol", "gap"]


def feature_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(instrument, dt, px, features): rows whose features are known, labelled or not."""
    w = by_instrument()
    df = features.realized_vol(features.pct_change(T.level(spark, sf), "px"), rows=20)
    df = df.withColumns({"ret1": F.col("ret"), "ret2": F.lag("ret", 1).over(w), "ret3": F.lag("ret", 2).over(w), "gap": F.col("px") / F.avg("px").over(w.rowsBetween(-19, 0)) - 1})
    return df.where("ret3 IS NOT NULL AND vol IS NOT NULL").select("instrument", "dt", "px", *FEATURES)


def panel(spark: SparkSession, sf: str, lead: int = 1, label=targets.binary_label) -> DataFrame:
    df = feature_panel(spark, sf)
    df = df.withColumn("forward_r", targets.forward_return(lead, "px")).withColumn("y", label(F.col("forward_r"))).where("y IS NOT NULL")
    return df.withColumn("rn", F.row_number().over(by_instrument()).cast("long") - 1).select("instrument", "dt", "rn", "px", "y", "forward_r", *FEATURES)


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df = folds.holdout(folds.with_size(panel(spark, sf)))
    return df.where("NOT is_test"), df.where("is_test")


def walk(spark: SparkSession, sf: str, spec: folds.FoldSpec) -> DataFrame:
    return folds.walk_forward(folds.with_size(panel(spark, sf)), spec)


def fold_windows(spark: SparkSession, sf: str, spec: folds.FoldSpec) -> DataFrame:
    rows = panel(spark, sf)
    return moments.window_moments(moments.running_sums(rows, FEATURES, ["instrument"]), moments.training_windows(rows, spec, ["instrument"]), ["instrument"])


PANEL = f"""{T.LEVEL}, p0 AS (SELECT *, (px / lag(px) OVER o - 1) * 100 AS ret FROM level WINDOW o AS (PARTITION BY instrument ORDER BY dt)),
p1 AS (SELECT instrument, dt, px, ret AS ret1, lag(ret) OVER o AS ret2, lag(ret, 2) OVER o AS ret3, CASE WHEN count(ret) OVER w >= 10 THEN stddev_samp(ret) OVER w END AS vol, px / avg(px) OVER w - 1 AS gap FROM p0
  WINDOW o AS (PARTITION BY instrument ORDER BY dt), w AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
p2 AS (SELECT *, lead(px) OVER (PARTITION BY instrument ORDER BY dt) / px - 1 AS forward_r FROM p1 WHERE ret3 IS NOT NULL AND vol IS NOT NULL),
panel AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY dt) - 1 AS rn, count(*) OVER (PARTITION BY instrument) AS n FROM p2 WHERE forward_r <> 0),
win AS (SELECT p.*, f.fold FROM panel p, range(0, 2000) f(fold) WHERE p.n >= 250 AND f.fold <= floor((p.n - 250) / 50) AND p.rn >= f.fold * 50 AND p.rn < f.fold * 50 + 200)"""
PAIRS = [(FEATURES[i], FEATURES[j]) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


@query("fold_moments", f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT instrument, fold, '{a}' AS a, '{b}' AS b, count(*) AS n, round(avg({a}), 6) AS mean_a, round(covar_pop({a}, {b}), 6) AS cov FROM win GROUP BY 1, 2" for a, b in PAIRS))
def fold_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Means and covariances of every fold's training rows as differences of running sums."""
    cov = F.expr("posexplode(cov)").alias("i", "cov")
    names = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(FEATURES.index(a)).alias("at")) for a, b in PAIRS))
    df = fold_windows(spark, sf, folds.FoldSpec()).select("instrument", "fold", "n", "mean", cov).withColumn("x", F.get(names, F.col("i")))
    return r6(df.select("instrument", "fold", "x.a", "x.b", "n", F.get("mean", F.col("x.at")).alias("mean_a"), "cov"), "mean_a", "cov")


@query("fold_components")
def fold_components(spark: SparkSession, sf: str) -> DataFrame:
    """How many principal components keep 95 % of each fold's variance, and what each keeps."""
    df = moments.components(fold_windows(spark, sf, folds.FoldSpec(step=5)))
    return df.select("instrument", "fold", "n", "k", F.transform("kept", lambda x: F.round(x, 6)).alias("kept"))


@query("fit_logistic_folds")
def fit_logistic_folds(spark: SparkSession, sf: str) -> DataFrame:
    return r6(models.fit_folds(walk(spark, sf, folds.FoldSpec()), FEATURES, "Logistic"), "p0", "p1", "forward_r")


@query("fit_logistic_pca_folds")
def fit_logistic_pca_folds(spark: SparkSession, sf: str) -> DataFrame:
    return r6(models.fit_folds(walk(spark, sf, folds.FoldSpec()), FEATURES, "PCA + logistic", variance=0.95), "p0", "p1", "forward_r")


def _fit(name: str, kind: str):
    @query(name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        train, test = halves(spark, sf)
        return r6(models.fit_panel(train, test, FEATURES, kind), "p0", "p1")

    return run


fit_logit = _fit("fit_logit", "logit")
fit_logistic_balanced = _fit("fit_logistic_balanced", "logistic_balanced")
fit_probit = _fit("fit_probit", "probit")


def _fit_halves(name: str, model: str):
    @query(name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """One fit an instrument at the published size, on the first half of its rows."""
        df = folds.holdout_as_fold(folds.with_size(panel(spark, sf)))
        made = grid.fit_classes(df, FEATURES, [model], ["instrument"])
        return r6(two_classes(made), "p0", "p1", "forward_r")

    return run


def two_classes(made: DataFrame) -> DataFrame:
    """Forecasts with arrays of probabilities as p0 and p1."""
    p = grid.of_classes("p", "labels", 2)
    return made.withColumns({"p0": F.get(p, 0), "p1": F.get(p, 1)}).drop("p", "labels")


fit_rf = _fit_halves("fit_rf", "Forest")
fit_gbt = _fit_halves("fit_gbt", "Boosted")
fit_gbt_fine = _fit_halves("fit_gbt_fine", "Boosted bins")
fit_gbt_sampled = _fit_halves("fit_gbt_sampled", "Boosted sampled")
fit_gbt_leafwise = _fit_halves("fit_gbt_leafwise", "Boosted leafwise")
fit_svm = _fit_halves("fit_svm", "Radial machine")
fit_mlp = _fit_halves("fit_mlp", "Perceptron")
fit_gbt_symmetric = _fit_halves("fit_gbt_symmetric", "Boosted symmetric")


@query("fit_svm_rff")
def fit_svm_rff(spark: SparkSession, sf: str) -> DataFrame:
    train, test = halves(spark, sf)
    return r6(models.fit_radial_machine(train, test, FEATURES), "p0", "p1")


@query("fit_mnlogit")
def fit_mnlogit(spark: SparkSession, sf: str) -> DataFrame:
    """Three classes fold by fold: an unpenalised multinomial logit on principal components, a penalised one, and their probabilities for every class."""
    df = three_class_folds(spark, sf)
    made = grid.fit_classes(df, FEATURES, ["Multinomial", "Logistic"], ["instrument", "fold"], 4).where("status = 'ok'")
    return r6(made.withColumn("p", F.transform(grid.of_classes("p", "labels", 3), lambda x: F.round(x, 6))).drop("labels"), "forward_r")


def three_class_folds(spark: SparkSession, sf: str, lead: int = 5) -> DataFrame:
    return folds.walk_forward(folds.with_size(panel(spark, sf, lead, targets.ternary_label)), folds.FoldSpec(purge=lead - 1))


@query("ternary_backtest")
def ternary_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted three-class probabilities through macro F1, positions (flat in the middle class and below 0.4) and risk statistics."""
    made = grid.fit_classes(three_class_folds(spark, sf), FEATURES, ["Multinomial", "Logistic"], ["instrument", "fold"], 4).where("status = 'ok'")
    keys = ["instrument", "model"]
    one = backtest.stitched(made, keys).withColumn("position", backtest.ternary_position(grid.of_classes("p", "labels", 3), 0.4)).withColumn("strat", F.col("position") * F.col("forward_r"))
    out = backtest.risk_stats(one, keys).join(metrics.f1_macro(made, keys), keys).join(metrics.accuracy(made, keys).select(*keys, "accuracy", "balanced_accuracy"), keys)
    return r6(out, *(c for c, t in out.dtypes if t == "double"))


#: 200 rows to fit variants on and 50 to score them before each 25 forecasts, each of these from the 250 rows before it.
BATCH = grid.BatchSpec(cap=250)
#: One forecast every 20 rows; 160 rows to fit on, 40 to choose a variant of each family, 50 to choose between the families.
INNER = folds.InnerSplit(250, 0.2)
ORIGIN = grid.BatchSpec(train=INNER.train, validation=INNER.validation, test=INNER.test, size=20, forecasts=1, cap=250)


def by_run(spark: SparkSession, sf: str) -> DataFrame:
    return grid.numbered(panel(spark, sf).drop("rn").withColumn("run", F.col("instrument")), ["run"])


def batch_champions(spark: SparkSession, sf: str) -> DataFrame:
    scores = grid.score_batches(by_run(spark, sf), FEATURES, tune.names("faster"), BATCH, ["run"], 5)
    return tune.champions(scores.persist())


@query("tune_champions")
def tune_champions(spark: SparkSession, sf: str) -> DataFrame:
    """Champions of every batch over the three families of the fastest grid."""
    return r6(batch_champions(spark, sf), "best_acc")


@query("tune_batch")
def tune_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Score logistic, boosted and bagged variants before each batch, choose sticky champions, and forecast the next 25 rows one by one, the champion being refitted at every step."""
    best = batch_champions(spark, sf)
    made = grid.deploy_batches(by_run(spark, sf), FEATURES, best.select("run", "batch", "champion"), BATCH, ["run"], 5)
    return r6(as_predictions(two_classes(made)), "p0", "p1", "forward_r")


def as_predictions(made: DataFrame, *more: str) -> DataFrame:
    return made.select(F.col("batch").alias("fold"), F.col("variant").alias("model"), F.col("run").alias("instrument"), "dt", "y", "forward_r", "p0", "p1", "pred", *more)


@query("fit_models_folds")
def fit_models_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Global PCA, PCA, logit and probit models fold by fold, with their pseudo R2 and explained variance; failed fits are rows with a status."""
    return r6(models.fit_models(walk(spark, sf, folds.FoldSpec()), FEATURES, k=4), "p0", "p1", "forward_r").drop("figures")


@query("model_results")
def model_results(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted probabilities through metrics: one row of results for each model and instrument on the hold-out."""
    df = folds.holdout_as_fold(folds.with_size(panel(spark, sf)))
    made = models.fit_models(df, FEATURES, k=4).where("status = 'ok'")
    out = metrics.result_rows(made, ["model", "instrument"], 1, "binary", len(FEATURES)).drop("extra")
    return r6(out, *(c for c, t in out.dtypes if t == "double"))


@query("model_backtest")
def model_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted probabilities and their mean ensemble through stitching, positions and risk statistics."""
    made = models.fit_models(walk(spark, sf, folds.FoldSpec()), FEATURES, k=4).where("status = 'ok' AND is_test")
    row = ["instrument", "fold", "dt"]
    mean = metrics.ensemble_mean(made, row).withColumn("model", F.lit("Ensemble mean"))
    names = ["instrument", "model", "fold", "dt", "y", "forward_r", "p0", "p1", "pred"]
    every = backtest.stitched(made.select(*names).unionByName(mean.select(*names)), ["instrument", "model"])
    every = every.withColumn("position", backtest.binary_position(F.col("p0"), F.col("p1"))).withColumn("strat", F.col("position") * F.col("forward_r"))
    out = backtest.risk_stats(every, ["instrument", "model"])
    return r6(out, *(c for c, t in out.dtypes if t == "double"))


@query("embedding_classifier")
def embedding_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Ready-made vectors: label 0 against the rest, hold-out by id."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    df = T.table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") == 0).cast("int").alias("y"))
    model = LogisticRegression(labelCol="y", regParam=0.01, maxIter=50).fit(df.where("vec_id % 2 = 0"))
    return model.transform(df.where("vec_id % 2 = 1")).select("vec_id", "y", F.col("prediction").cast("int").alias("pred"))


@query("tune_origins")
def tune_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Nested selection at each origin: the best variant of each family on the validation rows, the best of these on the inner test rows unless the champion still holds, and its forecast."""
    scores = grid.score_batches(by_run(spark, sf), FEATURES, tune.names("faster"), ORIGIN, ["run"], 5).persist()
    best = tune.nested_champions(scores)
    made = two_classes(grid.deploy_batches(by_run(spark, sf), FEATURES, best.select("run", "batch", "champion"), ORIGIN, ["run"], 5))
    out = made.join(best.select("run", "batch", "best", "best_acc"), ["run", "batch"])
    return r6(as_predictions(out, "best", "best_acc"), "p0", "p1", "forward_r", "best_acc")
