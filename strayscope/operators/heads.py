"""Trainable classifier heads on Spark ML: multinomial logistic regression
(with class weights), random forest, one-vs-rest linear SVM, naive Bayes;
validation-split model selection and random-search cross-validation with an
MCC evaluator.  Heads turn embeddings into class probabilities for the
probability-based detectors."""

from __future__ import annotations

import random

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (LinearSVC, LogisticRegression, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detectors import Detector
from .metrics import multiclass_mcc
from .prep import class_weights


def with_features(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("v"))


def make_classifier(kind: str, **params):
    if kind == "logreg":
        return LogisticRegression(family="multinomial", labelCol="label", featuresCol="features",
                                  maxIter=params.get("maxIter", 100), regParam=params.get("regParam", 0.0))
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=params.get("numTrees", 100), seed=0, labelCol="label")
    if kind == "linear_svc":
        return OneVsRest(classifier=LinearSVC(maxIter=params.get("maxIter", 50)), labelCol="label")
    if kind == "naive_bayes":
        return NaiveBayes(modelType=params.get("modelType", "gaussian"), labelCol="label")
    raise ValueError(f"unknown head {kind!r}")


def fit_head(train: DataFrame, kind: str = "logreg", weighting: str | None = None, **params):
    """Pipeline(label index lexical order -> classifier); ``weighting`` =
    balanced | log adds per-row class weights (logistic regression only)."""
    idx = StringIndexer(inputCol="intent", outputCol="label", stringOrderType="alphabetAsc")
    clf = make_classifier(kind, **params)
    data = with_features(train)
    if weighting:
        w = class_weights(train).select("intent", F.col("w_balanced" if weighting == "balanced" else "w_log")
                                        .alias("weight"))
        data = data.join(w, "intent")
        clf.setWeightCol("weight")
    return Pipeline(stages=[idx, clf]).fit(data)


def head_predictions(model, df: DataFrame) -> DataFrame:
    """(id, pred, probs array, msp); pred is the class name."""
    labels = model.stages[0].labels
    out = model.transform(with_features(df))
    lab = F.array(*[F.lit(x) for x in labels])
    if "probability" in out.columns:
        probs = vector_to_array("probability")
    else:  # one-vs-rest linear SVM: soft-max of the raw margins
        raw = vector_to_array("rawPrediction")
        mx = F.array_max(raw)
        ex = F.transform(raw, lambda x: F.exp(x - mx))
        probs = F.transform(ex, lambda x: x / F.aggregate(ex, F.lit(0.0), lambda a, b: a + b))
    return out.select("id", F.element_at(lab, F.col("prediction").cast("int") + 1).alias("pred"),
                      probs.alias("probs")).withColumn("msp", F.array_max("probs"))


class MLHeadMSP(Detector):
    """Maximum class probability of a trained Spark ML head (low = OOD)."""
    name = "ml_head_msp"
    outdomain_is_lower = True

    def __init__(self, ood_label: str = "oos", kind: str = "logreg", weighting: str | None = "balanced"):
        super().__init__(ood_label)
        self.kind, self.weighting = kind, weighting

    def _fit(self, train):
        super()._fit(train)
        self.model = fit_head(self.train, self.kind, self.weighting if self.kind == "logreg" else None)

    def score(self, df):
        return head_predictions(self.model, df).select("id", F.col("msp").alias("score"))


class MCCEvaluator(Evaluator):
    """Multi-class Matthews correlation of prediction vs label (larger is better)."""

    def _evaluate(self, dataset):
        d = dataset.select(F.col("label").cast("string").alias("intent"), F.col("prediction").cast("string").alias("pred"))
        return float(multiclass_mcc(d).first()["mcc"])

    def isLargerBetter(self):
        return True


def select_on_validation(train: DataFrame, val: DataFrame, grid: list[dict], kind: str = "logreg"):
    """Best-checkpoint stand-in: fit every grid point on train, keep the one with
    the lowest validation log-loss (validation rows of unseen classes dropped)."""
    from .prep import feasible_filter
    v = feasible_filter(val, train)
    best, best_loss = None, np.inf
    for params in grid:  # small, fixed grid of configurations
        m = fit_head(train, kind, **params)
        pr = head_predictions(m, v).join(v.select("id", "intent"), "id")
        labels = m.stages[0].labels
        pos = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("intent"))
        loss = pr.select(-F.log(F.greatest(F.element_at("probs", pos.cast("int")), F.lit(1e-15))).alias("l")) \
            .agg(F.avg("l")).first()[0]
        if loss < best_loss:
            best, best_loss = m, loss
    return best, best_loss


def random_search_cv(train: DataFrame, n_trials: int = 6, folds: int = 5, seed: int = 0, parallelism: int = 4):
    """Random search over logistic-regression regularisation, cross-validated
    on MCC with the stratified folds of :func:`prep.stratified_folds`."""
    from .prep import stratified_folds
    rnd = random.Random(seed)
    lr = make_classifier("logreg")
    grid = ParamGridBuilder().addGrid(lr.regParam, sorted({round(10 ** rnd.uniform(-4, 0), 6) for _ in range(n_trials)})) \
        .addGrid(lr.maxIter, [50]).build()
    pipe = Pipeline(stages=[StringIndexer(inputCol="intent", outputCol="label", stringOrderType="alphabetAsc"), lr])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=MCCEvaluator(), numFolds=folds,
                        foldCol="fold", seed=seed, parallelism=parallelism)
    data = with_features(train).join(stratified_folds(train, folds), "id").checkpoint()  # reused by every fit
    model = cv.fit(data)
    return model, [(pm[lr.regParam], float(m)) for pm, m in zip(grid, model.avgMetrics)]


def train_validation_split(train: DataFrame, grid_reg=(0.0, 0.01, 0.1), seed: int = 0):
    lr = make_classifier("logreg")
    grid = ParamGridBuilder().addGrid(lr.regParam, list(grid_reg)).build()
    pipe = Pipeline(stages=[StringIndexer(inputCol="intent", outputCol="label", stringOrderType="alphabetAsc"), lr])
    return TrainValidationSplit(estimator=pipe, estimatorParamMaps=grid, evaluator=MCCEvaluator(),
                                trainRatio=0.8, seed=seed).fit(with_features(train))
