"""Grouped-fold training, ensembles and hyper-parameter search with pyspark.ml (ML1-8)."""

from __future__ import annotations

import json
import random
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from .ranges import cut
from .scoring import scores

MODELS = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "svm": LinearSVC, "boosted": GBTClassifier}
#: Bounds of the seeded random search.
SPACES = {
    "logistic": {"regParam": (1e-4, 1.0), "elasticNetParam": (0.0, 1.0)},
    "forest": {"numTrees": (10, 60), "maxDepth": (3, 10)},
    "svm": {"regParam": (1e-4, 1.0)},
    "boosted": {"maxIter": (5, 20), "maxDepth": (2, 5), "stepSize": (0.05, 0.3)},
}


def training_rows(rows: DataFrame, features: str, demographics: str | None = None) -> DataFrame:
    """``rows`` with the vector column ``x`` of features and demographics."""
    parts = [F.transform(c, lambda v: v.cast("double")) for c in (features, demographics) if c]
    return rows.withColumn("x", array_to_vector(F.concat(*parts)))


def fitted(kind: str, train: DataFrame, label: str = "y", weight: str | None = "weight", **params):
    if kind not in MODELS:
        raise ValueError(f"no such model: {kind}")
    own = {"weightCol": weight} if weight else {}
    return MODELS[kind](featuresCol="x", labelCol=label, **own, **params).fit(train)


def predicted(model, rows: DataFrame) -> DataFrame:
    """``rows`` with y_score; a model without probabilities gives the logistic of its margin."""
    out = model.transform(rows)
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
    else:
        score = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.withColumn("y_score", score).drop("probability", "rawPrediction", "prediction")


def cross_validated(kind: str, rows: DataFrame, fold: str, test_fold: int, label: str = "y", weight: str | None = "weight", **params) -> DataFrame:
    """Scores of the ensemble of models, each trained without one fold, on the test fold: fold_out, and the rows' columns."""
    folds = [r[0] for r in rows.select(fold).distinct().where(F.col(fold) != test_fold).orderBy(fold).collect()]
    test = rows.where(F.col(fold) == test_fold)
    members = [predicted(fitted(kind, rows.where(~F.col(fold).isin(test_fold, f)), label, weight, **params), test).withColumn("fold_out", F.lit(f)) for f in folds]
    return reduce(DataFrame.unionByName, members)


def drawn(kind: str, trials: int, seed: int, space: dict | None = None) -> list[dict]:
    """Seeded random parameters of each trial, within the bounds of ``space`` or ``SPACES``."""
    rng = random.Random(seed)
    return [{k: rng.randint(*v) if isinstance(v[0], int) else rng.uniform(*v) for k, v in (space or SPACES[kind]).items()} for _ in range(trials)]


def trials_of(kind: str, rows: DataFrame, fold: str, drawn_params: list[dict], metric: str = "roc_auc", label: str = "y", weight: str = "weight", maximise: bool = True, at_once: int = 4) -> DataFrame:
    """(trial, kind, params, score, status, error, best), one row a trial: the mean of ``metric`` over the folds.

    ``at_once`` trials run together, each in a scheduler pool and job group of its own (they share the cluster evenly where
    spark.scheduler.mode is FAIR). A trial that fails is pruned: it is recorded with its error and without a score, and the others
    go on. best marks the trial of the best score, the first of equal ones; parameters stand as JSON.
    """
    spark = rows.sparkSession
    rows = cut(rows)  # read by every trial
    folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]

    def run(trial: int, params: dict) -> float | None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{trial}")
        spark.sparkContext.setJobGroup(f"trial-{trial}", f"{kind} {params}")
        parts = [predicted(fitted(kind, rows.where(F.col(fold) != f), label, weight, **params), rows.where(F.col(fold) == f)) for f in folds]
        return scores(reduce(DataFrame.unionByName, parts), [fold], y=label, w=weight).agg(F.avg(metric)).first()[0]

    def tried(trial: int, params: dict) -> tuple:
        try:
            score = run(trial, params)
            return trial, kind, json.dumps(params, sort_keys=True), score, "done" if score is not None else "pruned", None
        except Exception as failure:  # whatever the parameters did
            return trial, kind, json.dumps(params, sort_keys=True), None, "pruned", f"{type(failure).__name__}: {failure}"[:300]

    with ThreadPoolExecutor(at_once) as pool:
        done = [job.result() for job in [pool.submit(inheritable_thread_target(spark)(tried), k, p) for k, p in enumerate(drawn_params)]]
    ranked = sorted((r for r in done if r[3] is not None), key=lambda r: (-r[3] if maximise else r[3], r[0]))
    return spark.createDataFrame([(*r, bool(ranked) and r[0] == ranked[0][0]) for r in done], "trial int, kind string, params string, score double, status string, error string, best boolean")


def searched(kind: str, rows: DataFrame, fold: str, metric: str = "roc_auc", trials: int = 4, seed: int = 42, label: str = "y", weight: str = "weight", maximise: bool = True) -> tuple[dict, float]:
    """Best parameters and their mean score over the folds, among seeded random draws from the bounds of ``SPACES``."""
    best = trials_of(kind, rows, fold, drawn(kind, trials, seed), metric, label, weight, maximise).where("best").first()
    return (json.loads(best["params"]), best["score"]) if best else ({}, float("-inf") if maximise else float("inf"))


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="x").transform(rows)
