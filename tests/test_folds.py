"""Feature chains inside folds, correlation of many features, searches and counterfactuals of fitted models."""

import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.operators import features, folds, models, steps


def frame(spark, x, fold):
    return spark.createDataFrame([(k, None if f is None else int(f), [None if v is None or np.isnan(v) else float(v) for v in row]) for k, (row, f) in enumerate(zip(x, fold))], "id bigint, fold int, v array<double>")


def direct_chain(x, most=0.9):
    """The chain on training rows, step by step: kept features, means, medians and scales."""
    fine = np.isfinite(x).all(0)
    kept = [k for k in range(x.shape[1]) if fine[k] and x[:, k].max() > x[:, k].min()]
    r = np.corrcoef(x[:, kept].T)
    pairs = [(a, b, r[i, j]) for i, a in enumerate(kept) for j, b in enumerate(kept) if a < b and abs(r[i, j]) >= most]
    kept = [k for k in kept if k not in features.pruned(pairs) and x[:, k].var() > 1e-3]
    q = np.quantile(x[:, kept], [0.05, 0.5, 0.95], axis=0)
    return kept, q[1], (q[2] - q[0]) / 3.289707253902944


def test_chain_of_each_fold(spark):
    """A feature that is broken in one fold, one that is constant in the others, and one that is correlated in the others only."""
    rng = np.random.default_rng(1)
    x, fold = rng.normal(size=(240, 8)), np.arange(240) % 3
    x[fold == 0, 1] = np.nan
    x[fold != 1, 2] = 7.0
    x[:, 4] = np.where(fold == 2, x[:, 4], -3 * x[:, 3] + 0.01 * x[:, 4])
    x[:, 5] = 0.001 * x[:, 5]
    rows = frame(spark, x, fold)
    chain = folds.FoldChain(scale=True).fit(rows, "v", "fold")
    for f in range(3):
        kept, centre, scale = direct_chain(x[fold != f])
        assert chain.kept[f] == kept
        got = np.array([r.v for r in chain.transform(rows, "v", f).orderBy("id").collect()])
        want = (np.where(np.isnan(x), np.nanmean(x[fold != f], 0), x)[:, kept] - centre) / scale
        assert np.allclose(got, want, atol=1e-6)
    assert len({tuple(k) for k in chain.kept.values()}) == 3


def test_statistics_of_odd_folds(spark):
    rows = frame(spark, np.array([[1.0, np.nan], [3.0, np.nan], [1e13, 2.0]]), [0, 1, None])
    got = {(r.fold, r.pos): r for r in folds.fold_statistics(rows, "v", "fold").collect()}
    assert len(got) == 6 and got[None, 0].mean == 2 and got[None, 0].variance == 1 and got[None, 0].kept and not got[0, 0].kept and got[None, 1].n == 0 and got[None, 1].mean is None
    one = folds.fold_statistics(rows.where("fold = 0"), "v", "fold").collect()
    assert all(r.n == 0 and not r.kept for r in one) and folds.fold_statistics(rows.limit(0), "v", "fold").count() == 0


def test_correlation_of_many_features(spark):
    """Two thousand features, so several blocks, with and without folds, against numpy; and what is dropped."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 2000)) + 50
    for k in range(0, 1990, 40):
        x[:, k + 7] = x[:, k] * 2 + 0.3 * rng.normal(size=90)
        x[:, (k + 611) % 2000] = -x[:, k] + 0.5 * rng.normal(size=90)
    x[:, 1999] = 4.0
    fold = np.arange(90) % 2
    rows = frame(spark, x, fold).repartition(3)

    def direct(part):
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.nan_to_num(np.corrcoef(part.T))
        return {(int(i), int(j)): round(float(r[i, j]), 4) for i, j in np.argwhere(np.triu(np.abs(r) >= 0.8, 1))}

    got = folds.correlations(rows, "v", 0.8)
    pairs = [tuple(r) for r in got.collect()]
    assert {(i, j): round(r, 4) for i, j, r in pairs} == pytest.approx(direct(x), abs=2e-4) and pairs
    assert sorted(r.pos for r in folds.pruned(got).collect()) == sorted(features.pruned(pairs))
    by_fold = [tuple(r) for r in folds.correlations(rows, "v", 0.8, "fold").collect()]
    for f in (0, 1):
        assert {(i, j): round(r, 4) for g, i, j, r in by_fold if g == f} == pytest.approx(direct(x[fold != f]), abs=2e-4)
    share = folds.correlations(rows, "v", 0.8, sample=0.5).collect()
    assert share == folds.correlations(rows, "v", 0.8, sample=0.5).collect() and share != pairs


def test_pruning_in_rounds(spark):
    """The features of the sequential order, with many ties, for several keys at once."""
    rng = random.Random(3)
    rows = [(k, i, j, round(rng.choice([0.9, -0.92, 0.95]), 2)) for k in range(6) for i in range(24) for j in range(i + 1, 24) if rng.random() < 0.06 + 0.04 * k]
    got = {}
    for r in folds.pruned(spark.createDataFrame(rows, "k int, i int, j int, r double"), ("k",)).collect():
        got.setdefault(r.k, []).append(r.pos)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(features.pruned([r[1:] for r in rows if r[0] == k])) for k in range(6)}


def learnable(spark):
    rng = random.Random(4)
    rows = [(k, k % 3, [rng.gauss(k % 2, 0.4), rng.random()], float(k % 2), 1.0, [float(k % 5 == 0), float(k % 5 != 0)]) for k in range(120)]
    return spark.createDataFrame(rows, "id bigint, fold int, v array<double>, y double, weight double, demo array<double>")


def test_failing_trials_are_pruned(spark):
    rows = models.training_rows(learnable(spark), "v")
    some = [{"regParam": 0.01}, {"regParam": -1.0}, {"noSuchParameter": 1}, {"regParam": 100.0}]
    table = models.trials_of("logistic", rows, "fold", some, at_once=2)
    got = {r.trial: r for r in table.collect()}
    assert [got[k].status for k in range(4)] == ["done", "pruned", "pruned", "done"] and got[1].score is None and got[2].error
    asked = duckdb.connect()
    asked.register("trials", table.toPandas())
    for metric, pick in (("roc_auc", "arg_max"), ("accuracy", "arg_max")):
        assert asked.sql(f"select {pick}(trial, score) from trials").fetchall()[0][0] == next(k for k, r in got.items() if r.best), metric
    least = models.trials_of("logistic", rows, "fold", some, metric="f1", maximise=False).where("best").first()
    f1 = {r.trial: r.score for r in models.trials_of("logistic", rows, "fold", some, metric="f1").collect() if r.score is not None}
    assert least.trial == min(f1, key=lambda k: (f1[k], k)) and json.loads(least.params) == some[least.trial]
    assert models.trials_of("logistic", rows, "fold", some[1:3]).where("best").count() == 0


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_differences_of_fitted_models(spark, kind):
    """For the linear model, from its coefficients; for the other, from its own predictions."""
    rows = learnable(spark)
    params = {"maxIter": 10} if kind == "logistic" else {"numTrees": 4, "maxDepth": 3}
    got, fitted = steps.counterfactuals_of_models(kind, rows, "id", "v", "demo", "fold", {"five": ["yes", "no"]}, **params)
    got = {(r.id, r.value): r.difference for r in got.collect()}
    assert len(got) == 240
    own = rows.collect()
    for f in range(3):
        base = [sum(r.demo[k] for r in own if r.fold != f) / 80 for k in (0, 1)]
        for r in [r for r in own if r.fold == f][:5]:
            def score(demo, f=f, r=r):
                if kind == "logistic":
                    w = fitted[f].coefficients.toArray()
                    return 1 / (1 + math.exp(-(float(w @ np.array(r.v + demo)) + fitted[f].intercept)))
                return float(fitted[f].predictProbability(models.training_rows(rows.where(F.col("id") == r.id).withColumn("demo", F.array(*map(F.lit, demo))), "v", "demo").first().x)[1])

            for value, demo in (("yes", [1.0, 0.0]), ("no", [0.0, 1.0])):
                assert got[r.id, value] == pytest.approx(score(demo) - score(base), abs=2e-5)
