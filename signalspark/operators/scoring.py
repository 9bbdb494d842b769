"""Weighted classification scores, overall and by subgroup; counterfactual differences (SCO1-2, ML6, DIF1-3, AGG7-9, AGG11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import div, div0, rnd
from .ranges import cumulated

METRICS = ["accuracy", "recall", "specificity", "precision", "balanced_accuracy", "geom_rs", "harm_rs", "f1", "roc_auc", "mcc"]


def scores(rows: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_score", w: str = "weight", at: float = 0.5) -> DataFrame:
    """Weighted scores of each group; none for groups that lack a class. Rows of equal score are summed first, so the
    area under the curve needs one row for each distinct score of a group. Divisions by zero give 0."""
    weight, true = F.col(w).cast("double"), F.col(y) == 1
    points = rows.groupBy(*keys, F.col(p).alias("s")).agg(F.sum(F.when(true, weight).otherwise(0.0)).alias("pos"), F.sum(F.when(~true, weight).otherwise(0.0)).alias("neg"))
    points = cumulated(points, keys, [F.col("s")], "neg").withColumnRenamed("before", "below")
    said = F.col("s") >= at
    cells = points.groupBy(*keys).agg(
        F.sum(F.when(said, F.col("pos")).otherwise(0.0)).alias("tp"), F.sum(F.when(said, F.col("neg")).otherwise(0.0)).alias("fp"),
        F.sum(F.when(~said, F.col("neg")).otherwise(0.0)).alias("tn"), F.sum(F.when(~said, F.col("pos")).otherwise(0.0)).alias("fn"),
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("under"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, specificity, precision = div0(tp, tp + fn), div0(tn, tn + fp), div0(tp, tp + fp)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    made = {
        "accuracy": div0(tp + tn, tp + fp + tn + fn), "recall": recall, "specificity": specificity, "precision": precision,
        "balanced_accuracy": (recall + specificity) / 2, "geom_rs": F.sqrt(recall * specificity), "harm_rs": div0(2 * recall * specificity, recall + specificity),
        "f1": div0(2 * precision * recall, precision + recall), "roc_auc": div0(F.col("under"), (tp + fn) * (tn + fp)), "mcc": div0(tp * tn - fp * fn, F.sqrt(product)),
    }
    kept = cells.where((tp + fn > 0) & (tn + fp > 0))
    return kept.select(*keys, *(rnd(F.col(c), 5).alias(c) for c in ("tp", "fp", "tn", "fn")), *(rnd(c).alias(n) for n, c in made.items()))


def subgroup_scores(rows: DataFrame, dims: list[str], **names) -> DataFrame:
    """Scores in all and for each value of each dimension: kind, value and the scores."""
    kinds = F.array(F.struct(F.lit("Total").alias("kind"), F.lit("Total").alias("value")), *(F.struct(F.lit(d).alias("kind"), F.col(d).cast("string").alias("value")) for d in dims))
    long = rows.withColumn("k", F.explode(kinds)).withColumns({"kind": F.col("k.kind"), "value": F.col("k.value")})
    return scores(long, ["kind", "value"], **names)


def long_scores(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Scores as (ids, metric, value)."""
    return wide.unpivot(ids, METRICS, "metric", "value")


def ensemble(rows: DataFrame, ids: list[str], p: str = "y_score", at: float = 0.5) -> DataFrame:
    """Mean score of the members of an ensemble, and the class that it says."""
    out = rows.groupBy(*ids).agg(F.avg(p).alias(p))
    return out.withColumn("y_pred", (F.col(p) >= at).cast("int"))


def mean_std(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, sample and population standard deviation, and the mean's 95 % interval, by keys."""
    mean, std = F.avg(value), F.stddev_samp(value)
    return long.groupBy(*keys).agg(
        rnd(mean).alias("mean"), rnd(std).alias("std"), rnd(F.stddev_pop(value)).alias("std_pop"), rnd(mean - 1.96 * std).alias("low"), rnd(mean + 1.96 * std).alias("high"), F.count("*").alias("n"),
    )


def profile(rows: DataFrame, keys: list[str], entity: str, label: str, weight: str) -> DataFrame:
    """Rows, distinct entities, share of positives, mean weight by class, mean and spread of rows an entity."""
    each = rows.groupBy(*keys, entity).agg(F.count("*").alias("n"))
    sizes = each.groupBy(*keys).agg(rnd(F.avg("n")).alias("mean_rows"), rnd(F.stddev_samp("n")).alias("std_rows"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.countDistinct(entity).alias("entities"), rnd(100 * F.avg(label), 2).alias("positive"),
        rnd(F.avg(F.when(F.col(label) == 1, F.col(weight)))).alias("weight_1"), rnd(F.avg(F.when(F.col(label) == 0, F.col(weight)))).alias("weight_0"),
    )
    return out.join(sizes, keys)


def class_distribution(rows: DataFrame, category: str, value: str, weight: str) -> DataFrame:
    """Mean weight, entries and contribution of each value, and their fractions of the category's totals."""
    by = rows.groupBy(category, value).agg(F.avg(weight).alias("m"), F.count("*").alias("entries"), F.sum(weight).alias("c"))
    whole = Window.partitionBy(category)
    fraction, adjusted = div(F.col("entries"), F.sum("entries").over(whole)), div(F.col("c"), F.sum("c").over(whole))
    return by.select(category, value, rnd(F.col("m")).alias("mean_weight"), "entries", rnd(F.col("c"), 3).alias("contribution"), rnd(fraction).alias("fraction"), rnd(adjusted).alias("adjusted"))


def recall_specificity_ratio(wide: DataFrame, keys: list[str]) -> DataFrame:
    return wide.groupBy(*keys).agg(rnd(div(F.avg("recall"), F.avg("specificity")), 3).alias("ratio"))


def counterfactuals(rows: DataFrame, ids: list[str], demographics: str, blocks: list[int], predict) -> DataFrame:
    """Change of the prediction when one category of a block of the one-hot vector is set: (ids, position, difference).

    ``predict`` maps a vector column to a score column. Every row meets each position by an explode of fixed length.
    """
    spans, start = [], 0
    for size in blocks:
        spans += [(k, start, start + size) for k in range(start, start + size)]
        start += size
    options = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(e).alias("e")) for k, s, e in spans))
    long = rows.withColumn("o", F.explode(options))
    vector = F.transform(demographics, lambda x, i: F.when(i == F.col("o.k"), F.lit(1.0)).when((i >= F.col("o.s")) & (i < F.col("o.e")), F.lit(0.0)).otherwise(x.cast("double")))
    own = F.transform(demographics, lambda x: x.cast("double"))
    return long.select(*ids, F.col("o.k").alias("position"), rnd(predict(vector) - predict(own)).alias("difference"))


def linear(weights: list[float], bias: float):
    """A scorer for ``counterfactuals``: logistic of a dot product."""
    w = F.array(*map(F.lit, weights))
    return lambda v: 1 / (1 + F.exp(-(F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x) + bias)))


def external_confusion(rows: DataFrame, external: DataFrame, key: str, keys: list[str], unknown: tuple[str, ...] = ()) -> DataFrame:
    """Counts of agreement with an external class (key, class) by keys; with ``unknown``, of the rows alone whose demographics of
    these names are all Unknown, the signature of a whole population."""
    for c in unknown:
        rows = rows.where(F.col(c) == "Unknown")
    both = rows.join(external, key)
    case = lambda y, c: F.count_if((F.col("y") == y) & (F.col("class") == c))
    return both.groupBy(*keys).agg(case(1, 1).alias("tp"), case(0, 0).alias("tn"), case(1, 0).alias("fp"), case(0, 1).alias("fn"))


def stacked_metrics(tables: dict[str, DataFrame], fractions: DataFrame) -> DataFrame:
    """(stratification, category, metric, value): the scores of each stratification (category, metric, value) one under another,
    and under them the adjusted ``fractions`` (stratification, category, adjusted) as the metric AFT."""
    parts = [df.select(F.lit(name).alias("stratification"), F.col("category").cast("string").alias("category"), "metric", F.col("value").cast("double").alias("value")) for name, df in tables.items()]
    aft = fractions.select("stratification", F.col("category").cast("string").alias("category"), F.col("adjusted").cast("double").alias("AFT"))
    return reduce(DataFrame.unionByName, [*parts, aft.unpivot(["stratification", "category"], ["AFT"], "metric", "value")])


def signature(*columns: str) -> Column:
    """Values of a stratum as one text."""
    return F.concat_ws(" | ", *columns)


def parameters(trial: Column) -> Column:
    """A map of parameters as one text, by name."""
    pairs = F.array_sort(F.map_entries(trial))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit(": "), p["value"])), " | ")


def category_order(orders: dict[str, list[str]]) -> list[Column]:
    """Sort keys by the places of values in their category's order; others come last."""
    return [F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(c)), F.lit(0)).asc_nulls_last() for c, values in orders.items()]
