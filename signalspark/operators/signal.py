"""Pair counts, contingency tables and disproportionality signals (AGG1-5, DPA1-11, PRJ20, PRJ21)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import div, normal_quantile, rnd, valid


@dataclass(frozen=True)
class Settings:
    """Parameters of the metrics: least reports, error level, IC shrinkage, confidence power, sigmoid saturation."""

    min_records: int = 3
    alpha: float = 0.01
    shrink: float = 0.5
    power: float = 0.5
    saturation: float = 2.5


#: Value that a metric has without association.
NEUTRAL = {"prr": 1.0, "ror": 1.0, "ic": 0.0}


def pair_counts(rows: DataFrame, dims: list[str], drug: str, event: str) -> DataFrame:
    """Count of (drug, event) pairs for every subset of the demographic ``dims`` (a cube; null where not split), with gid."""
    return cubed(rows.groupBy(*dims, drug, event).agg(F.count("*").alias("n")), dims, drug, event)


def cubed(base: DataFrame, dims: list[str], drug: str, event: str) -> DataFrame:
    """``pair_counts`` from counts n by all ``dims``, drug and event."""
    sets = [[F.col(c) for c in (*kept, drug, event)] for k in range(len(dims), -1, -1) for kept in combinations(dims, k)]
    return base.groupingSets(sets, *dims, drug, event).agg((F.shiftright(F.grouping_id(*dims, drug, event), 2)).alias("gid"), F.sum("n").alias("n"))


def binarized(counts: DataFrame, dims: list[str], drug: str, event: str, sets: dict[str, list[str]]) -> DataFrame:
    """Pairs with and without an event of each set, one column a set: a_<set>, and n of all, by stratum and drug."""
    inside = [F.sum(F.when(F.col(event).isin(names), F.col("n")).otherwise(0)).alias(f"a_{s}") for s, names in sets.items()]
    return counts.groupBy("gid", *dims, drug).agg(*inside, F.sum("n").alias("n"))


def contingency(counts: DataFrame, dims: list[str], drug: str, flag: Column, n: str = "n") -> DataFrame:
    """2 x 2 cells of each drug within its stratum: a, b (drug), c, d (other drugs), with and without the event."""
    cells = counts.groupBy("gid", *dims, drug).agg(F.sum(F.when(flag, F.col(n)).otherwise(0)).alias("a"), F.sum(n).alias("n"))
    stratum = Window.partitionBy("gid", *dims)
    cells = cells.withColumns({"events": F.sum("a").over(stratum), "total": F.sum("n").over(stratum)})
    return cells.select("gid", *dims, drug, "a", (F.col("n") - F.col("a")).alias("b"), (F.col("events") - F.col("a")).alias("c"), (F.col("total") - F.col("n") - F.col("events") + F.col("a")).alias("d"))


def _bounds(value: Column, error: Column, alpha: float) -> tuple[Column, Column]:
    z = normal_quantile(1 - alpha / 2)
    return rnd(value * F.exp(-z * error)), rnd(value * F.exp(z * error))


def proportional_ratio(a: Column, b: Column, c: Column, d: Column, alpha: float) -> tuple[Column, Column, Column]:
    """(lower, value, upper) of the proportional reporting ratio."""
    expected = div((a + b).cast("double") * c, c + d)
    value = rnd(div(a, expected))
    error = F.sqrt(div(F.lit(1), a) - div(F.lit(1), a + b) + div(F.lit(1), c) - div(F.lit(1), c + d))
    lower, upper = _bounds(value, error, alpha)
    return lower, value, upper


def odds_ratio(a: Column, b: Column, c: Column, d: Column, alpha: float) -> tuple[Column, Column, Column]:
    """(lower, value, upper) of the reporting odds ratio."""
    value = rnd(div(a.cast("double") * d, b.cast("double") * c))
    error = F.sqrt(div(F.lit(1), a) + div(F.lit(1), b) + div(F.lit(1), c) + div(F.lit(1), d))
    lower, upper = _bounds(value, error, alpha)
    return lower, value, upper


def information_component(a: Column, b: Column, c: Column, d: Column, shrink: float) -> tuple[Column, Column]:
    """(value, rate): log2 of observed over expected, both shrunk; rate is the posterior's."""
    rate = div((a + b).cast("double") * (a + c), a + b + c + d) + shrink
    return rnd(F.log2((a.cast("double") + shrink) / rate)), rate


def gamma_cdf(shape: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1 / shape
        k = shape
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * front
    tiny = 1e-300
    b = x + 1 - shape
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 10_000):
        an = -k * (k - shape)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - h * front


def gamma_quantile(p: float, shape: float) -> float:
    """x of gamma_cdf(shape, x) = p, by bisection on a bracket grown from the mean."""
    low, high = 0.0, max(1.0, shape)
    while gamma_cdf(shape, high) < p:
        low, high = high, 2 * high
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if gamma_cdf(shape, mid) < p else (low, mid)
    return (low + high) / 2


def component_bounds(cells: DataFrame, s: Settings) -> DataFrame:
    """``cells`` with ic_lower and ic_upper: gamma quantiles depend on ``a`` alone, so each distinct ``a`` is computed once."""

    def quantiles(batches):
        for pdf in batches:
            rows = [[a, *(gamma_quantile(p, a + s.shrink) for p in (s.alpha / 2, 1 - s.alpha / 2))] for a in pdf["a"]]
            yield pd.DataFrame(rows, columns=["qa", "q_low", "q_high"]).astype({"qa": np.int64, "q_low": float, "q_high": float})

    table = cells.select("a").distinct().mapInPandas(quantiles, "qa bigint, q_low double, q_high double")
    _, rate = information_component(*(F.col(c) for c in "abcd"), s.shrink)
    out = cells.join(table, F.col("a") == F.col("qa"), "left")
    return out.withColumns({"ic_lower": rnd(F.log2(F.col("q_low") / rate)), "ic_upper": rnd(F.log2(F.col("q_high") / rate))}).drop("qa", "q_low", "q_high")


def metrics(cells: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``cells`` (a, b, c, d) with lower, value and upper of prr, ror and ic; all three null where one isn't valid."""
    a, b, c, d = (F.col(x) for x in "abcd")
    out = component_bounds(cells, s)
    out = out.withColumn("ic", information_component(a, b, c, d, s.shrink)[0])
    for name, three in (("prr", proportional_ratio(a, b, c, d, s.alpha)), ("ror", odds_ratio(a, b, c, d, s.alpha))):
        out = out.withColumns(dict(zip((f"{name}_lower", name, f"{name}_upper"), three)))
    for name in NEUTRAL:
        names = [f"{name}_lower", name, f"{name}_upper"]
        fine = valid(*(F.col(x) for x in names))
        out = out.withColumns({x: F.when(fine, F.col(x)) for x in names})
    return out


def label(name: str, s: Settings) -> Column:
    """Risk label of a metric: Undefined, Ambiguous, High, Moderate, Low or Minimal."""
    low, value, high, t = F.col(f"{name}_lower"), F.col(name), F.col(f"{name}_upper"), F.lit(NEUTRAL[name])
    return (
        F.when(F.col("a") < s.min_records, "Undefined").when(~valid(low, value, high), "Ambiguous").when(low >= t, "High")
        .when((low < t) & (t < high), F.when(value > t, "Moderate").when(value == t, "Ambiguous").otherwise("Low")).when(high <= t, "Minimal")
    )


def confidence(name: str, label_: Column, s: Settings) -> Column:
    """Distance from neutral over the interval's width; null for undefined and ambiguous ones."""
    low, value, high = F.col(f"{name}_lower"), F.col(name), F.col(f"{name}_upper")
    got = rnd(F.pow(F.abs(value - NEUTRAL[name]), F.lit(s.power)) / ((high - low) + 1e-4))
    return F.when(~label_.isin("Undefined", "Ambiguous") & valid(low, value, high), got)


def saturating(x: Column, saturation: float) -> Column:
    """Sigmoid through 0.1 at 0, 0.5 at half the saturation and 0.9 at it."""
    return rnd(1 / (1 + F.exp(F.lit(-2 / saturation * math.log(9)) * (x - saturation / 2))))


def binary(label_: Column) -> Column:
    return F.when(label_.isin("High", "Moderate"), 1).when(label_.isin("Low", "Minimal"), 0)


def smoothed(weight: Column, y: Column) -> Column:
    """Label drawn towards a half by its lack of weight."""
    return rnd(weight * y + (1 - weight) * 0.5)


def labelled(cells: DataFrame, name: str, s: Settings = Settings()) -> DataFrame:
    """label, confidence, weight, y and smooth of one metric."""
    out = cells.withColumn("label", label(name, s))
    out = out.withColumn("confidence", confidence(name, F.col("label"), s))
    out = out.withColumn("weight", saturating(F.col("confidence"), s.saturation)).withColumn("y", binary(F.col("label")))
    return out.withColumn("smooth", smoothed(F.col("weight"), F.col("y")))


def finished(rows: DataFrame, dims: list[str], values: dict[str, list[str]], drug: str) -> DataFrame:
    """Decided rows of one metric, ready for training: named strata and a one-hot vector of the demographics.

    Rows with an undefined label go, and so do rows of a dimension that is split but unknown; a dimension that isn't split
    is 'Unknown'. ``values`` has each dimension's categories in order; a vector holds a block for each.
    """
    split = {d: F.bitwise_not(F.shiftright("gid", len(dims) - 1 - k)).bitwiseAND(1) == 1 for k, d in enumerate(dims)}
    known = F.lit(True)
    for d in dims:
        known = known & (~split[d] | (F.col(d).isNotNull() & (F.col(d) != "Unknown")))
    out = rows.where(F.col("y").isNotNull() & known).withColumns({d: F.coalesce(F.col(d), F.lit("Unknown")) for d in dims})
    vector = F.array(*(F.when(F.col(d) == v, 1).otherwise(0) for d in dims for v in values[d]))
    return out.select(*dims, drug, "label", "confidence", "weight", "y", "smooth", vector.alias("demographics"))


def cells_from_rows(rows: DataFrame, drug: str, flag: Column) -> DataFrame:
    """2 x 2 cells of each drug straight from rows of reports."""
    totals = rows.agg(F.count_if(flag).alias("e"), F.count("*").alias("n"))
    own = rows.groupBy(drug).agg(F.count_if(flag).alias("a"), F.count_if(~flag).alias("b"))
    return own.crossJoin(F.broadcast(totals)).select(drug, "a", "b", (F.col("e") - F.col("a")).alias("c"), (F.col("n") - F.col("e") - F.col("b")).alias("d"))
