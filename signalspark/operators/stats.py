"""Paired tests with control of multiple comparisons (STA1-4, WIN3, WIN4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.numeric import div, rnd
from .ranges import cumulated, cut


def normal_tail(z: Column) -> Column:
    """Two-sided tail probability of a standard normal |z|, by the rational approximation of erfc (error below 1.2e-7)."""
    t = 1 / (1 + F.abs(z) / (2 * 2**0.5))
    poly = F.lit(0.0)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    return t * F.exp(-z * z / 2 + poly)


#: Most pairs that the exact distribution of the rank sums serves.
EXACT = 50


def rank_sums(n: int) -> list[int]:
    """How many of the 2 ** n choices of signs give each sum of the ranks 1 to n."""
    counts = [1]
    for rank in range(1, n + 1):
        longer = counts + [0] * rank
        for w, c in enumerate(counts):
            longer[w + rank] += c
        counts = longer
    return counts


def exact_tails(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """(n, w, exact_p): two-sided probability of a rank sum of w or less, from counts made once for each n; at most EXACT of them."""
    rows = []
    for n in sizes:
        below = 0
        for w, c in enumerate(rank_sums(n)[: n * (n + 1) // 4 + 1]):
            below += c
            rows.append((n, float(w), min(1.0, 2 * below / 2**n)))
    return spark.createDataFrame(rows, "n bigint, w double, exact_p double")


def signed_rank(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Wilcoxon signed-rank test of each group: w_plus, w_minus, statistic, z, p_value, rank_biserial, effect, n.

    Zero differences go, ties share their mean rank. p_value is exact for up to ``EXACT`` pairs without ties and zeros; else it is
    the normal approximation, corrected for ties and continuity, as z always is. Ranks come from counts of equal differences,
    added up over range partitions, so no group is one task's work.
    """
    rows = pairs.withColumn("d", F.col(x) - F.col(y)).where("d is not null").withColumn("m", F.abs("d"))
    ties = rows.groupBy(*keys, "m").agg(F.count("*").alias("all"), F.count_if(F.col("d") > 0).alias("plus"))
    ties = ties.withColumn("t", F.when(F.col("m") > 0, F.col("all")).otherwise(0))
    ties = cumulated(ties, keys, [F.col("m")], "t").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    sums = ties.groupBy(*keys).agg(
        F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("plus"))).alias("w_minus"),
        F.sum("t").alias("n"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("tied"), F.sum(F.col("all") - F.col("t")).alias("zeros"),
    ).where("n > 0")
    sums = cut(sums)
    plain = (F.col("tied") == 0) & (F.col("zeros") == 0) & (F.col("n") <= EXACT)
    sizes = [r["n"] for r in sums.where(plain).select("n").distinct().orderBy("n").collect()]  # at most EXACT
    n = F.col("n").cast("double")
    mean, spread = n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)
    least = F.least("w_plus", "w_minus")
    z = div(F.least(least - mean + 0.5, F.lit(0.0)), spread)
    r = div(F.col("w_plus") - F.col("w_minus"), F.col("w_plus") + F.col("w_minus"))
    effect = F.when(F.abs(r) < 0.1, "Negligible").when(F.abs(r) < 0.3, "Small").when(F.abs(r) < 0.5, "Medium").otherwise("Large")
    tails = F.broadcast(exact_tails(pairs.sparkSession, sizes).withColumnRenamed("n", "of"))
    sums = sums.join(tails, (F.col("of") == F.col("n")) & (F.col("w") == least) & plain, "left")
    return sums.select(*keys, "n", "w_plus", "w_minus", least.alias("statistic"), rnd(z).alias("z"), F.coalesce("exact_p", normal_tail(z)).alias("p_value"), rnd(r).alias("rank_biserial"), effect.alias("effect"))


@F.pandas_udf(DoubleType())
def t_tail(r: pd.Series, freedom: pd.Series) -> pd.Series:
    """Two-sided tail probability of Student's t = r * sqrt(freedom / (1 - r^2)), one row a test.

    It is the integral of cos^(freedom - 1) beyond asin(|r|), over that of the whole quarter turn; Gauss-Legendre over the few
    widths of the integrand that count.
    """
    nodes, weights = np.polynomial.legendre.leggauss(64)

    def area(power: float, low: float, high: float) -> float:
        edges = np.linspace(low, high, 9)
        half = (edges[1:] - edges[:-1])[:, None] / 2
        return float((half * weights * np.exp(power * np.log(np.cos(edges[:-1, None] + half * (1 + nodes))))).sum())

    def one(x: float, v: float) -> float | None:
        if x is None or v is None or np.isnan(x) or np.isnan(v) or v < 1:
            return None
        low, power = float(np.arcsin(min(1.0, abs(x)))), float(v) - 1
        wide = min(np.pi / 2, 40 / np.sqrt(power)) if power else np.pi / 2
        return min(1.0, area(power, low, min(np.pi / 2, low + wide)) / area(power, 0.0, wide)) if low < np.pi / 2 else 0.0

    return pd.Series([one(x, v) for x, v in zip(r, freedom)], dtype="float64")


def correlations(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """n, Pearson's r and its two-sided p_value of each group, over the rows where both are known; both null for a constant
    side, p_value also for fewer than three rows."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))  # corr fails on a constant side
    out = both.groupBy(*keys).agg(F.count("*").alias("n"), F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
    return out.select(*keys, "n", rnd(F.col("r")).alias("r"), t_tail("r", F.when(F.col("n") > 2, F.col("n") - 2).cast("double")).alias("p_value"))


def holm(tests: DataFrame, p: str = "p_value", alpha: float = 0.01, tie: str | None = None) -> DataFrame:
    """``tests`` with adjusted_p and rejected, by Holm's step-down; a table of tests is a few rows."""
    order = Window.orderBy(p, *([tie] if tie else []))
    out = tests.withColumn("i", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy()))
    stepped = F.max((F.col("m") - F.col("i") + 1) * F.col(p)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("adjusted_p", F.least(stepped, F.lit(1.0))).withColumn("rejected", F.col("adjusted_p") < alpha).drop("i", "m")
