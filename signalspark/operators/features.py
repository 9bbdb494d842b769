"""Screening and scaling of vector features, clustering and folds (FEA3-10, CLU1-3)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import div, normal_quantile, rnd
from .ranges import cumulated, cut, numbered


def long_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return rows.select(key, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def picked(rows: DataFrame, key: str, vector: str, kept: list[int]) -> DataFrame:
    """(key, vector) of the features at positions ``kept``."""
    return rows.select(key, F.array(*(F.get(vector, F.lit(k)) for k in kept)).alias(vector))


def feature_masks(rows: DataFrame, vector: str, most: float = 1e12) -> DataFrame:
    """(pos, kept): features without missing, infinite or huge values and with some variance."""
    long = rows.select(F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    bad = F.col("x").isNull() | F.isnan("x") | (F.abs("x") > most)
    return long.groupBy("pos").agg((~F.max(bad) & (F.max("x") > F.min("x"))).alias("kept"))


def mean_vectors(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, pos, mean) of each group's vectors, element by element."""
    return rows.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(rnd(F.avg(F.col("x").cast("double"))).alias("mean"))


def varying(rows: DataFrame, vector: str, least: float = 1e-3) -> DataFrame:
    """(pos, variance, kept) by population variance."""
    long = rows.select(F.posexplode(vector).alias("pos", "x"))
    return long.groupBy("pos").agg(rnd(F.var_pop(F.col("x").cast("double"))).alias("variance"), (F.var_pop(F.col("x").cast("double")) > least).alias("kept"))


def imputed(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Missing values replaced by the feature's mean."""
    x = F.when(~F.isnan("x"), F.col("x"))
    long = long_vectors(rows, key, vector).withColumn("x", x)
    return long.join(long.groupBy("pos").agg(F.avg("x").alias("mean")), "pos").select(key, "pos", F.coalesce("x", "mean").alias("x"))


def quantiles(rows: DataFrame, keys: list[str], value: str, levels: list[float]) -> DataFrame:
    """(keys, q): interpolated quantiles of ``value`` by keys, exact, from counts of values added up over range partitions."""
    return quantiles_of_counts(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), keys, value, levels)


def quantiles_of_counts(counts: DataFrame, keys: list[str], value: str, levels: list[float]) -> DataFrame:
    """``quantiles`` of distinct values and their counts n."""
    counts = cumulated(counts, keys, [F.col(value)], "n")
    spots = [level * (F.col("whole") - 1) for level in levels]
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("upto")), F.col(value)))
    ends = [x for k, spot in enumerate(spots) for x in (at(F.floor(spot)).alias(f"l{k}"), at(F.ceil(spot)).alias(f"h{k}"))]
    out = counts.groupBy(*keys, "whole").agg(*ends)
    part = lambda k: spots[k] - F.floor(spots[k])
    return out.select(*keys, F.array(*(F.col(f"l{k}") * (1 - part(k)) + F.col(f"h{k}") * part(k) for k in range(len(levels)))).alias("q"))


def robust_scales(rows: DataFrame, vector: str) -> DataFrame:
    """(pos, centre, scale): median, and the 5-95 % range over that of a standard normal."""
    width = normal_quantile(0.95) - normal_quantile(0.05)
    long = rows.select(F.posexplode(vector).alias("pos", "x")).select("pos", F.col("x").cast("double").alias("x"))
    out = quantiles(long, ["pos"], "x", [0.05, 0.5, 0.95])
    return out.select("pos", rnd(F.get("q", F.lit(1))).alias("centre"), rnd((F.get("q", F.lit(2)) - F.get("q", F.lit(0))) / width).alias("scale"))


def scaled(rows: DataFrame, key: str, vector: str, scales: DataFrame) -> DataFrame:
    """(key, pos, x) centred and scaled; one row a feature in ``scales``, so it is broadcast."""
    return long_vectors(rows, key, vector).join(F.broadcast(scales), "pos").select(key, "pos", rnd(div(F.col("x") - F.col("centre"), F.col("scale"))).alias("x"))


def pruned(pairs: list[tuple[int, int, float]]) -> list[int]:
    """Features to drop: again and again the one with most partners (then of higher mean correlation, then lower index)."""
    left, out = {(i, j): abs(r) for i, j, r in pairs}, []
    while left:
        held: dict[int, list[float]] = {}
        for (i, j), r in left.items():
            held.setdefault(i, []).append(r)
            held.setdefault(j, []).append(r)
        worst = min(held, key=lambda k: (-len(held[k]), -round(float(np.mean(held[k])), 5), k))
        out.append(worst)
        left = {p: r for p, r in left.items() if worst not in p}
    return out


def sign_bits(vector: Column) -> Column:
    """Positions of positive values as bits, 32 of them in each number of an array that covers the whole vector."""
    words = F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / 32).cast("int"))
    word = lambda w: F.aggregate(F.transform(F.slice(vector, w * 32 + 1, F.lit(32)), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda t, x: t + x)
    return F.when(F.size(vector) > 0, F.transform(words, word)).otherwise(F.array().cast("array<bigint>"))


def butina(neighbours: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, cluster): greedily the node with most unassigned neighbours (lowest key on ties) takes them; the rest are alone.

    Rounds in Spark: every node that comes before all others within two steps takes its neighbours at once. As numbers of
    neighbours only fall, these are the nodes and groups of the sequential order; clusters are numbered in that order, by
    falling size and key, the nodes left alone after them by key. Nothing is collected but one row a round.
    """
    edges = cut(neighbours.select("a", "b").union(neighbours.select("b", "a")).where("a <> b").distinct())
    taken = None
    while not edges.isEmpty():
        rank = edges.groupBy("a").agg(F.struct(F.count("*").alias("n"), (-F.col("a").cast("bigint")).alias("low")).alias("rank"))
        best = edges.join(rank.select(F.col("a").alias("b"), F.col("rank").alias("of")), "b").groupBy("a").agg(F.max("of").alias("one"))
        best = cut(best.join(rank, "a").select("a", F.greatest("one", "rank").alias("one"), "rank"))
        two = edges.join(best.select(F.col("a").alias("b"), F.col("one").alias("of")), "b").groupBy("a").agg(F.max("of").alias("two"))
        lead = best.join(two, "a").where(F.greatest("one", "two") == F.col("rank")).select("a", "rank")
        group = edges.join(lead, "a").select(F.col("b").alias("node"), F.col("a").alias("head"), "rank").union(lead.select("a", "a", "rank"))
        group = cut(group)
        taken = group if taken is None else taken.union(group)
        gone = group.select(F.col("node").alias("gone"))
        edges = cut(edges.join(gone, edges["a"] == gone["gone"], "left_anti").join(gone, F.col("b") == F.col("gone"), "left_anti"))
    every = nodes.select(F.col(key).cast("bigint").alias("node")).distinct()
    if taken is None:
        return numbered(every, [F.col("node")], "cluster").select(F.col("node").alias(key), "cluster")
    heads = numbered(taken.select("head", "rank").distinct(), [F.col("rank.n").desc(), F.col("head")], "cluster")
    alone = numbered(every.join(taken.select("node"), "node", "left_anti"), [F.col("node")], "cluster")
    first = alone.crossJoin(F.broadcast(heads.agg(F.count("*").alias("heads")))).select("node", (F.col("cluster") + F.col("heads")).alias("cluster"))
    return taken.join(heads.select("head", "cluster"), "head").select("node", "cluster").union(first).withColumnRenamed("node", key)


def dealt(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first, last, folds in turn) of groups in order of falling size, each onto the lightest fold (lowest on ties).

    ``sizes`` has (size, number of groups). Groups of one size go round the folds that are within that size of the lightest,
    until the next fold comes within reach: a few runs a size, whatever the number of groups.
    """
    load, out, start = [0] * folds, [], 0
    for size, m in sorted(sizes, reverse=True):
        while m:
            order = sorted(range(folds), key=lambda f: (load[f], f))
            base = load[order[0]]
            ring = [f for f in order if load[f] < base + size]
            beyond = [load[f] for f in order if load[f] >= base + size]
            take = min(m, len(ring) * ((min(beyond) - base) // size)) if beyond else m
            for n, f in enumerate(ring):
                load[f] += size * (take // len(ring) + (n < take % len(ring)))
            out.append((size, start, start + take - 1, ring))
            start, m = start + take, m - take
    return out


def group_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """(group, fold): groups by falling size, each onto the lightest fold. What comes to the driver is a row for each size."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    found = [(r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()]
    runs = rows.sparkSession.createDataFrame(dealt(found, folds), "run_size bigint, first bigint, last bigint, ring array<int>")
    placed = numbered(sizes, [F.col("size").desc(), F.col(group)])
    inside = (F.col("size") == F.col("run_size")) & (F.col("number") >= F.col("first")) & (F.col("number") <= F.col("last"))
    turn = F.pmod(F.col("number") - F.col("first"), F.size("ring")).cast("int")
    return placed.join(F.broadcast(runs), inside).select(group, F.get("ring", turn).alias("fold"))


def stratified_folds(rows: DataFrame, group: str, label: str, folds: int = 5) -> DataFrame:
    """(group, fold): whole groups, with like shares of positive labels in every fold.

    Groups stand in the order of their share of positives, then of size; each next ``folds`` of them go to one fold each, in
    turn from the first to the last and back. It is a deal without a seed, not the order of a shuffled greedy assignment.
    """
    of = rows.groupBy(group).agg(F.avg(label).alias("share"), F.count("*").alias("size"))
    placed = numbered(of, [F.col("share").desc(), F.col("size").desc(), F.col(group)])
    turn = F.pmod(F.col("number"), F.lit(folds))
    back = F.pmod(F.floor(F.col("number") / folds), F.lit(2)) == 1
    return placed.select(group, F.when(back, folds - 1 - turn).otherwise(turn).cast("int").alias("fold"))
