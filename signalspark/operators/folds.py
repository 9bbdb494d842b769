"""The feature chain inside every fold (ML5, ML7, ML8) and correlation of many features (FEA4).

A model of a fold learns masks, correlation, means, variances and scales from the rows of the other folds. One pass gives each
fold's counts, moments, products and value counts; what the training rows of a fold have is what all other folds have together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import normal_quantile, rnd
from . import features
from .ranges import cut

#: Features of a block: products are summed and shuffled by pairs of blocks.
BLOCK = 256
PRODUCTS = pa.schema([("pair", pa.int32()), ("fold", pa.string()), ("n", pa.int64()), ("sums", pa.binary()), ("gram", pa.binary())])
#: Largest value that isn't taken for broken, and least variance of a feature that is kept.
MOST, LEAST_VARIANCE = 1e12, 1e-3


def _long(rows: DataFrame, vector: str, fold: str) -> DataFrame:
    return rows.select(F.col(fold).alias("fold"), F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def fold_statistics(rows: DataFrame, vector: str, fold: str) -> DataFrame:
    """(fold, pos, n, bad, low, high, mean, variance, kept, varying) of each feature over the rows of all folds but ``fold``.

    n, mean and population variance are of the values that aren't missing; bad counts those that are missing, infinite or huge;
    kept: none is bad and not all are equal; varying: the variance is above 0.001. Moments of folds are put together, not
    subtracted, so nothing cancels out. A null fold is one like others.
    """
    x = F.when(~F.isnan("x"), F.col("x"))
    bad = F.col("x").isNull() | F.isnan("x") | (F.abs("x") > MOST)
    own = _long(rows, vector, fold).groupBy("pos", "fold").agg(F.count(x).alias("n"), F.count_if(bad).alias("bad"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"))
    every = own.groupBy("pos").agg(F.collect_list(F.struct("fold", "n", "bad", "low", "high", "mean", "variance")).alias("all"))  # a row a fold
    some = every.select("pos", F.explode("all").alias("own"), "all").select("pos", F.col("own.fold").alias("fold"), F.filter("all", lambda g: ~g["fold"].eqNullSafe(F.col("own.fold"))).alias("g"))
    total = lambda of: F.aggregate(F.transform("g", of), F.lit(0.0), lambda t, v: t + F.coalesce(v, F.lit(0.0)))
    count = lambda c: F.aggregate(F.transform("g", lambda g: g[c]), F.lit(0).cast("bigint"), lambda t, v: t + v)
    out = some.withColumns({"n": count("n"), "bad": count("bad"), "low": F.array_min(F.transform("g", lambda g: g["low"])), "high": F.array_max(F.transform("g", lambda g: g["high"]))})
    out = out.withColumn("mean", total(lambda g: g["n"] * g["mean"]) / F.nullif("n", F.lit(0).cast("bigint")))
    out = out.withColumn("variance", total(lambda g: g["n"] * (g["variance"] + (g["mean"] - F.col("mean")) * (g["mean"] - F.col("mean")))) / F.nullif("n", F.lit(0).cast("bigint")))
    kept = (F.col("bad") == 0) & (F.col("high") > F.col("low"))
    return out.select("fold", "pos", "n", "bad", "low", "high", "mean", "variance", F.coalesce(kept, F.lit(False)).alias("kept"), F.coalesce(F.col("variance") > LEAST_VARIANCE, F.lit(False)).alias("varying"))


def fold_scales(rows: DataFrame, vector: str, fold: str) -> DataFrame:
    """(fold, pos, centre, scale) by the values of all folds but ``fold``: median, and the 5-95 % range over that of a normal."""
    width = normal_quantile(0.95) - normal_quantile(0.05)
    counts = _long(rows, vector, fold).where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("pos", "x", "fold").agg(F.count("*").alias("n"))
    folds = rows.select(F.col(fold).alias("fold")).distinct().agg(F.collect_set("fold").alias("folds"))  # as many as folds
    by_value = counts.groupBy("pos", "x").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("own"))
    left = by_value.crossJoin(F.broadcast(folds)).select("pos", "x", "all", "own", F.explode("folds").alias("fold"))
    left = left.select("fold", "pos", "x", (F.col("all") - F.coalesce(F.try_element_at("own", F.col("fold")), F.lit(0))).alias("n")).where("n > 0")
    q = features.quantiles_of_counts(left, ["fold", "pos"], "x", [0.05, 0.5, 0.95])
    return q.select("fold", "pos", F.get("q", F.lit(1)).alias("centre"), ((F.get("q", F.lit(2)) - F.get("q", F.lit(0))) / width).alias("scale"))


def correlations(rows: DataFrame, vector: str, least: float = 0.9, fold: str | None = None, sample: float | None = None, seed: int = 42) -> DataFrame:
    """(i, j, r) of features i < j of absolute Pearson correlation ``least`` or more; with ``fold``, (fold, i, j, r) over the rows
    of all other folds. ``sample`` takes a seeded share of the rows, by a hash of the vector, so the same ones wherever they lie.

    Each task sums the products of its rows by fold and pair of blocks of features; pairs of blocks are the shuffle keys, and
    only pairs of features beyond the limit leave them. A task holds folds times features squared numbers, the driver one for
    each feature. Missing values count as the mean; features with equal values have no correlation.
    """
    rows = rows.where(F.col(vector).isNotNull())
    if sample is not None:
        rows = rows.where(F.pmod(F.xxhash64(vector, F.lit(seed)), F.lit(1 << 20)) < sample * (1 << 20))
    base = rows.select((F.col(fold) if fold else F.lit(0)).cast("string").alias("fold"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    means = base.select(F.posexplode("x").alias("pos", "x")).where(~F.isnan("x")).groupBy("pos").agg(F.avg("x").alias("mean"))
    centre = {r["pos"]: r["mean"] for r in means.collect()}  # products of what is near 0 don't cancel out
    shift = np.array([centre.get(k, 0.0) for k in range(max(centre, default=-1) + 1)])
    edges = list(range(0, len(shift), BLOCK)) + [len(shift)]
    blocks = [(a, b) for a in range(len(edges) - 1) for b in range(a, len(edges) - 1)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}
        for batch in batches:
            names = batch.column("fold").to_pylist()
            x = np.nan_to_num(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(names), len(shift)) - shift)
            for name in dict.fromkeys(names):
                part = x[[n == name for n in names]]
                own = held.setdefault(name, [0, np.zeros(len(shift)), np.zeros((len(shift), len(shift)))])
                own[0] += len(part)
                own[1] += part.sum(0)
                own[2] += part.T @ part
        for name, (n, sums, gram) in held.items():
            for k, (a, b) in enumerate(blocks):
                i, j = slice(edges[a], edges[a + 1]), slice(edges[b], edges[b + 1])
                squares = np.concatenate([sums[i], sums[j], np.diag(gram)[i], np.diag(gram)[j]])
                yield pa.RecordBatch.from_pydict({"pair": [k], "fold": [name], "n": [n], "sums": [squares.tobytes()], "gram": [np.ascontiguousarray(gram[i, j]).tobytes()]}, PRODUCTS)

    def related(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[str | None, list]] = {}
        for batch in batches:
            for k, name, n, sums, gram in zip(*(batch.column(c).to_pylist() for c in PRODUCTS.names)):
                own = held.setdefault(k, {}).setdefault(name, [0, 0.0, 0.0])
                own[:] = own[0] + n, own[1] + np.frombuffer(sums), own[2] + np.frombuffer(gram)
        for k, by_fold in held.items():
            a, b = blocks[k]
            at, to = np.arange(edges[a], edges[a + 1]), np.arange(edges[b], edges[b + 1])
            for name in by_fold:
                parts = [v for g, v in by_fold.items() if g != name or not fold]
                n = sum(v[0] for v in parts)
                if not n:
                    continue
                sums, gram = sum(v[1] for v in parts), sum(v[2] for v in parts).reshape(len(at), len(to))
                si, sj, qi, qj = np.split(sums, [len(at), len(at) + len(to), 2 * len(at) + len(to)])
                spread = lambda q, s: np.where(q / n - (s / n) ** 2 > 1e-12 * np.maximum(q / n, 1e-300), q / n - (s / n) ** 2, np.nan)  # noqa: B023, E731
                with np.errstate(invalid="ignore", divide="ignore"):
                    r = (gram / n - np.outer(si, sj) / n**2) / np.sqrt(np.outer(spread(qi, si), spread(qj, sj)))
                x, y = np.nonzero((np.abs(np.nan_to_num(r)) >= least) & (at[:, None] < to[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(at[x], pa.int32()), pa.array(to[y], pa.int32()), pa.array(r[x, y])], ["fold", "i", "j", "r"])

    packed = base.mapInArrow(products, "pair int, fold string, n bigint, sums binary, gram binary").repartition("pair")
    out = packed.mapInArrow(related, "fold string, i int, j int, r double").withColumn("r", rnd(F.col("r")))
    return out.select(F.col("fold").cast(rows.schema[fold].dataType).alias("fold"), "i", "j", "r") if fold else out.select("i", "j", "r")


def pruned(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pos): features to drop of correlated ``pairs`` (keys, i, j, r): again and again the one with most partners, then of
    higher mean absolute correlation (5 digits), then of lower index.

    In rounds: every feature that comes before all its partners goes at once. Those are the ones that the sequential order drops,
    too: as partners only get fewer, no partner of such a feature can come before it.
    """
    edges = cut(pairs.select(*keys, "i", "j", F.abs("r").alias("r")).where("i <> j"))
    out = None
    while not edges.isEmpty():
        both = edges.union(edges.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "r"))
        rank = both.groupBy(*keys, "i").agg(F.struct(F.count("*").alias("n"), rnd(F.avg("r")).alias("mean"), (-F.col("i")).alias("low")).alias("rank"))
        other = rank.select(*keys, F.col("i").alias("j"), F.col("rank").alias("of"))
        best = both.join(other, [*keys, "j"]).groupBy(*keys, "i").agg(F.max("of").alias("best"))
        gone = cut(rank.join(best, [*keys, "i"]).where("rank > best").select(*keys, F.col("i").alias("pos")))
        out = gone if out is None else out.union(gone)
        for side in "ij":
            edges = edges.join(gone.withColumnRenamed("pos", side), [*keys, side], "left_anti")
        edges = cut(edges.select(*keys, "i", "j", "r"))
    return pairs.select(*keys, F.col("i").alias("pos")).limit(0) if out is None else out


class FoldChain:
    """Masks, correlation, imputing, variance and scaling, fitted for each fold on the rows of the others."""

    def __init__(self, scale: bool, most_correlated: float = 0.9):
        self.scale, self.most = scale, most_correlated

    def fit(self, rows: DataFrame, vector: str, fold: str) -> FoldChain:
        """What comes to the driver is a row for each fold and feature."""
        stats = fold_statistics(rows, vector, fold).collect()
        masks = {(r["fold"], r["pos"]) for r in stats if r["kept"]}
        pairs = correlations(rows, vector, self.most, fold)
        allowed = rows.sparkSession.createDataFrame(sorted(masks, key=repr), pairs.select("fold", F.col("i").alias("pos")).schema)
        for side in "ij":
            pairs = pairs.join(F.broadcast(allowed.withColumnRenamed("pos", side)), ["fold", side])
        gone = {(r["fold"], r["pos"]) for r in pruned(pairs.select("fold", "i", "j", "r"), ("fold",)).collect()}
        varying = {(r["fold"], r["pos"]) for r in stats if r["varying"]}
        self.means = {(r["fold"], r["pos"]): r["mean"] for r in stats}
        self.scales = {(r["fold"], r["pos"]): (r["centre"], r["scale"]) for r in fold_scales(rows, vector, fold).collect()} if self.scale else {}
        self.kept = {f: sorted(p for g, p in masks - gone if g == f and (g, p) in varying) for f in {r["fold"] for r in stats}}
        return self

    def transform(self, rows: DataFrame, vector: str, of) -> DataFrame:
        """``rows`` with the features that the model of fold ``of`` uses, missing ones by the training mean, scaled if so fitted."""

        def value(k: int) -> Column:
            x = F.get(vector, F.lit(k)).cast("double")
            x = F.coalesce(F.when(~F.isnan(x), x), F.lit(self.means[of, k]))
            centre, scale = self.scales.get((of, k), (0.0, 1.0))
            return (x - F.lit(centre)) / F.lit(scale or 1.0)

        return rows.withColumn(vector, F.array(*map(value, self.kept[of])).cast("array<double>"))
