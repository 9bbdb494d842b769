"""Compositions: raw reports to decided rows with folds (PRJ7, WGT4, PRJ18, PRJ22), feature chain (FEA8-10), comparisons
(STA3, STA7), evaluation by fold (ML7), counterfactuals by fold (DIF2-3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd, to_number
from . import features, folds, models, reports, scoring, stats
from .folds import FoldChain
from .ranges import cut

#: Descriptors whose features are binary and stay unscaled, and the others (fixed values).
BINARY, CONTINUOUS = ("Morgan", "MACCS", "Klek"), ("CDDD", "ChemBERTa", "RDKit")


def to_date(text: Column) -> Column:
    """A ``yyyy-MM-dd`` text as a date; null where it isn't one."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def prepared(raw: DataFrame) -> DataFrame:
    """Raw reports, all texts, with parsed drugs and their indications, dates, reactions, numbers and age groups."""
    months = to_number(F.col("age_months"))
    raw = raw.withColumns({"drugs": reports.parsed_tuples(F.col("drugs"), reports.DRUG), "indications": reports.parsed_tuples(F.col("indications"), reports.INDICATION)})
    raw = cut(raw)  # else every later look at a list parses it again
    drugs = reports.with_indications(F.col("drugs"), F.col("indications"))
    return raw.select(
        F.col("primaryid").cast("bigint").alias("report"), to_date(F.col("event_dt")).alias("event_dt"), to_date(F.col("fda_dt")).alias("fda_dt"), F.col("sex").cast("string").alias("sex"),
        months.alias("age_months"), reports.age_group(months).alias("age_group"), to_number(F.col("weight_kg")).alias("weight_kg"), reports.split_terms(F.col("reactions")).alias("reactions"), drugs.alias("drugs"),
    )


def with_actives(rows: DataFrame, token_map: DataFrame) -> DataFrame:
    """``rows`` (drug, ...) with weight class, unknown demographics named, and the active ingredients of ``token_map`` (drug,
    active); rows without reactions or actives go."""
    rows = reports.weight_classes(rows, "weight_kg", "age_group", "sex").withColumnRenamed("weight_class", "weight")
    unknown = {c: F.coalesce(c, F.lit("Unknown")) for c in ("sex", "age_group", "weight")}
    rows = rows.withColumns(unknown).drop("event_dt", "fda_dt", "age_months", "weight_kg")
    return rows.join(token_map.select("drug", "active"), "drug").where("reactions is not null and active is not null")


def with_structures(rows: DataFrame, structures: DataFrame) -> DataFrame:
    """``rows`` whose actives (joined by ' : ') are all named in ``structures`` (name, structure), with the list of theirs; each
    distinct text of actives is looked up once. Demographics get their final names."""
    texts = rows.select("active").distinct()
    long = texts.select("active", F.posexplode(F.split("active", " : ")).alias("at", "name")).join(structures.select("name", "structure"), "name", "left")
    found = long.groupBy("active").agg(F.array_sort(F.collect_list(F.struct("at", "structure"))).alias("s"), F.count_if(F.col("structure").isNull()).alias("missing"))
    found = found.where("missing = 0").select("active", F.transform("s", lambda x: x["structure"]).alias("structures"))
    return rows.join(found, "active").drop("drug", "indication").withColumnsRenamed({"age_group": "Age", "sex": "Sex", "weight": "Weight"})


def with_folds(rows: DataFrame, folds: DataFrame, key: str, **identity: str) -> tuple[DataFrame, Column]:
    """``rows`` with cluster and fold of ``folds`` (key, cluster, fold) and named columns of constants, and an expression that
    counts the rows without a fold."""
    out = rows.join(folds.select(key, F.col("cluster").cast("int").alias("cluster"), F.col("fold").cast("int").alias("fold")), key, "left")
    return out.withColumns({k: F.lit(v) for k, v in identity.items()}), F.count_if(F.col("fold").isNull())


def reports_to_rows(raw: DataFrame, run: reports.Inclusion, terms: DataFrame, token_map: DataFrame, structures: DataFrame) -> DataFrame:
    """Steps 1 to 4: one row for each suspect drug of an included report, with mapped reactions, demographics and structures."""
    mapped = reports.mapped_terms(prepared(raw), "report", "reactions", terms)
    rows = cut(reports.included(mapped, run))  # the weight quantiles read it five times
    return with_structures(with_actives(rows, token_map), structures)


class FeatureChain:
    """Masks, correlation, imputing, variance and scaling, fitted on training rows and applied in that order."""

    def __init__(self, descriptors: str, most_correlated: float = 0.9):
        if descriptors not in BINARY + CONTINUOUS:
            raise ValueError(f"unknown descriptors: {descriptors}")
        self.scale, self.most = descriptors in CONTINUOUS, most_correlated

    def checked(self, rows: DataFrame, key: str, vector: str) -> DataFrame:
        """``rows``, if their vectors are all of one length; what comes to the driver is two numbers."""
        low, high = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
        if low != high:
            raise ValueError(f"vectors of {low} to {high} features")
        return rows.select(key, F.transform(vector, lambda x: x.cast("double")).alias(vector))

    def fit(self, rows: DataFrame, key: str, vector: str) -> FeatureChain:
        rows = self.checked(rows, key, vector)
        kept = [r["pos"] for r in features.feature_masks(rows, vector).where("kept").collect()]  # one row a feature here and below
        pairs = folds.correlations(features.picked(rows, key, vector, sorted(kept)), vector, self.most)
        dropped = {sorted(kept)[r["pos"]] for r in folds.pruned(pairs).collect()}
        kept = sorted(set(kept) - dropped)
        self.means = {r["pos"]: r["mean"] for r in features.long_vectors(rows, key, vector).where("not isnan(x)").groupBy("pos").agg(F.avg("x").alias("mean")).collect()}
        varying = {r["pos"] for r in features.varying(rows, vector).where("kept").collect()}
        self.kept = [k for k in kept if k in varying]
        self.scales = {r["pos"]: (r["centre"], r["scale"]) for r in features.robust_scales(rows, vector).collect()} if self.scale else {}
        return self

    def transform(self, rows: DataFrame, key: str, vector: str) -> DataFrame:
        """(key, vector) of the kept features, missing ones by their mean, scaled if the descriptors are continuous."""
        rows = self.checked(rows, key, vector)

        def value(k: int) -> Column:
            x = F.get(vector, F.lit(k))
            x = F.coalesce(F.when(~F.isnan(x), x), F.lit(self.means.get(k)).cast("double"))
            centre, scale = self.scales.get(k, (0.0, 1.0))
            return rnd((x - centre) / (scale or 1.0)) if self.scale else x

        return rows.select(key, F.array(*map(value, self.kept)).alias(vector))


def compared(long: DataFrame, group: str, pairs: list[tuple[str, str]], index: list[str], value: str = "value", alpha: float = 0.01) -> DataFrame:
    """One row for each pair of levels of ``group``: null_hypothesis, null_rejected, outcome, effect_size, w_stat, p_value and
    r_stat of the paired test over rows that agree in ``index``, with Holm's adjusted_p over the pairs."""
    levels = sorted({x for p in pairs for x in p})
    wide = long.groupBy(*index).pivot(group, levels).agg(F.first(value))
    both = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs)))
    tests = stats.signed_rank(wide.select(both.alias("p")).select("p.*"), ["a", "b"], "x", "y")
    rejected = F.col("p_value") < alpha
    sign = F.when(rejected & (F.col("rank_biserial") > 0), ">").when(rejected & (F.col("rank_biserial") < 0), "<").otherwise("==")
    out = tests.select(
        F.concat_ws(" == ", "a", "b").alias("null_hypothesis"), rejected.alias("null_rejected"), F.concat_ws(" ", "a", sign, "b").alias("outcome"),
        F.col("effect").alias("effect_size"), F.col("statistic").alias("w_stat"), "p_value", F.col("rank_biserial").alias("r_stat"),
    )
    return stats.holm(out, alpha=alpha, tie="null_hypothesis").drop("rejected")


def evaluated(kind: str, rows: DataFrame, fold: str, dims: list[str], label: str = "y", weight: str = "weight", chain: FoldChain | None = None, vector: str = "embedding", **params) -> DataFrame:
    """Scores by fold, Train or Eval, Unweighted or Weighted, in all and by each value of ``dims``: one model a fold. With a
    ``chain``, a fold's model is given the features of ``vector`` as the chain has them for that fold; else the column x."""
    parts = []
    for f in [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]:  # as many models as folds
        own = models.training_rows(chain.transform(rows, vector, f), vector) if chain else rows
        model = models.fitted(kind, own.where(F.col(fold) != f), label, weight, **params)
        part = models.predicted(model, own).withColumn("split", F.when(F.col(fold) == f, "Eval").otherwise("Train"))
        parts.append(part.select(F.lit(f).alias("fold_out"), "split", label, "y_score", weight, *dims))
    return evaluation_scores(reduce(DataFrame.unionByName, parts), ["fold_out", "split"], dims, label, weight)


def evaluation_scores(rows: DataFrame, keys: list[str], dims: list[str], label: str, weight: str) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(k).alias("weighting"), w.alias("w")) for k, w in (("Unweighted", F.lit(1.0)), ("Weighted", F.col(weight).cast("double")))))
    groups = F.array(F.struct(F.lit("Total").alias("kind"), F.lit("Total").alias("value")), *(F.struct(F.lit(d).alias("kind"), F.col(d).cast("string").alias("value")) for d in dims))
    long = rows.withColumn("k", F.explode(kinds)).withColumn("g", F.explode(groups)).select(*keys, label, "y_score", "k.*", "g.*")
    return scoring.scores(long, [*keys, "weighting", "kind", "value"], y=label, w="w")


def counterfactual_cases(rows: DataFrame, key: str, demographics: str, fold: str, blocks: dict[str, list[str]]) -> DataFrame:
    """(key, fold, category, value, base, changed): for each fold, its distinct keys with the mean demographics of the other
    folds, and those with one category of ``blocks`` set to each of its values."""
    long = rows.select(fold, F.posexplode(demographics).alias("pos", "x"))
    sums = long.groupBy(fold, "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))  # one row a fold and position
    other = sums.select(F.col(fold).alias("g"), "pos", "s", "n")
    means = sums.select(fold).distinct().join(other, F.col(fold) != F.col("g")).groupBy(fold, "pos").agg((F.sum("s") / F.sum("n")).alias("mean"))
    base = means.groupBy(fold).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("base"))
    cases = rows.select(key, fold).distinct().join(F.broadcast(base), fold)
    start, options = 0, []
    for category, values in blocks.items():
        options += [(category, v, start + k, start, start + len(values)) for k, v in enumerate(values)]
        start += len(values)
    option = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.lit(v).alias("value"), F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(e).alias("e")) for c, v, k, s, e in options)))
    set_one = F.transform("base", lambda x, i: F.when(i == F.col("o.k"), F.lit(1.0)).when((i >= F.col("o.s")) & (i < F.col("o.e")), F.lit(0.0)).otherwise(x))
    return cases.withColumn("o", option).select(key, fold, "o.category", "o.value", "base", set_one.alias("changed"))


def counterfactuals_by_fold(rows: DataFrame, key: str, demographics: str, fold: str, blocks: dict[str, list[str]], predict) -> DataFrame:
    """(key, fold, category, value, difference) of ``counterfactual_cases``. ``predict`` maps (key column, demographic vector) to a
    score."""
    cases = counterfactual_cases(rows, key, demographics, fold, blocks)
    return cases.select(key, fold, "category", "value", rnd(predict(F.col(key), F.col("changed")) - predict(F.col(key), F.col("base"))).alias("difference"))


def counterfactuals_of_models(kind: str, rows: DataFrame, key: str, vector: str, demographics: str, fold: str, blocks: dict[str, list[str]], label: str = "y", weight: str = "weight", **params) -> tuple[DataFrame, dict]:
    """(key, fold, category, value, difference) by fitted models, and the model of each fold, which hasn't seen the fold's rows.

    Cases and the mean demographics they start from are scored by the model of their fold, whatever its kind: features and
    demographics in one vector, a row for each case. ``rows`` has one feature vector a key.
    """
    cases = counterfactual_cases(rows, key, demographics, fold, blocks)
    texts = rows.groupBy(key, fold).agg(F.first(vector).alias(vector))  # keys may repeat
    cases = cut(cases.join(texts, [key, fold]))
    parts, fitted = [], {}
    for f in [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]:  # as many models as folds
        fitted[f] = models.fitted(kind, models.training_rows(rows.where(F.col(fold) != f), vector, demographics), label, weight, **params)
        own = cases.where(F.col(fold) == f)
        score = lambda c, own, f=f: models.predicted(fitted[f], models.training_rows(own, vector, c)).drop("x").withColumnRenamed("y_score", f"s_{c}")
        parts.append(score("base", score("changed", own)))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(key, fold, "category", "value", rnd(F.col("s_changed") - F.col("s_base")).alias("difference")), fitted


def mean_differences(differences: DataFrame, key: str) -> DataFrame:
    """(category, value, difference) over all keys, of each key's mean over folds and models first."""
    each = differences.groupBy(key, "category", "value").agg(F.avg("difference").alias("d"))
    return each.groupBy("category", "value").agg(rnd(F.avg("d")).alias("difference"))
