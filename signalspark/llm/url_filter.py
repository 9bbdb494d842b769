"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest (operator 4).

URLs that a rule decides are the labelled ones. Trees are trained on all of them, on the length, depth, digit ratio, entropy
and parameter count of the URL and on statistics of its suffixes (share blocked and frequency of the host's last label and of
the path's first part among all labelled URLs), and decide the others. A training row's suffix statistics come from the other
folds, so that they don't tell its own label. Features are cut into bins at quantiles of all labelled URLs, and the trees
take the bins as ordered categories: for these they count every row, while they'd look for cuts of plain numbers in a sample.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, table
from .graph import hot_bound, joined

#: (host, path, verdict); fixed values of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Bins of a feature at most.
BINS = 32
#: Folds of the labelled URLs, and labelled URLs that the share of all counts for beside a suffix's own.
FOLDS, PRIOR = 5, 2.0
SUFFIXES = ("tld", "first")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "host_length", "labels", "depth", "digits", "entropy", "parameters", "hyphens", "secure", "extension", "tld_blocked", "tld_seen", "first_blocked", "first_seen"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    found = url.contains("://")
    after = F.when(found, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"(?s)\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"(?s)\A[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without any. Rules of one length are tried in order of their text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    size = F.greatest(F.length(url), F.lit(1))
    share = lambda c: F.regexp_count(url, F.lit(c)) / size
    entropy = F.aggregate(
        F.array_distinct(F.split(F.translate(url, UPPER, LOWER), "")), F.lit(0.0),
        lambda total, c: total - F.when(F.length(c) > 0, (lambda p: p * F.log2(p))((size - F.length(F.replace(F.translate(url, UPPER, LOWER), c, F.lit("")))) / size)).otherwise(0.0),
    )
    return {
        "length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "labels": F.regexp_count(host, F.lit(r"\.")).cast("double"),
        "depth": F.regexp_count(path, F.lit("/")).cast("double"), "digits": share("[0-9]"), "entropy": entropy,
        "parameters": F.regexp_count(url, F.lit("[?&][^=&#]+=")).cast("double"), "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "secure": url.startswith("https:").cast("double"), "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
    }


#: Features that come from the labels of others.
STATISTICS = tuple(f"{name}_{c}" for name in SUFFIXES for c in ("blocked", "seen"))


def statistics(n: Column, blocked: Column, mean: float) -> tuple[Column, Column]:
    """Share blocked of ``n`` labelled URLs, drawn towards the share of all, and log(1 + n)."""
    return (blocked + PRIOR * mean) / (n + PRIOR), F.log1p(n.cast("double"))


def with_statistics(rows: DataFrame, name: str, mean: float, most: int) -> DataFrame:
    """``rows`` (label, fold, the suffix ``name``, ...) with the suffix's statistics over all labelled rows and, named ``..._others``, over
    those of the other folds. ``most``: rows of a suffix beyond which its statistics are broadcast."""
    of_fold = lambda f: F.array(*(f(F.when(F.col("fold") == k, F.col("label"))) for k in range(FOLDS)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    known = table(rows.groupBy(name).agg(
        F.count("*").alias("n"), F.count("label").alias("seen"), total("label").alias("blocked"), of_fold(F.count).alias("seen_of"), of_fold(total).alias("blocked_of"),
    ), name)
    own = lambda c: F.col(c) - F.when(F.col("label").isNotNull(), F.get(f"{c}_of", F.col("fold"))).otherwise(0)
    both = (("", F.col("seen"), F.col("blocked")), ("_others", own("seen"), own("blocked")))
    found = {f"{name}_{c}{of}": v for of, n, blocked in both for c, v in zip(("blocked", "seen"), statistics(n, blocked, mean))}
    out = table(joined(rows, known, name, most).select(*rows.columns, *(v.alias(c) for c, v in found.items())), "urls")
    drop(known)
    return out


def cuts_of(train: DataFrame) -> dict[str, list[float]]:
    """Where each feature is cut into bins: quantiles of all rows, but for the least; a feature of one bin is left out."""
    at = [k / BINS for k in range(BINS)]
    found = train.agg(*(F.percentile_approx(c, at, 10_000).alias(c) for c in FEATURES)).first()
    return {c: cuts for c in FEATURES if (cuts := sorted(set(found[c]))[1:])}


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, seed: int = 7) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, block_score.

    verdict is the longest fitting rule's, else ``block`` where the trees' block_score is at least 0.5. Null URLs and URLs
    without ``://`` have an empty host and path and are judged by the trees as empty ones. Where rules give no labels all
    is allowed; where they give one label it is the method's too. Repeated rows give repeated rows, other columns are
    ignored, an empty table gives no rows.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_and_path(url)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("u"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict)
    rows = rows.withColumn("label", (F.col("by_rule") == "block").cast("double")).withColumn("fold", F.pmod(F.xxhash64("u"), F.lit(FOLDS)).cast("int"))
    # the path's first part follows a slash, so that no path and an empty first part differ
    first = F.coalesce(F.concat(F.lit("/"), F.get(F.split("path", "/", 3), F.lit(1))), F.lit(""))
    rows = rows.withColumn("tld", F.substring_index("host", ".", -1)).withColumn("first", first)
    lexicals = (c.alias(name) for name, c in lexical(F.col("u"), F.col("host"), F.col("path")).items())
    rows = table(rows.select("page_id", "host", "path", "rule", "by_rule", "label", "fold", *SUFFIXES, *lexicals), "urls")
    found = {r["by_rule"]: r["count"] for r in rows.groupBy("by_rule").count().collect()}
    seen = found.get("allow", 0) + found.get("block", 0)
    mean = found.get("block", 0) / max(1, seen)

    def verdicts(scored: DataFrame) -> DataFrame:
        method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
        return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "block_score")

    if mean in (0.0, 1.0):
        return verdicts(rows.withColumn("block_score", F.lit(mean)))
    for name in SUFFIXES:
        rows, before = with_statistics(rows, name, mean, hot_bound(sum(found.values()))), rows
        drop(before)
    train = rows.where("label is not null").select("label", *(F.col(f"{c}_others").alias(c) if c in STATISTICS else c for c in FEATURES))
    cuts = cuts_of(train)
    if not cuts:
        return verdicts(rows.withColumn("block_score", F.lit(mean)))
    bins = Bucketizer(splitsArray=[[-float("inf"), *c, float("inf")] for c in cuts.values()], inputCols=list(cuts), outputCols=[f"bin_{c}" for c in cuts])
    assemble = VectorAssembler(inputCols=bins.getOutputCols(), outputCol="features")
    binned = lambda frame: assemble.transform(bins.transform(frame))
    model = GBTClassifier(maxIter=8, maxDepth=4, maxBins=BINS, stepSize=0.3, seed=seed).fit(binned(train).select("features", "label"))
    return verdicts(model.transform(binned(rows)).withColumn("block_score", vector_to_array("probability")[1]))
