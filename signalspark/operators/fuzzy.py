"""Similarity join by the fuzzy ratio, twice the longest common subsequence over both lengths (TOK22-26, JOIN13, JOIN16).

Two texts of m and n characters reach the ratio t only if L = t (m + n) / 2 characters of theirs are common, as multisets, too. So
each text is a set of characters numbered among their equals, in one order from rare to frequent: texts that share L of them
share three of their first m - L + 3, for the least L that any partner may have. Texts meet in an equi-join on such triples,
then lengths and the exact ratio decide. No pair is lost, whatever t is.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType

from .tokens import indel_ratio

#: Numbered characters whose order follows their frequency; others are rarer and come first.
FREQUENT = 1000
#: Characters in a key, and the odd multiplier of its hash.
MOST, MULTIPLIER = 3, 0x9E3779B97F4A7C15
#: Scores are rounded to three digits before they are compared.
ROUNDING = 0.0005


def numbered_characters(text: str) -> list[str]:
    """Each character with the number of equal ones before it."""
    seen: Counter = Counter()
    out = []
    for x in text:
        out.append(f"{x}{seen[x]}")
        seen[x] += 1
    return out


@pandas_udf(ArrayType(StringType()))
def _characters(text: pd.Series) -> pd.Series:
    return text.map(numbered_characters)


def needed(m: int, n: int, least: float) -> int:
    """Common characters that texts of m and n characters need."""
    return max(1, math.ceil((least - ROUNDING) * (m + n) / 2 - 1e-9))


def least_needed(m: int, least: float) -> int:
    """Common characters that a text of m characters needs with its shortest possible partner."""
    return next(needed(m, n, least) for n in range(1, m + 1) if needed(m, n, least) <= n)


def join_keys(text: str, rank: dict[str, int], least: float) -> list[int]:
    """Keys of a text: triples among its first characters, and pairs and single ones where a partner might share no more than
    two or one. Keys are hashes; equal ones of different characters only make more candidates."""
    m = len(text)
    if not m:
        return []
    need = least_needed(m, least)
    order = sorted(numbered_characters(text), key=lambda x: (rank.get(x, -1), x))
    number = [rank[x] if x in rank else FREQUENT + zlib.crc32(x.encode()) for x in order]
    out = set()
    for size in range(min(need, MOST), MOST + 1):
        for some in combinations(number[: m - max(need, size) + size], size):
            key = size
            for x in some:
                key = (key * MULTIPLIER + x) & (1 << 63) - 1
            out.add(key)
    return sorted(out)


def _ranks(texts: DataFrame) -> dict[str, int]:
    """Places of the most frequent numbered characters, at most ``FREQUENT``, the most frequent last."""
    counts = texts.select(F.explode(_characters("text")).alias("x")).groupBy("x").count().orderBy(F.desc("count"), "x").limit(FREQUENT)
    found = [r["x"] for r in counts.collect()]
    return {x: len(found) - k for k, x in enumerate(found)}


def candidates(tokens: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """Distinct (token, entry) that may reach the ratio ``least``."""
    left, right = (df.select(F.col(c).alias("text")).where(f"{c} <> ''").distinct() for df, c in ((tokens, "token"), (entries, "entry")))
    rank = _ranks(left.union(right))

    @pandas_udf(ArrayType(LongType()))
    def keys(text: pd.Series) -> pd.Series:
        return text.map(lambda x: join_keys(x, rank, least))

    side = lambda df, name: df.select(F.col("text").alias(name), F.explode(keys("text")).alias("key"))
    m, n = F.length("token"), F.length("entry")
    fits = F.least(m, n) * 2 >= (least - ROUNDING) * (m + n) - 1e-9
    return side(left, "token").join(side(right, "entry"), "key").where(fits).select("token", "entry").distinct()


def similar(tokens: DataFrame, entries: DataFrame, least: float = 0.75, k: int = 3) -> DataFrame:
    """(token, entry, score): the ``k`` entries of the highest fuzzy ratio to each token, of those that reach ``least``.

    Equal scores go by entry; repeated tokens and entries count once; null and empty texts match nothing. The keys of a text grow
    with the cube of a part of its length (a third, at 0.8): it is meant for names, not for documents.
    """
    pairs = candidates(tokens, entries, least).withColumn("score", indel_ratio("token", "entry")).where(F.col("score") >= least)
    order = Window.partitionBy("token").orderBy(F.desc("score"), "entry")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def similar_keys(tokens: DataFrame, entries: DataFrame, least: float = 0.85, k: int = 3) -> DataFrame:
    """``similar`` over the keys of a map (entry, value), with their values."""
    return similar(tokens, entries, least, k).join(entries.select("entry", "value"), "entry").select("token", "entry", "score", "value")


def searched(tokens: DataFrame, aliases: DataFrame, least: float = 0.80, k: int = 3) -> DataFrame:
    """(token, entry, status, score) of every distinct token: by the name of an entry (0), by another alias (1), by the names
    of the ``k`` most similar entries (2), or without an entry (3).

    ``aliases`` has (alias, entry, priority), priority 0 for the entry's own name and 1 for its synonyms, brands and mixtures.
    A token that names an entry isn't looked up any further; several synonyms may fit. Null tokens take no part.
    """
    tokens = tokens.select("token").where("token is not null").distinct()
    hits = tokens.join(aliases, F.col("token") == F.col("alias"))
    best = hits.groupBy("token").agg(F.min("priority").alias("priority"))
    exact = hits.join(best, ["token", "priority"]).select("token", "entry", F.col("priority").cast("int").alias("status"), F.lit(1.0).alias("score")).distinct()
    rest = tokens.join(best, "token", "left_anti")
    near = similar(rest, aliases.where("priority = 0").select(F.col("alias").alias("entry")), least, k)
    near = rest.join(near, "token", "left").select("token", "entry", F.when(F.col("entry").isNull(), 3).otherwise(2).alias("status"), "score")
    return exact.union(near)


def distinct_words(text: Column) -> Column:
    """Distinct lower-cased words of letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)))
