"""Token-rewrite rules over (name, tokens, active) and dictionary search (TOK1-28)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .ranges import cut

#: Rules that are folded into one plan before it is cut by a checkpoint.
FOLD = 50
STRINGS = "array<string>"


def wrapped(pattern: str) -> str:
    """A pattern as whole words: alone, at an end, or between white space."""
    return rf"(?U)(\A{pattern}\z|\A{pattern}\s+|\s+{pattern}\s+|\s+{pattern}\z)"


def plain(text: str) -> str:
    """A pattern for the lower-cased text itself, any white space for white space."""
    return re.sub(r"\s", r"\\s", re.sub(r"([^\w\s])", r"\\\1", text.lower()))


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


@dataclass(frozen=True)
class Rule:
    """One recorded change: kind, what it looks for, and what it puts there (parts joined by ' | ')."""

    kind: str
    find: str
    put: str = ""

    def columns(self, name: Column, tokens: Column, active: Column) -> tuple[Column, Column]:
        """New (tokens, active)."""
        find, put = self.find, self.put
        parts = F.array(*map(F.lit, put.split(" | "))).cast(STRINGS)
        word = wrapped(find)
        match self.kind:
            case "substitute_by_string":
                return F.transform(tokens, lambda x: F.when(x == find, F.lit(put)).otherwise(x)), active
            case "substitute_by_regex":
                return F.transform(tokens, lambda x: F.regexp_replace(x, word, f" {_literal(put)} ")), active
            case "extend_by_string":
                return F.when(F.array_contains(tokens, find), F.concat(F.array_remove(tokens, find), parts)).otherwise(tokens), active
            case "extend_by_regex":
                blank = F.transform(tokens, lambda x: F.regexp_replace(x, word, " "))
                return F.when(F.exists(tokens, lambda x: x.rlike(word)), F.concat(blank, parts)).otherwise(tokens), active
            case "remove_by_string":
                return F.array_remove(tokens, find), active
            case "remove_remaining_by_string":
                return F.when((F.size(tokens) == 1) & (F.get(tokens, F.lit(0)) == find), F.array().cast(STRINGS)).otherwise(tokens), active
            case "remove_by_regex":
                return F.filter(tokens, lambda x: ~x.rlike(word)), active
            case "move_by_string":
                return F.array_remove(tokens, find), F.concat(active, F.filter(tokens, lambda x: x == find))
            case "move_by_regex":
                return F.filter(tokens, lambda x: ~x.rlike(word)), F.concat(active, F.filter(tokens, lambda x: x.rlike(word)))
            case "capture_by_string":
                hits = F.filter(tokens, lambda x: x.contains(find))
                return F.transform(tokens, lambda x: F.replace(x, F.lit(find), F.lit(" "))), F.concat(active, F.transform(hits, lambda x: F.lit(find)))
            case "capture_by_regex":
                hit = lambda x: F.regexp_extract(x, word, 1)
                found = F.transform(F.filter(tokens, lambda x: x.rlike(word)), hit)
                return F.transform(tokens, lambda x: F.when(x.rlike(word), F.replace(x, hit(x), F.lit(" "))).otherwise(x)), F.concat(active, found)
            case "update_tokens":
                return F.when(name == find, parts).otherwise(tokens), active
        raise ValueError(f"no such rule: {self.kind}")


def cleaned(tokens: Column) -> Column:
    """Sorted distinct tokens, then lower-cased, trimmed, with single spaces."""
    return F.transform(F.array_sort(F.array_distinct(tokens)), lambda x: F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " ")))


def collected(rows: DataFrame) -> DataFrame:
    """Distinct (name, token)."""
    return rows.select("name", F.explode("tokens").alias("token")).distinct()


def applied(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` (name, tokens, active) after each distinct rule in turn. Plans are cut every ``FOLD`` rules."""
    for k, rule in enumerate(dict.fromkeys(rules), 1):
        tokens, active = rule.columns(F.col("name"), F.col("tokens"), F.col("active"))
        rows = rows.select("name", tokens.alias("tokens"), active.alias("active"))
        if k % FOLD == 0:
            rows = cut(rows)
    return rows


def finished_and_left(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned rows without tokens, and those that still have some."""
    rows = rows.withColumn("tokens", F.filter(cleaned(F.col("tokens")), lambda x: x != "")).withColumn("active", F.filter(cleaned(F.col("active")), lambda x: x != ""))
    return rows.where(F.size("tokens") == 0), rows.where(F.size("tokens") > 0)


def remembered(rows: DataFrame, memo: DataFrame) -> DataFrame:
    """Automatic mode: ``rows`` with the tokens that ``memo`` (token, put; one row a token) knows replaced by what it puts
    there. Every row gives one row, those without tokens and those of equal names too."""
    long = rows.select(F.monotonically_increasing_id().alias("row"), "name", "active", "tokens").select("row", "name", "active", "tokens", F.posexplode_outer("tokens").alias("at", "token"))
    long = long.drop("tokens").join(memo.select("token", "put"), "token", "left")
    words = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.coalesce("put", "token").alias("t")))))
    out = long.groupBy("row").agg(F.first("name").alias("name"), F.transform(words, lambda x: x["t"]).alias("tokens"), F.first("active").alias("active"))
    return out.drop("row")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length, rounded to 3."""
    return F.rint((1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))) * 1000) / 1000


@pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence over both lengths, rounded to 3."""

    def one(x: str, y: str) -> float | None:
        if x is None or y is None:
            return None
        masks: dict[str, int] = {}
        for k, ch in enumerate(x):
            masks[ch] = masks.get(ch, 0) | 1 << k
        s = full = (1 << len(x)) - 1
        for ch in y:
            u = s & masks.get(ch, 0)
            s = ((s + u) | (s - u)) & full
        common = len(x) - bin(s).count("1")
        return round(2 * common / max(1, len(x) + len(y)), 3)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def similar_keys(tokens: DataFrame, entries: DataFrame, least: float, k: int) -> DataFrame:
    """``similar`` over the keys of a map (entry, value), with their values."""
    return similar(tokens, entries, least, k).join(entries.select("entry", "value"), "entry").select("token", "entry", "score", "value")


def similar(tokens: DataFrame, entries: DataFrame, least: float, k: int) -> DataFrame:
    """(token, entry, score): the ``k`` most similar entries of each token, of edit similarity ``least`` or more.

    The distance of such a pair is at most d = (1 - least) of the longer length. The longer text is cut evenly into d + 1
    pieces; one of them stands whole in the shorter one, and if i pieces before it and d - i after it are touched, it is
    shifted by i at most on either side and by no more than the lengths' difference and d - i allow. Pairs meet in an
    equi-join on both lengths, piece and text; ties go by entry. No pair of such similarity is lost.
    """
    most = lambda n: F.floor(n * (1 - least) + 1e-9).cast("int")
    start = lambda n, i: F.floor(n * i / (most(n) + 1))

    def keyed(df: DataFrame, column: str) -> DataFrame:
        """Pieces of each text, for itself as the longer one, once for each length of a shorter one."""
        n = F.length(column)
        pieces = F.transform(F.sequence(F.lit(0), most(n)), lambda i: F.struct(i.alias("part"), F.substring(F.col(column), (start(n, i) + 1).cast("int"), (start(n, i + 1) - start(n, i)).cast("int")).alias("piece")))
        lengths = F.sequence(n - most(n), n)
        both = F.flatten(F.transform(lengths, lambda m: F.transform(pieces, lambda p: F.struct(n.alias("longer"), m.alias("shorter"), p["part"].alias("part"), p["piece"].alias("piece")))))
        return df.withColumn("key", F.explode(both))

    def probed(df: DataFrame, column: str) -> DataFrame:
        """Stretches of each text where a piece of a text at least as long may stand."""
        m = F.length(column)
        longest = F.floor(m / least + 1e-9).cast("int")

        def stretches(n: Column) -> Column:
            gap = n - m  # the shorter text lacks so many characters, before the piece or after it
            at = lambda i, low: F.greatest(F.lit(-1) * i, F.lit(-1) * gap - (most(n) - i)) if low else F.least(i, most(n) - i - gap)
            piece = lambda i, shift: F.struct(n.alias("longer"), m.alias("shorter"), i.alias("part"), F.substring(
                F.concat(F.repeat(F.lit("\0"), most(n)), F.col(column)), (start(n, i) + 1 + shift + most(n)).cast("int"), (start(n, i + 1) - start(n, i)).cast("int")).alias("piece"))
            of = lambda i: F.when(at(i, True) <= at(i, False), F.transform(F.sequence(at(i, True), at(i, False)), lambda shift: piece(i, shift))).otherwise(F.array())
            return F.flatten(F.transform(F.sequence(F.lit(0), most(n)), of))

        fits = F.filter(F.sequence(m, longest), lambda n: n - m <= most(n))
        return df.withColumn("key", F.explode(F.array_distinct(F.flatten(F.transform(fits, stretches)))))

    left, right = tokens.select("token").distinct(), entries.select("entry").distinct()
    pairs = keyed(left, "token").join(probed(right, "entry"), "key").select("token", "entry").union(probed(left, "token").join(keyed(right, "entry"), "key").select("token", "entry")).distinct()
    pairs = pairs.withColumn("score", edit_similarity(F.col("token"), F.col("entry"))).where(F.col("score") >= least)
    order = Window.partitionBy("token").orderBy(F.desc("score"), "entry")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def plausible(name: Column) -> Column:
    """Synonyms that look like names: at most 70 % digits, some letter, and no odd characters."""
    digits = F.length(F.regexp_replace(name, "[^0-9]", "")) / F.greatest(F.length(name), F.lit(1))
    return (digits <= 0.7) & name.rlike(r"(?=.*[a-zA-Z])\A[\da-zA-Z\s\-,.]+\z")
