"""Parsing and filtering of case reports (PRJ1-14), demographic classes (PRJ6, AGG6, WGT1-4), dictionaries (PRJ16-19)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd, to_number
from .ranges import cut, numbered


@dataclass(frozen=True)
class Inclusion:
    """Limits of a run: primary suspects, suspects, reactions."""

    max_ps: int | None = None
    max_drugs: int | None = None
    max_reactions: int = 20


PRIMARY, SECONDARY = Inclusion(max_ps=1), Inclusion(max_drugs=10)
DRUG = "array<struct<seq:int,role:string,name:string>>"
INDICATION = "array<struct<seq:int,name:string>>"


#: A quoted text with escapes, a tuple's inside (quoted texts, or anything but quotes and brackets), and a field of it.
QUOTED = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""
TUPLE = rf"""(?s)\(((?:{QUOTED}|[^()\[\]{{}}'"])*)\)"""
FIELD = rf"""(?s){QUOTED}|[^,'"\s][^,'"]*"""
#: Escapes and what lies between them; what the letters of escapes stand for (fixed values of the notation).
ESCAPES = r"(?s)\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[^\\]+"
LETTERS = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def unescaped(text: Column) -> Column:
    """Escapes of a quoted text replaced: letters, \\xhh and \\uhhhh; of others the backslash goes."""
    code = lambda digits: F.decode(F.unhex(digits), "UTF-16BE")

    def one(x: Column) -> Column:
        letter = F.substring(x, 2, 1)
        out = F.when(~x.startswith("\\"), x).when(x.rlike(r"\A\\x[0-9a-fA-F]{2}"), code(F.concat(F.lit("00"), F.substring(x, 3, 2)))).when(x.rlike(r"\A\\u[0-9a-fA-F]{4}"), code(F.substring(x, 3, 4)))
        for name, value in LETTERS.items():
            out = out.when(letter == name, F.lit(value))
        return out.otherwise(letter)

    return F.when(text.contains("\\"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(ESCAPES), F.lit(0)), one), "")).otherwise(text)


def parsed_tuples(text: Column, schema: str) -> Column:
    """A list of tuples written as text, e.g. ``[(1, 'PS', 'a (b)')]``, as an array of structs; null where it isn't one, as for a
    list of lists, and for tuples that hold tuples, lists or maps.

    Texts stand in quotes of either kind, with escapes, and may hold brackets, commas and the other quotes. ``None``
    is null. Fields go by position; missing ones are null.
    """
    fields = [f.split(":") for f in schema.removeprefix("array<struct<").removesuffix(">>").split(",")]
    inside = F.regexp_extract_all(text, F.lit(TUPLE), F.lit(1))
    bare = lambda x: unescaped(F.substring(x, F.lit(2), F.length(x) - 2))
    value = lambda x: F.when(x.rlike("^['\"]"), bare(x)).when(F.trim(x) != "None", F.trim(x))
    parts = F.transform(inside, lambda r: F.transform(F.regexp_extract_all(r, F.lit(FIELD), F.lit(0)), value))
    rows = F.transform(parts, lambda r: F.struct(*(F.get(r, F.lit(k)).try_cast(kind).alias(n) for k, (n, kind) in enumerate(fields))))
    frame = F.regexp_replace(F.regexp_replace(text, TUPLE, "\x01"), r"\s", "")  # a list of tuples is marks and commas
    return F.when(frame.rlike("\\A\\[(?:\x01,)*\x01?\\]\\z"), rows)


def with_indications(drugs: Column, indications: Column) -> Column:
    """Each drug with the last indication of its seq, '' without."""
    last = lambda seq: F.element_at(F.transform(F.filter(F.coalesce(indications, F.array().cast(INDICATION)), lambda i: i["seq"] == seq), lambda i: i["name"]), -1)
    known = lambda seq: F.exists(F.coalesce(indications, F.array().cast(INDICATION)), lambda i: i["seq"] == seq)
    return F.transform(drugs, lambda d: F.struct(d["seq"], d["role"], d["name"], F.when(known(d["seq"]), last(d["seq"])).otherwise("").alias("indication")))


def split_terms(text: Column) -> Column:
    return F.transform(F.split(text, ":"), lambda x: F.trim(F.lower(x)))


def age_group(months: Column) -> Column:
    return F.when((months >= 0) & (months < 144), "Children").when((months >= 144) & (months < 252), "Adolescent").when((months >= 252) & (months < 780), "Adult").when((months >= 780) & (months < 1200), "Elderly")


def mapped_terms(reports: DataFrame, key: str, terms: str, mapping: DataFrame) -> DataFrame:
    """``reports`` with the sorted distinct mapped terms (``mapping``: term, mapped); unmapped ones go, none left is an empty array."""
    long = reports.select(key, F.explode(terms).alias("term")).join(mapping, "term").groupBy(key).agg(F.array_sort(F.collect_set("mapped")).alias("mapped"))
    return reports.join(long, key, "left").withColumn(terms, F.when(F.col(terms).isNotNull(), F.coalesce("mapped", F.array().cast("array<string>")))).drop("mapped")


def primary(drugs: Column) -> Column:
    """Primary suspects; null if none."""
    kept = F.filter(drugs, lambda d: d["role"] == "PS")
    return F.when(F.size(kept) > 0, kept)


def suspects(drugs: Column) -> Column:
    """Primary suspects, and secondary ones that aren't named as primary earlier in the list; null if none."""
    earlier = lambda i, name: F.exists(F.slice(drugs, 1, i), lambda p: (p["role"] == "PS") & (p["name"] == name))
    kept = F.filter(drugs, lambda d, i: (d["role"] == "PS") | ((d["role"] == "SS") & ~earlier(i, d["name"])))
    return F.when(F.size(kept) > 0, kept)


def role_count(drugs: Column, role: str, roles: tuple[str, ...] = ("PS", "SS", "C", "I")) -> Column:
    """Drugs by name, each counted under its first recognised role."""
    known = F.filter(drugs, lambda d: d["role"].isin(*roles))
    first = F.filter(known, lambda d, i: ~F.exists(F.slice(known, 1, i), lambda p: p["name"] == d["name"]))
    return F.coalesce(F.size(F.filter(first, lambda d: d["role"] == role)), F.lit(0))


def included(reports: DataFrame, run: Inclusion) -> DataFrame:
    """Reports (report, drugs, reactions, ...) within a run's limits, one row for each of its suspects."""
    ps, ss = role_count(F.col("drugs"), "PS"), role_count(F.col("drugs"), "SS")
    n = F.coalesce(F.size("reactions"), F.lit(0))
    keep = (n > 0) & (n <= run.max_reactions) & (ps + ss > 0)
    if run.max_ps is not None:
        keep = keep & (ps <= run.max_ps)
    if run.max_drugs is not None:
        keep = keep & (ps + ss <= run.max_drugs)
    chosen = primary if run.max_ps is not None else suspects
    rows = reports.where(keep).withColumn("drugs", chosen(F.col("drugs")))
    return rows.withColumn("drug", F.explode_outer("drugs")).drop("drugs").withColumns({"role": F.col("drug.role"), "drug": F.col("drug.name")})


def quantile_table(rows: DataFrame, value: str, keys: list[str], levels: list[float], n: str | None = None) -> DataFrame:
    """Interpolated quantiles q of ``value`` by keys, rounded to 3; null values and keys take no part. ``n`` names a column with
    the number of rows that each row stands for."""
    kept = rows.where(F.col(value).isNotNull())
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    return kept.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, levels)), F.col(n) if n else 1).alias("q")).withColumn("q", F.transform("q", lambda x: rnd(x, 3)))


def weight_class(value: Column, q: Column) -> Column:
    """Unknown up to q0, Low, Average, High up to q1, q2, q3, then Unknown."""
    at = lambda k: F.get(q, F.lit(k))
    out = F.when(value <= at(0), "Unknown").when(value <= at(1), "Low").when(value <= at(2), "Average").when(value <= at(3), "High")
    return F.coalesce(out, F.lit("Unknown"))


def enclosing_mean(value: Column, tables: Column) -> Column:
    """Element-wise mean of the quantile arrays whose range holds the value; null if none."""
    fits = F.filter(tables, lambda q: (F.get(q, F.lit(0)) <= value) & (value <= F.get(q, F.lit(3))))
    total = lambda k: F.aggregate(F.transform(fits, lambda q: F.get(q, F.lit(k))), F.lit(0.0), lambda t, x: t + x)
    mean = F.array(*(total(k) / F.nullif(F.size(fits), F.lit(0)) for k in range(4)))
    return F.when(F.size(fits) > 0, mean)


def weight_classes(rows: DataFrame, value: str, age: str, sex: str) -> DataFrame:
    """``rows`` with weight_class: by the quantiles of (age, sex), of age, or of all groups of the sex, or of all, that hold
    the value, whichever is known. The quantile tables are a row for each group, so they are broadcast."""
    narrow, wide = [0.05, 1 / 3, 2 / 3, 0.95], [0.1, 1 / 3, 2 / 3, 0.9]
    counts = cut(rows.where(F.col(value).isNotNull()).groupBy(age, sex, value).agg(F.count("*").alias("n")))  # all tables come from these
    both = quantile_table(counts, value, [age, sex], narrow, "n").withColumnRenamed("q", "q1")
    by_age = quantile_table(counts, value, [age], narrow, "n").withColumnRenamed("q", "q2")
    by_sex = quantile_table(counts, value, [sex, age], wide, "n").groupBy(sex).agg(F.array_sort(F.collect_list("q")).alias("q3"))
    every = quantile_table(counts, value, [age], wide, "n").agg(F.array_sort(F.collect_list("q")).alias("q4"))
    out = rows.join(F.broadcast(both), [age, sex], "left").join(F.broadcast(by_age), age, "left").join(F.broadcast(by_sex), sex, "left").crossJoin(F.broadcast(every))
    v = F.col(value)
    q = F.when(F.col(age).isNotNull() & F.col(sex).isNotNull(), F.col("q1")).when(F.col(age).isNotNull(), F.col("q2"))
    q = q.when(F.col(sex).isNotNull(), enclosing_mean(v, F.col("q3"))).otherwise(enclosing_mean(v, F.col("q4")))
    return out.withColumn("weight_class", F.when(v.isNull(), "Unknown").otherwise(weight_class(v, q))).drop("q1", "q2", "q3", "q4")


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """(value, code) of the distinct values, numbered from 0 in order."""
    return numbered(rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct(), [F.col("value")], "code")


def encoded(rows: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """``column`` replaced by its code; values without one go."""
    return rows.join(codes, rows[column] == codes["value"]).drop(column, "value").withColumnRenamed("code", column)


def decoded(rows: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """``column`` of codes replaced by their values; codes without one go."""
    return rows.join(codes, rows[column] == codes["code"]).drop(column, "code").withColumnRenamed("value", column)


def actives(text: Column, mapping: Column) -> Column:
    """Names split at ' : ' and looked up in a map, 'Missing' by default; null if all are missing."""
    found = F.transform(F.split(text, " : "), lambda x: F.coalesce(F.try_element_at(mapping, x), F.lit("Missing")))
    return F.when(F.exists(found, lambda x: x != "Missing"), found)


def complete(found: Column) -> Column:
    """1 iff a list without 'Missing'."""
    return F.when(found.isNotNull() & ~F.array_contains(found, "Missing"), 1).otherwise(0)
