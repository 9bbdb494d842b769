"""Token rules as tables: planned from dictionary entries, written and read back, searched (TOK17, TOK20, TOK26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuzzy
from .tokens import Rule, applied, plain

SCHEMA = "place int, kind string, find string, put string"


def planned(name: str, synonyms: list[str], mixtures: dict[str, list[str]]) -> list[Rule]:
    """Rules that find a dictionary entry: its name, its synonyms for the name, its mixtures by their ingredients. Mixtures whose
    name holds the entry's are left out, as the name would be captured from them."""
    own = Rule("capture_by_regex", plain(name))
    out = [own, *(Rule("substitute_by_regex", plain(s), name) for s in synonyms), own]
    out += [Rule("extend_by_regex", plain(m), " | ".join(parts)) for m, parts in mixtures.items() if name not in m]
    return [*out, own]


def as_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(k, r.kind, r.find, r.put) for k, r in enumerate(rules)], SCHEMA)


def from_table(rules: DataFrame) -> list[Rule]:
    """The rules of a table in order; there are as many as a user has recorded."""
    return [Rule(r["kind"], r["find"], r["put"]) for r in rules.orderBy("place").collect()]


def run(rows: DataFrame, rules: DataFrame, delayed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rules still pending): rules applied at once, or put off."""
    return (rows, rules) if delayed else (applied(rows, from_table(rules)), rules.limit(0))


def plain_column(text: Column) -> Column:
    """``tokens.plain`` of a column."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)([^\w\s])", r"\\$1"), r"(?U)\s", r"\\s")


def planned_table(entries: DataFrame) -> DataFrame:
    """(name, place, kind, find, put): the rules of ``planned`` for each row of a dictionary (name, synonyms: array of texts,
    mixtures: array of structs of name and parts), as a table of any size. Null lists count as empty, rows without a name give
    no rules."""
    rule = lambda kind, find, put: F.struct(F.lit(kind).alias("kind"), plain_column(find).alias("find"), put.alias("put"))
    own = F.array(rule("capture_by_regex", F.col("name"), F.lit("")))
    other = F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda x: rule("substitute_by_regex", x, F.col("name")))
    mixed = F.filter("mixtures", lambda x: ~x["name"].contains(F.col("name")))
    mixed = F.coalesce(F.transform(mixed, lambda x: rule("extend_by_regex", x["name"], F.array_join(x["parts"], " | "))), F.array().cast("array<struct<kind:string,find:string,put:string>>"))
    rows = entries.where("name is not null").select("name", F.posexplode(F.concat(own, other, own, mixed, own)).alias("place", "rule"))
    return rows.select("name", "place", "rule.*")


def search(rules: DataFrame, tokens: DataFrame, least: float = 0.85, k: int = 3) -> DataFrame:
    """(token, kind, find, put, hit, score): distinct rules that look for a token as it is or as a pattern (``exact``), else those
    that look for a text with the token in it (``part``), else those whose texts are the ``k`` most similar to the token's pattern
    (``similar``, by the fuzzy ratio). Tokens that find nothing give no row; null ones take no part.

    Parts are found by an equi-join with all stretches of the rules' texts, so neither table has to be small.
    """
    rules = rules.select("kind", "find", "put").distinct()
    asked = tokens.select("token").where("token is not null").distinct()
    forms = asked.select("token", F.explode(F.array_distinct(F.array(F.lower("token"), plain_column(F.col("token"))))).alias("form"))
    n = F.length("find")
    stretches = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda m: F.substring("find", i, m))))
    texts = rules.select("find").where(n > 0).distinct()
    inside = texts.select("find", F.explode(F.array_distinct(stretches)).alias("form")).join(forms, "form").withColumn("same", F.col("form") == F.col("find"))
    found = inside.groupBy("token", "find").agg(F.max("same").alias("same"))
    best = found.groupBy("token").agg(F.max("same").alias("best"))
    known = found.join(best, "token").where("same = best").select("token", "find", F.when(F.col("same"), "exact").otherwise("part").alias("hit"), F.lit(1.0).alias("score"))
    rest = asked.join(best, "token", "left_anti").withColumn("form", plain_column(F.col("token")))
    near = fuzzy.similar(rest.select(F.col("form").alias("token")), texts.select(F.col("find").alias("entry")), least, k).withColumnsRenamed({"token": "form", "entry": "find"})
    near = rest.join(near, "form").select("token", "find", F.lit("similar").alias("hit"), "score")
    return known.union(near).join(rules, "find").select("token", "kind", "find", "put", "hit", "score")
