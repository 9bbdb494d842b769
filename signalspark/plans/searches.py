"""Queries of fuzzy search, rules planned from dictionaries, and the search of rules, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fuzzy, tables_of_rules
from .cases import of
from .registry import query

#: Fuzzy ratio of {a} and {b}, from rows of the table of longest common subsequences, one for each character of {a}.
_RATIO = """round_even(2.0::double * list_max(list_reduce(string_split({a}, ''), lambda t, x: [0] || list_transform(range(1, length({b}) + 1), lambda j: list_max(list_transform(range(1, j + 1),
  lambda i: greatest(t[i + 1], case when {b}[i] = x then t[i] + 1 else 0 end)))), list_transform(range(0, length({b}) + 1), lambda z: 0))) / (length({a}) + length({b})) * 1000, 0) / 1000"""
_BEST = "row_number() over (partition by token order by score desc, entry)"


@query(f"with a as (select distinct p_name as token from part), p as (select a.token, b.token as entry, {_RATIO.format(a='a.token', b='b.token')} as score from a, a b), k as (select *, {_BEST} as n from p where score >= 0.8) select token, entry, score from k where n <= 3")
def fuzzy_topk(spark, sf_dir):
    """The three names most similar to each name."""
    names = of(spark, sf_dir, "part").select("p_name").distinct()
    return fuzzy.similar(names.select(F.col("p_name").alias("token")), names.select(F.col("p_name").alias("entry")), 0.8, 3)


@query()
def fuzzy_words(spark, sf_dir):
    """The three words of the benchmark most similar to each word of the documents that it doesn't have."""
    word = lambda table: of(spark, sf_dir, table).select(F.explode(fuzzy.distinct_words(F.col("text"))).alias("word")).distinct()
    known = word("benchmark")
    asked = word("documents").join(known, "word", "left_anti")
    return fuzzy.similar(asked.select(F.col("word").alias("token")), known.select(F.col("word").alias("entry")), 0.85, 3)


@query(f"""with a as (select distinct p_name as token from part), names as (select token as alias, token as entry from a where length(token) % 2 = 0), brands as (select token as alias, entry from a, (values ('gear'), ('cog')) v(entry) where token like '%gear'),
exact as (select token, entry, 0 as status from a join names on token = alias), other as (select token, entry, 1 as status from a join brands on token = alias where token not in (select token from exact)),
rest as (select token from a where token not in (select token from exact union all select token from other)),
p as (select token, entry, {_RATIO.format(a='token', b='entry')} as score from rest, names), k as (select *, {_BEST} as n from p where score >= 0.8)
select token, entry, status, 1.0::double as score from (from exact union all from other) union all select rest.token, entry, case when entry is null then 3 else 2 end, score from rest left join (from k where n <= 3) using (token)""")
def exact_then_fuzzy(spark, sf_dir):
    """By name, by other alias (two entries have each), by similar names, or without an entry."""
    names = of(spark, sf_dir, "part").select(F.col("p_name").alias("token")).distinct()
    own = names.where(F.length("token") % 2 == 0).select(F.col("token").alias("alias"), F.col("token").alias("entry"), F.lit(0).alias("priority"))
    brands = names.where(F.col("token").endswith("gear")).select(F.col("token").alias("alias"), F.explode(F.array(F.lit("gear"), F.lit("cog"))).alias("entry"), F.lit(1).alias("priority"))
    return fuzzy.searched(names, own.union(brands), 0.8, 3)


_PLAIN = r"replace(replace(lower({0}), '#', '\#'), ' ', '\s')"
_PLANNED_SQL = f"""with e as (select lower(p_type) as name, list_sort(list_distinct(list(lower(p_brand)))) as synonyms, list_sort(list_distinct(list(p_name) filter (not contains(p_name, lower(p_type))))) as mixtures from part group by 1),
own as (select name, 'capture_by_regex' as kind, {_PLAIN.format('name')} as find, '' as put, len(synonyms) as s, len(mixtures) as m from e),
rules as (select name, unnest([0, s + 1, s + m + 2]) as place, kind, find, put from own
  union all select name, i, 'substitute_by_regex', {_PLAIN.format('synonyms[i]')}, name from (select *, unnest(range(1, len(synonyms) + 1)) as i from e)
  union all select name, len(synonyms) + 1 + i, 'extend_by_regex', {_PLAIN.format('mixtures[i]')}, replace(mixtures[i], ' ', ' | ') from (select *, unnest(range(1, len(mixtures) + 1)) as i from e))"""


@query(_PLANNED_SQL + " select name, place::int as place, kind, find, put from rules")
def planned_rules(spark, sf_dir):
    """Rules planned from a dictionary: types as entries, brands as their synonyms, names as mixtures of their words."""
    part = of(spark, sf_dir, "part").withColumn("name", F.lower("p_type"))
    names = F.array_sort(F.collect_set(F.when(~F.col("p_name").contains(F.col("name")), F.col("p_name"))))
    mixtures = F.transform(names, lambda x: F.struct(x.alias("name"), F.split(x, " ").alias("parts")))
    return tables_of_rules.planned_table(part.groupBy("name").agg(F.array_sort(F.collect_set(F.lower("p_brand"))).alias("synonyms"), mixtures.alias("mixtures")))


@query(f"""{_PLANNED_SQL}, r as (select distinct kind, find, put from rules), t as (select distinct unnest([p_name, replace(p_name, 'e', ''), lower(p_brand)[:7], lower(p_type)]) as token from part),
f as (select distinct token, find, find in (lower(token), {_PLAIN.format('token')}) as same from t, r where contains(find, lower(token)) or contains(find, {_PLAIN.format('token')})),
b as (select token, max(same) as best from f group by 1), known as (select token, find, case when same then 'exact' else 'part' end as hit, 1.0::double as score from f join b using (token) where same = best),
rest as (select token, {_PLAIN.format('token')} as form from t where token not in (select token from b)), p as (select token, find as entry, {_RATIO.format(a='form', b='find')} as score from rest, (select distinct find from r)), k as (select *, {_BEST} as n from p where score >= 0.85)
select token, kind, find, put, hit, score from (from known union all select token, entry, 'similar', score from k where n <= 3) join r using (find)""")
def searched_rules(spark, sf_dir):
    """Planned rules searched for names, shortened names, beginnings of brands, and types."""
    part = of(spark, sf_dir, "part")
    asked = part.select(F.explode(F.array("p_name", F.replace("p_name", F.lit("e"), F.lit("")), F.substring(F.lower("p_brand"), 1, 7), F.lower("p_type"))).alias("token"))
    return tables_of_rules.search(planned_rules(spark, sf_dir), asked)
