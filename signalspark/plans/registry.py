"""Queries of the operators over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import div, rnd, round_significant
from ..operators import features, folds, models, reports, scoring, signal, similarity, stats, tokens
from ..sources import tables
from .cases import DEMOGRAPHICS_SQL, DIMS, LINES_SQL, PAIRS_SQL, PREDICTIONS_SQL, SETS, VALUES, demographics, drug_lists, of, pairs, predictions

FLAGSHIP = "dpa_ror"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# pair counts and signals


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.pair_counts(pairs(spark, sf_dir), DIMS, "drug", "event")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.contingency(_counts(spark, sf_dir), DIMS, "drug", F.col("event").isin(SETS["promo"]))


CELLS_SQL = f"""with {PAIRS_SQL},
flagged as (select gid, seg, pri, status, drug, sum(case when event = 'PROMO' then n else 0 end)::bigint as a, sum(n)::bigint as t from counts group by all),
totals as (select *, sum(a) over w as e, sum(t) over w as total from flagged window w as (partition by gid, seg, pri, status)),
cells as (select gid, seg, pri, status, drug, a, t - a as b, (e - a)::bigint as c, (total - t - e + a)::bigint as d from totals)"""
Z = 2.5758293035489004
R = "round_even(({}) * 1e5, 0) / 1e5"
RATIO_SQL = CELLS_SQL + f""",
valued as (
  select *, {R.format('a::double / nullif((a + b)::double * c / nullif(c + d, 0), 0)')} as prr, {R.format('a::double * d / nullif(b::double * c, 0)')} as ror,
    sqrt(1.0::double / nullif(a, 0) - 1.0::double / nullif(a + b, 0) + 1.0::double / nullif(c, 0) - 1.0::double / nullif(c + d, 0)) as prr_s,
    sqrt(1.0::double / nullif(a, 0) + 1.0::double / nullif(b, 0) + 1.0::double / nullif(c, 0) + 1.0::double / nullif(d, 0)) as ror_s from cells),
bounded as (
  select *, {R.format(f'prr * exp(-{Z}::double * prr_s)')} as prr_lower, {R.format(f'prr * exp({Z}::double * prr_s)')} as prr_upper,
    {R.format(f'ror * exp(-{Z}::double * ror_s)')} as ror_lower, {R.format(f'ror * exp({Z}::double * ror_s)')} as ror_upper from valued)"""
LABEL_SQL = "case when a < 3 then 'Undefined' when {m}_lower is null or {m} is null or {m}_upper is null then 'Ambiguous' when {m}_lower >= 1 then 'High' when {m}_upper > 1 then case when {m} > 1 then 'Moderate' when {m} = 1 then 'Ambiguous' else 'Low' end else 'Minimal' end"


@query(f"with {PAIRS_SQL} select gid, seg, pri, status, drug, event, n from counts")
def pair_counts_cube(spark, sf_dir):
    return _counts(spark, sf_dir).select("gid", *DIMS, "drug", "event", "n")


@query(f"with {PAIRS_SQL} select gid, seg, pri, status, drug, " + ", ".join(f"sum(case when event in ({', '.join(repr(x) for x in names)}) then n else 0 end)::bigint as a_{s}" for s, names in SETS.items()) + ", sum(n)::bigint as n from counts group by all")
def event_binarize(spark, sf_dir):
    return signal.binarized(_counts(spark, sf_dir), DIMS, "drug", "event", SETS)


@query(CELLS_SQL + " select * from cells")
def contingency(spark, sf_dir):
    return _cells(spark, sf_dir)


def _ratio(spark, sf_dir, name: str) -> DataFrame:
    cells, s = _cells(spark, sf_dir), signal.Settings()
    make = {"prr": signal.proportional_ratio, "ror": signal.odds_ratio}[name]
    three = make(*(F.col(x) for x in "abcd"), s.alpha)
    out = cells.withColumns(dict(zip((f"{name}_lower", name, f"{name}_upper"), three)))
    return signal.labelled(out, name, s)


def _ratio_sql(m: str, columns: str) -> str:
    return RATIO_SQL + f"""
, named as (select *, {LABEL_SQL.format(m=m)} as label from bounded),
confident as (select *, case when label not in ('Undefined', 'Ambiguous') then {R.format(f'sqrt(abs({m} - 1)) / (({m}_upper - {m}_lower) + 1e-4::double)')} end as confidence,
  case when label in ('High', 'Moderate') then 1 when label in ('Low', 'Minimal') then 0 end as y from named),
weighted as (select *, {R.format('1 / (1 + exp(-2 / 2.5::double * ln(9::double) * (confidence - 1.25::double)))')} as weight from confident),
smoothed as (select *, {R.format('weight * y + (1 - weight) * 0.5::double')} as smooth from weighted)
select {columns} from smoothed"""


for _m in ("prr", "ror"):
    QUERIES[f"dpa_{_m}"] = lambda spark, sf_dir, m=_m: _ratio(spark, sf_dir, m).select("gid", *DIMS, "drug", "a", f"{m}_lower", m, f"{m}_upper", "label")
    ORACLES[f"dpa_{_m}"] = _ratio_sql(_m, f"gid, seg, pri, status, drug, a, {_m}_lower, {_m}, {_m}_upper, label")
    QUERIES[f"dpa_weights_{_m}"] = lambda spark, sf_dir, m=_m: _ratio(spark, sf_dir, m).select("gid", *DIMS, "drug", "confidence", "weight", "y", "smooth")
    ORACLES[f"dpa_weights_{_m}"] = _ratio_sql(_m, "gid, seg, pri, status, drug, confidence, weight, y, smooth")


@query(CELLS_SQL + f" select gid, seg, pri, status, drug, {R.format('log2((a + 0.5::double) / ((a + b)::double * (a + c) / (a + b + c + d) + 0.5::double))')} as ic from cells")
def dpa_ic_point(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return cells.select("gid", *DIMS, "drug", signal.information_component(*(F.col(x) for x in "abcd"), 0.5)[0].alias("ic"))


_ALL = [f"{m}{x}" for m in ("prr", "ror") for x in ("_lower", "", "_upper")]


@query(RATIO_SQL + " select gid, seg, pri, status, drug, " + ", ".join(f"case when {m}_lower is not null and {m} is not null and {m}_upper is not null then {m}{x} end as {m}{x}" for m in ("prr", "ror") for x in ("_lower", "", "_upper")) + f", {R.format('log2((a + 0.5::double) / ((a + b)::double * (a + c) / (a + b + c + d) + 0.5::double))')} as ic from bounded")
def dpa_metrics(spark, sf_dir):
    """All three metrics of every cell."""
    return signal.metrics(_cells(spark, sf_dir)).select("gid", *DIMS, "drug", *_ALL, "ic")


@query()
def dpa_ic_bounds(spark, sf_dir):
    out = signal.labelled(signal.metrics(_cells(spark, sf_dir)), "ic")
    return out.select("gid", *DIMS, "drug", "a", "ic_lower", "ic", "ic_upper", "label", "confidence", "weight", "smooth")


_VECTOR_SQL = ", ".join(f"case when coalesce({d}, 'Unknown') = '{v}' then 1 else 0 end" for d in DIMS for v in VALUES[d])


@query(_ratio_sql("ror", f"coalesce(seg, 'Unknown') as seg, coalesce(pri, 'Unknown') as pri, coalesce(status, 'Unknown') as status, drug, label, confidence, weight, y, smooth, concat_ws('', {_VECTOR_SQL}) as demographics") + " where y is not null")
def dpa_final(spark, sf_dir):
    out = signal.finished(_ratio(spark, sf_dir, "ror"), DIMS, VALUES, "drug")
    return out.withColumn("demographics", F.concat_ws("", F.transform("demographics", lambda x: x.cast("string"))))


# reports


@query("select p_partkey, case when m < 144 then 'Children' when m < 252 then 'Adolescent' when m < 780 then 'Adult' when m < 1200 then 'Elderly' end as age from (select p_partkey, p_size * 26 as m from part)")
def age_groups(spark, sf_dir):
    return of(spark, sf_dir, "part").select("p_partkey", reports.age_group(F.col("p_size") * 26).alias("age"))


@query(f"with {DEMOGRAPHICS_SQL}, q as (select age, sex, quantile_cont(weight, [0.05, 1/3, 2/3, 0.95]) as q from people where age is not null and sex is not null group by all) select age, sex, " + ", ".join(f"round_even(q[{k + 1}] * 1000, 0) / 1000 as q{k}" for k in range(4)) + " from q")
def weight_quantiles(spark, sf_dir):
    q = reports.quantile_table(demographics(spark, sf_dir), "weight", ["age", "sex"], [0.05, 1 / 3, 2 / 3, 0.95])
    return q.select("age", "sex", *(F.get("q", F.lit(k)).alias(f"q{k}") for k in range(4)))


_Q = "list_transform(quantile_cont(weight, {}), lambda x: round_even(x * 1000, 0) / 1000)"
_NARROW, _WIDE = "[0.05, 1/3, 2/3, 0.95]", "[0.1, 1/3, 2/3, 0.9]"


@query(f"""with {DEMOGRAPHICS_SQL},
q1 as (select age, sex, {_Q.format(_NARROW)} as q from people where age is not null and sex is not null group by all),
q2 as (select age, {_Q.format(_NARROW)} as q from people where age is not null group by all),
q3 as (select sex, age, {_Q.format(_WIDE)} as q from people where age is not null and sex is not null group by all),
q4 as (select age, {_Q.format(_WIDE)} as q from people where age is not null group by all),
m3 as (select p.id, list_transform([1, 2, 3, 4], lambda k: null::double) as z, avg(q[1]) as a, avg(q[2]) as b, avg(q[3]) as c, avg(q[4]) as d from people p join q3 using (sex) where p.age is null and p.weight between q[1] and q[4] group by p.id),
m4 as (select p.id, avg(q[1]) as a, avg(q[2]) as b, avg(q[3]) as c, avg(q[4]) as d from people p join q4 on true where p.age is null and p.sex is null and p.weight between q[1] and q[4] group by p.id),
chosen as (select p.*, case when p.age is not null and p.sex is not null then q1.q when p.age is not null then q2.q when p.sex is not null then [m3.a, m3.b, m3.c, m3.d] else [m4.a, m4.b, m4.c, m4.d] end as q
  from people p left join q1 on p.age = q1.age and p.sex = q1.sex left join q2 on p.age = q2.age left join m3 on p.id = m3.id left join m4 on p.id = m4.id)
select id, coalesce(case when weight <= q[1] then 'Unknown' when weight <= q[2] then 'Low' when weight <= q[3] then 'Average' when weight <= q[4] then 'High' end, 'Unknown') as weight_class from chosen""")
def weight_class(spark, sf_dir):
    return reports.weight_classes(demographics(spark, sf_dir), "weight", "age", "sex").select("id", "weight_class")


_LIST = lambda c: F.concat_ws(",", F.transform(c, lambda d: F.concat(d["role"], F.lit(":"), d["name"])))


@query(f"with {LINES_SQL} select report, coalesce(string_agg(role || ':' || name, ',' order by seq, name), '') as drugs from lines where role = 'PS' group by report")
def primary_filter(spark, sf_dir):
    rows = drug_lists(spark, sf_dir).withColumn("drugs", reports.primary(F.col("drugs"))).where("drugs is not null")
    return rows.select("report", _LIST("drugs").alias("drugs"))


@query(f"""with {LINES_SQL}, kept as (select * from lines l where role = 'PS' or role = 'SS' and not exists (select 1 from lines p where p.report = l.report and p.seq < l.seq and p.role = 'PS' and p.name = l.name))
select report, string_agg(role || ':' || name, ',' order by seq, name) as drugs from kept group by report""")
def primsec_filter(spark, sf_dir):
    rows = drug_lists(spark, sf_dir).withColumn("drugs", reports.suspects(F.col("drugs"))).where("drugs is not null")
    return rows.select("report", _LIST("drugs").alias("drugs"))


@query(f"""with {LINES_SQL}, first as (select report, name, arg_min(role, seq) as role from lines group by all)
select report, """ + ", ".join(f"count(*) filter (role = '{r}')::int as n_{r.lower()}" for r in ("PS", "SS", "C", "I")) + " from first group by report")
def role_counts(spark, sf_dir):
    return drug_lists(spark, sf_dir).select("report", *(reports.role_count(F.col("drugs"), r).alias(f"n_{r.lower()}") for r in ("PS", "SS", "C", "I")))


@query(f"""with {LINES_SQL}, first as (select report, name, arg_min(role, seq) as role from lines group by all),
fine as (select report from first group by report having count(*) filter (role in ('PS', 'SS')) between 1 and 10),
kept as (select l.* from lines l where report in (from fine) and (role = 'PS' or role = 'SS' and not exists (select 1 from lines p where p.report = l.report and p.seq < l.seq and p.role = 'PS' and p.name = l.name)))
select report, role, name as drug from kept""")
def report_explode(spark, sf_dir):
    return reports.included(drug_lists(spark, sf_dir), reports.SECONDARY).select("report", "role", "drug")


@query("select event_id, 2 as n, cast(props->>'k' as int) as k, upper(event_type) || ' (ORAL), 10' as name, null::varchar as role_2, 'o''b [' || event_type || ']' as name_2 from events")
def literal_parse(spark, sf_dir):
    """A list of tuples in text, with brackets and commas in names, a None and quotes of both kinds, parsed."""
    e = of(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    text = F.concat(F.lit("[("), F.col("k"), F.lit(", 'PS', '"), F.upper("event_type"), F.lit(" (ORAL), 10'), (2, None, \"o'b ["), F.col("event_type"), F.lit("]\")]"))
    d = e.withColumn("d", reports.parsed_tuples(text, reports.DRUG))
    first, second = (F.get("d", F.lit(k)) for k in (0, 1))
    return d.select("event_id", F.size("d").alias("n"), first["seq"].alias("k"), first["name"].alias("name"), second["role"].alias("role_2"), second["name"].alias("name_2"))


@query("""with o as (select o_orderkey, o_orderpriority from orders)
select l_orderkey as report, string_agg(l_linenumber || ':' || case when l_linenumber = 1 then o_orderpriority when l_linenumber = 2 then 'b' else '' end, ',' order by l_linenumber) as drugs from lineitem join o on l_orderkey = o_orderkey group by 1""")
def indication_join(spark, sf_dir):
    """Drugs with the last indication of their seq."""
    rows = drug_lists(spark, sf_dir).join(of(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report"), "o_orderpriority"), "report")
    one = lambda k, v: F.struct(F.lit(k).alias("seq"), v.alias("name"))
    named = F.array(one(1, F.lit("x")), one(2, F.lit("b")), one(1, F.col("o_orderpriority")))
    got = rows.select("report", reports.with_indications(F.col("drugs"), named).alias("d"))
    return got.select("report", F.concat_ws(",", F.transform("d", lambda d: F.concat(d["seq"].cast("string"), F.lit(":"), d["indication"]))).alias("drugs"))


@query(f"with {LINES_SQL}, m as (select distinct p_type as term, case when p_type <> 'PROMO' then substr(p_type, 1, 1) end as mapped from part) select report, coalesce(string_agg(distinct mapped, ',' order by mapped), '') as reactions from lines left join m on term = p_type and mapped is not null group by report")
def mapped_reactions(spark, sf_dir):
    mapping = of(spark, sf_dir, "part").select(F.col("p_type").alias("term"), F.substring("p_type", 1, 1).alias("mapped")).distinct().where("term <> 'PROMO'")
    out = reports.mapped_terms(drug_lists(spark, sf_dir), "report", "reactions", mapping)
    return out.select("report", F.concat_ws(",", "reactions").alias("reactions"))


@query("with codes as (select distinct p_brand as v, dense_rank() over (order by p_brand) - 1 as code from part) select p_partkey, code::int as p_brand from part join codes on v = p_brand")
def dict_encode(spark, sf_dir):
    part = of(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return reports.encoded(part, "p_brand", reports.dictionary(part, "p_brand"))


@query("select p_partkey, case when p_type in ('PROMO', 'LARGE', 'SMALL') then concat(lower(p_type), '|', case when p_size % 2 = 0 then 'small' else 'Missing' end) when p_size % 2 = 0 then 'Missing|small' end as actives, case when p_type in ('PROMO', 'LARGE', 'SMALL') and p_size % 2 = 0 then 1 else 0 end as complete from part")
def dict_lookup_complete(spark, sf_dir):
    mapping = F.create_map(*(F.lit(x) for k in ("PROMO", "LARGE", "SMALL") for x in (k, k.lower())))
    text = F.concat_ws(" : ", "p_type", F.when(F.col("p_size") % 2 == 0, "SMALL").otherwise("?"))
    got = of(spark, sf_dir, "part").select("p_partkey", reports.actives(text, mapping).alias("a"))
    return got.select("p_partkey", F.when(F.col("a").isNotNull(), F.concat_ws("|", "a")).alias("actives"), reports.complete(F.col("a")).alias("complete"))


@query("select p_partkey, case when p_retailprice = 0 then 0 else round_even(p_retailprice * power(10::double, 2 - floor(log10(abs(p_retailprice)))), 0) / power(10::double, 2 - floor(log10(abs(p_retailprice)))) end as price from part")
def significant_digits(spark, sf_dir):
    return of(spark, sf_dir, "part").select("p_partkey", round_significant(F.col("p_retailprice"), 3).alias("price"))


# token rules

_RULES = [
    tokens.Rule("substitute_by_string", "{w}", "new word"), tokens.Rule("substitute_by_regex", "{w}", "new"), tokens.Rule("extend_by_string", "{w}", "x | y"),
    tokens.Rule("extend_by_regex", "{w}", "x | y"), tokens.Rule("remove_by_string", "{w}"), tokens.Rule("remove_remaining_by_string", "{w}"), tokens.Rule("remove_by_regex", "{w}"),
    tokens.Rule("move_by_string", "{w}"), tokens.Rule("move_by_regex", "{w}"), tokens.Rule("capture_by_string", "{w}"), tokens.Rule("capture_by_regex", "{w}"), tokens.Rule("update_tokens", "{n}", "a | b"),
]
_T = "string_split(p_name, ' ')"
#: DuckDB twins of the rules for whole-word tokens: (tokens, active).
_RULE_SQL = {
    "substitute_by_string": ("list_transform(t, lambda x: case when x = '{w}' then 'new word' else x end)", "[]"),
    "substitute_by_regex": ("list_transform(t, lambda x: case when x = '{w}' then ' new ' else x end)", "[]"),
    "extend_by_string": ("case when list_contains(t, '{w}') then list_filter(t, lambda x: x <> '{w}') || ['x', 'y'] else t end", "[]"),
    "extend_by_regex": ("case when list_contains(t, '{w}') then list_transform(t, lambda x: case when x = '{w}' then ' ' else x end) || ['x', 'y'] else t end", "[]"),
    "remove_by_string": ("list_filter(t, lambda x: x <> '{w}')", "[]"),
    "remove_remaining_by_string": ("case when t = ['{w}'] then [] else t end", "[]"),
    "remove_by_regex": ("list_filter(t, lambda x: x <> '{w}')", "[]"),
    "move_by_string": ("list_filter(t, lambda x: x <> '{w}')", "list_filter(t, lambda x: x = '{w}')"),
    "move_by_regex": ("list_filter(t, lambda x: x <> '{w}')", "list_filter(t, lambda x: x = '{w}')"),
    "capture_by_string": ("list_transform(t, lambda x: replace(x, '{w}', ' '))", "list_transform(list_filter(t, lambda x: contains(x, '{w}')), lambda x: '{w}')"),
    "capture_by_regex": ("list_transform(t, lambda x: case when x = '{w}' then ' ' else x end)", "list_filter(t, lambda x: x = '{w}')"),
    "update_tokens": ("case when p_name = '{n}' then ['a', 'b'] else t end", "[]"),
}
WORD, NAME = "steel", "small steel"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = of(spark, sf_dir, "part")
    return part.select(F.col("p_name").alias("name"), F.split("p_name", " ").alias("tokens"), F.array().cast("array<string>").alias("active"), "p_partkey")


def _rule_query(spark, sf_dir, rule: tokens.Rule) -> DataFrame:
    rows = _names(spark, sf_dir)
    t, a = rule.columns(F.col("name"), F.col("tokens"), F.col("active"))
    return rows.select("p_partkey", F.concat_ws("|", t).alias("tokens"), F.concat_ws("|", a).alias("active"))


for _r in _RULES:
    _rule = tokens.Rule(_r.kind, _r.find.format(w=WORD, n=NAME), _r.put)
    QUERIES[f"tok_{_r.kind}"] = partial(_rule_query, rule=_rule)
    _t, _a = (x.format(w=WORD, n=NAME) for x in _RULE_SQL[_r.kind])
    ORACLES[f"tok_{_r.kind}"] = f"with r as (select p_partkey, p_name, {_T} as t from part) select p_partkey, coalesce(array_to_string({_t}, '|'), '') as tokens, coalesce(array_to_string({_a}::varchar[], '|'), '') as active from r"


@query(f"select p_partkey, array_to_string(list_transform(list_sort(list_distinct({_T})), lambda x: lower(trim(x))), '|') as tokens from part")
def tok_clean(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", F.concat_ws("|", tokens.cleaned(F.col("tokens"))).alias("tokens"))


@query(f"select distinct p_name as name, unnest({_T}) as token from part")
def tok_collect(spark, sf_dir):
    return tokens.collected(_names(spark, sf_dir))


@query(f"with r as (select distinct p_name as name, {_T} as t from part) select name, array_to_string(list_sort(list_distinct(list_filter(t, lambda x: x not in ('{WORD}', 'small')))), '|') as tokens, case when list_contains(t, '{WORD}') then '{WORD}' else '' end as active, len(list_filter(t, lambda x: x not in ('{WORD}', 'small'))) = 0 as finished from r")
def tok_apply_changes(spark, sf_dir):
    rules = [tokens.Rule("move_by_string", WORD), tokens.Rule("remove_by_string", "small"), tokens.Rule("move_by_string", WORD)]
    done, left = tokens.finished_and_left(tokens.applied(_names(spark, sf_dir).select("name", "tokens", "active").distinct(), rules))
    both = done.withColumn("finished", F.lit(True)).union(left.withColumn("finished", F.lit(False)))
    return both.select("name", F.concat_ws("|", "tokens").alias("tokens"), F.concat_ws("|", "active").alias("active"), "finished")


@query(f"with r as (select p_name as name, case when p_partkey % 5 = 0 then [] else {_T} end as t from part) select name, array_to_string(list_transform(t, lambda x: case when x like 's%' then upper(x) else x end), '|') as tokens from r")
def tok_auto_process(spark, sf_dir):
    """Rows of equal names and rows without tokens stay rows of their own."""
    rows = _names(spark, sf_dir).withColumn("tokens", F.when(F.col("p_partkey") % 5 != 0, F.col("tokens")).otherwise(F.array().cast("array<string>")))
    memo = tokens.collected(rows).where("token like 's%'").select("token").distinct().select("token", F.upper("token").alias("put"))
    return tokens.remembered(rows.select("name", "tokens", "active"), memo).select("name", F.concat_ws("|", "tokens").alias("tokens"))


_SIMILAR_SQL = "with a as (select distinct p_name as token from part), p as (select a.token, b.token as entry, round_even((1 - levenshtein(a.token, b.token)::double / greatest(length(a.token), length(b.token))) * 1000, 0) / 1000 as score from a, a b)"


@query(_SIMILAR_SQL + ", k as (select *, row_number() over (partition by token order by score desc, entry) as n from p where score >= 0.7) select token, entry, score from k where n <= 3")
def levenshtein_topk(spark, sf_dir):
    names = of(spark, sf_dir, "part").select("p_name").distinct()
    return tokens.similar(names.select(F.col("p_name").alias("token")), names.select(F.col("p_name").alias("entry")), 0.7, 3)


@query()
def fuzzy_ratio(spark, sf_dir):
    part = of(spark, sf_dir, "part")
    return part.select("p_partkey", tokens.indel_ratio("p_name", F.concat_ws(" ", "p_brand", "p_name")).alias("ratio"))


@query("select p_partkey, length(regexp_replace(p_brand, '[^0-9]', '', 'g'))::double / length(p_brand) <= 0.7 and regexp_matches(p_brand, '[a-zA-Z]') and regexp_full_match(p_brand, '[\\da-zA-Z\\s\\-,.]+') as plausible from part")
def plausible_names(spark, sf_dir):
    return of(spark, sf_dir, "part").select("p_partkey", tokens.plausible(F.col("p_brand")).alias("plausible"))


# scores and tables of scores


def _scores_sql(keys: str, rows: str) -> str:
    r = R.format
    return f"""with {PREDICTIONS_SQL}, rows_ as ({rows}),
pts as (select {keys}, y_score as s, sum(case when y_true = 1 then weight else 0 end) as pos, sum(case when y_true <> 1 then weight else 0 end) as neg from rows_ group by all),
cum as (select *, coalesce(sum(neg) over (partition by {keys} order by s rows between unbounded preceding and 1 preceding), 0) as below from pts),
cells as (select {keys}, sum(case when s >= 0.5 then pos else 0 end) as tp, sum(case when s >= 0.5 then neg else 0 end) as fp, sum(case when s < 0.5 then neg else 0 end) as tn, sum(case when s < 0.5 then pos else 0 end) as fn,
  sum(pos * (below + neg / 2)) as under from cum group by all),
base as (select *, coalesce(tp / nullif(tp + fn, 0), 0) as re, coalesce(tn / nullif(tn + fp, 0), 0) as sp, coalesce(tp / nullif(tp + fp, 0), 0) as pr from cells where tp + fn > 0 and tn + fp > 0)
select {keys}, tp, fp, tn, fn, {r('(tp + tn) / (tp + fp + tn + fn)')} as accuracy, {r('re')} as recall, {r('sp')} as specificity, {r('pr')} as precision, {r('(re + sp) / 2')} as balanced_accuracy, {r('sqrt(re * sp)')} as geom_rs,
  {r('coalesce(2 * re * sp / nullif(re + sp, 0), 0)')} as harm_rs, {r('coalesce(2 * pr * re / nullif(pr + re, 0), 0)')} as f1, {r('under / ((tp + fn) * (tn + fp))')} as roc_auc,
  {r('coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)')} as mcc from base"""


@query(_scores_sql("model, fold", "select * from preds"))
def fold_scores(spark, sf_dir):
    return scoring.scores(predictions(spark, sf_dir), ["model", "fold"])


@query(_scores_sql("kind, value", "select 'Total' as kind, 'Total' as value, * from preds where model = 'm0' union all select 'grp', grp, * from preds where model = 'm0' union all select 'fold', fold::varchar, * from preds where model = 'm0'"))
def scores_by_sign(spark, sf_dir):
    return scoring.subgroup_scores(predictions(spark, sf_dir).where("model = 'm0'"), ["grp", "fold"])


_LONG_SQL = _scores_sql("model, fold", "select * from preds").replace("with ", "with w as (with ", 1) + "), long as (unpivot (select * exclude (tp, fp, tn, fn) from w) on columns(* exclude (model, fold)) into name metric value value)"


@query(_LONG_SQL + f" select model, metric, {R.format('avg(value)')} as mean, {R.format('stddev_samp(value)')} as std, {R.format('stddev_pop(value)')} as std_pop, {R.format('avg(value) - 1.96::double * stddev_samp(value)')} as low, {R.format('avg(value) + 1.96::double * stddev_samp(value)')} as high, count(*) as n from long group by all")
def mean_std_table(spark, sf_dir):
    long = scoring.long_scores(scoring.scores(predictions(spark, sf_dir), ["model", "fold"]), ["model", "fold"])
    return scoring.mean_std(long, ["model", "metric"])


@query(f"with {PREDICTIONS_SQL} select id, y_true, {R.format('avg(y_score)')} as y_score, (avg(y_score) >= 0.5)::int as y_pred from preds group by id, y_true")
def ensemble_mean(spark, sf_dir):
    return scoring.ensemble(predictions(spark, sf_dir), ["id", "y_true"]).withColumn("y_score", rnd(F.col("y_score")))


@query(f"with {PREDICTIONS_SQL} select a.id, a.fold, a.y_true, a.y_score as x, b.y_score as y from preds a join preds b using (id, fold, y_true) where a.model = 'm0' and b.model = 'm1' and a.y_score >= 0.5")
def overlap_join(spark, sf_dir):
    p = predictions(spark, sf_dir)
    a = p.where("model = 'm0' and y_score >= 0.5").select("id", "fold", "y_true", F.col("y_score").alias("x"))
    return a.join(p.where("model = 'm1'").select("id", "fold", "y_true", F.col("y_score").alias("y")), ["id", "fold", "y_true"])


def _labelled(spark, sf_dir):
    return of(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(of(spark, sf_dir, "labels"), "doc_id")


@query(f"""with b as (select lang, source, avg(n_chars) as m, count(*) as entries, sum(n_chars) as c from documents join labels using (doc_id) group by all)
select lang, source, {R.format('m')} as mean_weight, entries, round_even(c * 1000.0::double, 0) / 1000 as contribution, {R.format('entries::double / sum(entries) over (partition by lang)')} as fraction, {R.format('c::double / sum(c) over (partition by lang)')} as adjusted from b""")
def class_distribution(spark, sf_dir):
    return scoring.class_distribution(_labelled(spark, sf_dir), "lang", "source", "n_chars")


@query(_scores_sql("model, fold", "select * from preds").replace("with ", "with w as (with ", 1) + ") select model, round_even(avg(recall) / nullif(avg(specificity), 0) * 1000, 0) / 1000 as ratio from w group by model")
def rs_ratio(spark, sf_dir):
    return scoring.recall_specificity_ratio(scoring.scores(predictions(spark, sf_dir), ["model", "fold"]), ["model"])


@query(f"""with r as (select * from documents join labels using (doc_id)), e as (select lang, source, count(*) as n from r group by all), s as (select lang, {R.format('avg(n)')} as mean_rows, {R.format('stddev_samp(n)')} as std_rows from e group by lang)
select lang, count(*) as n_rows, count(distinct source) as entities, round_even(10000 * avg(toxic), 0) / 100 as positive, {R.format('avg(case when toxic = 1 then n_chars end)')} as weight_1, {R.format('avg(case when toxic = 0 then n_chars end)')} as weight_0, any_value(mean_rows) as mean_rows, any_value(std_rows) as std_rows from r join s using (lang) group by lang""")
def dataset_profile(spark, sf_dir):
    return scoring.profile(_labelled(spark, sf_dir), ["lang"], "source", "toxic", "n_chars")


@query(f"with x as (select doc_id as k, (n_chars > 2000)::int as class from documents), r as (select doc_id as k, lang, toxic as y from documents join labels using (doc_id)) select lang, count(*) filter (y = 1 and class = 1) as tp, count(*) filter (y = 0 and class = 0) as tn, count(*) filter (y = 1 and class = 0) as fp, count(*) filter (y = 0 and class = 1) as fn from r join x using (k) group by lang")
def external_confusion(spark, sf_dir):
    docs = of(spark, sf_dir, "documents")
    external = docs.select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("class"))
    return scoring.external_confusion(_labelled(spark, sf_dir).withColumnRenamed("toxic", "y").select("doc_id", "lang", "y"), external, "doc_id", ["lang"])


# statistics

_PAIRED_SQL = "p as (select p_brand, l_partkey, avg(case when l_returnflag = 'R' then l_quantity end) as x, avg(case when l_returnflag = 'N' then l_quantity end) as y from lineitem join part on l_partkey = p_partkey group by all)"


def _paired(spark, sf_dir):
    rows = of(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity").join(of(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    mean = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    return rows.groupBy("p_brand", "l_partkey").agg(mean("R").alias("x"), mean("N").alias("y"))


_RANK_SQL = f"""with {_PAIRED_SQL}, d as (select p_brand, round_even((x - y) * 1e6, 0) as d from p where x is not null and y is not null), r as (select *, rank() over w + (count(*) over (partition by p_brand, abs(d)) - 1) / 2.0::double as rk, count(*) over (partition by p_brand, abs(d)) as t from d where d <> 0 window w as (partition by p_brand order by abs(d))),
s as (select p_brand, count(*) as n, sum(case when d > 0 then rk else 0 end) as w_plus, sum(case when d < 0 then rk else 0 end) as w_minus, sum(t::double * t - 1) as tied from r group by p_brand),
z as (select *, least(w_plus, w_minus) as statistic, least(least(w_plus, w_minus) - n * (n + 1) / 4.0::double + 0.5, 0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0::double - tied / 48), 0) as zz, (w_plus - w_minus) / nullif(w_plus + w_minus, 0) as r from s)
select p_brand, n, w_plus, w_minus, statistic, {R.format('zz')} as z, {R.format('r')} as rank_biserial, case when abs(r) < 0.1 then 'Negligible' when abs(r) < 0.3 then 'Small' when abs(r) < 0.5 then 'Medium' else 'Large' end as effect from z"""


def _tests(spark, sf_dir):
    scaled = _paired(spark, sf_dir).select("p_brand", F.rint((F.col("x") - F.col("y")) * 1e6).alias("x"), F.lit(0.0).alias("y"))
    return stats.signed_rank(scaled, ["p_brand"], "x", "y")


@query(_RANK_SQL)
def signed_rank(spark, sf_dir):
    return _tests(spark, sf_dir).drop("p_value")


@query()
def signed_rank_p(spark, sf_dir):
    return stats.holm(_tests(spark, sf_dir), tie="p_brand").select("p_brand", "p_value", "adjusted_p", "rejected")


@query("with t as (select p_brand, (avg(p_size) % 1) / 20 as p_value from part group by p_brand), r as (select *, row_number() over (order by p_value, p_brand) as i, count(*) over () as m from t) select p_brand, round_even(least(max((m - i + 1) * p_value) over (order by p_value, p_brand rows unbounded preceding), 1) * 1e5, 0) / 1e5 as adjusted_p from r")
def holm(spark, sf_dir):
    t = of(spark, sf_dir, "part").groupBy("p_brand").agg(((F.avg("p_size") % 1) / 20).alias("p_value"))
    return stats.holm(t, tie="p_brand").select("p_brand", rnd(F.col("adjusted_p")).alias("adjusted_p"))


@query("select p_brand, round_even(corr(p_size, p_retailprice) * 1e5, 0) / 1e5 as r from part group by p_brand")
def pearson(spark, sf_dir):
    return of(spark, sf_dir, "part").groupBy("p_brand").agg(rnd(F.corr("p_size", "p_retailprice")).alias("r"))


@query()
def pearson_p(spark, sf_dir):
    return stats.correlations(of(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice")


# vectors

_UNNEST_SQL = "u as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding)))::int as pos from embeddings)"


@query(f"with {_UNNEST_SQL} select pos, max(x) > min(x) as kept from u group by pos")
def feature_masks(spark, sf_dir):
    return features.feature_masks(of(spark, sf_dir, "embeddings"), "embedding")


@query(f"with {_UNNEST_SQL} select pos, {R.format('var_pop(x)')} as variance, var_pop(x) > 1e-3 as kept from u group by pos")
def variance_keep(spark, sf_dir):
    return features.varying(of(spark, sf_dir, "embeddings"), "embedding")


@query(f"with {_UNNEST_SQL} select pos, {R.format('quantile_cont(x, 0.5)')} as centre, {R.format('(quantile_cont(x, 0.95) - quantile_cont(x, 0.05)) / 3.289707253902944')} as scale from u group by pos")
def robust_scale(spark, sf_dir):
    return features.robust_scales(of(spark, sf_dir, "embeddings"), "embedding")


#: Embeddings with a constant and with mixtures of two components put after them.
_PLANTED_SQL = "planted as (select vec_id, list_transform(embedding, lambda x: x::double) || [1.0::double] || list_transform([1, 2, 3], lambda k: embedding[k]::double + embedding[k + 1]::double / 8) as v from embeddings), w as (select vec_id, unnest(v) as x, unnest(range(len(v)))::int as pos from planted)"


def _planted(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    more = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get(v, k) + F.get(v, k + 1) / 8)
    return of(spark, sf_dir, "embeddings").select("vec_id", F.concat(v, F.array(F.lit(1.0)), more).alias("v"))


@query(f"with {_PLANTED_SQL} select a.pos as i, b.pos as j, {R.format('corr(a.x, b.x)')} as r from w a join w b on a.vec_id = b.vec_id and a.pos < b.pos where a.pos <> 64 and b.pos <> 64 group by all having abs(corr(a.x, b.x)) >= 0.1")
def corr_pairs(spark, sf_dir):
    return folds.correlations(_planted(spark, sf_dir), "v", 0.1)


_BITS_SQL = "b as (select vec_id, list_transform(embedding, lambda x: (x > 0)::int::double) as bits from embeddings)"
_BOTH, _EITHER = "list_inner_product(x.bits, y.bits)", "(list_sum(x.bits) + list_sum(y.bits) - list_inner_product(x.bits, y.bits))"


def _bits(spark, sf_dir):
    return of(spark, sf_dir, "embeddings").select("vec_id", features.sign_bits(F.col("embedding")).alias("bits"))


@query(f"with {_BITS_SQL} select x.vec_id as a, y.vec_id as b, {R.format(f'{_BOTH} / {_EITHER}')} as similarity from b x join b y on x.vec_id < y.vec_id where {_BOTH} / {_EITHER} >= 0.6")
def tanimoto_pairs(spark, sf_dir):
    return similarity.tanimoto_pairs(_bits(spark, sf_dir), "vec_id", "bits", 0.6)


@query(f"with {_BITS_SQL} select x.vec_id, {R.format(f'min(1 - {_BOTH} / {_EITHER})')} as distance from b x join b y on x.vec_id % 5 <> y.vec_id % 5 group by 1")
def fold_min_distance(spark, sf_dir):
    return similarity.fold_distances(_bits(spark, sf_dir).withColumn("fold", F.col("vec_id") % 5), "vec_id", "bits", "fold")


@query()
def butina_clusters(spark, sf_dir):
    rows = _bits(spark, sf_dir)
    return similarity.clusters(rows, "vec_id", "bits", 0.6, packed_words=True)


def _url_bits(spark, sf_dir):
    """Urls as sets of 4,096 bits: the first three digits of the hashes of their runs of three characters."""
    runs = F.transform(F.sequence(F.lit(1), F.length("url") - 2), lambda i: F.conv(F.substring(F.md5(F.substring(F.col("url"), i, F.lit(3))), 1, 3), 16, 10).cast("int"))
    return of(spark, sf_dir, "pages").select("page_id", F.when(F.length("url") > 2, F.array_distinct(runs)).alias("positions"))


@query(f"with b as (select page_id, list_distinct(list_transform(range(1, length(url) - 1), lambda i: ('0x' || substr(md5(url[i:i + 2]), 1, 3))::int)) as s from pages), p as (select x.page_id as a, y.page_id as b, len(list_intersect(x.s, y.s))::double / nullif(len(list_distinct(x.s || y.s)), 0) as t from b x join b y on x.page_id < y.page_id) select a, b, {R.format('t')} as similarity from p where t >= 0.6")
def tanimoto_urls(spark, sf_dir):
    """Pairs of sparse sets of 4,096 bits, by the index."""
    return similarity.tanimoto_sets(_url_bits(spark, sf_dir), "page_id", "positions", 0.6)


@query()
def butina_urls(spark, sf_dir):
    """Clusters of sparse sets of 4,096 bits."""
    rows = _url_bits(spark, sf_dir)
    return similarity.clusters(rows, "page_id", "positions", 0.6)


@query()
def group_kfold(spark, sf_dir):
    return features.group_folds(of(spark, sf_dir, "documents"), "source")


@query("select vec_id, i - 1 as position, " + R.format("1 / (1 + exp(-((i - 1) * 0.3::double + 0.1))) - 1 / (1 + exp(-((label % 3) * 0.3::double + 0.1)))") + " as difference from embeddings, range(1, 4) t(i)")
def counterfactual_diff(spark, sf_dir):
    rows = of(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.when(F.col("label") % 3 == k, 1).otherwise(0)).alias("demo"))
    return scoring.counterfactuals(rows, ["vec_id"], F.col("demo"), [3], scoring.linear([0.0, 0.3, 0.6], 0.1))


@query()
def logistic_folds(spark, sf_dir):
    """Scores of an ensemble of logistic models over held-out folds."""
    rows = of(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).cast("double").alias("y"), (F.col("vec_id") % 4).cast("int").alias("fold"), F.lit(1.0).alias("weight"), "embedding")
    got = models.cross_validated("logistic", models.training_rows(rows, "embedding"), "fold", 0, maxIter=20)
    return scoring.scores(scoring.ensemble(got, ["vec_id", "y", "weight"]), [], y="y")


# shapes, sets, sources


@query("select * from (select page_id, url, split_part(split_part(url, '://', 2), '/', 1) as host, row_number() over (partition by split_part(split_part(url, '://', 2), '/', 1) order by page_id) as n from pages) where n = 1")
def keep_first(spark, sf_dir):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    n = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))
    return of(spark, sf_dir, "pages").select("page_id", "url", host.alias("host")).withColumn("n", n).where("n = 1")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def anti_finished(spark, sf_dir):
    return of(spark, sf_dir, "documents").join(of(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "lang")


@query("""select page_id, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') as links from pages""")
def html_links(spark, sf_dir):
    return of(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", tables.links(F.col("html"))).alias("links"))


@query("select lang, " + ", ".join(f"count(*) filter (toxic = {t}) as toxic_{t}" for t in (0, 1)) + " from documents join labels using (doc_id) group by lang")
def pivot_labels(spark, sf_dir):
    got = _labelled(spark, sf_dir).groupBy("lang").pivot("toxic", [0, 1]).count()
    return got.select("lang", *(F.coalesce(str(t), F.lit(0)).alias(f"toxic_{t}") for t in (0, 1)))


@query("select 'customer' as kind, c_custkey as key, c_name as name, null::double as balance from customer union all select 'supplier', s_suppkey, s_name, s_acctbal from supplier")
def union_by_name(spark, sf_dir):
    c = of(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    s = of(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("select 'nation' as stem, count(*) as n from nation")
def path_columns(spark, sf_dir):
    return tables.read_table(spark, f"{sf_dir}/nation.parquet").select(tables.from_path(r"([^/]+)\.parquet").alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))
