"""Queries of the compositions, joins and small shapes, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import features, folds, models, reports, scoring, signal, steps
from .cases import DIMS, LINES_SQL, PAIRS_SQL, PREDICTIONS_SQL, drug_lists, of, pairs, predictions
from .registry import R, query

# raw reports to rows


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw reports: every column a text, drugs and indications as literals of Python."""
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    literal = lambda rows, one: F.concat(F.lit("["), F.array_join(F.transform(rows, one), ", "), F.lit("]"))
    drug = lambda d: F.concat(F.lit("("), d["seq"].cast("string"), F.lit(", "), quoted(d["role"]), F.lit(", "), quoted(F.concat(d["name"], F.lit(" (ORAL)"))), F.lit(")"))
    orders = of(spark, sf_dir, "orders").join(of(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = drug_lists(spark, sf_dir).join(orders, F.col("report") == F.col("o_orderkey"))
    return rows.select(
        F.col("report").alias("primaryid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_dt"), F.lit("never").alias("fda_dt"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("sex"),
        (F.col("report") % 1300).cast("string").alias("age_months"), F.lit(None).cast("string").alias("age_group"), F.concat(F.col("report") % 90, F.lit(".5")).alias("weight_kg"),
        F.array_join(F.transform("reactions", lambda x: F.concat(F.lit(" "), x)), ":").alias("reactions"), literal(F.col("drugs"), drug).alias("drugs"),
        F.concat(F.lit("[(1, '"), F.col("o_orderpriority"), F.lit("'), (1, 'last')]")).alias("indications"),
    )


def _mapping(spark, sf_dir):
    part = of(spark, sf_dir, "part")
    terms = part.select(F.lower("p_type").alias("term"), F.substring("p_type", 1, 2).alias("mapped")).distinct().where("mapped <> 'PR'")
    names = part.select(F.substring("p_brand", 1, 7).alias("b")).distinct()
    token_map = names.where("b <> 'Brand#1'").select(F.concat("b", F.lit(" (ORAL)")).alias("drug"), F.concat("b", F.lit(" : salt")).alias("active"))
    structures = names.where("b <> 'Brand#2'").select(F.col("b").alias("name"), F.concat(F.lit("C-"), "b").alias("structure")).union(spark.createDataFrame([("salt", "NaCl")], "name string, structure string"))
    return terms, token_map, structures


def _steps_sql(most: str, chosen: str) -> str:
    """Rows of a run whose reports satisfy ``most`` and whose drugs satisfy ``chosen``, with weight classes over those rows."""
    q = lambda levels: f"list_transform(quantile_cont(w, {levels}), lambda x: round_even(x * 1000, 0) / 1000)"
    narrow, wide = "[0.05, 1/3, 2/3, 0.95]", "[0.1, 1/3, 2/3, 0.9]"
    return f"""with {LINES_SQL},
base as (select o_orderkey as report, nullif(c_mktsegment, 'BUILDING') as sex, o_orderkey % 90 + 0.5::double as w, case when o_orderkey % 1300 < 144 then 'Children' when o_orderkey % 1300 < 252 then 'Adolescent' when o_orderkey % 1300 < 780 then 'Adult' when o_orderkey % 1300 < 1200 then 'Elderly' end as age from orders join customer on o_custkey = c_custkey),
reacts as (select report, list_sort(list_distinct(list(substr(p_type, 1, 2)) filter (p_type <> 'PROMO'))) as reactions from lines group by report),
named as (select report, name, min(seq) as seq from lines group by all),
roles as (select report, count(*) filter (seq = 1) as ps, count(*) filter (seq in (2, 3)) as ss from named group by 1),
kept as (select r.report, ps, ss, reactions from roles r join reacts using (report) where len(reactions) between 1 and 20 and ps + ss > 0 and {most}),
suspects as (select l.report, l.role, l.name from lines l where {chosen}),
rows_ as (select row_number() over () as id, k.report, l.role, l.name, sex, age, w from kept k join base using (report) left join suspects l using (report)),
q1 as (select age, sex, {q(narrow)} as q from rows_ where age is not null and sex is not null group by all), q2 as (select age, {q(narrow)} as q from rows_ where age is not null group by all),
q3 as (select sex, age, {q(wide)} as q from rows_ where age is not null and sex is not null group by all), q4 as (select age, {q(wide)} as q from rows_ where age is not null group by all),
m3 as (select p.id, avg(q[1]) as a, avg(q[2]) as b, avg(q[3]) as c, avg(q[4]) as d from rows_ p join q3 using (sex) where p.age is null and p.w between q[1] and q[4] group by p.id),
m4 as (select p.id, avg(q[1]) as a, avg(q[2]) as b, avg(q[3]) as c, avg(q[4]) as d from rows_ p join q4 on true where p.age is null and p.sex is null and p.w between q[1] and q[4] group by p.id),
weighed as (select p.*, case when p.age is not null and p.sex is not null then q1.q when p.age is not null then q2.q when p.sex is not null then [m3.a, m3.b, m3.c, m3.d] else [m4.a, m4.b, m4.c, m4.d] end as q
  from rows_ p left join q1 on p.age = q1.age and p.sex = q1.sex left join q2 on p.age = q2.age left join m3 on p.id = m3.id left join m4 on p.id = m4.id)
select c.report, c.role, array_to_string(k.reactions, '|') as reactions, coalesce(sex, 'Unknown') as "Sex", coalesce(age, 'Unknown') as "Age", coalesce(case when w <= q[1] then 'Unknown' when w <= q[2] then 'Low' when w <= q[3] then 'Average' when w <= q[4] then 'High' end, 'Unknown') as "Weight",
  c.name || ' : salt' as active, 'C-' || c.name || '|NaCl' as structures from weighed c join kept k using (report) where c.name not in ('Brand#1', 'Brand#2')"""


def _steps(spark, sf_dir, run):
    terms, token_map, structures = _mapping(spark, sf_dir)
    rows = steps.reports_to_rows(raw_reports(spark, sf_dir), run, terms, token_map, structures)
    return rows.select("report", "role", F.concat_ws("|", "reactions").alias("reactions"), "Sex", "Age", "Weight", "active", F.concat_ws("|", "structures").alias("structures"))


@query(_steps_sql("ps + ss <= 10", "l.role = 'PS' or (l.role = 'SS' and not exists (select 1 from lines p where p.report = l.report and p.role = 'PS' and p.name = l.name and p.seq < l.seq))"))
def step_reports(spark, sf_dir):
    """Steps 1 to 4 of the run over all suspects, from texts to rows with weight classes and structures."""
    return _steps(spark, sf_dir, reports.SECONDARY)


@query(_steps_sql("ps <= 1", "l.role = 'PS'"))
def step_reports_primary(spark, sf_dir):
    """Steps 1 to 4 of the run over primary suspects."""
    return _steps(spark, sf_dir, reports.PRIMARY)


@query("select c_custkey, c_nationkey, n_regionkey as cluster, (n_nationkey % 5)::int as fold, 'customers' as dataset, 'ror' as metric from customer left join (from nation where n_regionkey < 4) on c_nationkey = n_nationkey")
def dataset_folds(spark, sf_dir):
    folds = of(spark, sf_dir, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("cluster"), (F.col("n_nationkey") % 5).alias("fold"))
    rows, _ = steps.with_folds(of(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), folds, "c_nationkey", dataset="customers", metric="ror")
    return rows.select("c_custkey", "c_nationkey", "cluster", "fold", "dataset", "metric")


@query("""with g as (select c_nationkey as grp, avg((c_acctbal > 5000)::int) as share, count(*) as size from customer group by all), k as (select grp, row_number() over (order by share desc, size desc, grp) - 1 as i from g)
select grp, (case when (i // 4) % 2 = 1 then 3 - i % 4 else i % 4 end)::int as fold from k""")
def stratified_folds(spark, sf_dir):
    """Whole groups dealt to four folds with like shares of positives."""
    rows = of(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), (F.col("c_acctbal") > 5000).cast("int").alias("y"))
    return features.stratified_folds(rows, "grp", "y", folds=4)


@query("with codes as (select p_brand as value, dense_rank() over (order by p_brand) - 1 as code from (select distinct p_brand from part)) select p_partkey, value as brand from part join codes on (p_partkey % 30) = code")
def dict_decode(spark, sf_dir):
    """Codes back to values; those without one go."""
    parts = of(spark, sf_dir, "part")
    return reports.decoded(parts.select("p_partkey", (F.col("p_partkey") % 30).alias("brand")), "brand", reports.dictionary(parts, "p_brand"))


@query("select n_nationkey, n_regionkey, r_name, count(c_custkey) as customers from nation join region on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by all")
def cluster_rows(spark, sf_dir):
    """Cluster ids of distinct keys joined back onto all their rows."""
    nation, region = of(spark, sf_dir, "nation"), of(spark, sf_dir, "region")
    clusters = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_regionkey", "r_name")
    return of(spark, sf_dir, "customer").join(clusters, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_regionkey", "r_name").agg(F.count("c_custkey").alias("customers"))


@query("select doc_id, lang, quality, label, page_id is not null as page, len(embedding) as n from documents join labels using (doc_id) join embeddings on doc_id = vec_id join pages on doc_id = page_id")
def descriptor_star(spark, sf_dir):
    """A dataset joined with tables of descriptors on one key, one after another."""
    d, e, p = of(spark, sf_dir, "documents").select("doc_id", "lang"), of(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.size("embedding").alias("n")), of(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    return d.join(of(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").join(e, "doc_id").join(p, "doc_id").select("doc_id", "lang", "quality", "label", F.lit(True).alias("page"), "n")


@query(f"with {PREDICTIONS_SQL} select a.id, a.fold, a.y_score as x, b.y_score as y, c.y_score as z from preds a join preds b on a.id = b.id and b.model = 'm1' join preds c on a.id = c.id and c.model = 'm0' and c.y_score >= 0.6 where a.model = 'm0' and a.y_score >= 0.5")
def overlap_three(spark, sf_dir):
    p = predictions(spark, sf_dir)
    one = lambda model, name: p.where(F.col("model") == model).select("id", "fold", F.col("y_score").alias(name))
    return one("m0", "x").where("x >= 0.5").join(one("m1", "y"), ["id", "fold"]).join(one("m0", "z").where("z >= 0.6"), ["id", "fold"])


@query(f"""with d as (select lang, toxic, count(*) as entries from documents join labels using (doc_id) group by all), r as (select lang, toxic, {R.format('avg(n_chars)::double / nullif(avg(quality), 0)')} as ratio from documents join labels using (doc_id) group by all) select lang, toxic, entries, ratio from d join r using (lang, toxic)""")
def ratio_with_classes(spark, sf_dir):
    rows = of(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(of(spark, sf_dir, "labels"), "doc_id")
    ratio = rows.groupBy("lang", "toxic").agg(rnd(F.avg("n_chars") / F.nullif(F.avg("quality"), F.lit(0.0))).alias("ratio"))
    return rows.groupBy("lang", "toxic").agg(F.count("*").alias("entries")).join(ratio, ["lang", "toxic"])


@query(f"with {PAIRS_SQL}, t as (select count(*) as n, count(*) filter (event = 'PROMO') as e from pairs) select drug, count(*) filter (event = 'PROMO') as a, count(*) filter (event <> 'PROMO') as b, any_value(e) - count(*) filter (event = 'PROMO') as c, any_value(n) - any_value(e) - count(*) filter (event <> 'PROMO') as d from pairs, t group by drug")
def cells_from_rows(spark, sf_dir):
    return signal.cells_from_rows(pairs(spark, sf_dir), "drug", F.col("event") == "PROMO")


# features, evaluation, comparison

_CHAIN_SQL = f"""with v as (select vec_id, list_transform(embedding, lambda x: x::double) || [1.0::double, 2 * embedding[1]::double] as v from embeddings), u as (select vec_id, unnest(v) as x, unnest(range(len(v)))::int as pos from v),
s as (select pos, {R.format('quantile_cont(x, 0.5)')} as centre, {R.format('(quantile_cont(x, 0.95) - quantile_cont(x, 0.05)) / 3.289707253902944')} as scale from u group by pos)
select vec_id, (u.pos - case when u.pos = 65 then 2 else 1 end)::int as pos, {R.format('(x - centre) / scale')} as value from u join s using (pos) where pos not in (0, 64)"""


@query(_CHAIN_SQL)
def feature_chain(spark, sf_dir):
    """A constant and a multiple of the first component are planted: the mask drops the one, correlation the first component."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = of(spark, sf_dir, "embeddings").select("vec_id", F.concat(v, F.array(F.lit(1.0), 2 * F.get(v, F.lit(0)))).alias("v"))
    out = steps.FeatureChain("CDDD").fit(rows, "vec_id", "v").transform(rows, "vec_id", "v")
    return out.select("vec_id", F.posexplode("v").alias("pos", "value"))


@query(f"""with v as (select vec_id, list_transform(embedding, lambda x: (x > 0)::int::double) as v from embeddings), u as (select vec_id, unnest(v) as x, unnest(range(len(v)))::int as pos from v),
k as (select pos, avg(x) as mean from u where vec_id % 5 > 0 group by pos having max(x) > min(x) and var_pop(x) > 0.001), g as (select vec_id, pos, mean, case when pos <> 3 or vec_id % 5 > 0 then x end as x from u join k using (pos))
select vec_id, (dense_rank() over (order by pos) - 1)::int as pos, {R.format('coalesce(x, mean)')} as value from g""")
def feature_chain_binary(spark, sf_dir):
    """Binary descriptors stay unscaled; a feature that new rows lack takes the mean of the rows that the chain was fitted on."""
    bits = F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    rows = of(spark, sf_dir, "embeddings").select("vec_id", bits.alias("v"))
    chain = steps.FeatureChain("MACCS").fit(rows.where("vec_id % 5 > 0"), "vec_id", "v")
    lacking = rows.withColumn("v", F.transform("v", lambda x, k: F.when((k != 3) | (F.col("vec_id") % 5 > 0), x)))
    return chain.transform(lacking, "vec_id", "v").select("vec_id", F.posexplode("v").alias("pos", "value")).withColumn("value", rnd(F.col("value")))


@query(f"""with {PREDICTIONS_SQL}, w as (select id, max(case when model = 'm0' then round_even(y_score * 1000, 0) end) as x, max(case when model = 'm1' then round_even(y_score * 1000, 0) end) as y from preds group by id),
d as (select x - y as d from w where x <> y), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0::double as rk, count(*) over (partition by abs(d)) as t from d),
s as (select count(*) as n, sum(case when d > 0 then rk else 0 end) as p, sum(case when d < 0 then rk else 0 end) as m, sum(t::double * t - 1) as tied from r),
z as (select *, least(least(p, m) - n * (n + 1) / 4.0::double + 0.5, 0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::double - tied / 48) as z, (p - m) / (p + m) as r from s)
select 'm0 == m1' as null_hypothesis, abs(z) > 2.5758293035489 as null_rejected, 'm0 ' || case when abs(z) > 2.5758293035489 and r > 0 then '>' when abs(z) > 2.5758293035489 and r < 0 then '<' else '==' end || ' m1' as outcome, least(p, m) as w_stat, {R.format('r')} as r_stat from z""")
def compare_pairs(spark, sf_dir):
    long = predictions(spark, sf_dir).withColumn("value", F.rint(F.col("y_score") * 1000))
    return steps.compared(long, "model", [("m0", "m1")], ["id"]).select("null_hypothesis", "null_rejected", "outcome", "w_stat", "r_stat")


_FOLDS_SQL = """v as (select vec_id, (vec_id % 3)::int as fold, list_transform(embedding, lambda x: x::double) || [1.0::double, 2 * embedding[1]::double, case when vec_id % 3 <> 1 then embedding[2]::double end] as v from embeddings),
u as (select vec_id, fold, unnest(v) as x, unnest(range(len(v)))::int as pos from v), f as (select distinct fold as f from v)"""


def _with_folds(spark, sf_dir):
    """Vectors with a constant, a multiple of the first component, and a feature that is missing in fold 1 alone."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fold = (F.col("vec_id") % 3).cast("int")
    planted = F.array(F.lit(1.0), 2 * F.get(v, F.lit(0)), F.when(fold != 1, F.get(v, F.lit(1))))
    return of(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).cast("double").alias("y"), fold.alias("fold"), (1.0 + F.col("vec_id") % 4).alias("weight"), (F.col("label") % 3).alias("grp"), F.concat(v, planted).alias("v"))


@query(f"""with {_FOLDS_SQL} select f as fold, pos, count(x) as n, count(*) - count(x) as bad, {R.format('min(x)')} as low, {R.format('max(x)')} as high, {R.format('avg(x)')} as mean, {R.format('var_pop(x)')} as variance, count(*) = count(x) and max(x) > min(x) as kept, var_pop(x) > 0.001 as varying from u, f where fold <> f group by all""")
def fold_statistics(spark, sf_dir):
    """What each fold's model learns of every feature, from the rows of the other folds."""
    out = folds.fold_statistics(_with_folds(spark, sf_dir), "v", "fold")
    return out.withColumns({c: rnd(F.col(c)) for c in ("low", "high", "mean", "variance")})


@query(f"""with {_FOLDS_SQL} select f as fold, pos, {R.format('quantile_cont(x, 0.5)')} as centre, {R.format('(quantile_cont(x, 0.95) - quantile_cont(x, 0.05)) / 3.289707253902944')} as scale from u, f where fold <> f and x is not null group by all""")
def fold_scales(spark, sf_dir):
    return folds.fold_scales(_with_folds(spark, sf_dir), "v", "fold").withColumns({c: rnd(F.col(c)) for c in ("centre", "scale")})


@query(f"""with {_FOLDS_SQL}, w as (select * from u where pos not in (64, 66)) select f as fold, a.pos as i, b.pos as j, {R.format('corr(a.x, b.x)')} as r from w a join w b on a.vec_id = b.vec_id and a.pos < b.pos, f where a.fold <> f group by all having abs(corr(a.x, b.x)) >= 0.1""")
def fold_correlations(spark, sf_dir):
    rows = _with_folds(spark, sf_dir).withColumn("v", F.concat(F.slice("v", 1, 65), F.slice("v", 66, 1)))
    return folds.correlations(rows, "v", 0.1, "fold")


@query()
def fold_evaluation(spark, sf_dir):
    """Train and Eval, Unweighted and Weighted scores of one logistic model a fold, each with its own feature chain, in all and
    by group."""
    rows = _with_folds(spark, sf_dir)
    return steps.evaluated("logistic", rows, "fold", ["grp"], chain=folds.FoldChain(scale=True).fit(rows, "v", "fold"), vector="v", maxIter=15)


_DEMO_SQL = "list_transform([0, 1, 2], lambda k: (label % 3 = k)::int::double) || list_transform([0, 1], lambda k: (vec_id % 2 = k)::int::double)"
_SCORE_SQL = "1 / (1 + exp(-((vec_id % 7) / 7.0::double + {0}[1] * 0.1::double + {0}[2] * 0.4::double + {0}[3] * 0.9::double - {0}[4] * 0.3::double + {0}[5] * 0.5::double)))"
_COUNTER_SQL = f"""with rows_ as (select vec_id, (vec_id % 4)::int as fold, {_DEMO_SQL} as demo from embeddings),
folds as (select distinct fold from rows_), means as (select f.fold, [avg(demo[1]), avg(demo[2]), avg(demo[3]), avg(demo[4]), avg(demo[5])] as base from folds f join rows_ r on f.fold <> r.fold group by f.fold),
options as (select * from (values ('label', '0', 1, 1, 3), ('label', '1', 2, 1, 3), ('label', '2', 3, 1, 3), ('parity', '0', 4, 4, 5), ('parity', '1', 5, 4, 5)) t(category, value, k, s, e)),
cases as (select vec_id, fold, category, value, base, list_transform([1, 2, 3, 4, 5], lambda i: case when i = k then 1.0::double when i between s and e then 0.0::double else base[i] end) as v from rows_ join means using (fold), options),
diffs as (select vec_id, fold, category, value, {R.format(_SCORE_SQL.format('v') + ' - ' + _SCORE_SQL.format('base'))} as difference from cases)"""


def _demographics():
    return F.concat(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.when(F.col("label") % 3 == k, 1.0).otherwise(0.0)), F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: F.when(F.col("vec_id") % 2 == k, 1.0).otherwise(0.0)))


def _differences(spark, sf_dir):
    rows = of(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 4).cast("int").alias("fold"), _demographics().alias("demo"))
    weights = [0.1, 0.4, 0.9, -0.3, 0.5]
    score = lambda key, v: 1 / (1 + F.exp(-((key % 7) / F.lit(7.0) + sum(F.get(v, F.lit(k)) * w for k, w in enumerate(weights)))))
    return steps.counterfactuals_by_fold(rows, "vec_id", "demo", "fold", {"label": ["0", "1", "2"], "parity": ["0", "1"]}, score)


@query(_COUNTER_SQL + " select vec_id, fold, category, value, round_even(difference * 1e4, 0) / 1e4 as difference from diffs")
def counterfactual_folds(spark, sf_dir):
    return _differences(spark, sf_dir).withColumn("difference", rnd(F.col("difference"), 4))


@query(_COUNTER_SQL + f", each as (select vec_id, category, value, avg(difference) as d from diffs group by all) select category, value, round_even({R.format('avg(d)')} * 1e4, 0) / 1e4 as difference from each group by all")
def counterfactual_means(spark, sf_dir):
    return steps.mean_differences(_differences(spark, sf_dir), "vec_id").withColumn("difference", rnd(F.col("difference"), 4))


@query("select distinct p_name as name from part order by name")
def drug_names(spark, sf_dir):
    return of(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().orderBy("name")


@query()
def counterfactual_models(spark, sf_dir):
    """Differences by fitted models: each fold's keys scored by the logistic model of the other folds."""
    rows = of(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 4).cast("int").alias("fold"), (F.col("label") % 2).cast("double").alias("y"), F.lit(1.0).alias("weight"), _demographics().alias("demo"))
    return steps.counterfactuals_of_models("logistic", rows, "vec_id", "embedding", "demo", "fold", {"label": ["0", "1", "2"], "parity": ["0", "1"]}, maxIter=10)[0]


@query()
def searched_models(spark, sf_dir):
    """Trials of three kinds of models, with the best of each kind."""
    rows = of(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).cast("double").alias("y"), (F.col("vec_id") % 2).cast("int").alias("fold"), F.lit(1.0).alias("weight"), "embedding")
    rows = models.training_rows(rows, "embedding").drop("embedding")
    spaces = {"forest": {"numTrees": (3, 8), "maxDepth": (2, 5)}, "boosted": {"maxIter": (2, 4), "maxDepth": (2, 3), "stepSize": (0.05, 0.3)}, "svm": {"regParam": (1e-3, 1.0)}}
    tables = [models.trials_of(kind, rows, "fold", models.drawn(kind, 2, 42, space), at_once=2) for kind, space in spaces.items()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


# shapes


@query("""select o_orderkey, o_orderdate::date as day, o_orderstatus || ' | ' || o_orderpriority as signature, printf('%.0f | %.2f', floor(o_totalprice), o_orderkey::double) as mean_std, split_part(o_orderpriority, '-', 1) || ': ' || o_orderstatus || ' | b: ' || (o_orderkey % 3) as params from orders""")
def text_columns(spark, sf_dir):
    """Dates from text, signatures, mean and spread in one text, parameters of a trial in one text."""
    o = of(spark, sf_dir, "orders")
    trial = F.map_from_arrays(F.array(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)), F.lit("b")), F.array("o_orderstatus", (F.col("o_orderkey") % 3).cast("string")))
    return o.select(
        "o_orderkey", steps.to_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), scoring.signature("o_orderstatus", "o_orderpriority").alias("signature"),
        F.format_string("%.0f | %.2f", F.floor("o_totalprice").cast("double"), F.col("o_orderkey").cast("double")).alias("mean_std"), scoring.parameters(trial).alias("params"),
    )


@query("select place::int as place, o_orderstatus, o_orderpriority, o_orderkey from (select *, row_number() over (order by list_position(['P', 'F', 'O'], o_orderstatus), list_position(['5-LOW', '1-URGENT'], o_orderpriority) nulls last, o_orderkey) as place from orders) where place <= 10")
def ordered_categories(spark, sf_dir):
    """The first ten rows by orders of categories; values without a place come last."""
    first = of(spark, sf_dir, "orders").orderBy(*scoring.category_order({"o_orderstatus": ["P", "F", "O"], "o_orderpriority": ["5-LOW", "1-URGENT"]}), "o_orderkey").limit(10)
    rows = first.agg(F.collect_list(F.struct("o_orderstatus", "o_orderpriority", "o_orderkey")).alias("r"))  # the ten
    order = F.array_sort("r", lambda a, b: F.when(_rank(a) < _rank(b), -1).when(_rank(a) > _rank(b), 1).when(a["o_orderkey"] < b["o_orderkey"], -1).otherwise(1))
    return rows.select(F.posexplode(order).alias("p", "x")).select((F.col("p") + 1).alias("place"), "x.*")


def _rank(x):
    return F.array_position(F.array(*map(F.lit, ["P", "F", "O"])), x["o_orderstatus"]) * 10 + F.coalesce(F.nullif(F.array_position(F.array(F.lit("5-LOW"), F.lit("1-URGENT")), x["o_orderpriority"]), F.lit(0)), F.lit(9))


@query("select m.v as metric, s.v as status, r.r_name as region from (values ('prr'), ('ror'), ('ic')) m(v), (values ('F'), ('O')) s(v), region r")
def parameter_product(spark, sf_dir):
    """Every combination of a few parameters."""
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    return one("metric", ["prr", "ror", "ic"]).crossJoin(one("status", ["F", "O"])).crossJoin(F.broadcast(of(spark, sf_dir, "region").select(F.col("r_name").alias("region"))))


@query("select o_orderstatus, array_to_string(list_sort(list_distinct(list(o_orderpriority) filter (o_orderkey % 3 = 0))), '|') as some, array_to_string(list_sort(list_filter(list_distinct(list(o_orderpriority) filter (o_orderkey % 3 = 0)), lambda x: x <> '5-LOW')), '|') as left_over, array_to_string(list_sort(list_distinct(list(o_orderpriority) filter (o_orderkey % 3 = 0) || ['6-NONE'])), '|') as with_more from orders group by o_orderstatus")
def name_sets(spark, sf_dir):
    """Unions and differences of lists of names."""
    rows = of(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.collect_set(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))).alias("s"))
    text = lambda c: F.concat_ws("|", F.array_sort(c))
    return rows.select("o_orderstatus", text(F.col("s")).alias("some"), text(F.array_except("s", F.array(F.lit("5-LOW")))).alias("left_over"), text(F.array_union("s", F.array(F.lit("6-NONE")))).alias("with_more"))


@query("select c_custkey as key from customer where c_nationkey < 5 union select s_suppkey from supplier where s_nationkey < 5")
def key_union(spark, sf_dir):
    c, s = of(spark, sf_dir, "customer"), of(spark, sf_dir, "supplier")
    return c.where("c_nationkey < 5").select(F.col("c_custkey").alias("key")).union(s.where("s_nationkey < 5").select("s_suppkey")).distinct()


@query(f"""with m as (select r.vec_id, r.pos, avg(r.x) as x from (select vec_id, unnest(range(len(embedding)))::int as pos, unnest(embedding)::double as x, label from embeddings) r group by all), p as (select label, pos, {R.format('avg(x)')} as mean from (select vec_id, label, unnest(range(len(embedding)))::int as pos, unnest(embedding)::double as x from embeddings) group by all) select label, pos, mean from p""")
def mean_vectors(spark, sf_dir):
    """Mean vector of each group, element by element."""
    return features.mean_vectors(of(spark, sf_dir, "embeddings"), ["label"], "embedding").select("label", "pos", "mean")
