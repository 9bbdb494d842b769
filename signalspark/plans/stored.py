"""Queries of stored steps, token state and counts by chunk, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import reports, scoring, signal, steps
from ..operators.ranges import shared_folder
from ..operators.tokens import Rule
from ..sources import tables
from ..sources.store import CountsByChunk, Steps, TokenState, exploded_pairs
from .cases import DEMOGRAPHICS_SQL, DIMS, PAIRS_SQL, demographics, of, pairs
from .registry import R, query
from .steps import _mapping, _steps_sql, raw_reports

DEMOGRAPHICS = ["Sex", "Age", "Weight"]


def stored_run(spark, sf_dir, store: Steps, run: reports.Inclusion):
    """Steps 1 to 9, each a table of the store: prepared reports, mapped reactions, included rows, actives, structures, pairs,
    cube, cells, metrics."""
    terms, token_map, structures = _mapping(spark, sf_dir)
    tables = [of(spark, sf_dir, x) for x in ("orders", "lineitem", "part", "customer")]
    prepared = store.step("1_prepared", lambda: steps.prepared(raw_reports(spark, sf_dir)), tables)
    mapped = store.step("2_mapped", lambda: reports.mapped_terms(prepared, "report", "reactions", terms), [prepared, terms])
    rows = store.step("3_included", lambda: reports.included(mapped, run), [mapped], vars(run))
    active = store.step("4_actives", lambda: steps.with_actives(rows, token_map), [rows, token_map])
    found = store.step("5_structures", lambda: steps.with_structures(active, structures), [active], {"structures": store.folder.fingerprint(structures)})
    counted = store.step("6_pairs", lambda: exploded_pairs(found, DEMOGRAPHICS, "structures", "reactions").groupBy(*DEMOGRAPHICS, "drug", "event").agg(F.count("*").alias("n")), [found])
    cube = store.step("7_cube", lambda: signal.cubed(counted, DEMOGRAPHICS, "drug", "event"), [counted], {"dims": DEMOGRAPHICS})
    cells = store.step("8_cells", lambda: signal.contingency(cube, DEMOGRAPHICS, "drug", F.col("event") == "LA"), [cube], {"event": "LA"})
    return store.step("9_metrics", lambda: signal.metrics(cells), [cells])


_SETS = ", ".join(f"({', '.join(kept + ['drug', 'event'])})" for kept in ([d for k, d in enumerate(('"Sex"', '"Age"', '"Weight"')) if code >> k & 1] for code in range(8)))


@query(f"""with rows_of as ({_steps_sql("ps + ss <= 10", "l.role = 'PS' or (l.role = 'SS' and not exists (select 1 from lines p where p.report = l.report and p.role = 'PS' and p.name = l.name and p.seq < l.seq))")}),
pairs_of as (select "Sex", "Age", "Weight", drug, unnest(string_split(reactions, '|')) as event from (select *, unnest(string_split(structures, '|')) as drug from rows_of)),
cube as (select (4 * grouping("Sex") + 2 * grouping("Age") + grouping("Weight"))::int as gid, "Sex", "Age", "Weight", drug, event, count(*) as n from pairs_of group by grouping sets ({_SETS})),
flagged as (select gid, "Sex", "Age", "Weight", drug, sum(case when event = 'LA' then n else 0 end)::bigint as a, sum(n)::bigint as t from cube group by all),
totals as (select *, sum(a) over w as e, sum(t) over w as total from flagged window w as (partition by gid, "Sex", "Age", "Weight"))
select gid, "Sex", "Age", "Weight", drug, a, t - a as b, (e - a)::bigint as c, (total - t - e + a)::bigint as d from totals""")
def stored_steps(spark, sf_dir):
    """Steps 1 to 9 from the store: what an earlier run has committed of the same input is read back."""
    store = Steps(spark, shared_folder(spark, "signalspark-steps") + "/steps")
    return stored_run(spark, sf_dir, store, reports.SECONDARY).select("gid", *DEMOGRAPHICS, "drug", "a", "b", "c", "d")


_WORDS = "string_split(p_name, ' ')"
_LEFT = lambda t, gone: f"list_filter({t}, lambda x: x not in ({gone}))"


@query(f"""with r as (select distinct p_name as name, {_WORDS} as t from part), two as (select name, {_LEFT('t', "'steel', 'small'")} as one, {_LEFT('t', "'steel', 'small', 'ring', 'gear'")} as two, list_filter(t, lambda x: x = 'steel' or x = 'ring' and len({_LEFT('t', "'steel', 'small'")}) > 0) as active from r)
select name, array_to_string(list_sort(list_distinct(two)), '|') as tokens, array_to_string(list_sort(list_distinct(active)), '|') as active, case when len(one) = 0 then 1 when len(two) = 0 then 3 end as version from two""")
def tok_state(spark, sf_dir):
    """Finished and pending rows after rules that were applied at once and rules that were recorded and applied later."""
    names = of(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.split("p_name", " ").alias("tokens"), F.array().cast("array<string>").alias("active")).distinct()
    state = TokenState(spark, f"{shared_folder(spark, 'signalspark-tokens')}/tokens-{uuid.uuid4().hex}")
    state.start(names)
    state.apply([Rule("move_by_string", "steel"), Rule("remove_by_string", "small")])
    state.record([Rule("move_by_string", "ring"), Rule("remove_by_string", "gear")])
    state.apply()
    both = state.finished().unionByName(state.pending().withColumn("version", F.lit(None).cast("int")))
    return both.select("name", F.concat_ws("|", "tokens").alias("tokens"), F.concat_ws("|", "active").alias("active"), "version")


@query(f"with {PAIRS_SQL} select gid, seg, pri, status, drug, event, n from counts")
def chunked_cube(spark, sf_dir):
    """The cube of three chunks, one of which comes twice."""
    counts = CountsByChunk(spark, f"{shared_folder(spark, 'signalspark-chunks')}/chunks-{uuid.uuid4().hex}", DIMS, "drug", "event")
    rows = pairs(spark, sf_dir)
    for status in ("F", "O", "O", "P"):
        counts.add(rows.where(F.col("status") == status), status)
    return counts.cube().select("gid", *DIMS, "drug", "event", "n")


@query("select o_orderstatus as status, o_orderpriority as priority, count(*) as n, count(o_clerk_key) as keyed, sum(o_orderkey)::bigint as total from (select *, case when o_orderstatus <> 'P' then o_custkey end as o_clerk_key from orders) group by all")
def variant_tree(spark, sf_dir):
    """A tree of variant files, one kind of which lacks a column, read back as one table with the folders as columns."""
    root = f"{shared_folder(spark, 'signalspark-trees')}/tree-{uuid.uuid4().hex}"
    orders = of(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("s"), F.regexp_replace("o_orderpriority", " ", "_").alias("p"))
    for status in ("F", "O", "P"):
        part = orders.where(F.col("s") == status)
        part = part.drop("o_custkey") if status == "P" else part
        part.drop("s").write.partitionBy("p").parquet(f"{root}/{status}")
    rows = tables.read_tree(spark, f"{root}/*/*/part-*.parquet", ["status", "priority", "stem"])
    priority = F.regexp_replace(F.regexp_replace("priority", "p=", ""), "_", " ")
    return rows.groupBy("status", priority.alias("priority")).agg(F.count("*").alias("n"), F.count("o_custkey").alias("keyed"), F.sum("o_orderkey").alias("total"))


@query("select p_partkey, 'a' || chr(10) || p_name || chr(9) || '\\' || 'é' || chr(39) as name, 2 as n, true as no_lists, true as no_nesting from part")
def literal_escapes(spark, sf_dir):
    """Escapes in literals, and lists that aren't lists of tuples."""
    name = F.concat(F.lit("'a\\n"), "p_name", F.lit("\\t\\\\\\xe9\\''"))
    text = F.concat(F.lit("[(1, 'PS', "), name, F.lit("), (2, None, \"\\u00e9\"), ]"))
    parsed = lambda x: reports.parsed_tuples(x, reports.DRUG)
    d = of(spark, sf_dir, "part").select("p_partkey", parsed(text).alias("d"), parsed(F.concat(F.lit("[[1, "), name, F.lit("]]"))).alias("l"), parsed(F.concat(F.lit("[(1, (2, "), name, F.lit("))]"))).alias("t"))
    return d.select("p_partkey", F.get("d", F.lit(0))["name"].alias("name"), F.size("d").alias("n"), F.col("l").isNull().alias("no_lists"), F.col("t").isNull().alias("no_nesting"))


@query(f"""with {DEMOGRAPHICS_SQL}, r as (select id, coalesce(age, 'Unknown') as age, coalesce(sex, 'Unknown') as sex, id % 3 as grp, (weight > 40)::int as y from people), x as (select o_orderkey as id, (o_custkey % 2)::int as class from orders where o_custkey % 7 > 0)
select grp, count(*) filter (y = 1 and class = 1) as tp, count(*) filter (y = 0 and class = 0) as tn, count(*) filter (y = 1 and class = 0) as fp, count(*) filter (y = 0 and class = 1) as fn from r join x using (id) where age = 'Unknown' and sex = 'Unknown' group by grp""")
def external_unknown(spark, sf_dir):
    """Agreement with an external ranking of the rows of the all-Unknown signature."""
    people = demographics(spark, sf_dir).select("id", F.coalesce("age", F.lit("Unknown")).alias("age"), F.coalesce("sex", F.lit("Unknown")).alias("sex"), (F.col("id") % 3).alias("grp"), (F.col("weight") > 40).cast("int").alias("y"))
    external = of(spark, sf_dir, "orders").where("o_custkey % 7 > 0").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 2).cast("int").alias("class"))
    return scoring.external_confusion(people, external, "id", ["grp"], ("age", "sex"))


@query(f"""with r as (select * from documents join labels using (doc_id)), m as (select lang, avg(toxic) as toxic, avg(quality) as quality from r group by 1), w as (select source, avg(toxic) as toxic, avg(quality) as quality from r group by 1),
c as (select lang, source, sum(n_chars) as c from r group by all), f as (select source as category, sum(c) / sum(sum(c)) over () as adjusted from c group by 1)
select 'lang' as stratification, lang as category, unnest(['toxic', 'quality']) as metric, {R.format('unnest([toxic, quality])')} as value from m union all select 'source', source, unnest(['toxic', 'quality']), {R.format('unnest([toxic, quality])')} from w union all select 'source', category, 'AFT', {R.format('adjusted')} from f""")
def stacked_metrics(spark, sf_dir):
    """Scores of two stratifications one under another, then the adjusted fractions of one."""
    rows = of(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(of(spark, sf_dir, "labels"), "doc_id").withColumn("all", F.lit("all"))
    means = lambda c: rows.groupBy(F.col(c).alias("category")).agg(rnd(F.avg("toxic")).alias("toxic"), rnd(F.avg("quality")).alias("quality")).unpivot(["category"], ["toxic", "quality"], "metric", "value")
    fractions = scoring.class_distribution(rows, "all", "source", "n_chars").select(F.lit("source").alias("stratification"), F.col("source").alias("category"), "adjusted")
    return scoring.stacked_metrics({"lang": means("lang"), "source": means("source")}, fractions)
