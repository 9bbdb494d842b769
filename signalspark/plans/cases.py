"""The driver's tables seen as case reports: orders are reports, lines their drugs, part types their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = ["seg", "pri", "status"]
#: Categories of the dimensions, in order (fixed values of the tables).
VALUES = {"seg": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "pri": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "status": ["F", "O", "P"]}
SETS = {"promo": ["PROMO"], "large": ["LARGE", "ECONOMY"], "small": ["SMALL", "MEDIUM", "STANDARD"]}


def of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seg, pri, status, drug, event), one row a line."""
    line = of(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    order = of(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("pri"), F.col("o_orderstatus").alias("status"))
    customer = of(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    part = of(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("drug"), F.col("p_type").alias("event"))
    out = line.join(order, line.l_orderkey == order.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return out.join(part, F.col("l_partkey") == F.col("p_partkey")).select(*DIMS, "drug", "event")


PAIRS_SQL = """pairs as (
  select c_mktsegment as seg, o_orderpriority as pri, o_orderstatus as status, p_brand as drug, p_type as event
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey),
counts as (
  select seg, pri, status, drug, event, (4 * grouping(seg) + 2 * grouping(pri) + grouping(status))::int as gid, count(*) as n
  from pairs group by grouping sets ((seg,pri,status,drug,event),(seg,pri,drug,event),(seg,status,drug,event),(pri,status,drug,event),(seg,drug,event),(pri,drug,event),(status,drug,event),(drug,event)))"""


def drug_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report, drugs, reactions): role by line number, name by brand, reactions by part type."""
    line = of(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = of(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    role = F.when(F.col("l_linenumber") == 1, "PS").when(F.col("l_linenumber") <= 3, "SS").when(F.col("l_linenumber") == 4, "C").otherwise("I")
    rows = line.join(part, line.l_partkey == part.p_partkey)
    drug = F.struct(F.col("l_linenumber").cast("int").alias("seq"), role.alias("role"), F.substring("p_brand", 1, 7).alias("name"))
    return rows.groupBy(F.col("l_orderkey").alias("report")).agg(F.array_sort(F.collect_list(drug)).alias("drugs"), F.array_sort(F.collect_set("p_type")).alias("reactions"))


LINES_SQL = """lines as (
  select l_orderkey as report, l_linenumber as seq, substr(p_brand, 1, 7) as name, p_type,
    case when l_linenumber = 1 then 'PS' when l_linenumber <= 3 then 'SS' when l_linenumber = 4 then 'C' else 'I' end as role
  from lineitem join part on l_partkey = p_partkey)"""


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, age, sex, weight) with some unknown ages and sexes."""
    orders, customer = of(spark, sf_dir, "orders"), of(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("id"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("age"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("sex"), (F.col("o_totalprice") / 4000).alias("weight"),
    )


DEMOGRAPHICS_SQL = """people as (
  select o_orderkey as id, nullif(o_orderpriority, '5-LOW') as age, nullif(c_mktsegment, 'BUILDING') as sex, o_totalprice / 4000 as weight
  from orders join customer on o_custkey = c_custkey)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, model, fold, grp, y_true, y_score, weight): two scores of each embedding."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = of(spark, sf_dir, "embeddings").select("vec_id", "label", e.alias("e"))
    score = lambda k: F.rint((0.5 + F.get("e", F.lit(k))) * 1000) / 1000
    models = F.array(*(F.struct(F.lit(name).alias("model"), score(k).alias("s")) for k, name in enumerate(("m0", "m1"))))
    long = rows.withColumn("m", F.explode(models))
    return long.select(F.col("vec_id").alias("id"), F.col("m.model").alias("model"), (F.col("vec_id") % 5).cast("int").alias("fold"), F.concat(F.lit("g"), F.col("label") % 3).alias("grp"), (F.col("label") % 2).alias("y_true"), F.col("m.s").alias("y_score"), (1 + F.col("vec_id") % 3).cast("double").alias("weight"))


PREDICTIONS_SQL = """preds as (
  select vec_id as id, model, (vec_id % 5)::int as fold, 'g' || (label % 3) as grp, label % 2 as y_true, (1 + vec_id % 3)::double as weight,
    round_even((0.5 + embedding[case when model = 'm0' then 1 else 2 end]::double) * 1000, 0) / 1000 as y_score
  from embeddings, (values ('m0'), ('m1')) as t(model))"""
