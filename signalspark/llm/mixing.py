"""Mixing sources to target weights by a low-discrepancy schedule (operator 6).

Every source's documents stand in a fixed shuffled order, again and again as far as the mix may use them, and are cut into
blocks of equally many words. A schedule of slots takes one block each: the van der Corput point of a slot, mapped through
the cumulative target shares, names its source, and the slot's rank among those of its source names the block. So every
stretch of the schedule is near the target shares. Slots are joined to the pieces of documents that lie in their blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Slots are at most 2 ** SLOT_BITS; blocks are as large as that asks for.
SLOT_BITS = 17
CELLS = 1 << 12
WORDS = r"[^\x20\x09-\x0D]+"


def sources_with_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(key, source_size, weight, target, low, high) of each source; low and high cut [0, 1) by the targets' shares.

    ``sized`` has key (source in order, null last) and size. Weights repeat along the keys; targets share all words by
    weight but stop at ``most`` times their source's size, the excess going to the others by weight. One row a source.
    """
    by = Window.orderBy("key")
    totals = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by) - 1, F.lit(len(weights))) + 1).cast("int"))
    # in order of size over weight, a source is full if its share of what fuller ones leave is beyond its limit
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    full = F.col("limit") * F.col("rest") < F.col("weight") * (F.col("total") - F.col("used"))
    return (
        totals.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(every)).withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(after)).withColumn("full", full)
        .withColumn("kept", F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0)))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(every))
        .withColumn("target", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(((F.col("total") - F.col("kept")) * F.col("weight")).cast("double") / F.col("open")))
        .withColumn("high", F.sum("target").over(by) / F.nullif(F.col("total"), F.lit(0)))
        .withColumn("low", F.coalesce(F.lag("high").over(by), F.lit(0.0)))
        .withColumn("high", F.when(F.row_number().over(Window.orderBy(F.desc("key"))) == 1, 2.0).otherwise(F.col("high")))
        .select("key", "source_size", "weight", "target", "low", "high", "total")
    )


def schedule(spark: SparkSession, sources: DataFrame, slots: int) -> DataFrame:
    """(slot, point, key, rank) for slots 0, 1, ...: the source that a slot takes a block of, and its rank there from 0."""
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), SLOT_BITS, "0")), 2, 10).cast("double") / (1 << SLOT_BITS)
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS))
    last = F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))
    cells = sources.where("target > 0").select("key", "low", "high", F.explode(F.sequence(F.least(F.floor(F.col("low") * CELLS), last), last)).alias("cell"))
    found = points.join(cells, "cell").where("point >= low and point < high")
    return found.select("slot", "point", "key", (F.row_number().over(Window.partitionBy("key").orderBy("slot")) - 1).alias("rank"))


def placed(docs: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Documents with their places in their source's order, the sources, words of a block, number of slots."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = table(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
        .select("doc_id", "source", key.alias("key"), mark.alias("mark"), F.xxhash64("text").alias("tie"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size")),
        "sized",
    )
    # parts of the hash's range; rows without doc_id, which share one hash, are dealt by their text
    sized = sized.withColumn("part", F.when(F.col("doc_id").isNotNull(), F.substring("mark", 1, 3)).otherwise(F.concat(F.lit("z"), F.substring(F.md5(F.col("tie").cast("string")), 1, 3))))
    sources = table(sources_with_targets(sized, weights, most), "sources")
    total = sources.agg(F.max("total")).first()[0] or 0
    block = max(1, -(-total // (1 << SLOT_BITS)))
    # place of each document in its source's order: of parts of the hash's range first, then within a part
    parts = sized.groupBy("key", "part").agg(F.sum("size").alias("n"))
    at = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "part", F.coalesce(F.sum("n").over(at), F.lit(0)).alias("base")).join(sources.select("key", "source_size", "target"), "key")
    within = Window.partitionBy("key", "part").orderBy("mark", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(parts, ["key", "part"])
    return table(rows.withColumn("place", (F.col("base") + F.col("before")).cast("bigint")).drop("mark", "tie", "part", "before", "base"), "placed"), sources, block, -(-total // block)


def pieces(rows: DataFrame, slots: DataFrame, block: int, most: int) -> DataFrame:
    """(slot, key, place, first, words): the words that a slot takes of the document at ``place``, from its word ``first`` on."""
    start = F.col("place") + F.col("source_size") * F.col("turn")
    turns = rows.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("start", start.cast("bigint"))
    cut = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    low = F.greatest(F.col("start"), F.col("rank") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("rank") + 1) * block)
    return cut.select("key", "rank", "place", (low - F.col("start")).alias("first"), (high - low).alias("words")).join(slots.select("slot", "key", "rank"), ["key", "rank"]).drop("rank")


def scheduled(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mix itself: (slot, doc_id, source, first, words), the words of each document that each slot takes, in order of slot."""
    rows, sources, block, slots = placed(docs, weights, most)
    found = pieces(rows, schedule(docs.sparkSession, sources, slots), block, most)
    return found.join(rows.where("size > 0").select("key", "place", "doc_id", "source"), ["key", "place"]).select("slot", "doc_id", "source", "first", "words")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row for each document row: doc_id, source, size, source_size, target, taken, first_word (place in the source's order).

    A document's size is its number of words (null text: 0). Sources are ordered by code point, null last, and weighted in
    turn. ``taken`` counts the words that the mix takes of a document, at most ``most`` times its size: its pieces in the
    blocks of the schedule. Documents of a source are shuffled by a hash of doc_id, ties by size and text; rows without
    doc_id come last, in an order of their texts. Repeated rows have places of their own. An empty table gives no rows, a mix
    of empty texts takes nothing. Reruns agree.
    """
    rows, sources, block, slots = placed(docs, weights, most)
    got = pieces(rows, schedule(docs.sparkSession, sources, slots), block, most).groupBy("key", "place").agg(F.sum("words").alias("taken"))
    out = rows.where("size > 0").join(got, ["key", "place"], "left").union(rows.where("size = 0").withColumn("taken", F.lit(0)).select("key", "place", *(c for c in rows.columns if c not in ("key", "place")), "taken"))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.col("place").alias("first_word"))


def _reversed(bits: int) -> str:
    return " + ".join(f"(((k >> {i}) & 1) << {bits - 1 - i})" for i in range(bits))


#: DuckDB twin of ``mixed`` over a table named {docs}.
MIXED_SQL = f"""
with sized as (
  select doc_id, source, case when source is null then '1' else '0' || source end as key,
    case when doc_id is null then 'z' else md5(cast(doc_id as varchar)) end as mark, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
  from {{docs}}),
totals as (select key, sum(size)::bigint as source_size, [5, 2, 1][((row_number() over (order by key) - 1) % 3 + 1)::int] as weight from sized group by key),
limits as (
  select *, 3 * source_size as most, sum(source_size) over () as total,
    coalesce(sum(3 * source_size) over (order by source_size::double / weight, key rows between unbounded preceding and 1 preceding), 0) as used,
    sum(weight) over (order by source_size::double / weight, key rows between current row and unbounded following) as rest
  from totals),
fulls as (select *, most * rest < weight * (total - used) as filled from limits),
targets as (
  select *, case when filled then most::double else ((total - coalesce(sum(case when filled then most end) over (), 0)) * weight)::double
    / (sum(case when not filled then weight end) over ()) end as target from fulls),
cuts as (select *, sum(target) over (order by key) / nullif(total, 0) as high, row_number() over (order by key desc) as back from targets),
spans as (select *, coalesce(lag(high) over (order by key), 0) as low, case when back = 1 then 2.0 else high end as top from cuts),
size_of as (select greatest(1, ceil(sum(size) / {1 << SLOT_BITS}.0))::bigint as block, coalesce(sum(size), 0)::bigint as total from sized),
points as (select (({_reversed(SLOT_BITS)}) / {1 << SLOT_BITS}.0)::double as point from (select unnest(range(ceil(total / block::double)::bigint)) as k from size_of)),
slots as (select s.key, count(*) as n from spans s join points p on p.point >= s.low and p.point < s.top where s.target > 0 group by s.key),
whole as (select s.*, least(coalesce(n, 0) * (select block from size_of), 3 * source_size) as words from spans s left join slots using (key)),
placed as (
  select d.*, w.source_size, w.target, w.words,
    coalesce(sum(size) over (partition by d.key order by mark, size rows between unbounded preceding and 1 preceding), 0)::bigint as place
  from sized d join whole w using (key)),
cut as (select *, case when source_size = 0 then 0 else words // source_size end as rounds from placed)
"""
