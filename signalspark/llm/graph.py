"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table

#: Least number of edges that makes a node a hot one, and the share of all edges (one in so many) that does so too: about
#: 2 * HOT_NODES nodes at most are hot, whatever the size.
HOT, HOT_NODES = 1_000, 10_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def joined(rows: DataFrame, groups: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` with the columns of ``groups`` (key, n, ...; one row a key, n: its rows). Groups of more than ``most`` rows come
    by broadcast, so that no task gets all rows of a key; rows being counted, fewer than rows / ``most`` groups have as many."""
    hot = F.broadcast(groups.where(F.col("n") > most).drop("n"))
    return rows.join(hot, key).union(rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col("n") <= most).drop("n"), key))


def hot_bound(n: int) -> int:
    """Rows of a key beyond which it counts as hot, of ``n`` rows in all."""
    return max(HOT, n // HOT_NODES)


def _large(edges: DataFrame, most: int) -> DataFrame:
    both = _both(edges)
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return joined(both.where("b > a"), low, "a", most).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame, most: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = joined(down, low, "a", most).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def _counted(edges: DataFrame) -> tuple[int, int]:
    """Number of edges (a > b), and of nodes that keep them from being stars: those with two lower ends, or one that are a lower end, too."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return tuple(nodes.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count_if(F.expr("down > 1 or down = 1 and up = 1"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: bigint) that isn't its component's smallest node.

    Loops and repeated edges are ignored; an empty table gives no rows. Rounds end when every component is a star around its
    smallest node. Nothing is collected but one check row a round.
    """
    edges = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        n, open_nodes = _counted(edges)
        if not open_nodes:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        most = hot_bound(n)
        stars = table(_large(edges, most), "stars")
        new = table(_small(stars, most), "edges")
        drop(edges, stars)
        edges = new
