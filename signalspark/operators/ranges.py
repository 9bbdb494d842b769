"""Running sums and row numbers over range partitions, so that no group or table is one task's work."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share. Where that is unset, a folder of the machine serves a local
    session; a cluster gets an error, as its executors couldn't read what the others write there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or "file://" + os.path.join(tempfile.gettempdir(), name)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession, "signalspark-checkpoints"))
    return df.checkpoint()


def cumulated(rows: DataFrame, keys: list[str], order: list, amount: str) -> DataFrame:
    """``rows`` with before and upto: the sums of ``amount`` over the rows of the same ``keys`` that come earlier in
    ``order``, without and with the row itself, and whole, that over all of them. ``order`` must tell rows apart.

    Rows are dealt to partitions by range and fixed there; each partition adds up its own, and what earlier partitions have
    of a group, one row a partition and group, is added to that.
    """
    placed = cut(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("_part", *keys).agg(F.sum(amount).alias("_sum"))
    by = Window.partitionBy(*keys)
    earlier = by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), F.sum("_sum").over(by).alias("whole"))
    same = placed["_part"] == sums["_part"]
    for k in keys:
        same = same & placed[k].eqNullSafe(sums[k])
    upto = F.col("_base") + F.sum(amount).over(within)
    out = placed.join(sums.drop(), same).select(placed["*"], "_base", "whole").withColumn("upto", upto)
    return out.withColumn("before", F.col("upto") - F.col(amount)).drop("_part", "_base")


def numbered(rows: DataFrame, order: list, name: str = "number") -> DataFrame:
    """``rows`` with their place in ``order``, from 0."""
    return cumulated(rows.withColumn("_one", F.lit(1).cast("bigint")), [], order, "_one").withColumn(name, F.col("before")).drop("_one", "upto", "before", "whole")
