"""Helpers shared by the operators: shared tables, word ids, blobs and small numeric fits."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd 64-bit constants of the mixing steps (fixed values).
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)
MIX_C = np.uint64(0x165667B19E3779F9)

#: bytes.translate table that lower-cases A-Z only.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of the machine serves a local
    session; a cluster gets an error, as its executors couldn't read what the driver or others write there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "signalspark-shared")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what ``table`` wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session; buckets of blobs follow it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def remainder(column: str, modulus: int):
    """crc32 of a key's decimal text, modulo ``modulus`` (null for a null key)."""
    return F.crc32(F.col(column).cast("string")) % modulus


class WordIds(dict):
    """64-bit ids of words (bytes); the memo is emptied when it reaches ``limit`` entries."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(31))
    x = x * MIX_B
    return x ^ (x >> np.uint64(29))


def chain(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive ids (none if there are fewer)."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * MIX_A + ids[k : len(ids) - n + 1 + k])
    return mix(out)


def as_bytes(column) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def label_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: dict[int, int]) -> DataFrame:
    """Bounded sample of labelled training rows: (doc_id, text, label).

    Only rows whose crc32(doc_id) mod 3 is not 1 take part. ``per_class`` holds the largest expected number of rows of
    each label; rows are picked by a hash of the key. The picked keys are few (the bound), so they are broadcast and the
    texts are never shuffled. Null texts count as empty; a key labelled twice counts with its larger label.
    """
    rows = (
        labels.select(F.col("doc_id").alias("key"), F.col(target).cast("int").alias("label"))
        .where("key is not null and label is not null").where(F.crc32(F.col("key").cast("string")) % 3 != 1)
        .groupBy("key").agg(F.max("label").alias("label"))
    )
    found = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for value, most in per_class.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, most / max(1, found.get(value, 0))))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), F.col("doc_id") == F.col("key")).select("doc_id", "text", "label")


def rows_kept(docs: DataFrame, keep: bool) -> DataFrame:
    """(doc_id, text) of ``docs``, with the whole row as struct ``row`` if it is to be kept."""
    row = [F.struct("*").alias("row")] if keep else []
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)


def row_schema(docs: DataFrame, keep: bool) -> str:
    """Schema text of the struct ``row``, to follow other fields."""
    return f", row {docs.schema.simpleString()}" if keep else ""


def row_key(docs: DataFrame) -> list:
    """Columns k1 and k2 that, with doc_id, tell rows of different texts apart (96 bits of hash for rows without doc_id)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.hash(F.lit("row"), text).alias("k2")]


def _beside(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, object]:
    """``docs`` with its keys, ``rows`` (broadcast if they are few, by count) and the condition that joins them."""
    k1, k2 = row_key(docs)
    left = docs.withColumns({"_doc": F.col("doc_id").cast("bigint"), "_k1": k1, "_k2": k2})
    right = rows.select(F.col("doc_id").alias("gone"), F.col("k1").alias("gone_k1"), F.col("k2").alias("gone_k2"))
    right = F.broadcast(right) if rows.count() <= 1_000_000 else right
    return left, right, F.col("_doc").eqNullSafe(F.col("gone")) & (F.col("_k1") == F.col("gone_k1")) & (F.col("_k2") == F.col("gone_k2"))


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) isn't among ``rows`` (doc_id, k1, k2; distinct). A null doc_id is one like others."""
    left, right, same = _beside(docs, table(rows, "gone"))
    return left.join(right, same, "left_anti").select(*docs.columns)


def rows_among(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) is among ``rows``, with their keys as _doc, _k1 and _k2."""
    left, right, same = _beside(docs, rows)
    return left.join(right, same, "left_semi")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
