"""From raw documents to a training mix: five stages, each one an operator of ``signalspark.llm`` on all that is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. In every stage
an empty table gives an empty one, other columns come along whatever their names, and rows are dropped only for what the
stage looks for; what it does with nulls, ties and repeated rows is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalspark.llm import decontaminate, mixing, quality, tokengroups, toxicity
from signalspark.llm.common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject (score below 0.7).

    Null and empty texts score as texts without words. Repeated rows are judged alike; rows without doc_id are judged, too.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity_scores(docs, labels, keep=True).where("predicted = 0").select("row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of 0.5 or more).

    Null and empty texts get the curve's value for even odds. Repeated rows are judged alike; rows without doc_id, too.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_scores(docs, labels, keep=True).where("predicted = 1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard similarity of 0.8 or more.

    The row of least doc_id stays; rows without doc_id come after all others, by hashes of their texts. A row that occurs
    again in doc_id and text stays once. Null and empty texts are nobody's copy: all of them stay.
    """
    return tokengroups.one_of_each(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, up to a tenth of its words edited.

    Rows are told apart by doc_id and text, so a clean row stays even if another one of its doc_id goes; rows without doc_id
    are judged by their texts. Null and empty texts stay.
    """
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the training mix takes of each document, and the document's place in its source's order.

    One row for each row: repeated ones have places of their own, null texts have no words, a null source is the last one.
    """
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Classifiers and edit matching can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
