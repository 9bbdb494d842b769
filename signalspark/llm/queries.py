"""Queries of the operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, exact, html_text, language_model, licences, middles, mixing, neighbours, quality, tokengroups, toxicity, url_filter


def _of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_of(spark, sf_dir, "embeddings"), every=50, k=5)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(_of(spark, sf_dir, "pages"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.lm_scores(_of(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_of(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_of(spark, sf_dir, "documents"), _of(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_of(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(_of(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokengroups.jaccard_components(_of(spark, sf_dir, "documents"), words=4, percent=85)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_of(spark, sf_dir, "documents"), _of(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(_of(spark, sf_dir, "documents"), _of(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middles.fill_in_middle(_of(spark, sf_dir, "documents"), digests=True)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_of(spark, sf_dir, "documents"))


def op13_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_copies(_of(spark, sf_dir, "documents"), digests=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_neighbours, op2_html_text, op3_language_model, op4_url_filter, op5_toxicity, op6_mixing, op7_licences, op8_jaccard_join, op9_quality, op10_decontamination, op11_fill_in_middle, op12_collocations, op13_exact_copies)
}

ORACLES: dict[str, str] = {
    "op6_mixing": mixing.MIXED_SQL.format(docs="documents")
    + "select doc_id, size, source_size, target, (rounds * size + greatest(0, least(place + size, words - rounds * source_size) - place))::bigint as taken from cut",
    "op11_fill_in_middle": middles.MIDDLES_SQL,
    "op12_collocations": collocations.COLLOCATIONS_SQL,
    "op13_exact_copies": exact.COPIES_SQL,
}
