"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    crf_quality,
    itq,
    lexical,
    line_chunks,
    mixing,
    oracle,
    packing,
    pii,
    prefix_doubling,
    resample,
    sigtree,
    suffix_contam,
    toxicity,
    warc,
)
from .staging import documents, prepare

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(documents(prepare(spark), sf_dir, "pages"))


def op2_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.link(documents(prepare(spark), sf_dir, "embeddings"))


def op3_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.link(documents(prepare(spark), sf_dir))


def op4_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffix_contam.report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(prepare(spark), sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.report(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.report(documents(prepare(spark), sf_dir), passages=True)


def op8_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return crf_quality.report(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(prepare(spark), sf_dir))


def op10_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_doubling.report(documents(prepare(spark), sf_dir))


def op11_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.report(documents(prepare(spark), sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return resample.report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op13_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lexical.search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    from corpus_pipeline import run

    ops = [op1_warc, op2_itq, op3_signature_trees, op4_suffix_arrays, op5_mixing, op6_toxicity,
           op7_line_chunks, op8_crf_quality, op9_pii, op10_prefix_doubling,
           op11_sum_of_squares, op12_importance_resampling, op13_geometric_blocks]
    return {f.__name__: f for f in ops} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    tables = {t: t for t in TABLES}
    sql = {"op1_warc": warc.ORACLE, "op5_mixing": mixing.ORACLE, "op12_importance_resampling": resample.ORACLE,
           "op13_geometric_blocks": lexical.ORACLE, "op2_itq": oracle.EMBEDDINGS, "op3_signature_trees": oracle.JACCARD,
           "op4_suffix_arrays": oracle.CONTAMINATION, "op10_prefix_doubling": oracle.SUBSTRINGS}
    return {name: text.format(**tables) for name, text in sql.items()}
