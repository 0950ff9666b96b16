"""From raw documents to a training mix, in five stages.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of ``documents``.

Toxicity, near-duplicates and contamination are judged and applied row by row, never
by doc_id: a row without an id goes if its own text is flagged, and of rows that share
an id only the flagged ones go.  Of linked rows the one of the smallest id stays, of
rows equal in id and text one.  Rows without an id keep their lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_chunks, mixing, sigtree, suffix_contam, toxicity
from tidemark.llm.staging import documents, nested, prepare, staged, unnested


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    prepare(spark)
    rows = nested(docs, "doc_id", "text", apart=("text",))
    judged = toxicity.report(rows, documents(spark, sf_dir, "labels"), carry=("text", "_row"))
    return unnested(judged.where("toxic = 0"), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier document holds are taken out."""
    prepare(spark)
    return line_chunks.with_deduped_text(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    prepare(spark)
    return sigtree.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    prepare(spark)
    rows = nested(docs, "doc_id", "text", apart=("text",))
    found = suffix_contam.contamination(rows, documents(spark, sf_dir, "benchmark"), carry=("text", "_row"))
    return unnested(found.where("NOT contaminated"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per copy of the mix."""
    prepare(spark)
    return mixing.mix(docs)


STAGES = [("toxicity", clean), ("line dedup", dedup_lines), ("n-gram Jaccard join", dedup_near),
          ("benchmark decontamination", decontaminate), ("mixing", mix)]

#: classifiers, rolling hashes and similarity components are not SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
