"""Corpus pipeline: language ID, exact dedup, near-dedup, substring dedup, best-fit packing.

Each stage reads what its predecessor kept, as a table; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesforge.llm import exact, langid, minhash, packing, passages
from seriesforge.llm.common import saved


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones stay; text without a letter or that no learned language
    explains goes; how much a text may cost is measured on labelled documents held out of the training."""
    out = langid.held_out()
    bounds = langid.foreign_bounds(docs, langid.train(docs, where=~out), where=out)
    return langid.keep_known(docs, langid.train(docs), bounds=bounds)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return minhash.drop_near(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents with nothing else go."""
    return passages.cut_passages(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("substring_dedup", passage_stage), ("packing", packing_stage)]
ORACLE_SQL = None       # the near-duplicate, passage and packing stages have no SQL; tests/llm compares them by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs)
    return docs
