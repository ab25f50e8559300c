"""A corpus pipeline of five stages, each one operator of lumenspark.llm. Every stage's result is written and reread.

All stages but the last return the columns of their input. In each of them null texts, empty and very long texts, repeated
rows, empty tables and further columns, whatever their names, have the results that its operator's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspark.llm import op1_quality, op3_line_dedup, op6_decontaminate, op7_bpe, op10_simhash
from lumenspark.llm.queries import tokenizer
from lumenspark.plans import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject. Without labels of both classes all stay."""
    return op1_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of repeated line runs; a document may become empty. Null texts stay null."""
    return op3_line_dedup.dedup(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Texts without words, null ones included, are one group."""
    return op10_simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated by the benchmark. Texts without words stay."""
    return op6_decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; a null text counts as empty."""
    return op7_bpe.digest(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("simhash", simhash), ("decontaminate", decontaminate), ("bpe", bpe)]

#: The stages are a trained model, a suffix array, XXH64 fingerprints and a BPE: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the documents that stay.

    What a stage has written on its way is deleted when its result is stored; the last stage's input stays, as the result
    reads it. Tables of other work in the same driver aren't touched.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch.job(spark) as own:
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i + 1 < len(STAGES):
                docs = scratch.materialize(docs, name)
                own.release({docs._scratch})
    return docs
