"""Corpus pipeline: toxic documents go, then exact and near copies, then sources
are mixed to their weights and the mixture is packed into sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all
rows the stage before it kept, and returns a DataFrame, which the caller writes
and reads again. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from crx.llm.exact_dedup import drop_exact_copies
from crx.llm.mixing import mix_documents
from crx.llm.ngram_join import drop_near_copies
from crx.llm.packing import pack_documents
from crx.llm.q_text import tokenizer_path
from crx.llm.toxicity import drop_toxic, train
from crx.plans.session import ensure_checkpoint_dir, ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon model doesn't reject."""
    ship_package(spark)
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the smallest id."""
    return drop_exact_copies(docs, keep="min")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.8 on five-word shingles, one."""
    ship_package(spark)
    return drop_near_copies(docs, threshold=0.8, k=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; documents of short sources come twice, the
    one at a source's cut with its words before the cut."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids."""
    ship_package(spark)
    return pack_documents(docs, tokenizer_path(), window=1024, end_id=0)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None  # a learned lexicon, LSH and subword tokens have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's rows written to the shared folder and
    reread by the next."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
