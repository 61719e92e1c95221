"""Queries of the operators that read whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crx.llm.fingerprints import edit_report
from crx.llm.ngram_join import similarity_classes
from crx.llm.packing import pack_documents
from crx.llm.queries import query, table
from crx.llm.toxicity import score_documents, train
from crx.llm.warc import build_derivatives, responses_of_pages

TOKENIZER_FILE = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER_FILE)


@query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (similarity_classes(table(spark, sf_dir, "documents"), threshold=0.8, k=5)
            .select("doc_id", "class_id", "n_links", "n_copies"))


@query("op2_warc")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_derivatives(responses_of_pages(table(spark, sf_dir, "pages")))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(table(spark, sf_dir, "documents"))
