"""Corpus pipeline: five stages from ``documents`` to token ids.

Each stage takes (spark, docs, sf_dir) and returns the rows for the next one.
The first four return the columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe_codec, decontaminate, jaccard_join, secret_scan, toxicity
from millrace.llm.queries import tokenizer_path
from millrace.runtime import cut, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of at least 0.5 go."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), toxicity.in_fold(F.col("doc_id"), 5, 0))
    column = "toxicity"
    while column in docs.columns:
        column += "_"
    return toxicity.score(docs, model, out_col=column).where(F.col(column) < 0.5).drop(column)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays (smallest id); linked
    are documents whose sets of five words have a similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, n=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item or more go."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by placeholders; no document goes."""
    ledger = secret_scan.scan(secret_scan.blobs(docs))
    out = secret_scan.redact(docs, ledger)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining texts."""
    return bpe_codec.encode_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken")).drop("n_chars")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", mask_secrets),
    ("byte_level_bpe", encode),
]

#: SQL expresses neither the trained classifier nor tiling and merging by rank; the tests run brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of a data folder; every
    stage's result is cut from its lineage."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
