"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe_codec, collocations, decontaminate, html_wrapper, jaccard_join, lattice_lm, secret_scan, spelling, token_count, tool_calls, topk_search, toxicity, url_rules
from millrace.runtime import read, spread


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.op1_lattice_lm(spread(read(spark, sf_dir, "documents")), tokenizer_path("piece_bpe_32k.model"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op2_jaccard_join(spread(read(spark, sf_dir, "documents")))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.op3_topk(read(spark, sf_dir, "embeddings"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op4_decontaminate(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.op5_encode_decode(spread(read(spark, sf_dir, "documents")), tokenizer_path("byte_bpe_50k.tiktoken"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op6_secret_scan(spread(read(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.op7_token_counts(spread(read(spark, sf_dir, "documents")), tokenizer_path("byte_bpe_50k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.op8_html_extraction(spread(read(spark, sf_dir, "pages")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9_toxicity(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.op10_tool_calls(read(spark, sf_dir, "conversations"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.op11_collocations(spread(read(spark, sf_dir, "documents")))


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.op12_url_rules(read(spark, sf_dir, "pages"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op13_spelling_variants(spread(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_lm": op1_lattice_lm,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_topk_search": op3_topk_search,
    "op4_decontaminate": op4_decontaminate,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_counts": op7_token_counts,
    "op8_html_extraction": op8_html_extraction,
    "op9_toxicity": op9_toxicity,
    "op10_tool_calls": op10_tool_calls,
    "op11_collocations": op11_collocations,
    "op12_url_rules": op12_url_rules,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE: dict[str, str] = {
    "op3_topk_search": topk_search.ORACLE_SQL,
    "op10_tool_calls": tool_calls.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op12_url_rules": url_rules.ORACLE_SQL,
}
