"""The ten registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formsift.llm import chat, pages, quality, warc
from formsift.llm.common import prepare, read_table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(module: str, function: str, table: str, *args) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        run = getattr(importlib.import_module(f"formsift.llm.{module}"), function)
        return run(read_table(spark, sf_dir, table), *args)

    return query


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": _table("secrets", "secret_digests", "documents"),
    "op2_chat_formatting": _table("chat", "chat_digests", "conversations"),
    "op3_quality_rules": _table("quality", "quality_verdicts", "documents"),
    "op4_html_extraction": _table("pages", "main_texts", "pages"),
    "op5_token_files": _table("tokenfiles", "token_file_digests", "documents", "word_bpe_49k.json"),
    "op6_warc": _table("warc", "archive_digests", "pages"),
    "op7_simhash_near_dedup": _table("simhash", "near_duplicates", "documents"),
    "op8_packing": _table("packing", "packing_digests", "documents", "byte_bpe_50k.json"),
    "op9_winnowing": _table("winnow", "fingerprint_pairs", "documents"),
    "op10_bpe": _table("bpe", "roundtrip_digests", "documents", "word_bpe_49k.json"),
    "pipeline": _pipeline,
}

ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat.ORACLE,
    "op3_quality_rules": quality.ORACLE,
    "op4_html_extraction": pages.ORACLE,
    "op6_warc": warc.ORACLE,
}
