"""A training corpus in four stages, each written as Parquet and read again.

Documents that the quality rules reject go; of each group of near-duplicates the
one with the smallest doc_id stays; secrets in the text are masked; what is left
is packed into token sequences. All but the last stage return the columns of
their input (an n_chars column follows the masked text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formsift.llm.common import prepare, read_table, staged
from formsift.llm.neardup import keep_one
from formsift.llm.packing import packed_rows
from formsift.llm.quality import keep_good
from formsift.llm.secrets import mask_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packed_rows(docs, "byte_bpe_50k.json")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("packing", packing)]

#: XXH64 shingles, component search, merged automata and BPE are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
