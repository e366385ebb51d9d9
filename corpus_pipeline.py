"""A pipeline of five document operators, each reading what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from axisloom.llm.decontaminate import remove_contaminated
from axisloom.llm.mixing import mixed
from axisloom.llm.ngram_join import keep_one_per_group
from axisloom.llm.quality import keep_quality
from axisloom.llm.queries import table, tokenizer_path
from axisloom.llm.records import token_records
from axisloom.session import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs, whole=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_records(spark, docs, tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: no SQL: the stages' models and tokenizer have none
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):  # written and read again; the last one is the result
            docs, _ = stored(docs, f"stage-{name}")
    return docs
