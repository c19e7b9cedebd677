"""A corpus pipeline in five stages over ``documents``.

Each stage works on all that the one before it kept: language identification
(rejected documents go), near copies by word five-grams at a similarity of 0.8
(one document of each group stays), benchmark decontamination (contaminated
documents go), secrets (replaced in the text) and packing into sequences.

Defined cases, for every stage: rows with a null or empty text have no letters and
are rejected by the first stage, so no later one sees any unless it is called by
itself, and then keeps them; decisions hold for the rows of one id and text, so
rows that share an id, or have none, do not take one another along, but in
near_copies, where rows of one id are one document and those without an id stay;
repeated rows stay or go together; other columns stay, whatever their names; long
texts are read whole; an empty table has an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard, langid, packing, secrets
from tessera.llm.common import materialize, new_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted_documents(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.without_near_copies(spark, docs, words=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unnamed=True)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(spark, docs, ledger=new_path(spark, "ledger"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminate", benchmark),
    ("secrets", redact),
    ("pack", pack),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
