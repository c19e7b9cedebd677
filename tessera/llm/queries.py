"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import ann, decontaminate, extract, jaccard, langid, licenses, packing, secrets, suffix_dedup, warc
from tessera.llm.common import materialize, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_documents(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, _table(spark, sf_dir, "documents"))


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(spark, _table(spark, sf_dir, "pages"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(spark, _table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # first with the base rules; then the ledger holds those pairs, and only the added rules are scanned for
    docs, ledger = _table(spark, sf_dir, "documents"), new_path(spark, "ledger")
    secrets.scan_documents(spark, docs, rules=tuple(r for r in secrets.RULES if r.kind in secrets.BASE_KINDS), ledger=ledger)
    return secrets.digest(secrets.scan_documents(spark, docs, ledger=ledger))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find_licenses(spark, _table(spark, sf_dir, "documents")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.judge(spark, docs, _table(spark, sf_dir, "benchmark"), unnamed=True))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialize(spark, ann.build_index(spark, _table(spark, sf_dir, "embeddings")), "ann-index")
    return ann.nearest(spark, index, index.where("vec_id % 50 = 0"), 5)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.round_trip(spark, _table(spark, sf_dir, "pages")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_corpus(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_extract": op3_extract,
    "op4_jaccard": op4_jaccard,
    "op5_secrets": op5_secrets,
    "op6_licenses": op6_licenses,
    "op7_decontaminate": op7_decontaminate,
    "op8_nearest": op8_nearest,
    "op9_warc": op9_warc,
    "op10_language": op10_language,
}

#: SQL for those that it can express; the others have brute-force tests.
ORACLE_SQL: dict[str, str] = {"op4_jaccard": jaccard.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op9_warc": warc.ORACLE}
