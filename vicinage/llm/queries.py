"""Registered queries of the training-data operators: thin wrappers that apply
each operator to its whole table and derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm import sql
from vicinage.session import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinage.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinage.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinage.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents")).drop("matches")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinage.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinage.llm.syncmers import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinage.llm.voronoi import top_inner_products

    return top_inner_products(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinage.llm.toxicity import held_out, score, train

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinage.llm.common import fresh_path
    from vicinage.llm.warc import read_archives, write_archives

    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path).where("kind <> 'gap'")
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinage.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


#: Stands in for a secret that a deployment passes itself.
DEMO_KEY = b"not a secret"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinage.llm.pii import pseudonymise_documents

    return pseudonymise_documents(table(spark, sf_dir, "documents"), DEMO_KEY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_licenses": op3_licenses,
    "op4_neardup": op4_neardup,
    "op5_syncmers": op5_syncmers,
    "op6_topk": op6_topk,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_html": op9_html,
    "op10_pii": op10_pii,
}
ORACLE_SQL: dict[str, str] = {
    "op3_licenses": sql.license_sql(),
    "op4_neardup": sql.near_duplicate_sql(),
    "op6_topk": sql.TOPK_SQL,
    "op8_warc": sql.WARC_SQL,
}
