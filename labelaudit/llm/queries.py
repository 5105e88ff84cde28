"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelaudit.llm import (
    op1_repeats,
    op2_multi_index,
    op3_packing,
    op4_classifier,
    op5_token_codes,
    op6_link_trust,
    op7_chunk_bpe,
    op8_warc,
    op9_rules,
    op10_simhash,
    op11_repair,
    op12_minhash,
    op13_search,
    oracles,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_chunk_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_chunk_bpe.encoding_digests(table(spark, sf_dir, "documents"))


def op5_token_codes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_token_codes.token_codes(table(spark, sf_dir, "documents"))


def op3_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_packing.pack_documents(table(spark, sf_dir, "documents"))


def op1_repeats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_repeats.removal_digests(table(spark, sf_dir, "documents"))


def op2_multi_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_multi_index.nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op4_classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_link_trust_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_link_trust.filter_urls(table(spark, sf_dir, "pages"))


def op8_warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_repair.repaired_conversations(table(spark, sf_dir, "conversations"))


def op12_minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_minhash.near_sets(table(spark, sf_dir, "documents"))


def op13_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top, beside the package

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_repeats": op1_repeats_query,
        "op2_multi_index": op2_multi_index_query,
        "op3_packing": op3_packing_query,
        "op4_classifier": op4_classifier_query,
        "op5_token_codes": op5_token_codes_query,
        "op6_link_trust": op6_link_trust_query,
        "op7_chunk_bpe": op7_chunk_bpe_query,
        "op8_warc": op8_warc_query,
        "op9_rules": op9_rules_query,
        "op10_simhash": op10_simhash_query,
        "op11_repair": op11_repair_query,
        "op12_minhash": op12_minhash_query,
        "op13_search": op13_search_query,
        "pipeline": pipeline_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_repair": oracles.OP11_REPAIR, "op12_minhash": oracles.OP12_MINHASH, "op13_search": oracles.OP13_SEARCH}
