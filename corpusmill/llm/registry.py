"""Queries of this package over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import audit, classlm, codes, jaccard, langid, mixing, secrets, sharding, suffixes, tiling, topk, toxicity, winnowing


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hypergeometric_shards": _over_documents(sharding.sharded_documents),
        "op2_toxicity_lexicon": lambda spark, sf_dir: toxicity.toxic_documents(_documents(spark, sf_dir), _table(spark, sf_dir, "labels")),
        "op3_jaccard_join": _over_documents(jaccard.joined_documents),
        "op4_secret_ledger": _over_documents(secrets.secret_documents),
        "op5_suffix_dedup": _over_documents(suffixes.deduplicated_documents),
        "op6_language_filters": _over_documents(langid.identified_documents),
        "op7_class_model": _over_documents(classlm.scored_documents),
        "op8_source_mixing": _over_documents(mixing.mixed_documents),
        "op9_string_tiling": lambda spark, sf_dir: tiling.contaminated_documents(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark")),
        "op10_winnowing": _over_documents(winnowing.fingerprints),
        "op11_bounded_search": lambda spark, sf_dir: topk.nearest_vectors(_table(spark, sf_dir, "embeddings")),
        "op12_filter_audit": lambda spark, sf_dir: audit.filter_audit(_documents(spark, sf_dir), _table(spark, sf_dir, "labels")),
        "op13_pivot_codes": lambda spark, sf_dir: codes.compressed(_table(spark, sf_dir, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_jaccard_join": jaccard.oracle(),
        "op4_secret_ledger": secrets.oracle(),
        "op5_suffix_dedup": suffixes.oracle(),
        "op8_source_mixing": mixing.oracle(),
        "op11_bounded_search": topk.oracle(),
        "op12_filter_audit": audit.oracle(),
        "op13_pivot_codes": codes.oracle(),
    }
