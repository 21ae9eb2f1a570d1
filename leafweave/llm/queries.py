"""The subpackage's queries and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafweave.llm import collection_bwt, decontaminate, kd_shards, packing, pii, quality_rules, simhash, sql, suffix_trees, token_files, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op2_best_fit_packing": packing.packing_query,
        "op5_suffix_tree_dedup": suffix_trees.substring_query,
        "op6_collection_bwt_dedup": collection_bwt.suffix_array_query,
        "op9_simhash_bk_trees": simhash.simhash_query,
        "op10_distribution_divergence": quality_rules.quality_query,
        "op1_cgk_decontamination": decontaminate.decontaminate_query,
        "op3_weak_supervision_pii": pii.pii_query,
        "op7_warc_derivatives": warc.warc_query,
        "op8_kd_tree_shards": kd_shards.shard_query,
        "op4_token_files": token_files.token_file_query,
    }


def oracle_sql() -> dict[str, str]:
    """The others aren't expressible: edit distances, subword ids, fitted classifiers, files, trees of medians, XXH64."""
    return {"op5_suffix_tree_dedup": sql.substring_dedup(), "op6_collection_bwt_dedup": sql.suffix_array_dedup(), "op10_distribution_divergence": sql.quality()}
