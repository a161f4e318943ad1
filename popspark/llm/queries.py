"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard_join, line_dedup, mixing, passages, quality, sharding, token_counts, token_ids, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_latent_decontamination": decontaminate.op2_latent_decontamination,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_hash_tree_shards": sharding.op4_hash_tree_shards,
    "op5_robust_outliers": quality.op5_robust_outliers,
    "op6_token_ids": token_ids.op6_token_ids,
    "op7_pivotal_mix": mixing.op7_pivotal_mix,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_tiled_jaccard": jaccard_join.op9_tiled_jaccard,
    "op10_chained_passages": passages.op10_chained_passages,
}

ORACLE_SQL: dict[str, str] = {"op1_url_filter": url_filter.OP1_SQL}
