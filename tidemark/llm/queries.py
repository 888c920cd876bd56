"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, langid, media, mixing, pieces, pii, quality, sharding, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_family": suffixes.op1_suffix_family,
    "op2_raked_mixture": mixing.op2_raked_mixture,
    "op2_marginals": mixing.op2_marginals,
    "op3_parity_join": jaccard.op3_parity_join,
    "op4_piece_codec": pieces.op4_piece_codec,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_language_filters": langid.op6_language_filters,
    "op7_toxicity_chain": toxicity.op7_toxicity_chain,
    "op8_media_columns": media.op8_media_columns,
    "op9_jump_shards": sharding.op9_jump_shards,
    "op10_feistel_pseudonyms": pii.op10_feistel_pseudonyms,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_family": suffixes.SQL,
    "op2_raked_mixture": mixing.SQL,
    "op2_marginals": mixing.MARGINALS_SQL,
    "op3_parity_join": jaccard.SQL,
    "op5_quality_rules": quality.SQL,
    "op9_jump_shards": sharding.SQL,
}
